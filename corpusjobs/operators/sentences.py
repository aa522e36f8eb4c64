"""Sentences: rows of their own, breaks, running ids; and work on all tokens of a batch of sentences at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusjobs.operators.evaluation import running_sums

# Marks that end a sentence of raw text.
ENDS = {"greek": (".", ";", "·", "·"), "other": (".", "?", "!")}


def fields(tokens: DataFrame) -> list[str]:
    """The columns of tokens, flat ones or those of sentences (sent_id, s: tokens in the order of tok_idx)."""
    return tokens.schema["s"].dataType.elementType.names if "s" in tokens.columns else tokens.columns


def kinds(tokens: DataFrame) -> dict[str, str]:
    """Types by column, of flat tokens or of sentences."""
    own = dict(tokens.dtypes)
    return own | {f.name: f.dataType.simpleString() for f in tokens.schema["s"].dataType.elementType} if "s" in own else own


def grouped(tokens: DataFrame, *columns: str) -> DataFrame:
    """sent_id, s: a row a sentence with its tokens (tok_idx and columns) in order.

    Flat tokens meet by one exchange; sentences that already are rows (sent_id, s) stay where they are.
    """
    if "s" not in tokens.columns:
        return tokens.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("tok_idx", *columns))).alias("s"))
    if fields(tokens) == ["tok_idx", *columns]:
        return tokens.select("sent_id", "s")
    return tokens.select("sent_id", F.transform("s", lambda x: F.struct(*(x[c].alias(c) for c in ("tok_idx", *columns)))).alias("s"))


def with_default(tokens: DataFrame, column: str, value: Column) -> DataFrame:
    """tokens, flat or as sentences, with a column of one value if they lack it."""
    if column in fields(tokens):
        return tokens
    if "s" not in tokens.columns:
        return tokens.withColumn(column, value)
    return tokens.withColumn("s", F.transform("s", lambda x: F.struct(*(x[c].alias(c) for c in fields(tokens)), value.alias(column))))


def over_sentences(tokens: DataFrame, columns: list[str], work: Callable, schema: str) -> DataFrame:
    """Rows of work(sentence ids, sentence number of each token, columns as flat arrays), by one exchange, or none where
    tokens come as sentences (sent_id, s).

    Tokens are in the order of tok_idx; sentences come in batches, so work can be done on arrays.
    """
    rows = grouped(tokens, *columns)

    def run(batches):
        for batch in batches:
            s = batch.column(1)
            flat, size = s.flatten(), np.asarray(s.value_lengths())
            yield pa.RecordBatch.from_pydict(work(batch.column(0), np.repeat(np.arange(len(s)), size), {c: flat.field(i) for i, c in enumerate(["tok_idx", *columns])}))

    return rows.mapInArrow(run, schema)


def sentence_rows(tokens: DataFrame, *columns: str) -> DataFrame:
    """sent_id, n and, for each column, the array of its values in the order of tok_idx."""
    own = grouped(tokens, *columns)
    return own.select("sent_id", F.size("s").cast("long").alias("n"), *(F.col(f"s.{c}").alias(c) for c in columns))


def broken(texts: DataFrame, ends: tuple[str, ...] = ENDS["other"]) -> DataFrame:
    """doc_id, sent_no (from 0), forms: a row a sentence, which ends after an end mark.

    texts: doc_id, forms (array). A text is one row, so no exchange is needed.
    """
    ended = F.filter(F.transform("forms", lambda x, i: F.when(x.isin(*ends), i)), lambda x: x.isNotNull())
    rows = texts.select("doc_id", "forms", ended.alias("ended"))
    last = F.coalesce(F.expr("array_max(ended)"), F.lit(-1))
    cuts = F.when(last < F.size("forms") - 1, F.concat("ended", F.array(F.size("forms") - 1))).otherwise(F.col("ended"))
    rows = rows.select("doc_id", "forms", cuts.alias("cuts"))
    begun = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda x: x + 1))
    rows = rows.select("doc_id", "forms", F.posexplode(F.arrays_zip(F.slice(begun, 1, F.size("cuts")).alias("a"), F.col("cuts").alias("b"))).alias("sent_no", "c"))
    return rows.select("doc_id", F.col("sent_no").cast("long"), F.slice("forms", F.col("c.a") + 1, F.col("c.b") - F.col("c.a") + 1).alias("forms"))


def break_sentences(texts: DataFrame, ends: tuple[str, ...] = ENDS["other"]) -> DataFrame:
    """doc_id, sent_no (from 0), tok_idx (from 1 in each sentence), form: the tokens of broken()."""
    rows = broken(texts, ends).select("doc_id", "sent_no", F.posexplode("forms").alias("at", "form"))
    return rows.select("doc_id", "sent_no", (F.col("at") + 1).cast("long").alias("tok_idx"), "form")


def running_ids(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """sizes with first_id: the sum of size over all rows before, by order, over ranges that Spark samples."""
    return running_sums(sizes, order, size).withColumnRenamed(f"{size}_before", "first_id")


def breaks_of(rows: DataFrame, unit: str, key: str, *order: str) -> DataFrame:
    """rows with run, from 1 in each unit: it grows where key differs from the row before."""
    own = Window.partitionBy(unit).orderBy(*order)
    new = F.when(F.lag(key).over(own) == F.col(key), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(own)).drop("_new")


def too_long(sentences: DataFrame, n_tokens: Column, n_pieces: Column, most: int = 512, check_from: int = 128) -> DataFrame:
    """Sentences of check_from tokens or more whose pieces reach most."""
    return sentences.filter((n_tokens >= check_from) & (n_pieces >= most))


def window_of(tokens: DataFrame, reach: int = 5) -> DataFrame:
    """sent_id, tok_idx, context: each token with `reach` on either side, and '...' where the sentence goes on."""
    whole = Window.partitionBy("sent_id")
    own = whole.orderBy("tok_idx")
    near = F.array_join(F.collect_list("form").over(own.rowsBetween(-reach, reach)), " ")
    before, after = F.row_number().over(own) > reach + 1, F.row_number().over(own) + reach < F.count("*").over(whole)
    return tokens.select("sent_id", "tok_idx", F.concat(F.when(before, "... ").otherwise(""), near, F.when(after, " ...").otherwise("")).alias("context"))


def distinct_forms(tokens: DataFrame) -> DataFrame:
    """The different forms of tokens that aren't artificial."""
    return tokens.filter(~F.col("artificial")).select("form").distinct()


def in_corpus_order(rows: DataFrame, unit: str, place: str) -> DataFrame:
    return rows.orderBy(unit, place)


def with_task(*datasets: DataFrame) -> DataFrame:
    """The datasets one after the other, with the number of each as task_id."""
    out = None
    for k, one in enumerate(datasets):
        one = one.withColumn("task_id", F.lit(k).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def stored_corpus(words: DataFrame, strings: DataFrame, lemmas: DataFrame, heads: DataFrame, units: list, confirmed: DataFrame | None = None) -> DataFrame:
    """Words of the units, by unit and place, from a corpus kept in tables that are joined by key.

    words: word_id, sentence_id, unit_id, place, string_id; strings: string_id, form, lemma_id; lemmas: lemma_id,
    lemma; heads: word_id, head, relation; confirmed: sentence_id, degree, of which degree 2 counts.
    """
    own = words.filter(F.col("unit_id").isin(*units)).join(strings, "string_id").join(lemmas, "lemma_id").join(heads, "word_id")
    if confirmed is not None:
        own = own.join(confirmed.filter("degree = 2").select("sentence_id").distinct(), "sentence_id", "left_semi")
    return in_corpus_order(own.select("word_id", "sentence_id", "unit_id", "place", "form", "lemma", "head", "relation"), "unit_id", "place")
