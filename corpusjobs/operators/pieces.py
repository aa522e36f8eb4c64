"""Word pieces, joined phrases and conjunct chains, per sentence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusjobs.operators import association
from corpusjobs.operators.sentences import over_sentences
from corpusjobs.operators.treebank import first_conjuncts, heads_of


def mark(pieces: DataFrame) -> DataFrame:
    """pieces (sent_id, piece_idx, word_idx; null at special pieces) with word_no, first_piece and last_piece.

    word_no counts words from 0 and is null at special pieces; a word begins where word_idx changes. pieces may also be
    sentences (sent_id, s: tok_idx, which is the piece's place, and word_idx in order; more columns ride along): then s has
    piece_idx, word_no, first_piece and last_piece, and nothing is exchanged.
    """
    if "s" in pieces.columns:
        return _marked(pieces)
    own = Window.partitionBy("sent_id").orderBy("piece_idx")
    known = F.last("word_idx", True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    here = F.col("word_idx").isNotNull()
    rows = pieces.withColumn("new", (here & ~F.coalesce(known == F.col("word_idx"), F.lit(False))).cast("long"))
    differs = lambda other: here & ~F.coalesce(other == F.col("word_idx"), F.lit(False))
    rows = rows.withColumn("word_no", F.when(here, F.sum("new").over(own) - 1))
    return rows.withColumn("first_piece", differs(F.lag("word_idx").over(own))).withColumn("last_piece", differs(F.lead("word_idx").over(own))).drop("new")


def label(marked: DataFrame, labels: DataFrame | str, ids: dict[str, int], last: bool = True, ignored: str | None = None) -> DataFrame:
    """marked with label_id; labels: sent_id, word_no, label. Unknown labels are 0, ignored and other pieces -100.

    Of marked sentences labels is a column with the array of their words' labels; rows of pieces come out, and nothing is
    exchanged.
    """
    if "s" in marked.columns:
        return _labelled(marked, labels, ids, "last_piece" if last else "first_piece", ignored)
    own = Window.partitionBy("sent_id").orderBy("piece_idx")
    chosen = F.col("last_piece" if last else "first_piece")
    rows = marked.withColumn("at", F.when(chosen, F.sum(chosen.cast("long")).over(own) - 1))
    rows = rows.join(labels.select("sent_id", F.col("word_no").alias("at"), "label"), ["sent_id", "at"], "left")
    known = F.create_map(*(F.lit(x) for p in ids.items() for x in p))
    left_out = F.col("label").isNull() | (F.col("label").eqNullSafe(F.lit(ignored)))
    return rows.withColumn("label_id", F.when(left_out, -100).otherwise(F.coalesce(F.element_at(known, F.col("label")), F.lit(0)))).drop("at", "label")


PIECE = "array<struct<piece_idx: long, word_no: long, first_piece: boolean, last_piece: boolean>>"


def _marked(sentences: DataFrame) -> DataFrame:
    others = [c for c in sentences.columns if c not in ("sent_id", "s")]
    kinds = dict(sentences.dtypes)

    def run(batches):
        for batch in batches:
            s = batch.column(1)
            size = np.asarray(s.value_lengths().fill_null(0)).astype(np.int64)
            flat, sent = s.flatten(), np.repeat(np.arange(len(s)), size)
            here, word = np.asarray(flat.field(1).is_valid()), np.asarray(flat.field(1).fill_null(0))
            at = np.flatnonzero(here)  # pieces of words: a word begins where the last one known differs
            new = np.zeros(len(here), bool)
            new[at] = np.append(True, (word[at][1:] != word[at][:-1]) | (sent[at][1:] != sent[at][:-1])) if len(at) else False
            before = np.append(0, np.cumsum(new))
            number = np.cumsum(new) - 1 - before[(np.cumsum(size) - size)[sent]]
            joined = np.append(False, (sent[1:] == sent[:-1]) & here[1:] & here[:-1] & (word[1:] == word[:-1]))[: len(here)]
            rows = pa.StructArray.from_arrays([flat.field(0).cast(pa.int64()), pa.array(number, mask=~here), pa.array(here & ~joined), pa.array(here & ~np.append(joined, False)[1:])], ["piece_idx", "word_no", "first_piece", "last_piece"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), rows), *batch.columns[2:]], ["sent_id", "s", *others])

    return sentences.select("sent_id", "s", *others).mapInArrow(run, f"sent_id {kinds['sent_id']}, s {PIECE}" + "".join(f", `{c}` {kinds[c]}" for c in others))


def _labelled(marked: DataFrame, labels: str, ids: dict[str, int], chosen: str, ignored: str | None) -> DataFrame:
    names = ["piece_idx", "word_no", "first_piece", "last_piece"]

    def run(batches):
        for batch in batches:
            s, told = batch.column(1), batch.column(2)
            size, words = (np.asarray(x.value_lengths().fill_null(0)).astype(np.int64) for x in (s, told))
            flat, sent, told = s.flatten(), np.repeat(np.arange(len(s)), size), told.flatten().dictionary_encode()
            known = np.array([-100 if x == ignored else ids.get(x, 0) for x in told.dictionary.to_pylist()] + [-100])
            known = known[np.asarray(told.indices.fill_null(len(told.dictionary)))]
            own = np.asarray(flat.field(chosen))
            upto = np.append(0, np.cumsum(own))
            at = upto[1:] - 1 - upto[(np.cumsum(size) - size)[sent]]
            there = np.flatnonzero(own & (at < words[sent]))
            out = np.full(len(own), -100, np.int32)
            out[there] = known[(np.cumsum(words) - words)[sent[there]] + at[there]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(sent)), *(flat.field(n) for n in names), pa.array(out)], ["sent_id", *names, "label_id"])

    return marked.select("sent_id", "s", labels).mapInArrow(run, f"sent_id {dict(marked.dtypes)['sent_id']}, piece_idx long, word_no long, first_piece boolean, last_piece boolean, label_id int")


def join_phrases(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """sent_id, tok_idx, phrase: pairs of neighbours that are phrases (a, b), taken greedily from the left.

    In a run of overlapping pairs every second one is taken, beginning with the first. tokens: sent_id, tok_idx, lemma, or
    sentences (sent_id, s: tok_idx and lemma in order), whose pairs need no exchange by sentence and meet phrases by a
    64-bit hash.
    """
    if "s" in tokens.columns:
        pairs = association.neighbours(tokens).filter("a is not null").select("sent_id", "tok_idx", (F.col("tok_idx") - F.col("place")).alias("gap"), F.xxhash64("a", "b").alias("h"))  # the gap is mostly 0
        hits = pairs.join(phrases.select("a", "b").distinct().select(F.xxhash64("a", "b").alias("h"), "a", "b"), "h")
        return _every_second(hits.withColumn("place", F.col("tok_idx") - F.col("gap")))
    own = Window.partitionBy("sent_id").orderBy("tok_idx")
    pairs = tokens.select("sent_id", "tok_idx", F.col("lemma").alias("a"), F.lead("lemma").over(own).alias("b"), F.row_number().over(own).alias("place"))
    hits = pairs.filter("b is not null").join(phrases.select("a", "b").distinct(), ["a", "b"])
    return _every_second(hits)


def _every_second(hits: DataFrame) -> DataFrame:
    runs = hits.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy("sent_id").orderBy("tok_idx")))
    rank = F.row_number().over(Window.partitionBy("sent_id", "run").orderBy("tok_idx"))
    return runs.withColumn("rank", rank).filter("rank % 2 = 1").select("sent_id", "tok_idx", F.concat_ws("_", "a", "b").alias("phrase"))


def conjunct_heads(tokens: DataFrame, conjunct: str = "CO") -> DataFrame:
    """sent_id, tok_idx, first_conjunct, coordination_head: the nearest head that is no conjunct, and its head.

    Both are null where there is none.
    """

    def work(ids, sent, c):
        head = heads_of(sent, np.asarray(c["tok_idx"]), np.asarray(c["head_id"].fill_null(0)))
        first = first_conjuncts(head, np.asarray(pc.equal(c["relation"].fill_null(""), conjunct)))
        at = lambda x: c["tok_idx"].take(pa.array(x, mask=x < 0))
        return {"sent_id": ids.take(pa.array(sent)), "tok_idx": c["tok_idx"], "first_conjunct": at(first), "coordination_head": at(np.where(first < 0, -1, head[first]))}

    return over_sentences(tokens, ["head_id", "relation"], work, "sent_id long, tok_idx long, first_conjunct long, coordination_head long")
