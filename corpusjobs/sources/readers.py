"""Readers and writers of annotated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusjobs.functions.text import feats_map, feats_string, full_rule, normalize, tokens
from corpusjobs.operators.sentences import ENDS, break_sentences
from corpusjobs.sources import blocks

CONLLU = {"ID": 0, "FORM": 1, "LEMMA": 2, "UPOS": 3, "XPOS": 4, "FEATS": 5, "HEAD": 6, "DEPREL": 7, "DEPS": 8, "MISC": 9}
PRESETS = {"CONLLU": CONLLU, "simple": {"ID": 0, "FORM": 1, "MISC": 2}, "simple_tagger": {"ID": 0, "FORM": 1, "UPOS": 2, "XPOS": 3, "FEATS": 4}}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, over all files in their order), value: each partition's lines are counted, then their offsets added."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_id"), "value").withColumn("_part", F.shiftright("_id", 33))
    sizes = lines.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    return lines.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("line_no"), "value")


def sentences(spark: SparkSession, path: str, split_bytes: int = blocks.SPLIT_BYTES) -> DataFrame:
    """One row per block of lines: file, sent_id (ascending in the files' order) and its lines, whatever each file's line ends."""
    blocks.register(spark)
    return spark.read.format("blocks").option("splitBytes", split_bytes).load(path)


def _last_of_each(pairs: Column) -> Column:
    """A map of (key, value) pairs in which the last of a key counts."""
    pairs = pairs.cast("array<struct<key: string, value: string>>")
    later = lambda i: F.slice(pairs, i + 2, F.size(pairs))
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(later(i), lambda q: q["key"] == p["key"])))


def read_conll(spark: SparkSession, path: str, columns: str | dict[str, int] = "CONLLU") -> DataFrame:
    """Tokens of CoNLL files by preset or by column places; only CoNLL-U has comments."""
    places = PRESETS[columns] if isinstance(columns, str) else columns
    rows = sentences(spark, path)
    if columns == "CONLLU":
        rows = rows.withColumn("lines", F.filter("lines", lambda x: ~x.startswith("#")))
    rows = rows.select("sent_id", F.posexplode("lines").alias("at", "line")).withColumn("cells", F.split("line", "\t"))
    out = rows.select("sent_id", (F.col("at") + 1).alias("tok_idx"), *(F.get("cells", F.lit(k)).alias(n.lower()) for n, k in places.items()))
    if "FEATS" not in places:
        return out
    several = lambda _, v: F.array_join(F.sort_array(F.split(v, ",")), ",")
    return out.withColumn("feats", F.transform_values(feats_map(F.col("feats")), several))


def read_treebank(spark: SparkSession, path: str) -> DataFrame:
    """Tokens with their sentence's attributes (comment lines 'key = value') and the artificial flag."""
    rows = sentences(spark, path)
    told = F.filter("lines", lambda x: x.startswith("#") & F.contains(x, F.lit("=")) & ~x.startswith("# text") & ~x.startswith("# file"))
    pairs = F.transform(told, lambda x: F.struct(F.trim(F.substring_index(F.substr(x, F.lit(2)), "=", 1)).alias("key"), F.trim(F.substr(x, F.instr(x, F.lit("=")) + 1)).alias("value")))
    rows = rows.select("sent_id", _last_of_each(pairs).alias("attributes"), F.posexplode(F.filter("lines", lambda x: ~x.startswith("#"))).alias("at", "line")).withColumn("cells", F.split("line", "\t"))
    cells = {n: F.get("cells", F.lit(k)) for k, n in enumerate(["id", "form", "lemma", "upos", "xpos", "feats", "head", "relation", "deps", "misc"])}
    pos = F.when(cells["upos"] != "_", cells["upos"]).otherwise(cells["xpos"])
    return rows.select("sent_id", "attributes", (F.col("at") + 1).alias("tok_idx"), *(c.alias(n) for n, c in cells.items() if n != "feats"), feats_map(cells["feats"]).alias("feats"), pos.alias("pos"), ((cells["form"] == "E") | (cells["lemma"] == "E")).alias("artificial"))


def read_treebank_xml(spark: SparkSession, path: str) -> DataFrame:
    """Words of treebank XML that have a head."""
    word = "_id string, _form string, _lemma string, _postag string, _head string, _relation string, _artificial string"
    rows = spark.read.format("xml").option("rowTag", "sentence").schema(f"_id string, word array<struct<{word.replace(' string', ': string')}>>").load(path)
    rows = rows.select(F.col("_id").alias("sentence_id"), F.posexplode("word").alias("at", "w")).filter("w._head is not null")
    return rows.select("sentence_id", (F.col("at") + 1).alias("tok_idx"), *(F.col(f"w._{n}").alias(n) for n in ("id", "form", "lemma", "postag", "head", "relation")), F.col("w._artificial").isNotNull().alias("artificial"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, quote="")


def _normal(column: Column, rule: str | None) -> Column:
    """A normal form, or 'greek': all folding rules; none leaves the text as it is."""
    return full_rule(column) if rule == "greek" else normalize(column, rule) if rule else column


def read_tag_lexicon(spark: SparkSession, path: str, normalization: str | None = None) -> DataFrame:
    """Different rows of form, normalised, and feature columns."""
    rows = read_tsv(spark, path)
    return rows.select(_normal(F.col("form"), normalization).alias("form"), *(F.coalesce(F.col(c), F.lit("_")).alias(c) for c in rows.columns if c != "form")).distinct()


def read_possible_tags(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """Tags in the order of the features, '_' where the file has none of them."""
    rows = read_tsv(spark, path)
    return rows.select(*(F.coalesce(F.col(f), F.lit("_")).alias(f) if f in rows.columns else F.lit("_").alias(f) for f in features))


def read_class_table(spark: SparkSession, path: str, columns: list[str] = (), normalization: str | None = None) -> DataFrame:
    """A table with header for classifiers, some of its columns normalised."""
    rows = read_tsv(spark, path)
    return rows.select(*(_normal(F.col(c), normalization).alias(c) if c in columns else c for c in rows.columns))


def read_raw(spark: SparkSession, path: str, greek: bool = False) -> DataFrame:
    """doc_id, sent_no, tok_idx, form of raw text, a document a line."""
    texts = numbered_lines(spark, path).filter(F.trim("value") != "").select(F.col("line_no").alias("doc_id"), tokens(F.col("value")).alias("forms"))
    return break_sentences(texts, ENDS["greek" if greek else "other"])


def read_lemma_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Key columns (all but lemma) and the set of lemmas."""
    rows = read_tsv(spark, path)
    return rows.groupBy(*(c for c in rows.columns if c != "lemma")).agg(F.array_sort(F.collect_set("lemma")).alias("lemmas"))


def read_vectors(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    cells = F.split("value", "\t")
    rows = spark.read.text(path).select(cells.alias("c"))
    if header:
        rows = rows.filter(F.expr("try_cast(c[1] as float)").isNotNull())
    return rows.select(F.col("c")[0].alias("key"), F.slice("c", 2, F.size("c") - 1).cast("array<float>").alias("vector"))


def read_gazetteer(spark: SparkSession, path: str, class_name: str | None = None) -> DataFrame:
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    return rows.select(F.col("c")[0].alias("key"), *([F.get("c", F.lit(1)).alias(class_name)] if class_name else [])).distinct()


def read_parallel(spark: SparkSession, path: str, lemmas: str | None = None, tags: str | None = None) -> DataFrame:
    """sent_no (the line, from 0), src and tgt tokens, the gold map of source to target indices, and side files' arrays.

    Rows without gold are dropped, but count in sent_no; side files have a line a sentence, attached by number, and
    what they have too much is left out.
    """
    cells = F.split("value", "\t")
    rows = numbered_lines(spark, path).select(F.col("line_no").alias("sent_no"), cells.alias("c")).filter("size(c) > 2 and c[2] <> ''")
    gold = F.from_json(F.regexp_replace(F.col("c")[2], "(\\d+)\\s*:", '"$1":'), "map<string,array<int>>")
    out = rows.select("sent_no", F.split(F.col("c")[0], " ").alias("src"), F.split(F.col("c")[1], " ").alias("tgt"), F.transform_keys(gold, lambda k, _: k.cast("int")).alias("gold"))
    for name, side in (("lemmas", lemmas), ("tags", tags)):
        if side:
            own = numbered_lines(spark, side).select(F.col("line_no").alias("sent_no"), F.split("value", " ").alias(name))
            out = out.join(own, "sent_no", "left")
    return out


def read_translations(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """src_lemma, tgt pairs of 'a|b' cells (sources in NFD), or of 'a=3|b=1' cells when weighted (sources in NFC)."""
    rows = spark.read.csv(path, sep="\t", quote="").toDF("src_lemma", "cell").withColumn("src_lemma", normalize(F.col("src_lemma"), "NFC" if weighted else "NFD"))
    one = rows.select("src_lemma", F.explode(F.split("cell", "\\|")).alias("tgt"))
    if weighted:
        return one.withColumn("tgt", F.substring_index("tgt", "=", 1))
    return one.withColumn("tgt", F.replace(F.lower("tgt"), F.lit(" "), F.lit("_"))).distinct()


def conllu_lines(rows: DataFrame) -> DataFrame:
    """sent_id, block: the CoNLL-U lines of each sentence, from flat tokens with a feats map, or from sentences (sent_id, s)."""

    def line_of(names, column):
        cell = lambda n: F.coalesce(column(n).cast("string"), F.lit("_")) if n in names else F.lit("_")
        return F.concat_ws("\t", column("tok_idx").cast("string"), cell("form"), cell("lemma"), cell("upos"), cell("xpos"), feats_string(column("feats")), cell("head"), cell("deprel"), cell("deps"), cell("misc"))

    if "s" in rows.columns:
        names = rows.schema["s"].dataType.elementType.names
        return rows.select("sent_id", F.concat_ws("\n", F.transform("s", lambda x: line_of(names, lambda c: x[c]))).alias("block"))
    line = line_of(rows.columns, F.col)
    parts = F.sort_array(F.collect_list(F.struct("tok_idx", line.alias("line"))))
    return rows.groupBy("sent_id").agg(F.concat_ws("\n", F.transform(parts, lambda x: x["line"])).alias("block"))


def write_conllu(rows: DataFrame, path: str) -> None:
    conllu_lines(rows).orderBy("sent_id").select("block").write.option("lineSep", "\n\n").text(path)


def read_corpus_jdbc(spark: SparkSession, url: str, tables: dict[str, str], texts: list[int], column: str = "unit_id", parts: int = 8, properties: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables of a relational corpus, each with the rows of the texts wanted alone: the list of texts is part of what
    the database is asked, cut into `parts` questions that are read apart.

    tables: for each name the table, or for one that has no such column a query in brackets that has.
    """
    wanted = sorted(set(map(int, texts)))
    size = max(1, -(-len(wanted) // parts))
    asked = [f"{column} in ({', '.join(map(str, wanted[lo : lo + size]))})" for lo in range(0, len(wanted), size)] or ["1 = 0"]
    return {name: spark.read.jdbc(url, table, predicates=asked, properties=properties or {}) for name, table in tables.items()}
