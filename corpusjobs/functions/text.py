"""Column functions on tokens and texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Characters that the folding and splitting rules name.
APOSTROPHES = "᾽'ʼ´"
DASHES = "‑—"
QUOTES = "“”„‘«»ʽ\""
DOTS = ":··•˙"
SPLIT = ".,—\"·;;()‑“”„‘«»ʽ:·•˙（）†"
KEPT_COMPOSED = "ʹ·"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~·;·"


def normalize(text: Column, form: str) -> Column:
    """Unicode normal form; an unknown form leaves the text as it is."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        return text
    return F.pandas_udf(lambda s: s.str.normalize(form), "string")(text)


@F.pandas_udf(StringType())
def nfd_keeping(text: pd.Series) -> pd.Series:
    """NFD of every character but the numeral sign and the raised dot."""
    return text.map(lambda t: "".join(c if c in KEPT_COMPOSED else unicodedata.normalize("NFD", c) for c in t), na_action="ignore")


def fold_punctuation(text: Column) -> Column:
    """One form of apostrophes, dashes, quotes, raised dots, question marks and brackets."""
    text = F.translate(text, APOSTROPHES + DASHES, "’" * len(APOSTROPHES) + "—" * len(DASHES))
    text = F.replace(text, F.lit("--"), F.lit("—"))
    return F.translate(text, QUOTES + DOTS + ";（）", '"' * len(QUOTES) + "·" * len(DOTS) + ";()")


def fold_accents(text: Column) -> Column:
    """Of NFD text: graves become acutes; without graves, an acute after a first accent goes."""
    once = F.regexp_replace(text, "^([^́͂]*[́͂][^́͂]*)́", "$1")
    return F.when(F.contains(text, F.lit("̀")), F.translate(text, "̀", "́")).otherwise(once)


def full_rule(text: Column) -> Column:
    return fold_accents(nfd_keeping(fold_punctuation(text)))


def tokens(text: Column) -> Column:
    """Tokens of a text: punctuation stands alone, a double hyphen goes."""
    marks = "".join("\\" + c if ord(c) < 128 else c for c in SPLIT)
    text = F.regexp_replace(text, f"([{marks}])|--", " $1 ")
    text = F.regexp_replace(F.regexp_replace(text, "(?U)\\s+", " "), "^ | $", "")
    return F.split(text, " ")


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(normalize(text, "NFD"), "\\p{Mn}", "")


def vector_key(text: Column) -> Column:
    return F.lower(F.translate(strip_accents(text), "\u03c2", "\u03c3"))


def is_capital(form: Column) -> Column:
    return form.rlike("^\\p{IsUppercase}")


def is_punct(form: Column) -> Column:
    return form.isin(*PUNCTUATION, "")


def of_different(work: Callable, kind: pa.DataType) -> Callable:
    """A function of arrays that works once on each different value of a batch: tags repeat far more often than they differ."""

    def run(values: pa.Array) -> pa.Array:
        coded = values.dictionary_encode()
        told = pa.array([*map(work, coded.dictionary.to_pylist()), work(None)], kind)
        return told.take(coded.indices.fill_null(len(told) - 1))

    return run


def _parsed(feats: str | None) -> list[tuple[str, str]]:
    pairs = [p.split("=", 1) for p in (feats or "").split("|") if "=" in p]
    return list({k: v for k, v in reversed(pairs)}.items())[::-1]


@F.arrow_udf(ArrayType(StructType([StructField("key", StringType()), StructField("value", StringType())])))
def _entries(feats: pa.Array) -> pa.Array:
    return of_different(lambda x: [{"key": k, "value": v} for k, v in _parsed(x)], pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))(feats)


def feats_map(feats: Column) -> Column:
    """Map of 'A=b|C=d', the first value of a name winning; '_' and null are empty."""
    return F.map_from_entries(_entries(feats))


@F.arrow_udf(StringType())
def feats_ordered(feats: pa.Array) -> pa.Array:
    """feats_string(feats_map(feats)), without a map between."""
    return of_different(lambda x: "|".join(sorted(f"{k}={v}" for k, v in _parsed(x) if v != "_")) or "_", pa.string())(feats)


def feature(feats: Column, name: str) -> Column:
    """The value of a name in 'A=b|C=d', '_' if there is none."""

    @F.arrow_udf(StringType())
    def value(feats: pa.Array) -> pa.Array:
        return of_different(lambda x: dict(_parsed(x)).get(name, "_"), pa.string())(feats)

    return value(feats)


def feats_string(feats: Column) -> Column:
    """'A=b|C=d' of the values that aren't '_', by name; '_' if none is."""
    kept = F.sort_array(F.transform(F.filter(F.map_entries(feats), lambda e: e["value"] != "_"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(F.size(kept) == 0, "_").otherwise(F.concat_ws("|", kept))


def context_label(lemma: Column, relation: Column, prefix: Column, direction: bool = True, relations: bool = False, conjunct: str = "CO") -> Column:
    """lemma, prefix_lemma or prefix_relation_lemma; a conjunct's prefix is Cd."""
    if not direction:
        return lemma
    prefix = F.when(relation == conjunct, "Cd").otherwise(prefix)
    return F.concat_ws("_", prefix, *([relation] if relations else []), lemma)


def softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors, null where one is a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def sentence_text(forms: Column, at: Column | None = None) -> Column:
    """The sentence; with at (1-based) the token there stands in brackets."""
    if at is None:
        return F.concat_ws(" ", forms)
    return F.concat_ws(" ", F.transform(forms, lambda x, i: F.when(i + 1 == at, F.concat(F.lit("["), x, F.lit("]"))).otherwise(x)))


# Which part of speech stands for several words, lower ones first.
POS_ORDER = {"VERB": 1, "PROPN": 2, "NOUN": 3, "INTJ": 3, "PRON": 4, "PTCP": 5, "ADJ": 5, "NUM": 5, "ADV": 6, "ADP": 7, "SCONJ": 7, "DET": 8, "CCONJ": 8, "X": 8, "PART": 8, "PUNCT": 8, "SYM": 8, "AUX": 8}


def multiword_pos(tags: Column) -> Column:
    """Of an array of parts of speech the one that stands for all, the first of equals; '' where none is known."""
    order = F.create_map(*(F.lit(x) for pair in POS_ORDER.items() for x in pair))
    ranked = F.transform(tags, lambda t, i: F.struct(F.coalesce(F.element_at(order, t), F.lit(1000)).alias("r"), i.alias("i"), t.alias("t")))
    best = F.array_min(ranked)
    return F.when(best["r"] < 1000, best["t"]).otherwise("")


def feature_key(pos: Column, feats: Column) -> Column:
    """pos_feats, or what there is of both."""
    return F.when(pos.isNotNull() & feats.isNotNull(), F.concat_ws("_", pos, feats)).otherwise(pos)


def mean_of(vectors: Column) -> Column:
    """The mean of an array of vectors."""
    total = sum_of(vectors)
    return F.transform(total, lambda x: x / F.size(vectors))


def sum_of(vectors: Column) -> Column:
    """The sum of an array of vectors (layers), number by number."""
    first = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    return F.aggregate(vectors, first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))


def concat_of(vectors: Column) -> Column:
    """Layers one after the other."""
    return F.flatten(vectors)


def rounded(vector: Column, places: int) -> Column:
    return F.transform(vector, lambda x: F.round(x, places))
