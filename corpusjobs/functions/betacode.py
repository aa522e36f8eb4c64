"""Greek in beta code and back, and the cleaning of word lists."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Beta code of letters and of combining marks.
LETTERS = dict(zip("αβγδεζηθικλμνξοπρστυφχψω", "abgdezhqiklmncoprstufxyw"))
MARKS = {"̓": ")", "̔": "(", "̈": "+", "́": "/", "̀": "\\", "͂": "=", "ͅ": "|"}
BACK = {v: k for k, v in LETTERS.items()}
MARKS_BACK = {v: k for k, v in MARKS.items()}
# Forms that a word list leaves out, by a pattern each.
LEFT_OUT = (r"^$", r"^\.\.\.$", "[G–⏔⏕⏑x]", "^[.,·;:()—†\"]", "-$")


def _encode(text: str) -> str:
    out = []
    for letter, marks in re.findall("([^̀-ͯ])([̀-ͯ]*)", unicodedata.normalize("NFD", text)):
        told = "".join(MARKS.get(m, m) for m in marks)
        low = "σ" if letter == "ς" else letter.lower()
        if low not in LETTERS:
            out.append(letter + told)
        else:
            out.append(f"*{told}{LETTERS[low]}" if letter != letter.lower() else LETTERS[low] + told)
    return "".join(out)


def _decode(text: str) -> str:
    """Marks may stand in any order; breathing and diaeresis come first, the iota subscript last."""
    out = []
    order = ")(+/\\=|"
    for star, early, letter, late, other in re.findall(r"(\*?)([()+/\\=|]*)([a-z])([()+/\\=|]*)|([\s\S])", text):
        if letter not in BACK:
            out.append(star + early + (letter or other) + late)
            continue
        marks = sorted(early + late if star else late, key=order.index)
        greek = BACK[letter].upper() if star else BACK[letter]
        out.append(("" if star else early) + greek + "".join(MARKS_BACK[m] for m in marks))
    said = unicodedata.normalize("NFD", "".join(out))
    return re.sub("σ(?![̀-ͯΑ-Ωα-ω’'])", "ς", said)


@F.pandas_udf(StringType())
def to_beta(text: pd.Series) -> pd.Series:
    """Beta code of Greek: capitals with '*' and their marks before the letter."""
    return text.map(_encode, na_action="ignore")


@F.pandas_udf(StringType())
def from_beta(text: pd.Series) -> pd.Series:
    """Greek of beta code, in NFD; a sigma at a word's end is final."""
    return text.map(_decode, na_action="ignore")


def regular(beta: Column) -> Column:
    """One form of apostrophes, graves as acutes, no second accent, no number of a final sigma."""
    beta = F.translate(beta, "’᾽\\", "''/")
    return F.replace(F.regexp_replace(beta, "([/=])(.*)/", "$1$2"), F.lit("s1'"), F.lit("s'"))


def word_list(forms: DataFrame, regularized: bool = True) -> DataFrame:
    """beta: the different forms (form) in beta code, without empty, metrical, broken and punctuation ones."""
    out = F.lit(False)
    for pattern in LEFT_OUT:
        out = out | F.col("form").rlike(pattern)
    beta = to_beta(F.col("form"))
    # patterns and code are for different forms only: a filter on a count isn't moved below it
    different = forms.groupBy("form").agg(F.count("*").alias("_n")).filter(F.when(F.col("_n") > 0, ~out))
    return different.select((regular(beta) if regularized else beta).alias("beta")).distinct()
