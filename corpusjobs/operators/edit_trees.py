"""Edit trees from forms to lemmas: built per different pair, counted, and applied as joins and regular expressions.

Below the root every span of a tree has a fixed length, so a tree is a pattern with one open middle: literal
inputs to replace, kept runs of known length, and `(.+)` where the root matches. It is applied on the JVM.
"""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that may be broadcast.
MOST_RULES = 20_000
TREE = "tree string, pattern string, replacement string, key string"


def _common(form: str, lemma: str) -> list[tuple[int, int, int]]:
    """Start in form, start in lemma and length of all longest common substrings, in order of place."""
    # most lemmas are nearly their forms, so long substrings are asked for first
    for n in range(min(len(form), len(lemma)), 0, -1):
        places: dict[str, list[int]] = {}
        for j in range(len(lemma) - n + 1):
            places.setdefault(lemma[j : j + n], []).append(j)
        found = [(i, j, n) for i in range(len(form) - n + 1) for j in places.get(form[i : i + n], ())]
        if found:
            return found
    return []


@cache
def _best(form: str, lemma: str, depth: int = -1) -> tuple[int, tuple]:
    """Replaced characters and the cheapest tree: ('r', input, output) or ('m', left length, left, right length, right).

    At depth 0 what is left is replaced whole; a negative depth has no limit.
    """
    options = []
    for i, j, n in _common(form, lemma) if depth else []:
        sides = [_best(a, b, depth - 1) if a or b else (0, None) for a, b in ((form[:i], lemma[:j]), (form[i + n :], lemma[j + n :]))]
        options.append((sides[0][0] + sides[1][0], ("m", i, sides[0][1], len(form) - i - n, sides[1][1])))
    return min(options, key=lambda o: o[0]) if options else (len(form) + len(lemma), ("r", form, lemma))


def _printed(tree: tuple) -> str:
    if tree[0] == "r":
        return f"r({tree[1]}, {tree[2]})"
    _, left_length, left, right_length, right = tree
    start = f"{left_length}{_printed(left)} " if left else ""
    return "(" + start + (f" {right_length}{_printed(right)}" if right else "") + ")"


def _segments(tree: tuple | None, length: int | None) -> list:
    """In order: (input, output) to replace, a length to keep, None for the open middle."""
    if tree is None:
        return []
    if tree[0] == "r":
        return [tree[1:]]
    _, left_length, left, right_length, right = tree
    middle = None if length is None else length - left_length - right_length
    return [*_segments(left, left_length), middle, *_segments(right, right_length)]


def _rule(form: str, lemma: str, depth: int) -> tuple[str, str, str, str]:
    if form == lemma and form and depth:
        return _written(("m", 0, None, 0, None))
    return _written(_best(form, lemma, depth)[1])


@cache
def _written(tree: tuple) -> tuple[str, str, str, str]:
    """The printed tree, its pattern, replacement and key; trees are far fewer than pairs."""
    segments = _segments(tree, None)
    pattern, replacement, group = "(?s)^", "", 0
    for s in segments:
        if isinstance(s, tuple):
            pattern += re.escape(s[0])
            replacement += re.sub(r"([\\$])", r"\\\1", s[1])
        else:
            group += 1
            pattern += f"(?<g{group}>." + ("+" if s is None else f"{{{s}}}") + ")"
            replacement += f"${{g{group}}}"
    literal = lambda s: s[0] if isinstance(s, tuple) else ""
    tail, head = literal(segments[-1]), literal(segments[0])
    return _printed(tree), pattern + r"\z", replacement, f">{tail}" if tail else f"<{head}"


def rule(form: Column, lemma: Column, depth: int = -1) -> Column:
    """Struct of the printed tree, its pattern and replacement, and the key: '>' and the literal end, or '<' and the start."""

    @F.pandas_udf(TREE)
    def build(forms: pd.Series, lemmas: pd.Series) -> pd.DataFrame:
        rows = [_rule(f, le, depth) for f, le in zip(forms, lemmas)]
        _best.cache_clear()
        _written.cache_clear()
        return pd.DataFrame(rows, columns=["tree", "pattern", "replacement", "key"])

    return build(form, lemma)


def trees(pairs: DataFrame, depth: int = -1) -> DataFrame:
    """form, lemma, n, tree, pattern, replacement, key of pairs (form, lemma); each different pair is built once."""
    own = pairs.filter("form is not null and lemma is not null").groupBy("form", "lemma").agg(F.count("*").alias("n"))
    return own.withColumn("t", rule(F.col("form"), F.col("lemma"), depth)).select("form", "lemma", "n", "t.*")


def frequent(own: DataFrame, least: int = 5) -> DataFrame:
    """tree, pattern, replacement, key, pairs: trees of at least `least` different pairs."""
    return own.groupBy("tree", "pattern", "replacement", "key").agg(F.count("*").alias("pairs")).filter(F.col("pairs") >= least)


def apply(forms: DataFrame, rules: DataFrame) -> DataFrame:
    """Columns of forms (form among them) with tree and lemma: a row for each rule that fits the form.

    A rule meets a form through its literal end, or start where it has no end, so forms and rules meet by key.
    """
    n = F.length("form")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit(">"), F.right(F.col("form"), i)))
    starts = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("<"), F.left(F.col("form"), i)))
    asked = forms.withColumn("key", F.explode(F.array_distinct(F.concat(ends, starts))))
    own = rules.select("tree", "pattern", "replacement", "key").persist()
    few = own.limit(MOST_RULES + 1).count() <= MOST_RULES  # then they go to the forms, whose keys are many
    met = asked.join(F.broadcast(own) if few else own, "key")
    fits = met.filter(F.regexp_like("form", F.col("pattern")))
    return fits.select(*forms.columns, "tree", F.regexp_replace("form", F.col("pattern"), F.col("replacement")).alias("lemma"))


def candidates(forms: DataFrame, rules: DataFrame) -> DataFrame:
    """lemma, n: candidate lemmas with the frequency of the forms (form, n) that lead to them."""
    return apply(forms, rules).groupBy("lemma").agg(F.sum("n").alias("n"))


def unknown_lemmas(forms: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """form, lemma: of the results that are known lemmas (lemma, n), the most frequent; ties by the lemma."""
    own = apply(forms.select("form").distinct(), rules).join(known, "lemma")
    return own.groupBy("form").agg(F.min(F.struct((-F.col("n")).alias("n"), "lemma")).alias("b")).select("form", "b.lemma")


def tree_lines(own: DataFrame) -> DataFrame:
    """line: form, lemma and tree of trees()."""
    return own.select(F.concat_ws("\t", "form", "lemma", "tree").alias("line"))
