"""Rule tables: rewriting lemmas, joining prefixes, and classes by ordered rules."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def condition(rule: dict, columns: dict[str, Column]) -> Column:
    """Whether all of a rule's conditions hold: 'name' (a value or several), 'name_like' (a pattern or several),
    'name_not' (values that it must not have); with 'any' one of the conditions in it."""

    def one(key: str, wanted) -> Column:
        wanted = (wanted,) if isinstance(wanted, str) else tuple(wanted)
        if key.endswith("_like"):
            return reduce(lambda a, b: a | b, (columns[key[:-5]].rlike(w) for w in wanted))
        return ~columns[key[:-4]].isin(*wanted) if key.endswith("_not") else columns[key].isin(*wanted)

    parts = [one(k, v) for k, v in rule.items() if k not in ("to", "any")]
    if "any" in rule:
        parts.append(reduce(lambda a, b: a | b, (one(k, v) for option in rule["any"] for k, v in option.items())))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def first_rule(rules: list[dict], columns: dict[str, Column], default: Column) -> Column:
    """'to' of the first rule that holds, else the default."""
    out = default
    for rule in reversed(rules):
        out = F.when(condition(rule, columns), F.lit(rule["to"])).otherwise(out)
    return out


def last_rule(rules: list[dict], columns: dict[str, Column], default: Column) -> Column:
    """'to' of the last rule that holds: later rules override earlier ones."""
    return first_rule(list(reversed(rules)), columns, default)


def rewrite(lemma: Column, form: Column, rules: list[dict]) -> Column:
    """The lemma by the first rule on lemma and form that holds, after digits and a final -pl are taken off."""
    bare = F.regexp_replace(F.regexp_replace(lemma, "[0-9]", ""), "-pl$", "")
    return first_rule(rules, {"lemma": bare, "form": form}, bare)


VOWELS = "aehiouw"
# How a prefix changes before the next one, before a rough or smooth breathing, and before consonants
# (what it is like, what follows, its end, what stands for it); prefixes that keep their vowel; accents that move.
KEEP_VOWEL = ("peri", "pro", "a)mfi")
BEFORE_PREFIX = ((f"[{VOWELS}]$", f"^[{VOWELS}]", f"[{VOWELS}]$", ""), ("n$", "^k", "n$", "g"), ("n$", "^p", "n$", "m"), ("k$", f"^[{VOWELS}]", "k$", "c"))
BEFORE_ROUGH_U = (("t$", r"^u\(", "t$", "q"), ("p$", r"^u\(", "p$", "f"))
BEFORE_BREATHING = (("^(ka|me)ta$", "ta$", "q", "t"), (r"^(a\)?|u\(?)po$", "po$", "f", "p"), ("^(dia|para)$", "a$", "", ""), (r"^e\)?pi$", "pi$", "f", "p"), (r"^e\)?k$", "k$", "c", "c"), (r"^a\)?na$", "a$", "", ""), (r"^a\)?nti$", "ti$", "q", "t"))
BEFORE_CONSONANT = ((r"^(sun|e\)?n)$", "^[bpfym]", "n$", "m"), (r"^(sun|e\)?n)$", "^[gkxc]", "n$", "g"), (r"^(sun|e\)?n)$", "^l", "n$", "l"), ("^sun$", "^r", "n$", "r"), ("^sun$", "^s", "n$", ""))
ACCENT_MOVES = {"kei=mai": "keimai", "h=mai": "hmai", "ei=mi": "eimi", "oi=da": "oida", "eimi/": "eimi", "fhmi/": "fhmi", "hmi/": "hmi"}


def _changed(prefix: str, after: str, table: tuple) -> str:
    for like, follows, end, to in table:
        if re.search(like, prefix) and re.search(follows, after):
            return re.sub(end, to, prefix)
    return prefix


def _assembled(lemma: str) -> str:
    if "-" not in lemma:
        return lemma
    prefixes, base = lemma.split("-")[:2]
    parts = [re.sub(r"[/=\\]", "", p) for p in prefixes.split(",")]
    for k in range(len(parts) - 1):
        if parts[k] not in KEEP_VOWEL or not re.match(f"[{VOWELS}]", parts[k + 1]):
            parts[k] = _changed(parts[k], parts[k + 1], BEFORE_PREFIX)
        parts[k] = _changed(parts[k], parts[k + 1], BEFORE_ROUGH_U)
    parts[1:] = [re.sub(r"[()]", "", p) for p in parts[1:]]
    last = parts[-1]
    rough, smooth = (re.match(rf"[{VOWELS}]+\{mark}", base) for mark in "()")
    if rough or smooth:
        base = re.sub(r"\(" if rough else r"\)", "", base)
        last = _changed(last, "", tuple((like, "", end, q if rough else t) for like, end, q, t in BEFORE_BREATHING))
    else:
        base = base.replace("(", "")
        last = _changed(last, base, BEFORE_CONSONANT)
        if base.startswith("r") and re.search(f"[{VOWELS}]$", last):
            base = "r" + base
    if base in ACCENT_MOVES:
        base, last = ACCENT_MOVES[base], re.sub(rf"([{VOWELS}][)(]?)([^{VOWELS}]*)$", r"\1/\2", last)
    return "".join([*parts[:-1], last, base])


@F.pandas_udf(StringType())
def assemble(lemma: pd.Series) -> pd.Series:
    """'prefix,prefix-base' in beta code as one word, with elision and assimilation; other lemmas stay."""
    return lemma.map(_assembled, na_action="ignore")
