"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("corpusjobs.llm")

from corpusjobs.llm import spelling  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain_words(rows):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    """One edit parts a and b, by their common beginnings and ends."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    return a[lo + 1 :] == b[lo + 1 :] if len(a) == len(b) else a[lo + 1 :] == b[lo:] if len(a) > len(b) else a[lo:] == b[lo + 1 :]


def plain(words, times=10):
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    out, form = {}, {}
    for w, n in words.items():
        around = [o for d in (-1, 0, 1) for o in by_length.get(len(w) + d, []) if near(w, o)]
        best = min(around, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
        out[w] = [n, len(around)]
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] += [form[w], words[form[w]] if form[w] else None, root]
    return {w: tuple(x) for w, x in out.items()}


def told(rows):
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = plain_words(docs)
    assert told(spelling.op13_spelling(spark, SF).collect()) == plain(words) and len(words) > 500


def test_rounds_and_shards(spark):
    """Chains of forms, ties, repeated letters; small filters, several shards and rounds give the same."""
    rng = random.Random(1)
    words = {"aaaaaaa": 100_000, "aaaaaaaa": 9_000, "aaaaaaab": 9_000, "aaaaaabb": 800, "aaaaabbb": 70, "aaaabbbb": 5, "zzzzzzz": 3, "zzzzzzy": 30, "zzzzzzx": 30, "ÿàçèéêë": 40, "ÿàçèéê": 4}
    words |= {"".join(rng.choice("abÿ") for _ in range(rng.randrange(6, 11))): rng.randrange(1, 2000) for _ in range(400)}
    words |= {w[:3] + w[4:]: 2 for w in [*words][:60]}
    words["x" * 3000] = 50
    words["x" * 1500 + "y" + "x" * 1499] = 5
    df = spark.createDataFrame([*words.items()], "word string, n long")
    expected = plain(words)
    assert told(spelling.grouped(df).collect()) == expected
    assert told(spelling.grouped(df, filter_bytes=300, shard_words=40).collect()) == expected


def test_odd_rows(spark):
    schema = "doc_id long, text string, word string, n int, h string"
    assert spelling.grouped(spelling.words_of(spark.createDataFrame([], schema))).collect() == []
    rows = [(1, None), (2, ""), (None, "Spelling spelling SPELLINGS spellings"), (3, "spelling spelling"), (3, "spelling spelling"), (4, "ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ×÷ " * 2), (5, "q" * 20_000 + " " + "q" * 20_000)]
    df = spark.createDataFrame([(*r, "k", 1, "z") for r in rows], schema)
    words = plain_words(rows)
    assert told(spelling.grouped(spelling.words_of(df)).collect()) == plain(words)
    assert "q" * 20_000 in words


def test_filter():
    """A filter holds all that it was made of, and few others."""
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 100_000).astype(np.uint64)
    own = spelling.filter_of(h)
    assert spelling.within(own, h).all() and own.nbytes == 300_000
    assert spelling.within(own, rng.integers(0, 1 << 63, 1_000_000).astype(np.uint64)).mean() < 0.006


def test_edit_hashes():
    """Edits' hashes are those of the edited words; each pair of neighbours comes from one of its sides once."""
    words = ["abcabca", "aabbccd", "aaaaaaa"]
    points = lambda ws: np.array([[ord(c) for c in w] for w in ws], np.uint32)
    alphabet = np.array([97, 98, 99, 100], np.uint32)
    for i, w in enumerate(words):
        got = {-1: [], 0: []}
        for change, h, pick in spelling.edits_of(points(words), alphabet):
            k, row = pick(np.arange(len(h)))
            got[change] += [int(x) for x in h[k][row == i]]
        deleted = {w[:p] + w[p + 1 :] for p in range(len(w))}
        changed = {w[:p] + c + w[p + 1 :] for p in range(len(w)) for c in "abcd" if c > w[p]}
        for change, texts in ((-1, deleted), (0, changed)):
            assert sorted(got[change]) == sorted(int(x) for x in spelling.hash_of(points(sorted(texts))))
