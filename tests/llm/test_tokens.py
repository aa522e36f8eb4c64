"""Token alignment against a plain version: the tokenizers' own calls, dicts and loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("corpusjobs.llm")
P = pytest.importorskip("public_tokenizers")

from corpusjobs.llm import tokens  # noqa: E402

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def own_calls():
    """Functions from a text to ids and tokens' bytes, by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def by_a(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(byte[c] for c in a.id_to_token(i)) for i in ids]

    def by_b(text):
        ids = b.encode(text)
        return ids, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    return by_a, by_b


def plain(rows):
    by_a, by_b = own_calls()
    links, out = [], []
    for doc_id, text in rows:
        (a, bytes_a), (b, bytes_b) = (f(text) if text else ([], []) for f in (by_a, by_b))
        if b"".join(bytes_a) != (" " + (text or "")).encode() or b"".join(bytes_b) != (" " + (text or "")).encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        at_b = defaultdict(list)
        for x, e in zip(b, ends_b):
            at_b[e].append(x)
        own = [(x, y) for x, e in zip(a, ends_a) for y in at_b[e]]
        cuts, groups = sorted({*ends_a} & {*ends_b}), []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append(",".join(str(x) for x, e in zip(a, ends_a) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(b, ends_b) if lo < e <= hi))
        links.append(own)
        out.append([doc_id, len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    counts = Counter(x for own in links for x in own)
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return sorted(((*o[:5], sum(counts[x] == highest[x[1]] for x in own), sum(counts[x] for x in own), o[5]) for o, own in zip(out, links)), key=str)


def told(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=str)


def test_query(spark):
    docs = [(r.doc_id, (r.text or "")[:4000]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    assert told(tokens.align(spark.createDataFrame(docs, "doc_id long, text string"), A, B)) == plain(docs)
    whole = {r.doc_id: r for r in tokens.op11_tokens(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    expected = {r[0]: r for r in plain(list(texts.items()))}
    assert {i: (r.n_a, r.n_best, r.count_sum, r.groups_sha256) for i, r in whole.items()} == {i: (r[1], r[5], r[6], r[7]) for i, r in expected.items()}


def test_odd_rows(spark):
    texts = [None, "", " ", "  a  b ", "\n\ttab\r\n", "▁ under", "it's we'll I'M", "<|endoftext|> <s></s> <unk> <0x41>", "日本語 テキスト", "🙂🙃 mixed Ünïcode", "\x00\x01 nul", "é combining", " \u0085\x1c\x1f spaces", "same text", "same text", "ﬁ ligature ½ ² Ⅷ", "a" * 3000, "word " * 2000 + "end"]
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_a long, run string")
    expected = plain(rows)
    assert told(tokens.align(df, A, B)) == expected
    assert told(tokens.align(df, A, B, run_bytes=20)) == expected
    assert told(tokens.align(df.filter("false"), A, B)) == []
    assert told(tokens.align(df.filter("text is null"), A, B)) == [(0, 0, 0, 0, 0, 0, 0, "")]


def test_texts_ids(monkeypatch):
    """Ids by ranks and by runs of segments are those of the tokenizers' own calls, for all characters below PLAIN_END and some above."""
    monkeypatch.setattr(tokens, "LONG", 5)
    rng = random.Random(7)
    every = [chr(c) for c in range(1, ord(tokens.PLAIN_END))]
    by_a, by_b = own_calls()
    a, b = tokens.byte_ids(A), tokens.piece_ids(B)
    texts = ["".join(every[i : i + 7]) + " " + every[i] for i in range(len(every) - 7)]
    texts += ["".join(rng.choice(" " * 6 + "\n\t\r's" + "abcdé1²Жя,.'" + rng.choice(every)) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    texts += ["z" * 200 + " " + "z" * 200, "w" * 70 + " w", " ", "   ", "x" * 9 + " " * 9, " " * 9 + "x", "<|endoftext|> </s> <s>", "日本語 の テキスト です。 ab", "a▁b ▁ c d e f", "\u0660\u06f0 \u2003 x\u200by"]
    for own, call in ((a, by_a), (b, by_b)):
        got = [x.tolist() for lo in range(0, len(texts), 17) for x in own.of([" " + t for t in texts[lo : lo + 17]])]
        for t, ids_of_t in zip(texts, got):
            ids, raw = call(t)
            assert ids_of_t == (ids if b"".join(raw) == (" " + t).encode() else []), repr(t)


def test_by_ranks():
    """Ranks stand for merges only if no other halves of an entry can meet."""
    model = lambda merges: {"vocab": {c: k for k, c in enumerate([*map(chr, range(256)), *("".join(m) for m in merges)])}, "merges": [" ".join(m) for m in merges]}

    def alone(own):
        from tokenizers.models import BPE

        return BPE(own["vocab"], [tuple(m.split(" ")) for m in own["merges"]]).tokenize

    def holds(merges, **others):
        own = model(merges) | others
        return tokens.by_ranks(own, {e.encode("latin-1"): k for e, k in own["vocab"].items()}, alone(model(merges)))

    assert holds([("a", "b"), ("ab", "c")])
    assert not holds([("b", "c"), ("a", "b"), ("ab", "c")])  # "abc" alone is "a", "bc", whose joined text has an id
    assert not holds([("a", "b"), ("ab", "c")], ignore_merges=True)
    own = model([("a", "b"), ("ab", "c")])
    own["merges"].reverse()
    assert not tokens.by_ranks(own, {e.encode("latin-1"): k for e, k in own["vocab"].items()}, alone(own))


def test_overlaps():
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randrange(1, 60)
        cut = lambda: sorted({0, *rng.sample(range(n), rng.randrange(n))})
        a, b = cut(), cut()
        x, y = tokens.overlaps(np.array(a), np.array(b))
        ranges = lambda s: [set(range(lo, hi)) for lo, hi in zip(s, [*s[1:], n])]
        assert sorted(zip(x.tolist(), y.tolist())) == [(i, j) for i, p in enumerate(ranges(a)) for j, q in enumerate(ranges(b)) if p & q]
