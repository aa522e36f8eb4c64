"""The pipeline against a plain run of its decisions."""

import re

import pytest

pytest.importorskip("corpusjobs.llm")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def one_of_each(texts, k=5, share=0.8):
    """The smallest id of each component of texts whose sets of k-word shingles are alike, by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", lowered(t)) if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    kept = []
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]) - 1e-12:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = {i for i in sets if find(i) == i}
    return {i: texts[i] for i in kept}


def contaminated(text, items, window=13, share=20):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
    own, hit = words(text), set()
    for item in items:
        w = words(item)
        n = min(window, len(w))
        wanted = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1) if n else ():
            if tuple(own[i : i + n]) in wanted:
                hit |= set(range(i, i + n))
    return bool(hit) and share * len(hit) >= len(own)


def test_pipeline(spark):
    """Near duplicates by all pairs, contamination by windows one by one, ids by the tokenizer's own call; the two
    classifiers' decisions are those of the operators, which have plain versions of their own."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from corpusjobs.llm import quality, toxicity

    sf = "/root/testdata/sf0.001"
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    docs = docs.filter(docs.doc_id.isin([r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted == 1]))
    docs = docs.filter(docs.doc_id.isin([r.doc_id for r in toxicity.grade(docs, labels).collect() if not r.toxic]))
    texts = one_of_each({r.doc_id: r.text for r in docs.collect()})
    items = [r.text for r in read("benchmark").collect()]
    kept = {i: t for i, t in texts.items() if not contaminated(t, items)}
    assert 0 < len(kept) < len(texts) < 200
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(kept)
    for i, own in pieces.items():
        ids, at = np.array(tok.encode(kept[i] or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeats, shared ids and columns named like the stages' own; what is packed are whole documents."""
    import zlib

    import numpy as np
    import public_tokenizers
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = docs.filter("doc_id < 40").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (None, ""), (7, ""), (7, None)], "doc_id long, text string")
    rows = good.unionByName(good.filter("doc_id < 5")).unionByName(good.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd)
    for k, c in enumerate(("score", "__text", "__node", "contaminated", "spans", "c0", "own")):
        rows = rows.withColumn(c, F.lit(k))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in good.collect()}
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in pieces.items():
        if i in texts and i != 7:
            ids, at = np.array(tok.encode(texts[i], add_special_tokens=False).ids + [1], "<u4"), 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)  # once, though some rows stood twice
    for own in sequences.values():
        ends = [0, *(o + n for o, n in sorted(own))]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
    assert 5 < len(pieces) <= 41
    for t in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").filter("false").write.parquet(f"{tmp_path}/none/{t}.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
