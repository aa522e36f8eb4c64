"""The data source of blocks, and a corpus in a database."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusjobs.sources import blocks, readers


def plain(data: bytes):
    out, lines = [], []
    for line in [*data.split(b"\n"), b""]:
        if line.strip():
            lines.append(line.rstrip(b"\r").decode())
        elif lines:
            out.append(lines)
            lines = []
    return out + ([lines] if lines else [])


def some_file(rng, end: bytes) -> bytes:
    blank = lambda: rng.choice([b"", b" ", b"\t "]) + end
    text = b"".join(blank() for _ in range(rng.randrange(3)))
    for _ in range(rng.randrange(12)):
        text += b"".join(f"{i}\tλόγος{'x' * rng.randrange(30)}".encode() + end for i in range(rng.randrange(1, 5)))
        text += b"".join(blank() for _ in range(rng.randrange(1, 4)))
    return text[: -len(end)] if rng.random() < 0.3 else text


def test_splits_at_any_place(tmp_path):
    """Whatever the ranges, each block comes once and whole."""
    rng = random.Random(9)
    for k in range(60):
        data = some_file(rng, rng.choice([b"\n", b"\r\n"]))
        path = tmp_path / f"f{k}"
        path.write_bytes(data)
        for split in (1, 2, 3, 7, 50, 10_000):
            with path.open("rb") as file:
                got = [b for lo in range(0, len(data), split) for b in blocks.blocks_in(file, lo, min(lo + split, len(data)))]
            assert [x for _, x in got] == plain(data) and len({at for at, _ in got}) == len(got)


def test_mixed_folder(spark, tmp_path):
    """Files with different line ends in one folder, hidden ones left out, ids in the files' order."""
    rng = random.Random(4)
    data = {f"{k}.conllu": some_file(rng, b"\r\n" if k % 2 else b"\n") for k in range(5)} | {"sub/z.conllu": b"1\ta\n\n2\tb", "empty": b""}
    for name, text in data.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(text)
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"no")
    expected = [x for name in sorted(data) for x in plain(data[name])]
    for split in (16, 1 << 20):
        rows = readers.sentences(spark, str(tmp_path / "in"), split).orderBy("sent_id").collect()
        assert [r.lines for r in rows] == expected and len({r.sent_id for r in rows}) == len(rows)
    with pytest.raises(Exception, match="nowhere"):
        readers.sentences(spark, str(tmp_path / "nowhere")).collect()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_written_and_read_again(spark, tmp_path, end):
    blocks.register(spark)
    own = spark.range(50).select(F.transform(F.sequence(F.lit(0), F.col("id") % 4), lambda i: F.concat(F.col("id").cast("string"), F.lit("\t"), i.cast("string"))).alias("lines"))
    out = str(tmp_path / "out")
    for _ in range(2):  # the second takes the place of the first
        own.repartition(3).write.format("blocks").option("lineEnd", end).mode("overwrite").save(out)
    assert sorted(r.lines for r in readers.sentences(spark, out).collect()) == sorted(r.lines for r in own.collect())
    names = [p.name for p in Path(out).iterdir()]
    assert "_SUCCESS" in names and not any(n.startswith(".part") for n in names)
    own.limit(1).write.format("blocks").mode("append").save(out)
    assert readers.sentences(spark, out).count() == 51


def test_corpus_in_a_database(spark, tmp_path):
    """An embedded database gives the rows that the Parquet form gives, for the texts asked for alone."""
    url = f"jdbc:derby:{tmp_path}/corpus;create=true"
    words = spark.range(200).select(F.col("id").alias("WORD_ID"), (F.col("id") % 10).alias("UNIT_ID"), F.concat(F.lit("w"), F.col("id")).alias("FORM"))
    heads = spark.range(200).select(F.col("id").alias("WORD_ID"), (F.col("id") / 2).cast("long").alias("HEAD_ID"))
    for name, df in (("words", words), ("heads", heads)):
        df.coalesce(1).write.jdbc(url, name)
    tables = {"words": "words", "heads": "(select h.word_id, head_id, unit_id from heads h join words w on h.word_id = w.word_id) h"}
    got = readers.read_corpus_jdbc(spark, url, tables, [7, 3, 3, 5], parts=2)
    assert got["words"].rdd.getNumPartitions() == 2
    rows = got["words"].join(got["heads"].select("word_id", "head_id"), "word_id").select("word_id", "unit_id", "form", "head_id")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, words.join(heads, "word_id").filter("unit_id in (3, 5, 7)").collect()))
    assert readers.read_corpus_jdbc(spark, url, {"words": "words"}, [])["words"].count() == 0
