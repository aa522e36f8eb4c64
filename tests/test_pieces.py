"""Pieces are marked, labelled and averaged in their sentence's row, and come out as the flat ones do."""

import pytest
from pyspark.sql import functions as F

from corpusjobs.operators import features, pieces
from corpusjobs.plans import registry, workloads  # noqa: F401

SF = "/root/testdata/sf0.001"
SENTS = [(1, [None, 0, 0, 1, None, 1, 2, None], ["a", "p", None]), (2, [], []), (3, [None, None], ["a"]), (4, [5, 5, 3, 3, 5], ["z", "a"])]


@pytest.mark.parametrize("last", [True, False])
def test_marks_and_labels_in_rows(spark, last):
    own = spark.createDataFrame(SENTS, "sent_id long, w array<long>, labels array<string>")
    rows = own.select("sent_id", F.transform("w", lambda w, i: F.struct(i.cast("long").alias("tok_idx"), w.alias("word_idx"))).alias("s"), "labels")
    flat = rows.select("sent_id", F.inline("s")).withColumnRenamed("tok_idx", "piece_idx")
    labels = own.select("sent_id", F.posexplode("labels").alias("word_no", "label"))
    names = ["sent_id", "piece_idx", "word_no", "first_piece", "last_piece", "label_id"]
    told = lambda frame: sorted(map(str, frame.select(*names).collect()))
    got = told(pieces.label(pieces.mark(rows), "labels", {"a": 1}, last, "p"))
    assert got == told(pieces.label(pieces.mark(flat), labels, {"a": 1}, last, "p")) and len(got) == 15

    with_vectors = lambda at: F.array(at.cast("double"), (at * at).cast("double"))
    whole = pieces.mark(rows).withColumn("s", F.transform("s", lambda p: F.struct(p["word_no"].alias("word_no"), with_vectors(p["piece_idx"]).alias("vector"))))
    both = (features.word_vectors(x, ("mean", "first", "last")) for x in (whole, pieces.mark(flat).withColumn("vector", with_vectors(F.col("piece_idx")))))
    assert len({str(sorted(map(tuple, x.select("sent_id", "word_no", "mean", "first", "last").collect()))) for x in both}) == 1


@pytest.mark.parametrize("name", ["piece_labels", "word_piece_vectors"])
def test_pieces_are_not_exchanged(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sent_id" not in plan and "Window" not in plan
