"""A word's tokens are dealt to shares in every session, and null keys meet nothing."""

import pytest
from pyspark.sql import functions as F

from corpusjobs.operators import lexicon

SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
RULE = "spark.sql.requireAllClusterKeysForCoPartition"  # which the alignment queries set


@pytest.mark.parametrize("all_keys", ["true", "false"])
def test_tokens_of_a_word_are_dealt(spark, all_keys):
    tokens = spark.createDataFrame([(k, 1, "the") for k in range(400)] + [(400, 1, None), (401, 1, "a")], "sent_id long, tok_idx long, form string")
    entries = spark.createDataFrame([("the", 5), ("the", 6), (None, 7)], "form string, x int").groupBy("form").agg(F.max("x").alias("x"))
    before = {c: spark.conf.get(c, None) for c in [*SETTINGS, RULE]}
    for c, v in (SETTINGS | {RULE: all_keys}).items():
        spark.conf.set(c, v)
    try:
        out = lexicon.shared_join(tokens, entries, ["form"])
        assert out.columns == ["sent_id", "tok_idx", "form", "x"]
        rows = out.select("form", "x", F.spark_partition_id()).collect()
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert sorted((r[0] or "", r[1] or 0) for r in rows) == [("", 0), ("a", 0)] + [("the", 6)] * 400
    assert len({r[2] for r in rows if r[0] == "the"}) > 1


def test_listed_probabilities(spark):
    rows = spark.createDataFrame([(1, 1, 0.2, 0.2, 0.5), (1, 2, 0.9, 0.1, 0.25), (2, 1, 0.4, 0.6, 1.0)], "sent_id long, tok_idx long, x double, y double, z double")
    listed = {"upos": {"v": F.col("x"), "n": F.col("y")}, "case": {"g": F.col("z")}}
    parts = [F.struct(F.lit(f).alias("feat"), F.lit(v).alias("value"), p.alias("prob")) for f, values in listed.items() for v, p in values.items()]
    told = lambda frame: sorted((r.sent_id, r.tok_idx, sorted(r.tag.items()), r.p) for r in frame.collect())
    got = told(lexicon.independent_tags(rows, listed))
    assert got == told(lexicon.independent_tags(rows.select("sent_id", "tok_idx", F.array(*parts).alias("probs")))) and dict(got[0][2])["upos"] == "n"
