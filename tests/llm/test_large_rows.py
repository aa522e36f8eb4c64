"""Rows of megabytes stand in row groups of a few, so writers and readers hold few of them."""

import pyarrow as pa
import pyarrow.parquet as pq

from corpusjobs.llm import common, tokens


def test_row_groups_of_large_rows(spark, tmp_path, monkeypatch):
    def made(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"run": pa.array([k]), "links": pa.array([list(range(k, 500_000 + k))], pa.list_(pa.int32()))})

    monkeypatch.setattr(common, "shared_dir", lambda spark, name: f"{tmp_path}/{name}")
    rows = spark.range(0, 12, 1, 1).mapInArrow(made, "run long, links array<int>")
    own = common.table_of(rows, "runs", large=True)
    assert sorted((r.run, len(r.links), r.links[-1]) for r in own.collect()) == [(k, 500_000, 499_999 + k) for k in range(12)]
    (file,) = (tmp_path / "runs").glob("*.parquet")
    told = pq.ParquetFile(file).metadata
    assert max(told.row_group(k).num_rows for k in range(told.num_row_groups)) <= 4


def test_runs_are_written_so(spark, monkeypatch):
    said = {}
    real = tokens.table_of
    monkeypatch.setattr(tokens, "table_of", lambda df, name, **more: said.update({name: more}) or real(df, name, **more))
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    import public_tokenizers

    assert tokens.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).count() == 1
    assert said["token-runs"] == {"large": True}
