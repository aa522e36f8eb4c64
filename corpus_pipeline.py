"""A training corpus from `documents`: five stages, each written as Parquet and read again by the next.

1. quality (operator 10): documents predicted bad go.
2. toxicity (operator 1): documents with P(grade > 0) of at least a half go.
3. near_duplicates (operator 8): five-word shingles, similarity 0.8; the row with the smallest doc_id of each component stays.
4. decontamination (operator 2): contaminated documents go, others stay as they are.
5. packing (operator 4): what is left, packed into sequences.

Defined cases: a null text counts as empty; empty and very long texts are judged as they are, the latter whole; rows with
a null doc_id or one that others share are decided by their texts; of repeated rows one stays; ties fall as in the
operators; an empty table gives no rows; other columns pass through to the packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusjobs.llm.common import passing, shared_dir, table
from corpusjobs.llm.decontam import drop_contaminated
from corpusjobs.llm.jaccard import keep_one
from corpusjobs.llm.packing import pack
from corpusjobs.llm.quality import classify
from corpusjobs.llm.toxicity import grade


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classify(docs, table(spark, sf_dir, "labels"), keep=True)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return grade(docs, table(spark, sf_dir, "labels"), keep=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: The classifiers and the packing order can't be expressed in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, result = table(spark, sf_dir, "documents"), shared_dir(spark, "pipeline")
    with passing():  # what a stage wrote besides its result goes with it, and its result when all are done
        for k, (name, stage) in enumerate(STAGES, 1):
            path = shared_dir(spark, f"stage-{name}") if k < len(STAGES) else result
            with passing():
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
