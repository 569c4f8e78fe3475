"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and its decisions take effect: toxic documents go, one document of each group of
near copies stays, contaminated documents go, personal data is replaced, and
what is left is packed. All but the last return the columns of documents.

Defined results, in every stage: a null text counts as empty and stays, as does
an empty one; texts of any length are taken whole; rows without doc_id stay; of
rows that repeat an id one stays after the second stage; an empty table gives no
rows; further columns pass through all stages but the last, whatever their
names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridsmith.llm.common import checkpoint_dir, table
from gridsmith.llm.decontaminate import drop_contaminated
from gridsmith.llm.jaccard import keep_one_of_each
from gridsmith.llm.packing import pack
from gridsmith.llm.pii import redact
from gridsmith.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL has neither boosted trees nor a tokenizer; the tests hold the stages against plain versions.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read by the next, after which what came before goes."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _delete(spark, before)
        before = path
    return docs
