"""From documents to packed sequences: language ID, quality, near duplicates, secrets, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from semloom.llm import langid, packing, quality, secrets, simhash
from semloom.llm.common import shared_folder

#: (name, function of (spark, docs, sf_dir)); each result is written and read again as the next one's docs.
STAGES = [
    ("language_id", langid.filter_stage),
    ("quality", quality.filter_stage),
    ("near_dedup", simhash.filter_stage),
    ("secrets", secrets.redact_stage),
    ("packing", packing.pack_stage),
]

#: SimHash, learned models and greedy packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents: the rows of the last one, see packing.pack().

    The stages' tables lie in a folder of their own under that of spark.checkpoint.dir; each is removed once the next one is
    written, but for the last one's, which the result is read from. Rows with a null id or text, repeated rows and
    columns with clashing names are what each stage says; an empty table gives an empty result, of the same columns."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{name}")
        docs = spark.read.parquet(path)
        if last:
            _remove(spark, last)
        last = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
