"""Tables and RDF that keep coming: the batch operators over streams.

Serialisation is a narrow projection, so it runs on a stream as it is. Triples are a set; on a stream they are made
distinct within a watermark, so that the state doesn't grow for ever.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.operators.serialize import Entry, table_triples
from semloom.sources.rdf import _parsed
from semloom.terms import TRIPLE_COLUMNS


def stream_tables(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """CSV files as they land in a folder."""
    return spark.readStream.schema(schema).option("header", True).csv(folder)


def stream_triples(rows: DataFrame, template: Sequence[Entry], **options) -> DataFrame:
    """table_triples() of a stream of rows."""
    return table_triples(rows, template, **options)


def distinct_triples(triples: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The stream's triples without those that came before within the delay; `time` is a timestamp column."""
    return triples.withWatermark(time, delay).dropDuplicatesWithinWatermark([c for c in TRIPLE_COLUMNS if c != "g"])


def stream_rdf(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of RDF files as they land in a folder; a file that can't be parsed gives one error row."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)

    def run(frames):
        for f in frames:
            for out in _parsed(f["path"], f["content"], None, True):
                yield out.assign(arrived=f["modificationTime"].max())

    return files.mapInPandas(run, ", ".join(f"{c} string" for c in TRIPLE_COLUMNS) + ", arrived timestamp")


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """(window_start, key, n) by tumbling windows; the same plan on a batch and on a stream."""
    marked = events.withWatermark(time, delay) if events.isStreaming else events
    return marked.groupBy(F.window(time, width).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
