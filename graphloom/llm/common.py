"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.scratch import dropped, shared_dir, written

__all__ = ["SPACE", "dropped", "held_out", "shared_dir", "sliced", "small_batches", "table", "written"]

#: Fixed value: the white space that separates words, as a Java/RE2/Python class body.
SPACE = r"\x20\x09-\x0D"

#: Rows that the JVM hands to Python at once at most: a batch of whole texts is held on either side.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after its session's setting for the rows of a batch is lowered to ``BATCH_ROWS``, if it is higher."""
    spark = docs.sparkSession
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that learning must not see."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def sliced(batches, rows: int):
    """Arrow batches cut into pieces of at most ``rows``, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
