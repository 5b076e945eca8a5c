"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tremorscope.sources.shared import dropped, shared_dir, stored

__all__ = ["arrow_batches", "ascii_lower", "block_reads", "block_writes", "crc_bucket", "dropped", "free_name", "shared_dir", "stored"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(column, UPPER, LOWER)


def crc_bucket(doc_id, modulus: int):
    """crc32 of the decimal text of an id, modulo ``modulus``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def free_name(name: str, *tables) -> str:
    """``name``, with underscores after it until none of the tables has such a column."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Jobs run inside have these settings; the session's own come back afterwards."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def arrow_batches(spark: SparkSession, size: int = 16 << 20):
    """Jobs run inside give Python batches of about ``size`` bytes, or one longer row: for tables whose rows are blocks."""
    return _set(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(size)})


#: Bytes of blocks that an Arrow batch and a row group hold, and rows that the Parquet reader decodes at once.
BATCH_BYTES, GROUP_BYTES, READ_ROWS = 4 << 20, 32 << 20, 2


def block_writes(spark: SparkSession):
    """For jobs that write tables whose rows are blocks of megabytes: small Arrow batches, and row groups that are closed by their bytes, not by a hundred rows at least."""
    return _set(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "1"})


def block_reads(spark: SparkSession):
    """For jobs that read nothing but such tables: a few rows are decoded at once, where Parquet's reader takes 4096."""
    return _set(spark, {"spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS)})
