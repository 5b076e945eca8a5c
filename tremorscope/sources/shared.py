"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting under which a query's shuffle files go when it ends, not when its plan is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where that is unset, on one machine, a temporary folder is made and set. A cluster without it raises RuntimeError."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tremorscope-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage so that a lost executor costs a reread, not a recompute,
    and lets several later jobs reuse the rows. The table goes when the
    application ends, the shuffle files of its job as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tremorscope-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    where, system = _place(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dropped(df: DataFrame) -> None:
    """Delete the table, or tables, that ``stored`` made; nothing may read them from then on. Other DataFrames are left alone."""
    paths = getattr(df, "stored_at", None) or []
    for path in [paths] if isinstance(paths, str) else paths:
        where, system = _place(df.sparkSession, path)
        system.delete(where, True)
