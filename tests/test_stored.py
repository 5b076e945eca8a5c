"""Written tables leave no shuffle files."""

import time

from pyspark.sql import functions as F

from tremorscope.sources.shared import stored


def test_a_written_table_leaves_no_shuffle_files(spark):
    held = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().endswith(".data")}
    before, name = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name, None)
    table = stored(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "kept")
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and spark.conf.get(name, None) == setting
    assert table.count() == 1000
