"""Sources and sinks: the supplied tables as training cases, and results as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_cases(spark: SparkSession, folder: str) -> DataFrame:
    """(rid, y, x, z, g, label): orders with their customers; prices and balances in thousands."""
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return joined.select(
        F.col("o_orderkey").alias("rid"),
        (F.col("o_totalprice") / 1000).alias("y"),
        (F.col("c_acctbal") / 1000).alias("x"),
        (F.pmod("o_custkey", F.lit(97)) / 10.0).alias("z"),
        F.col("o_orderpriority").alias("g"),
        F.col("o_orderstatus").alias("label"),
    )


def line_cases(spark: SparkSession, folder: str) -> DataFrame:
    """(rid, y, x, z, g, label): order lines; the price in thousands, quantity, discount, tax and return flag.

    Order and line number aren't unique, so rid is made of all keys and a count
    of the rows that share them; rows that are equal throughout are interchangeable.
    """
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    again = F.row_number().over(Window.partitionBy(*keys).orderBy("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"))
    return table(spark, folder, "lineitem").select(
        F.concat_ws("|", *keys, again).alias("rid"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        F.col("l_quantity").cast("double").alias("x"),
        F.col("l_discount").cast("double").alias("z"),
        F.col("l_tax").cast("double").alias("g"),
        F.col("l_returnflag").alias("label"),
    )


def require_columns(df: DataFrame, *names: str) -> None:
    """Raises ValueError for a column that isn't there, at planning time."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_scalar(df: DataFrame, name: str) -> None:
    """Raises ValueError for a target that is an array, map or struct: one value a row is needed."""
    require_columns(df, name)
    if df.schema[name].dataType.typeName() in ("array", "map", "struct"):
        raise ValueError(f"{name} must hold one value a row")


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def require_numeric(df: DataFrame, *names: str) -> None:
    """Raises ValueError for columns that aren't there or don't hold numbers, at planning time."""
    require_columns(df, *names)
    kinds = {n: df.schema[n].dataType.simpleString() for n in names}
    if bad := [f"{n} ({k})" for n, k in kinds.items() if k not in NUMERIC and not k.startswith("decimal")]:
        raise ValueError(f"not numbers: {', '.join(bad)}")


def checked(df: DataFrame, what: str, finite: Sequence[str] = (), present: Sequence[str] = ()) -> int:
    """The number of rows, from one aggregate that also looks for what no fit can take.

    Columns in ``finite`` must hold numbers, with no null, NaN or infinity;
    those in ``present`` no null, and no NaN. Otherwise, and for no rows at all,
    ValueError says what is wrong, by column, and how many rows it concerns.
    """
    require_numeric(df, *finite)
    require_columns(df, *present)
    looks, floating = [], lambda n: df.schema[n].dataType.typeName() in ("float", "double")
    for name in dict.fromkeys([*finite, *present]):
        looks.append((name, "null", F.col(name).isNull()))
        if floating(name):
            looks.append((name, "NaN", F.isnan(name)))
        if name in finite and floating(name):
            looks.append((name, "infinite", F.abs(F.col(name)) == float("inf")))
    n, *found = df.agg(F.count("*"), *[F.count_if(hit) for _, _, hit in looks]).first()
    if wrong := [f"{name} is {kind} in {k} of {n} rows" for (name, kind, _), k in zip(looks, found, strict=True) if k]:
        raise ValueError(f"{what}: {'; '.join(wrong)}")
    if not n:
        raise ValueError(f"{what}: no rows")
    return n


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
