"""The tables the queries read: one Parquet file or folder per name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], order: list[str], columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per key, with ``columns`` (all, if none are named): that of the greatest ``order``. Rows with equal keys are one record.

    What isn't asked for is pruned before the shuffle. Uses ``max_by`` over the
    packed row, so the map side already keeps one row per key and a hot key
    never gathers in one task.
    """
    rest = [c for c in (columns or df.columns) if c not in keys]
    packed = F.struct(*rest)
    picked = df.select(*dict.fromkeys([*keys, *rest, *order])).groupBy(*keys).agg(F.max_by(packed, F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def row_number(keys: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def thinned(df: DataFrame, rows: int, by: list[str], total: int) -> DataFrame:
    """A share of ``df`` by a hash of ``by``, of about four times ``rows`` rows if there are ``total``; all of a small table."""
    share = 1.0 if total <= 4 * rows else 4 * rows / total
    return df.filter(F.pmod(F.xxhash64(*by), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))


def drawn(df: DataFrame, rows: int, by: list[str], total: int, copies: int = 0) -> DataFrame:
    """At most ``rows`` rows, chosen by a hash of ``by``; ``total`` is about the number of rows there are.

    With ``copies`` only ``by`` is kept, and equal rows are drawn at most so often, so that copies don't fill the sample.
    A share of the hash range is taken first, so that what reaches the driver's
    merge stays near the sample's size however many partitions there are.
    """
    h = thinned(df, rows, by, total).withColumn("_h", F.xxhash64(*by))
    if copies:
        h = h.groupBy("_h", *by).agg(F.count(F.lit(1)).cast("int").alias("_n")).select("_h", *by, F.explode(F.sequence(F.lit(1), F.least("_n", F.lit(copies)))).alias("_n")).drop("_n")
    return h.orderBy("_h", *by).limit(rows).drop("_h")
