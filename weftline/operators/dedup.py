"""Greedy removal of near-duplicates over a whole collection.

Pairs that are alike come from ``overlaps``. Who stays is the lexicographically
first maximal independent set in priority order: a row is kept once all its
better neighbours are removed, and removed once a better neighbour is kept. Each
round is one join over what is undecided, written to the shared folder to cut
the lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.overlaps import similar_pairs
from weftline.session import discard, written


def greedy_keep(df: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """``df`` without the rows that the greedy pass in order of ``key`` removes. ``pairs`` holds ``a < b``.

    Every round decides at least the best undecided row of each component, so
    the rounds end; their number is the longest chain of decisions that hang on
    each other, not the number of rows.
    """
    edges = written(pairs, "dedup-edges")
    removed = None
    kept = None
    live = edges
    before = None
    while not live.isEmpty():
        losers = live.select(F.col("b").alias("k")).distinct()
        # Not the worse end of any live pair: nothing better is undecided, so it stays.
        winners = live.select(F.col("a").alias("k")).distinct().join(losers, "k", "left_anti")
        winners = written(winners, "dedup-kept")
        gone = written(live.join(winners.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("b").alias("k")).distinct(), "dedup-gone")
        removed = gone if removed is None else removed.unionByName(gone)
        kept = winners if kept is None else kept.unionByName(winners)
        live = live.join(gone.withColumnRenamed("k", "a"), "a", "left_anti").join(gone.withColumnRenamed("k", "b"), "b", "left_anti")
        live = live.join(winners.withColumnRenamed("k", "a"), "a", "left_anti")
        live, old = written(live, "dedup-live"), before
        before = live
        if old is not None:
            discard(old)
    if removed is None:
        return df
    return df.join(removed.select(F.col("k").alias(key)).distinct(), key, "left_anti")


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """A dense position in a total order, without gathering the rows in one task.

    A range sort splits the rows into partitions; each partition's count gives
    the offset of the next. The counts (one number per partition) are the only
    thing the driver sees.
    """
    from pyspark.sql import types as S

    spread = written(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    sizes = {r["_p"]: r["n"] for r in spread.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    base = df.sparkSession.createDataFrame(offsets or [(0, 0)], S.StructType([S.StructField("_p", S.IntegerType()), S.StructField("_base", S.LongType())]))
    # The low 33 bits count the rows of a partition from 0.
    at = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return spread.join(F.broadcast(base), "_p").withColumn(name, at + F.col("_base")).drop("_p", "_m", "_base")


def deduplicate(df: DataFrame, text: str, order: list[Column], num: int = 7, den: int = 10) -> DataFrame:
    """Keeps a row unless its word Jaccard with a kept row before it reaches ``num / den``."""
    r = ranked(df, order, "_rank")
    return greedy_keep(r, "_rank", similar_pairs(r, "_rank", text, num, den, strict=False)).drop("_rank")


def merge_sources(df: DataFrame, text: str, source: str, order: list[Column], num: int = 3, den: int = 4) -> DataFrame:
    """Keeps a row unless its word Jaccard with a kept row of another source before it is above ``num / den``."""
    r = ranked(df, order, "_rank")
    pairs = similar_pairs(r, "_rank", text, num, den, strict=True)
    s = r.select(F.col("_rank").alias("k"), F.col(source).alias("s"))
    other = pairs.join(s.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    return greedy_keep(r, "_rank", other.filter(~F.col("sa").eqNullSafe(F.col("sb"))).select("a", "b")).drop("_rank")
