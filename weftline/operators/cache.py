"""Result cache as a table: the latest entry of a key counts, until it expires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T

TTL_SECONDS = 86_400


def entries(df: DataFrame, video: str, query: str, payload: list[str], at: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """``key, at, expires_at`` and the payload."""
    key = T.cache_key(F.coalesce(F.col(video), F.lit("search")), F.coalesce(F.col(query), F.lit("")))
    return df.select(key.alias("key"), F.col(at).alias("at"), (F.col(at) + F.make_interval(secs=F.lit(ttl))).alias("expires_at"), *payload)


def lookup(requests: DataFrame, cache: DataFrame, now: str, payload: list[str]) -> DataFrame:
    """``requests`` (with ``key``) left-joined with the latest entry written before and not expired at ``now``.

    One as-of pass: entries and requests of a key are ordered by time and the
    last entry is carried along.
    """
    from pyspark.sql import Window

    both = requests.select(F.col("key"), F.col(now).alias("t"), F.lit(1).alias("kind"), F.struct(*requests.columns).alias("request"), F.lit(None).cast(cache.select(F.struct("expires_at", *payload).alias("e")).schema["e"].dataType).alias("entry")).unionByName(
        cache.select("key", F.col("at").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast(requests.select(F.struct(*requests.columns).alias("r")).schema["r"].dataType).alias("request"), F.struct("expires_at", *payload).alias("entry"))
    )
    # Entries of the same instant as a request are not yet visible to it.
    w = Window.partitionBy("key").orderBy(F.col("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("last", F.last("entry", ignorenulls=True).over(w)).filter("kind = 1")
    live = F.col("last.expires_at") > F.col("t")
    return seen.select("request.*", F.coalesce(live, F.lit(False)).alias("hit"), *[F.when(live, F.col(f"last.{p}")).alias(f"cached_{p}") for p in payload])


def invalidate(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key").distinct(), "key", "left_anti")


def stats(cache: DataFrame, size: Column) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
