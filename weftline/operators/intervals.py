"""Problem 5: overlapping and gapped time intervals.

Per entity, spans that overlap, nest or touch become continuous periods, and
the gaps between the periods are listed.

Plan. A span goes to the time bucket its start falls in, so a hot entity is
spread over as many groups as it has buckets. Inside ``(entity, bucket)``
``session_window`` with the span's own length merges overlaps natively. Per
bucket one summary row (largest end) runs through a window per entity, which
tells each bucket how far the entity is already covered when it begins. A
merged session opens a new period iff it starts after everything before it
ended; touching sessions fuse in this step. Gaps come from ``lag`` inside a
bucket plus that carried bound, periods from the same boundaries read with
``lead``. Results do not depend on the bucket length.

Defined results: spans with a null, NaN or infinite bound or, after rounding to
whole milliseconds, no positive length are left out; repeated rows change
nothing; a null entity is an entity of its own; an empty table gives no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS = 900_000
#: Bounds beyond this many ms (about 31,000 years) are broken and left out.
LIMIT_MS = 10**15


def ms(seconds: Column) -> Column:
    """Seconds as whole milliseconds, null for NaN, infinities and absurd sizes."""
    x = F.round(seconds.cast("double") * F.lit(1000.0))
    return F.when(F.abs(x) < F.lit(float(LIMIT_MS)), x.cast("long"))


def spans(df: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """``keys, s, e`` in whole milliseconds; spans without positive length are gone."""
    out = df.select(*keys, ms(start).alias("s"), ms(end).alias("e"))
    return out.filter(F.col("s").isNotNull() & F.col("e").isNotNull() & (F.col("e") > F.col("s")))


def merged_sessions(span: DataFrame, keys: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Disjoint sessions ``s, e`` per ``(keys, bucket)``."""
    length = F.make_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), ((F.col("e") - F.col("s")) / F.lit(1000)).cast("decimal(18,6)")
    )
    at = span.select(
        *keys,
        F.floor(F.col("s") / F.lit(bucket_ms)).alias("bucket"),
        F.timestamp_millis(F.col("s")).alias("at"),
        "s",
        "e",
    )
    grouped = at.groupBy(*keys, "bucket", F.session_window("at", length).alias("w"))
    return grouped.agg(F.min("s").alias("s"), F.max("e").alias("e")).select(*keys, "bucket", "s", "e")


def boundaries(span: DataFrame, keys: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """A row for each period: its start ``s`` and ``covered``, the end of all spans before it (null for the first)."""
    sessions = merged_sessions(span, keys, bucket_ms)
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        sessions.groupBy(*keys, "bucket")
        .agg(F.max("e").alias("top"), F.min("s").alias("low"))
        # Always true; it makes this branch read the same columns as the other, so that one shuffle serves both.
        .filter(F.col("low") < F.col("top"))
        .select(*keys, "bucket", F.max("top").over(before).alias("carried"))
        .filter(F.col("carried").isNotNull())
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy("s")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col("l.bucket") == F.col("r.bucket")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return (
        sessions.withColumn("lag_e", F.lag("e").over(inside)).alias("l")
        .join(carry.alias("r"), on, "left")
        .select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.bucket"), "s", "e", F.greatest("lag_e", "carried").alias("covered"))
    )


def gaps(span: DataFrame, keys: list[str], least_ms: int = 1, below_ms: int | None = None, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``keys, gap_start_ms, gap_end_ms`` of each uncovered stretch between two covered times."""
    length = F.col("s") - F.col("covered")
    keep = length >= F.lit(max(1, least_ms))
    if below_ms is not None:
        keep = keep & (length < F.lit(below_ms))
    return boundaries(span, keys, bucket_ms).filter(keep).select(*keys, F.col("covered").alias("gap_start_ms"), F.col("s").alias("gap_end_ms"))


def periods(span: DataFrame, keys: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``keys, period_start_ms, period_end_ms``: the continuous periods.

    A period ends where the next boundary's ``covered`` says, the last one at
    the entity's largest end. The next boundary of a bucket's last period is
    found through one summary row per bucket, so no entity is sorted as a whole.
    """
    b = boundaries(span, keys, bucket_ms)
    opens = F.col("covered").isNull() | (F.col("s") > F.col("covered"))
    after = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys)
    first_open = F.min(F.when(opens, F.struct(F.col("s"), F.col("covered")))).alias("first_open")
    summary = (
        b.groupBy(*keys, "bucket")
        .agg(first_open, F.max("e").alias("top"))
        .select(*keys, "bucket", F.first("first_open", ignorenulls=True).over(after).alias("next_open"), F.max("top").over(whole).alias("last_end"))
    )
    starts = b.filter(opens).withColumn("next_here", F.lead("covered").over(Window.partitionBy(*keys, "bucket").orderBy("s")))
    on = F.col("l.bucket") == F.col("r.bucket")
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return (
        starts.alias("l").join(summary.alias("r"), on)
        .select(
            *[F.col(f"l.{k}").alias(k) for k in keys],
            F.col("s").alias("period_start_ms"),
            F.coalesce("next_here", F.col("next_open.covered"), "last_end").alias("period_end_ms"),
        )
    )
