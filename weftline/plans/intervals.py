"""Queries of problem 5 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import intervals
from weftline.sources.tables import table

#: A longer stretch without captions is a break of the recording, not a gap.
BREAK_MS = 600_000
KEYS = ["origin", "video_id"]


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = table(spark, folder, "cleaned_segments").select(F.lit("cleaned_segments").alias("origin"), "video_id", F.col("start_sec").alias("a"), F.col("end_sec").alias("b"))
    raw = table(spark, folder, "raw_segments").select(F.lit("raw_segments").alias("origin"), "video_id", F.col("start_sec").alias("a"), (F.col("start_sec") + F.col("duration")).alias("b"))
    return intervals.spans(cleaned.unionByName(raw), KEYS, F.col("a"), F.col("b"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.gaps(_spans(spark, folder), KEYS, 1, BREAK_MS)


def p5_periods(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.periods(_spans(spark, folder), KEYS)


QUERIES = {"p5_found": p5_found, "p5_periods": p5_periods}

_SPANS = """
WITH spans AS (
  SELECT 'cleaned_segments' AS origin, video_id, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e FROM cleaned_segments
  UNION ALL
  SELECT 'raw_segments', video_id, CAST(round(start_sec * 1000) AS BIGINT), CAST(round((start_sec + duration) * 1000) AS BIGINT) FROM raw_segments
), ok AS (
  SELECT * FROM spans WHERE s IS NOT NULL AND e IS NOT NULL AND e > s
), seen AS (
  SELECT origin, video_id, s, e, max(e) OVER (PARTITION BY origin, video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM ok
)"""

ORACLE = {
    "p5_found": _SPANS
    + " SELECT origin, video_id, covered AS gap_start_ms, s AS gap_end_ms FROM seen WHERE s - covered >= 1 AND s - covered < 600000",
    "p5_periods": _SPANS
    + """, marked AS (SELECT *, CASE WHEN covered IS NULL OR s > covered THEN 1 ELSE 0 END AS opens FROM seen),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY origin, video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM marked)
    SELECT origin, video_id, min(s) AS period_start_ms, max(e) AS period_end_ms FROM numbered GROUP BY origin, video_id, n""",
}
