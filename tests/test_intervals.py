import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import intervals

SCHEMA = "video_id string, start double, stop double, bucket int, s string"


def brute(rows):
    by = {}
    for v, a, b, *_ in rows:
        if a is None or b is None or a != a or b != b:
            continue
        s, e = round(a * 1000), round(b * 1000)
        if e > s:
            by.setdefault(v, []).append((s, e))
    periods, gaps = [], []
    for v, spans in by.items():
        cur = None
        for s, e in sorted(spans):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
            else:
                if cur:
                    periods.append((v, *cur))
                    gaps.append((v, cur[1], s))
                cur = [s, e]
        periods.append((v, *cur))
    return sorted(periods, key=str), sorted(gaps, key=str)


def run(spark, rows, bucket):
    df = spark.createDataFrame(rows, SCHEMA)
    span = intervals.spans(df, ["video_id"], F.col("start"), F.col("stop"))
    p = sorted((tuple(r) for r in intervals.periods(span, ["video_id"], bucket).collect()), key=str)
    g = sorted((tuple(r) for r in intervals.gaps(span, ["video_id"], 1, None, bucket).collect()), key=str)
    return p, g


@pytest.mark.parametrize("bucket", [500, 900_000])
def test_against_brute_force(spark, bucket):
    rng = random.Random(7)
    rows = []
    for v in ["a", "b", None]:
        for _ in range(120):
            s = round(rng.uniform(0, 60), 2)
            rows.append((v, s, round(s + rng.choice([0.1, 0.5, 3.0, 9.0]), 2), 1, "x"))
    rows += rows[:10]
    assert run(spark, rows, bucket) == brute(rows)


def test_broken_bounds_touching_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("v", 0.0, 1.0, 0, ""), ("v", 1.0, 2.0, 0, ""), ("v", 5.0, 4.0, 0, ""), ("v", None, 3.0, 0, ""), ("v", 2.5, None, 0, ""), ("v", nan, 9.0, 0, ""), ("v", 3.0, inf, 0, ""), ("v", 2.0004, 2.0001, 0, ""), ("v", 3.0, 4.0, 0, "")]
    p, g = run(spark, rows, 1000)
    assert p == [("v", 0, 2000), ("v", 3000, 4000)]
    assert g == [("v", 2000, 3000)]
    assert run(spark, [], 1000) == ([], [])


def test_gap_limits(spark):
    rows = [("v", 0.0, 1.0, 0, ""), ("v", 601.0, 602.0, 0, ""), ("v", 1300.0, 1301.0, 0, "")]
    span = intervals.spans(spark.createDataFrame(rows, SCHEMA), ["video_id"], F.col("start"), F.col("stop"))
    assert intervals.gaps(span, ["video_id"], 1, 600_000).count() == 0
    assert intervals.gaps(span, ["video_id"], 1, 600_001).count() == 1
