"""Evaluating an expression once where the optimizer would copy it into each use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later expressions read instead of repeating their own.

    Neighbouring projections are merged by the optimizer, and a long chain of
    regular expressions that is used five times then runs five times. A
    one-element ``explode`` stands between them; it stays in the JVM.
    """
    kept = [c for c in df.columns if c not in columns]
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select(*kept, packed).select(*kept, *[F.col("_once")[n].alias(n) for n in columns])
