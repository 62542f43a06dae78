"""Structured Streaming forms of the operators that make sense on arriving rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per window and key, late rows accepted within ``late``."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions per key with their number of rows."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_seen(rows: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Drops rows whose keys were seen before, with state bounded by the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def consecutive(rows: DataFrame, entity: str, index: str, text: str, threshold: float = 0.85) -> DataFrame:
    """Consecutive duplicate removal on a stream: the state of an entity is the last kept text."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else ""
        out = []
        for pdf in frames:
            for i, t in sorted(zip(pdf[index], pdf[text], strict=True), key=lambda x: x[0]):
                mine = set((t or "").lower().split())
                kept = set(last.lower().split())
                if mine and not (kept and len(mine & kept) / len(mine | kept) >= threshold):
                    out.append((key[0], i, t))
                    last = t
        state.update((last,))
        yield pd.DataFrame(out, columns=[entity, index, text])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"`{entity}` {kinds[entity]}, `{index}` {kinds[index]}, `{text}` string"
    return rows.groupBy(entity).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)
