"""The nine-stage cleaner of caption segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.once import once
from weftline.operators.folds import drop_windowed, merge_fragments
from weftline.session import written


@dataclass(frozen=True)
class Config:
    """Limits of the cleaner; ``language`` forces ``ja`` or ``en`` instead of detection."""

    min_chars: int = 8
    max_noise: float = 0.72
    merge_gap: float = 1.8
    threshold: float = 0.72
    language: str | None = None


def staged(df: DataFrame, entity: str, index: str, text: str, start: str, duration: str, config: Config = Config()) -> DataFrame:
    """Stages 1 to 8: every line left after the second check with its noise score and what removed it (``stage``: noise, duplicate, short or kept)."""
    length = F.greatest(F.coalesce(F.col(duration), F.lit(0.0)), F.lit(0.0))
    base = df.filter(F.col(start).isNotNull()).select(entity, index, F.col(text).alias("text"), F.col(start).cast("double").alias("start"), (F.col(start) + length).alias("end"))
    base = once(base, text=T.normalize_line(F.coalesce(F.col("text"), F.lit("")))).filter(~T.unrecoverable(F.col("text")))
    lang = F.lit(config.language) if config.language else T.script_language(F.col("text"))
    lines = once(base, lang=lang, text=T.repair_line(F.col("text")))
    merged = merge_fragments(lines, entity, index, config.merge_gap)
    clean = once(merged, text=T.tidy(T.strip_fillers(F.col("text"), F.col("lang")))).filter(~T.unrecoverable(F.col("text")))
    scored = written(once(clean, noise_score=T.noise_factors(F.col("text"), F.col("lang"))["total"]), "cleaner-scored")
    quiet = drop_windowed(scored.filter(F.col("noise_score") <= config.max_noise), entity, ["start", "idx"], "text", config.threshold)
    stage = F.when(~F.col("kept"), "duplicate").when(F.length("text") < config.min_chars, "short").otherwise("kept")
    return quiet.withColumn("stage", stage).drop("kept").unionByName(scored.filter(F.col("noise_score") > config.max_noise).withColumn("stage", F.lit("noise")))


def clean(df: DataFrame, entity: str, index: str, text: str, start: str, duration: str, config: Config = Config()) -> DataFrame:
    """``entity, idx, text, start_sec, end_sec, noise_score, original_count`` of the lines that survive."""
    s = staged(df, entity, index, text, start, duration, config).filter("stage = 'kept'")
    return s.select(entity, "idx", "text", F.col("start").alias("start_sec"), F.col("end").alias("end_sec"), "noise_score", "original_count")


def stats(df: DataFrame, staged_: DataFrame, entity: str) -> DataFrame:
    """Counts per entity: input, output, removed as noise or duplicate, merged fragments, output per input."""
    before = df.groupBy(entity).agg(F.count(F.lit(1)).alias("input_segments"))
    count = lambda k: F.sum(F.when(F.col("stage") == k, 1).otherwise(0))
    after = staged_.groupBy(entity).agg(
        count("kept").alias("output_segments"), count("noise").alias("removed_noise"), count("duplicate").alias("removed_duplicates"), F.sum(F.col("original_count") - 1).alias("merged_count")
    )
    zero = ["output_segments", "removed_noise", "removed_duplicates", "merged_count"]
    return before.join(after, entity, "left").na.fill(0, zero).withColumn("compression_ratio", F.col("output_segments") / F.col("input_segments"))
