"""Caption formats and source selection: WebVTT, timed JSON events, preferred languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

#: What an error message of a blocked source holds.
BLOCKED = r"403|429|ip|block|cloud|sign in|bot"
_CLOCK = r"(\d{2,}):(\d{2}):(\d{2}(?:\.\d+)?)"


def _clock(line: Column, which: int) -> Column:
    part = lambda g: F.get(F.regexp_extract_all(line, F.lit(_CLOCK), F.lit(g)), F.lit(which))
    return part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double")


def parse_vtt(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key, idx, text, start, duration`` of the cues. A cue needs two clocks with hours; tags go, its lines are joined, empty cues are left out."""
    blocks = df.select(key, F.posexplode(F.split(F.regexp_replace(content, r"\r\n?", "\n"), r"\n\n+")).alias("block", "b"))
    lines = blocks.select(key, "block", F.split("b", "\n").alias("ls"))
    at = F.array_position(F.transform("ls", lambda x: F.contains(x, F.lit("-->"))), True).cast("int")
    cue = lines.withColumn("at", at).filter("at > 0").withColumn("line", F.element_at("ls", F.col("at")))
    cue = cue.filter(F.size(F.regexp_extract_all("line", F.lit(_CLOCK), F.lit(0))) >= 2)
    rest = F.slice("ls", F.col("at") + 1, F.greatest(F.size("ls") - F.col("at"), F.lit(0)))
    text = T.strip(F.regexp_replace(F.array_join(F.filter(rest, lambda x: T.strip(x) != ""), " "), r"<[^>]+>", ""))
    start, end = _clock(F.col("line"), 0), _clock(F.col("line"), 1)
    found = cue.select(key, "block", text.alias("text"), start.alias("start"), (end - start).alias("duration")).filter("text <> ''")
    return found.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("block")) - 1).select(key, "idx", "text", "start", "duration")


def parse_events(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key, idx, text, start, duration`` of a JSON document's events; times are milliseconds there."""
    schema = "struct<events: array<struct<tStartMs: double, dDurationMs: double, segs: array<struct<utf8: string>>>>>"
    e = df.select(key, F.posexplode(F.from_json(content, schema)["events"]).alias("pos", "e"))
    text = T.strip(F.array_join(F.transform(F.coalesce("e.segs", F.array().cast("array<struct<utf8:string>>")), lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    found = e.select(key, "pos", text.alias("text"), (F.coalesce("e.tStartMs", F.lit(0.0)) / 1000).alias("start"), (F.coalesce("e.dDurationMs", F.lit(0.0)) / 1000).alias("duration")).filter("text <> ''")
    return found.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).select(key, "idx", "text", "start", "duration")


def language_rank(lang: Column) -> Column:
    """Japanese before English before the rest."""
    low = F.lower(F.coalesce(lang, F.lit("")))
    return F.when(low.startswith("ja"), 0).when(low.startswith("en"), 1).otherwise(2)


def preferred(df: DataFrame, key: str, lang: str) -> DataFrame:
    """``key, lang_rank, chosen``: the best track of each key; of equal ranks the first in the alphabet."""
    return df.groupBy(key).agg(F.min(F.struct(language_rank(F.col(lang)).alias("r"), F.coalesce(lang, F.lit("")).alias("l"))).alias("m")).select(key, F.col("m.r").alias("lang_rank"), F.col("m.l").alias("chosen"))


def is_blocked(message: Column) -> Column:
    return F.lower(message).rlike(BLOCKED)


def first_track(tracks: DataFrame, key: str, source: str, lang: str, automatic: str, cues: str) -> DataFrame:
    """``key, source, lang, automatic`` of the track that is used: of the first source with any track of at least one cue the one of the best language, written by hand before automatic, then by name."""
    order = F.struct(F.col(source).alias("s"), language_rank(F.col(lang)).alias("r"), F.coalesce(F.col(automatic), F.lit(False)).alias("a"), F.coalesce(lang, F.lit("")).alias("l"))
    return tracks.filter(F.col(cues) > 0).groupBy(key).agg(F.min(order).alias("m")).select(key, F.col("m.s").alias(source), F.col("m.l").alias(lang), F.col("m.a").alias(automatic))


def fetch_outcome(text: Column, message: Column) -> Column:
    """``found``, ``blocked`` or ``missing`` for a source's text or error message."""
    return F.when(F.coalesce(text, F.lit("")) != "", "found").when(is_blocked(F.coalesce(message, F.lit(""))), "blocked").otherwise("missing")


def titled(details: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """``details`` with the ``title`` of the search result of its key; empty where there is none."""
    one = titles.groupBy(key).agg(F.max("title").alias("_t"))
    return details.drop("title").join(one, key, "left").withColumn("title", F.coalesce("_t", F.lit(""))).drop("_t")


def eligible_videos(df: DataFrame, longest: int = 3600) -> DataFrame:
    """Videos with an 11-character id and a duration of at most an hour; missing durations count as 0, missing titles as empty."""
    one = df.groupBy("video_id").agg(F.max(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("duration", F.lit(0)).alias("duration"))).alias("m"))
    return one.select("video_id", "m.title", "m.duration").filter((F.length("video_id") == 11) & (F.col("duration") <= longest))
