"""Queries of the caption, retrieval and knowledge operators over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.once import once
from weftline.operators import cache, cleaner, dedup, folds, knowledge, retrieval
from weftline.sources import captions
from weftline.sources.tables import latest, table

#: Fixed questions: what texts are compressed and attended for.
QUESTIONS = [
    (1, "how many watts does the canvas tarp need"),
    (2, "what is the difference between the drum sander and the kiln shelf"),
    (3, "risks of the water pump on a cold morning"),
    (4, "why should the fuse box never touch the rope ladder the the"),
]
_TYPES_SQL = "dim(ord, ktype, title) AS (VALUES " + ", ".join(f"({k}, '{t}', '{s}')" for k, (t, s) in enumerate(knowledge.TYPES)) + ")"
BUDGET = 6000
#: Tokens of a brief in the queries: small, so that the tables' short objects meet the limit.
BRIEF_BUDGET = 600


_SPACE = r"\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}"
_LETTER = r"\pL\pM\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}"


def _words_sql(c: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[{_SPACE}]+'), lambda x: x <> '')"


def _trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _without_phrases_sql(c: str, phrases: list[str]) -> str:
    """Whole phrases removed whatever their case. Words are set between two signs first, for DuckDB's word boundary knows ASCII only."""
    marked = f"regexp_replace({c}, '([{_LETTER}]+)', chr(2) || '\\1' || chr(3), 'g')"
    inner = "|".join(p.replace(" ", "\\x03 \\x02") for p in phrases)
    return f"regexp_replace(regexp_replace({marked}, '\\x02(?i:{inner})\\x03', '', 'g'), '[\\x02\\x03]', '', 'g')"


def _caption_sql(c: str) -> str:
    line = r"[^\n\r\x{85}\x{2028}\x{2029}]*?"
    for rx in (rf"\[{line}\]", rf"\({line}\)", f"♪{line}♪", "&amp;|&lt;|&gt;", "<[^>]+>", f"[{_SPACE}]{{2,}}"):
        c = f"regexp_replace({c}, '{rx}', ' ', 'g')"
    return _trim_sql(_without_phrases_sql(c, T.CAPTION_FILLERS))


def _compress_sql(c: str) -> str:
    phrases = ["as i said", "as i mentioned", "as i was saying", "like i said", "you know what i mean", "let me tell you", "let me show you", "so basically", "anyway", "alright so"]
    return _trim_sql(f"regexp_replace({_without_phrases_sql(c, phrases)}, '[{_SPACE}]{{2,}}', ' ', 'g')")


def _dense_sql(c: str, terms: list[str]) -> str:
    """Sentences of ``c`` that share enough words with the terms, or are short."""
    parts = f"string_split(regexp_replace({c}, '([.!?])[{_SPACE}]+', '\\1' || chr(1), 'g'), chr(1))"
    w = _words_sql("s")
    keep = f"len({w}) > 0 AND (len(list_intersect(list_distinct({w}), {terms})) / len(list_distinct({w})) >= 0.05 OR len({w}) < 6)"
    kept = f"list_filter({parts}, lambda s: {keep})"
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE {c} END"


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """The stated queries of the searches: the requests whose id is divisible by 20, without those of null or blank text."""
    asked = _log(spark, folder, "query_text").filter((F.col("request_id") % 20 == 0) & (T.word_count(F.col("query_text")) > 0))
    return asked.select(F.col("request_id").alias("qid"), F.col("query_text").alias("q"))


def _objects(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row per object id with ``columns`` (all, if none are named), types in lower case."""
    one = latest(table(spark, folder, "knowledge_objects"), ["id"], ["content", "ktype", "confidence", "ts_sec"], columns)
    return one.withColumn("ktype", F.lower("ktype")) if "ktype" in one.columns else one


_OBJECTS_SQL = """objects AS (SELECT id, lower(ktype) AS ktype, content, entities, confidence, video_id, ts_sec, lang FROM
  (SELECT *, row_number() OVER (PARTITION BY id ORDER BY content DESC NULLS LAST) AS rn FROM knowledge_objects) WHERE rn = 1)"""


def _raw(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return latest(table(spark, folder, "raw_segments"), ["video_id", "idx"], ["ingested_at"], columns)


_RAW_SQL = "raw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, idx ORDER BY ingested_at DESC) AS rn FROM raw_segments) WHERE rn = 1)"

Q: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- sources ---------------------------------------------------------------------------------------------------------
@query(
    """SELECT video_id, title, duration FROM (
      SELECT video_id, coalesce(title, '') AS title, coalesce(duration, 0) AS duration,
        row_number() OVER (PARTITION BY video_id ORDER BY coalesce(title, '') DESC, coalesce(duration, 0) DESC) AS rn FROM videos)
    WHERE rn = 1 AND length(video_id) = 11 AND duration <= 3600"""
)
def video_filter(spark, folder):
    return captions.eligible_videos(table(spark, folder, "videos"))


@query(
    """SELECT DISTINCT video_id, CASE WHEN duration IS NULL OR duration < 0 THEN 0 ELSE duration END AS seconds FROM videos"""
)
def iso_durations(spark, folder):
    d = F.greatest(F.coalesce("duration", F.lit(0)), F.lit(0))
    iso = F.concat(F.lit("PT"), F.floor(d / 3600).cast("string"), F.lit("H"), (F.floor(d / 60) % 60).cast("string"), F.lit("M"), (d % 60).cast("string"), F.lit("S"))
    return table(spark, folder, "videos").select("video_id", T.iso_seconds(iso).alias("seconds")).distinct()


@query("SELECT DISTINCT video_id, video_id AS from_watch, video_id AS from_short, video_id AS from_bare, CAST(NULL AS VARCHAR) AS from_text FROM videos WHERE length(video_id) = 11")
def video_ids(spark, folder):
    v = table(spark, folder, "videos").filter(F.length("video_id") == 11).select("video_id").distinct()
    host = "https://"
    return v.select(
        "video_id",
        T.video_id(F.concat(F.lit(host + "example.test/watch?a=1&v="), "video_id", F.lit("&t=3"))).alias("from_watch"),
        T.video_id(F.concat(F.lit(host + "youtu.be/"), "video_id", F.lit("?t=3"))).alias("from_short"),
        T.video_id(F.col("video_id")).alias("from_bare"),
        T.video_id(F.concat("video_id", F.lit(" and more"))).alias("from_text"),
    )


def _clock(c: Column) -> Column:
    ms = F.round(c * 1000).cast("bigint")
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(part(F.floor(ms / 3_600_000), 2), F.lit(":"), part(F.floor(ms / 60_000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit("."), part(ms % 1000, 3))


_DOCUMENT_SQL = "doc AS (SELECT video_id || '#' || CAST(idx // 40 AS VARCHAR) AS doc, idx, regexp_replace(text, '[\\x{00}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}<>-]+', ' ', 'g') AS t, start_sec, greatest(coalesce(duration, 0), 0) AS d FROM raw WHERE text IS NOT NULL)"


def _documents(spark, folder) -> DataFrame:
    """Forty captions each as a caption document's pieces: no markup, no line breaks."""
    text = F.regexp_replace("text", r"(?U)[\s\x00-\x20\x85<>\-]+", " ")
    return _raw(spark, folder, "text", "start_sec", "duration").filter(F.col("text").isNotNull()).select(
        F.concat("video_id", F.lit("#"), F.floor(F.col("idx") / 40).cast("string")).alias("doc"), "idx", text.alias("t"), "start_sec", F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.0)).alias("d")
    )


@query(
    f"""WITH {_RAW_SQL}, {_DOCUMENT_SQL}
    SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY idx) - 1 AS idx, trim(t) AS text, round(start_sec * 1000) / 1000 AS start, round(round((start_sec + d) * 1000) - round(start_sec * 1000)) / 1000 AS duration
    FROM doc WHERE trim(t) <> ''"""
)
def vtt_cues(spark, folder):
    cue = F.concat(_clock(F.col("start_sec")), F.lit(" --> "), _clock(F.col("start_sec") + F.col("d")), F.lit("\n<c>"), "t", F.lit("</c>"))
    doc = _documents(spark, folder).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("idx", cue.alias("cue")))).alias("cs"))
    content = F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("cs", lambda x: x["cue"]), "\n\n"))
    out = captions.parse_vtt(doc.select("doc", content.alias("content")), "doc", "content")
    return out.select("doc", "idx", "text", F.round("start", 3).alias("start"), F.round("duration", 3).alias("duration"))


@query(
    f"""WITH {_RAW_SQL}, {_DOCUMENT_SQL}
    SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY idx) - 1 AS idx, trim(t) AS text, round(start_sec * 1000) / 1000 AS start, round(d * 1000) / 1000 AS duration
    FROM doc WHERE trim(t) <> ''"""
)
def json_events(spark, folder):
    half = F.greatest(F.floor(F.length("t") / 2), F.lit(0)).cast("int")
    segs = F.array(F.struct(F.substring(F.col("t"), F.lit(1), half).alias("utf8")), F.struct(F.substring(F.col("t"), half + 1, F.length("t")).alias("utf8")))
    e = F.struct((F.round(F.col("start_sec") * 1000)).alias("tStartMs"), F.round(F.col("d") * 1000).alias("dDurationMs"), segs.alias("segs"))
    doc = _documents(spark, folder).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("idx", e.alias("e")))).alias("es"))
    content = F.to_json(F.struct(F.transform("es", lambda x: x["e"]).alias("events")))
    return captions.parse_events(doc.select("doc", content.alias("content")), "doc", "content")


@query(
    """SELECT video_id, lang_rank, chosen FROM (SELECT video_id,
        CASE WHEN lower(coalesce(lang, '')) LIKE 'ja%' THEN 0 WHEN lower(coalesce(lang, '')) LIKE 'en%' THEN 1 ELSE 2 END AS lang_rank, coalesce(lang, '') AS chosen,
        row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN lower(coalesce(lang, '')) LIKE 'ja%' THEN 0 WHEN lower(coalesce(lang, '')) LIKE 'en%' THEN 1 ELSE 2 END, coalesce(lang, '')) AS rn
      FROM segments) WHERE rn = 1"""
)
def preferred_language(spark, folder):
    return captions.preferred(table(spark, folder, "segments"), "video_id", "lang")


# --- knowledge store -------------------------------------------------------------------------------------------------
@query(f"WITH {_OBJECTS_SQL} SELECT video_id, ktype, count(*) AS n FROM objects GROUP BY video_id, ktype")
def type_counts(spark, folder):
    return _objects(spark, folder, "video_id", "ktype").groupBy("video_id", "ktype").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_OBJECTS_SQL} SELECT id, ktype, content, entities, confidence, video_id, ts_sec FROM objects WHERE video_id IN (SELECT video_id FROM query_log)")
def objects_of_video(spark, folder):
    asked = table(spark, folder, "query_log").select("video_id").distinct()
    wanted = latest(table(spark, folder, "knowledge_objects").join(asked, "video_id", "left_semi"), ["id"], ["content", "ktype", "confidence", "ts_sec"], ("ktype", "content", "entities", "confidence", "video_id", "ts_sec"))
    return wanted.withColumn("ktype", F.lower("ktype")).select("id", "ktype", "content", "entities", "confidence", "video_id", "ts_sec")


@query(f"WITH {_OBJECTS_SQL} SELECT id, content FROM objects WHERE ktype IN ('risk', 'metric')")
def objects_of_types(spark, folder):
    return _objects(spark, folder, "ktype", "content").filter(F.col("ktype").isin("risk", "metric")).select("id", "content")


@query(f"WITH {_OBJECTS_SQL}, {_TYPES_SQL} SELECT video_id, string_agg(o.ktype, ',' ORDER BY ord) AS types FROM (SELECT DISTINCT video_id, ktype FROM objects) o JOIN dim USING (ktype) GROUP BY video_id")
def types_by_video(spark, folder):
    dim = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(knowledge.TYPES)], "ord int, ktype string")
    rows = _objects(spark, folder, "video_id", "ktype").select("video_id", "ktype").distinct().join(F.broadcast(dim), "ktype")  # ten rows
    return rows.groupBy("video_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "ktype"))), lambda x: x["ktype"]), ",").alias("types"))


@query("SELECT DISTINCT video_id FROM videos v WHERE EXISTS (SELECT 1 FROM knowledge_objects k WHERE k.video_id = v.video_id)")
def indexed_videos(spark, folder):
    return table(spark, folder, "videos").select("video_id").distinct().join(table(spark, folder, "knowledge_objects"), "video_id", "left_semi")


@query("SELECT DISTINCT video_id FROM videos v WHERE NOT EXISTS (SELECT 1 FROM knowledge_objects k WHERE k.video_id = v.video_id)")
def unindexed_videos(spark, folder):
    return table(spark, folder, "videos").select("video_id").distinct().join(table(spark, folder, "knowledge_objects"), "video_id", "left_anti")


@query(f"WITH {_OBJECTS_SQL} SELECT id, CASE WHEN confidence > 0.9 THEN 'new' ELSE 'old' END AS version, content FROM objects")
def upserted_objects(spark, folder):
    o = _objects(spark, folder, "content", "confidence")
    old = o.select("id", F.lit("old").alias("version"), "content")
    return knowledge.upsert(old, o.filter("confidence > 0.9").select("id", F.lit("new").alias("version"), "content"))


@query(f"WITH {_OBJECTS_SQL} SELECT id, ktype || ': ' || content AS embedded_text, replace('ko_' || video_id, '-', '_') AS collection FROM objects WHERE content IS NOT NULL AND ktype IS NOT NULL")
def embedded_texts(spark, folder):
    o = _objects(spark, folder, "ktype", "content", "video_id").filter("content is not null and ktype is not null")
    return o.select("id", F.concat("ktype", F.lit(": "), "content").alias("embedded_text"), T.collection_name(F.concat(F.lit("ko_"), "video_id")).alias("collection"))


@query(f"WITH {_OBJECTS_SQL} SELECT id, to_json(coalesce(entities, []))::VARCHAR AS as_json, len(coalesce(entities, [])) AS n_entities FROM objects")
def entities_json(spark, folder):
    e = F.coalesce("entities", F.array().cast("array<string>"))
    j = F.to_json(e)
    return _objects(spark, folder, "entities").select("id", j.alias("as_json"), F.size(F.from_json(j, "array<string>")).alias("n_entities"))


@query(
    f"""WITH {_OBJECTS_SQL}, {_TYPES_SQL}, good AS (SELECT o.*, row_number() OVER (PARTITION BY video_id ORDER BY id) - 1 AS pos FROM objects o WHERE content IS NOT NULL AND video_id IS NOT NULL)
    SELECT video_id || '_' || CAST(pos AS VARCHAR) AS id, ktype, content, round(coalesce(confidence, 0.8), 6) AS confidence, round(coalesce(ts_sec, 0), 6) AS ts_sec
    FROM good WHERE ktype IN (SELECT ktype FROM dim) AND content <> ''"""
)
def parsed_answers(spark, folder):
    o = _objects(spark, folder, "ktype", "content", "entities", "confidence", "video_id", "ts_sec").filter("content is not null and video_id is not null")
    item = F.struct(F.col("ktype").alias("type"), F.col("content"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), "confidence", F.col("ts_sec").alias("timestamp"))
    raw = o.groupBy("video_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("id", item.alias("item")))), lambda x: x["item"])).alias("j"))
    answers = raw.select("video_id", F.concat(F.lit("Here is the list:\n```json\n"), "j", F.lit("\n```")).alias("raw"))
    return knowledge.parse_objects(answers, "video_id", "raw").select("id", "ktype", "content", F.round("confidence", 6).alias("confidence"), F.round("ts_sec", 6).alias("ts_sec"))


@query(
    f"""WITH {_OBJECTS_SQL}, {_TYPES_SQL} SELECT video_id, CAST(ord AS INTEGER) AS ord, row_number() OVER (PARTITION BY video_id, ktype ORDER BY ts_sec NULLS FIRST, id) AS position,
      '  [' || CAST(CAST(trunc(coalesce(ts_sec, 0)) AS BIGINT) AS VARCHAR) || 's] ' || coalesce(content, '') AS line FROM objects JOIN dim USING (ktype)"""
)
def inspector(spark, folder):
    return knowledge.inspect(_objects(spark, folder, "video_id", "ktype", "ts_sec", "content"), "video_id", "ktype", "ts_sec", "content", "id")


# --- cache -----------------------------------------------------------------------------------------------------------
def _log(spark, folder, *columns: str) -> DataFrame:
    return latest(table(spark, folder, "query_log"), ["request_id"], ["asked_at", "answer"], columns)


_LOG_SQL = "log AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY asked_at DESC, answer DESC NULLS LAST) AS rn FROM query_log) WHERE rn = 1)"
_KEY_SQL = "sha256(coalesce(video_id, 'search') || '::' || lower(regexp_replace(coalesce(query_text, ''), '^[\\s\\x{85}\\x{A0}\\x{3000}]+|[\\s\\x{85}\\x{A0}\\x{3000}]+$', '', 'g')))"


@query(f"WITH {_LOG_SQL} SELECT request_id, {_KEY_SQL} AS key FROM log")
def cache_keys(spark, folder):
    return _log(spark, folder, "video_id", "query_text").select("request_id", T.cache_key(F.coalesce("video_id", F.lit("search")), F.coalesce("query_text", F.lit(""))).alias("key"))


@query(
    f"""WITH {_LOG_SQL}, k AS (SELECT request_id, asked_at, {_KEY_SQL} AS key FROM log),
    p AS (SELECT request_id, asked_at, max(asked_at) OVER (PARTITION BY key ORDER BY asked_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS before FROM k)
    SELECT request_id, coalesce(before + INTERVAL 86400 SECOND > asked_at, false) AS hit FROM p"""
)
def cache_hits(spark, folder):
    log = _log(spark, folder, "video_id", "query_text", "answer", "asked_at")
    entries = cache.entries(log, "video_id", "query_text", ["answer"], "asked_at")
    asked = log.select("request_id", "asked_at", T.cache_key(F.coalesce("video_id", F.lit("search")), F.coalesce("query_text", F.lit(""))).alias("key"))
    return cache.lookup(asked, entries, "asked_at", ["answer"]).select("request_id", "hit")


@query(f"WITH {_LOG_SQL} SELECT count(*) AS entries, CAST(sum(length(coalesce(answer, ''))) AS BIGINT) AS bytes FROM log")
def cache_stats(spark, folder):
    return cache.stats(cache.entries(_log(spark, folder, "video_id", "query_text", "answer", "asked_at"), "video_id", "query_text", ["answer"], "asked_at"), F.length(F.coalesce("answer", F.lit(""))))


@query(f"WITH {_LOG_SQL}, k AS (SELECT {_KEY_SQL} AS key, cached FROM log) SELECT key, count(*) AS n FROM k WHERE key NOT IN (SELECT key FROM k WHERE cached) GROUP BY key")
def cache_invalidated(spark, folder):
    log = _log(spark, folder, "video_id", "query_text", "cached", "asked_at")
    entries = cache.entries(log, "video_id", "query_text", ["cached"], "asked_at")
    return cache.invalidate(entries, entries.filter("cached")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


# --- text ------------------------------------------------------------------------------------------------------------
@query(f"SELECT DISTINCT video_id, idx, CAST(len({_words_sql('text')}) AS INTEGER) AS n_words, CAST(trunc(len({_words_sql('text')}) * CAST(1.35 AS DOUBLE)) AS INTEGER) AS n_tokens FROM segments")
def token_estimates(spark, folder):
    return table(spark, folder, "segments").select("video_id", "idx", T.word_count(F.col("text")).alias("n_words"), T.token_estimate(F.col("text")).alias("n_tokens")).distinct()


@query(f"WITH {_RAW_SQL} SELECT video_id, idx, {_caption_sql('text')} AS text FROM raw")
def caption_clean(spark, folder):
    return _raw(spark, folder, "text").select("video_id", "idx", T.caption_clean(F.col("text")).alias("text"))


@query(f"WITH c AS (SELECT DISTINCT video_id, idx, {_compress_sql('text')} AS t FROM (SELECT DISTINCT video_id, idx, text FROM segments)) SELECT video_id, idx, {_dense_sql('t', QUESTIONS[1][1].split())} AS text FROM c")
def compressed_texts(spark, folder):
    terms = T.words(F.lit(QUESTIONS[1][1]))
    t = table(spark, folder, "segments").select("video_id", "idx", "text").distinct()
    return t.select("video_id", "idx", T.dense_sentences(T.compress(F.col("text")), terms).alias("text"))


@query(
    """SELECT id, CAST(pos - 1 AS INTEGER) AS pos, s AS sentence FROM (SELECT id, unnest(parts) AS s, generate_subscripts(parts, 1) AS pos FROM (
      SELECT DISTINCT id, string_split(regexp_replace(content, '([.!?])[\\s\\x{85}\\x{A0}\\x{3000}]+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM knowledge_objects WHERE content IS NOT NULL))"""
)
def sentence_split(spark, folder):
    ko = table(spark, folder, "knowledge_objects").filter("content is not null").select("id", "content").distinct()
    return ko.select("id", F.posexplode(T.sentences(F.col("content"))).alias("pos", "sentence"))


@query(
    f"""WITH {_OBJECTS_SQL} SELECT id, '[' || CAST(CAST(trunc(coalesce(ts_sec, 0)) AS BIGINT) AS VARCHAR) || 's] ' || coalesce(content, '') AS line FROM objects"""
)
def context_lines(spark, folder):
    return _objects(spark, folder, "ts_sec", "content").select("id", T.context_line(F.col("ts_sec"), F.col("content")).alias("line"))


@query("SELECT DISTINCT video_id, idx, '[' || CAST(CAST(round_even(start_sec, 0) AS BIGINT) AS VARCHAR) || 's–' || CAST(CAST(round_even(end_sec, 0) AS BIGINT) AS VARCHAR) || 's] ' || text AS line FROM cleaned_segments WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL AND text IS NOT NULL")
def chunk_lines(spark, folder):
    c = table(spark, folder, "cleaned_segments").filter("start_sec is not null and end_sec is not null and text is not null")
    return c.select("video_id", "idx", T.chunk_line(F.col("start_sec"), F.col("end_sec"), F.col("text")).alias("line")).distinct()


@query()
def normalized_lines(spark, folder):
    t = once(_raw(spark, folder, "text"), text=T.normalize_line(F.coalesce("text", F.lit(""))))
    return t.select("video_id", "idx", "text", T.script_language(F.col("text")).alias("lang"), T.unrecoverable(F.col("text")).alias("unrecoverable"))


@query(
    f"""WITH {_RAW_SQL}, s AS (SELECT video_id, idx, coalesce(text, '') AS t FROM raw), n AS (
      SELECT video_id, idx, t, len(regexp_extract_all(t, '[\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}]')) AS cjk,
        length(regexp_replace(t, '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', '', 'g')) AS solid FROM s)
    SELECT video_id, idx, CASE WHEN cjk / greatest(solid, 1) > 0.25 THEN 'ja' ELSE 'en' END AS lang, CASE WHEN solid = 0 THEN 1.0 WHEN solid < 4 THEN 0.95 WHEN solid < 8 THEN 0.6 WHEN solid < 12 THEN 0.25 ELSE 0 END AS penalty,
      CASE WHEN solid = 0 THEN 1.0 WHEN len(regexp_extract_all(t, '[\\pL\\pN]')) / solid >= 0.5 THEN 0.0 ELSE round((0.5 - len(regexp_extract_all(t, '[\\pL\\pN]')) / solid) * 2, 6) END AS symbols FROM n"""
)
def script_and_length(spark, folder):
    t = F.coalesce("text", F.lit(""))
    return _raw(spark, folder, "text").select("video_id", "idx", T.script_language(t).alias("lang"), T.length_penalty(t).alias("penalty"), F.round(T.symbol_noise(t), 6).alias("symbols"))


@query()
def noise_factors(spark, folder):
    rows = once(_raw(spark, folder, "text"), text=T.normalize_line(F.coalesce("text", F.lit(""))))
    rows = once(rows, lang=T.script_language(F.col("text")))
    return once(rows, n=T.noise_factors(F.col("text"), F.col("lang"))).select("video_id", "idx", *[F.round(f"n.{c}", 6).alias(c) for c in ("filler", "repetition", "length", "incompleteness", "symbols", "total")])


# --- folds -----------------------------------------------------------------------------------------------------------
@query(
    f"""WITH RECURSIVE {_RAW_SQL}, w AS (SELECT video_id, idx, list_distinct({_words_sql('t')}) AS ws FROM (SELECT video_id, idx, {_caption_sql('text')} AS t FROM raw)), s AS (SELECT video_id, idx, ws, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS n FROM w WHERE len(ws) > 0),
    f AS (SELECT video_id, idx, n, ws AS last, true AS kept FROM s WHERE n = 1
      UNION ALL SELECT s.video_id, s.idx, s.n,
        CASE WHEN len(list_intersect(f.last, s.ws)) / (len(f.last) + len(s.ws) - len(list_intersect(f.last, s.ws))) >= 0.85 THEN f.last ELSE s.ws END,
        NOT (len(list_intersect(f.last, s.ws)) / (len(f.last) + len(s.ws) - len(list_intersect(f.last, s.ws))) >= 0.85)
      FROM f JOIN s ON s.video_id = f.video_id AND s.n = f.n + 1)
    SELECT video_id, idx, row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1 AS new_idx FROM f WHERE kept"""
)
def consecutive_dedup(spark, folder):
    clean = once(_raw(spark, folder, "text"), text=T.caption_clean(F.col("text")))
    return folds.drop_consecutive(clean, "video_id", "idx", "text").select("video_id", "idx", "new_idx")


@query(
    f"""WITH RECURSIVE {_RAW_SQL}, w AS (SELECT video_id, idx, len({_words_sql('text')}) AS nw, start_sec, start_sec + greatest(coalesce(duration, 0), 0) AS e, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS n FROM raw),
    f AS (SELECT video_id, idx, n, nw, 0 AS chunk, nw AS buf FROM w WHERE n = 1
      UNION ALL SELECT w.video_id, w.idx, w.n, w.nw, f.chunk + CASE WHEN f.buf + w.nw > 120 THEN 1 ELSE 0 END, CASE WHEN f.buf + w.nw > 120 THEN f.nw + w.nw ELSE f.buf + w.nw END FROM f JOIN w ON w.video_id = f.video_id AND w.n = f.n + 1),
    o AS (SELECT video_id, chunk, n FROM f UNION ALL SELECT video_id, chunk, n - 1 FROM (SELECT *, row_number() OVER (PARTITION BY video_id, chunk ORDER BY n) AS k FROM f) WHERE k = 1 AND chunk > 0)
    SELECT video_id, CAST(chunk AS INTEGER) AS chunk_id, min_by(w.start_sec, o.n) AS chunk_start, max_by(w.e, o.n) AS chunk_end, count(*) AS n_segments, CAST(sum(w.nw) AS BIGINT) AS n_words
    FROM o JOIN w USING (video_id, n) GROUP BY video_id, chunk"""
)
def chunk_packing(spark, folder):
    r = _raw(spark, folder, "text", "start_sec", "duration").withColumn("end_sec", F.col("start_sec") + F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.0)))
    c = folds.pack_chunks(r, "video_id", "idx", "text", "start_sec", "end_sec")
    return c.select("video_id", "chunk_id", "chunk_start", "chunk_end", F.size("segment_indices").cast("bigint").alias("n_segments"), T.word_count(F.col("text")).cast("bigint").alias("n_words"))


def _lines(spark, folder) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return _raw(spark, folder, "text", "start_sec", "duration").select("video_id", "idx", t.alias("text"), F.col("start_sec").alias("start"), (F.col("start_sec") + F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.0))).alias("end"), T.script_language(t).alias("lang"))


@query()
def fragment_merge(spark, folder):
    return folds.merge_fragments(_lines(spark, folder).filter("text <> ''"), "video_id", "idx")


@query()
def window_dedup(spark, folder):
    return folds.drop_windowed(_lines(spark, folder).filter("text <> ''"), "video_id", ["start", "idx"], "text").select("video_id", "idx", "kept")


@query()
def cleaned_captions(spark, folder):
    return cleaner.clean(_raw(spark, folder, "text", "start_sec", "duration"), "video_id", "idx", "text", "start_sec", "duration")


@query()
def cleaner_stats(spark, folder):
    r = _raw(spark, folder, "text", "start_sec", "duration")
    return cleaner.stats(r, cleaner.staged(r, "video_id", "idx", "text", "start_sec", "duration"), "video_id")


def _greedy_sql(order: str, hit: str, columns: str) -> str:
    """The greedy pass as one recursion over the rows that are like an earlier one; ``hit`` decides on ``n_both, na, nb`` and the sources."""
    return f"""WITH RECURSIVE {_OBJECTS_SQL}, r AS (SELECT id, video_id, row_number() OVER (ORDER BY {order}) AS n, list_distinct({_words_sql('content')}) AS w FROM objects WHERE content IS NOT NULL),
      x AS (SELECT n, video_id, len(w) AS k, unnest(w) AS t FROM r), met AS (SELECT a.n AS a, b.n AS b, a.k AS na, b.k AS nb, a.video_id AS va, b.video_id AS vb, count(*) AS n_both FROM x a JOIN x b ON a.t = b.t AND a.n < b.n GROUP BY ALL),
      near AS MATERIALIZED (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS step FROM met WHERE {hit} GROUP BY b),
      f AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS gone UNION ALL
        SELECT near.step, CASE WHEN len(list_filter(near.before, lambda a: NOT list_contains(f.gone, a))) > 0 THEN list_append(f.gone, near.b) ELSE f.gone END FROM f JOIN near ON near.step = f.step + 1)
      SELECT {columns} FROM r WHERE n NOT IN (SELECT unnest(gone) FROM f WHERE step = (SELECT max(step) FROM f))"""


@query(_greedy_sql("id", "10 * n_both >= 7 * (na + nb - n_both)", "id"))
def greedy_dedup(spark, folder):
    return dedup.deduplicate(_objects(spark, folder, "content").filter("content is not null"), "content", [F.col("id")]).select("id")


@query(_greedy_sql("confidence DESC NULLS LAST, video_id NULLS FIRST, id", "4 * n_both > 3 * (na + nb - n_both) AND va IS DISTINCT FROM vb", "id, video_id"))
def merged_sources(spark, folder):
    order = [F.desc_nulls_last("confidence"), F.col("video_id"), F.col("id")]
    return dedup.merge_sources(_objects(spark, folder, "content", "confidence", "video_id").filter("content is not null"), "content", "video_id", order).select("id", "video_id")


# --- search ----------------------------------------------------------------------------------------------------------
_QUESTION_SQL = f"{_LOG_SQL}, questions AS (SELECT request_id AS qid, query_text AS q FROM log WHERE request_id % 20 = 0 AND len({_words_sql('query_text')}) > 0)"
_BM25_SQL = f"""{_OBJECTS_SQL}, {_QUESTION_SQL}, d AS (SELECT id, content, {_words_sql('content')} AS w FROM objects WHERE content IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
    tf AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(w) AS t FROM d) GROUP BY id, t), dfs AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    idf AS (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, st), m AS (SELECT avg(r) AS mean FROM idf),
    qt AS (SELECT qid, t, count(*) AS qf FROM (SELECT qid, unnest({_words_sql('q')}) AS t FROM questions) GROUP BY qid, t),
    bm AS (SELECT qid, tf.id, round(sum(qf * CASE WHEN r < 0 THEN 0.25 * mean ELSE r END * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len(d.w) / avgdl))), 8) AS score
      FROM qt JOIN idf USING (t) JOIN tf USING (t) JOIN d USING (id), m, st GROUP BY qid, tf.id)"""


def _bm25(spark, folder, k: int) -> DataFrame:
    docs = _objects(spark, folder, "content").filter("content is not null")
    return retrieval.bm25_best(docs, "id", "content", _questions(spark, folder), "qid", "q", k)


@query(f"WITH {_BM25_SQL} SELECT qid, id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 20")
def bm25_top(spark, folder):
    return _bm25(spark, folder, 20).withColumn("score", F.round("score", 5))


@query(
    f"""WITH {_BM25_SQL}, filled AS (SELECT questions.qid, d.id, coalesce(score, 0) AS score FROM questions CROSS JOIN d LEFT JOIN bm ON bm.qid = questions.qid AND bm.id = d.id)
    SELECT qid, id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM filled) WHERE rank <= 20"""
)
def bm25_filled(spark, folder):
    """The 20 best of all documents, those without a word of the question included."""
    docs, asked = _objects(spark, folder, "content").filter("content is not null"), _questions(spark, folder)
    best = retrieval.bm25_best(docs, "id", "content", asked, "qid", "q", 20)
    return retrieval.with_unmatched(best, docs, "id", asked, "qid", 20).withColumn("score", F.round("score", 5))


_VEC_SQL = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), q AS (SELECT vec_id AS qid, e AS qe, label AS ql FROM v WHERE vec_id % 20 = 0)"""


def _vectors(spark, folder) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as stated queries those whose id is divisible by 20."""
    v = table(spark, folder, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return v, v.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), "label")


@query(f"WITH {_VEC_SQL} SELECT qid, vec_id, round(s, 6) AS similarity, rank FROM (SELECT qid, vec_id, list_cosine_similarity(e, qe) AS s, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(e, qe), 10) DESC, vec_id) AS rank FROM v, q) WHERE rank <= 20")
def vector_top(spark, folder):
    v, q = _vectors(spark, folder)
    return retrieval.nearest(v, "vec_id", "embedding", q, "qid", "qv", 20).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_VEC_SQL} SELECT qid, vec_id, round(s, 6) AS similarity, rank FROM (SELECT qid, vec_id, list_cosine_similarity(e, qe) AS s, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(e, qe), 10) DESC, vec_id) AS rank FROM v JOIN q ON label = ql) WHERE rank <= 10")
def vector_top_by_label(spark, folder):
    v, q = _vectors(spark, folder)
    return retrieval.nearest(v, "vec_id", "embedding", q, "qid", "qv", 10, ["label"]).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_VEC_SQL} SELECT qid, vec_id, rank FROM (SELECT qid, vec_id, label, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(e, qe), 10) DESC, vec_id) AS rank FROM v, q) WHERE rank <= 40 AND label IN (SELECT label FROM v GROUP BY label HAVING label % 2 = 0)")
def nearest_then_semi(spark, folder):
    v, q = _vectors(spark, folder)
    pool = v.filter(F.col("label") % 2 == 0).select("vec_id")
    return retrieval.nearest(v, "vec_id", "embedding", q, "qid", "qv", 40).join(pool, "vec_id", "left_semi").select("qid", "vec_id", "rank")


_LISTS_SQL = f"""b AS (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 30),
    o AS (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM (SELECT qid, id, round(len(list_filter(w, lambda x: list_contains({_words_sql('q')}, x))) / len(w), 8) AS s FROM d, questions WHERE len(w) > 0) WHERE s > 0) WHERE rank <= 30),
    u AS (SELECT qid, id, 0 AS source, rank, 0.6 / (60 + rank) AS part FROM o UNION ALL SELECT qid, id, 1, rank, 0.4 / (60 + rank) FROM b)"""


#: Another ranking of the same objects, for fusion: confident objects that share words with the question.
def _by_overlap(spark, folder) -> DataFrame:
    o = _objects(spark, folder, "content").filter("content is not null")
    return retrieval.density_best(o, "id", "content", _questions(spark, folder), "qid", "q", 30)


@query(
    f"""WITH {_BM25_SQL}, {_LISTS_SQL},
    g AS (SELECT qid, id, sum(part) AS score, min(source) AS src, min_by(rank, source) AS r FROM u GROUP BY qid, id)
    SELECT qid, id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, src, r, id) AS rank FROM g) WHERE rank <= 15"""
)
def fused_top(spark, folder):
    return retrieval.fuse([(_by_overlap(spark, folder), "rank", 0.6), (_bm25(spark, folder, 30), "rank", 0.4)], "qid", "id").withColumn("score", F.round("score", 9))


def _attended(spark, folder) -> DataFrame:
    """Every chunk with its attention ``score``; an unknown noise score counts as full noise, an unknown bound as the middle. A video reaches to its latest known end."""
    c = table(spark, folder, "cleaned_segments").select("video_id", "idx", "text", "start_sec", "end_sec", "noise_score").distinct()
    total = c.groupBy("video_id").agg(F.max("end_sec").alias("total"))
    relevance = 1 - F.coalesce("noise_score", F.lit(1.0))
    score = retrieval.attention(relevance, F.col("text"), T.words(F.lit(QUESTIONS[1][1])), F.col("start_sec"), F.col("end_sec"), F.col("total"))
    return c.join(total, "video_id", "left").withColumn("score", score)


_ATTENDED_SQL = f"""c AS (SELECT DISTINCT video_id, idx, text, start_sec, end_sec, noise_score FROM cleaned_segments),
    t AS (SELECT video_id, max(end_sec) AS total FROM c GROUP BY video_id),
    attended AS (SELECT c.*, 1 - coalesce(noise_score, 1) + 0.15 * CASE WHEN len({_words_sql('text')}) > 0 THEN len(list_filter({_words_sql('text')}, lambda x: list_contains({QUESTIONS[1][1].split()}, x))) / len({_words_sql('text')}) ELSE 0 END
      + coalesce(CASE WHEN total > 0 THEN 0.4 * abs((start_sec + end_sec) / 2 / total - 0.5) END, 0) AS score FROM c LEFT JOIN t USING (video_id))"""


@query(f"WITH {_ATTENDED_SQL} SELECT video_id, idx, round(score, 6) AS attention FROM attended")
def attention_scores(spark, folder):
    return _attended(spark, folder).select("video_id", "idx", F.round("score", 6).alias("attention"))


def _token_sql(c: str) -> str:
    return f"CAST(trunc(len({_words_sql(c)}) * CAST(1.35 AS DOUBLE)) AS INTEGER)"


@query(
    f"""WITH RECURSIVE {_ATTENDED_SQL}, x AS (SELECT video_id, idx, {_dense_sql('z', QUESTIONS[1][1].split())} AS text, round(score, 9) AS score FROM (SELECT video_id, idx, {_compress_sql('text')} AS z, score FROM attended WHERE text IS NOT NULL)),
    r AS (SELECT video_id, idx, text, len({_words_sql('text')}) AS nw, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, idx) AS n FROM x WHERE text <> ''),
    f AS (SELECT video_id, n, idx, text, nw AS take, CAST(trunc(nw * CAST(1.35 AS DOUBLE)) AS INTEGER) AS tokens, CAST(trunc(nw * CAST(1.35 AS DOUBLE)) AS INTEGER) AS used, trunc(nw * CAST(1.35 AS DOUBLE)) >= {BUDGET} AS done FROM r WHERE n = 1
      UNION ALL SELECT video_id, n, idx, text, take, tokens, used + tokens, used + tokens >= {BUDGET} FROM (
        SELECT r.video_id, r.n, r.idx, r.text, f.used, CASE WHEN f.used + trunc(r.nw * CAST(1.35 AS DOUBLE)) <= {BUDGET} THEN r.nw ELSE CAST(trunc(({BUDGET} - f.used) * CAST(0.75 AS DOUBLE)) AS INTEGER) END AS take,
          CAST(trunc(CASE WHEN f.used + trunc(r.nw * CAST(1.35 AS DOUBLE)) <= {BUDGET} THEN r.nw ELSE trunc(({BUDGET} - f.used) * CAST(0.75 AS DOUBLE)) END * CAST(1.35 AS DOUBLE)) AS INTEGER) AS tokens
        FROM f JOIN r ON r.video_id = f.video_id AND r.n = f.n + 1 WHERE NOT f.done AND (f.used + trunc(r.nw * CAST(1.35 AS DOUBLE)) <= {BUDGET} OR {BUDGET} - f.used >= 30)))
    SELECT video_id, idx, CASE WHEN take < len({_words_sql('text')}) THEN array_to_string(list_filter(string_split_regex(text, '[{_SPACE}]+'), lambda w: w <> '')[1:take], ' ') ELSE text END AS text, tokens FROM f"""
)
def compressed_to_budget(spark, folder):
    """The chunks of each video, best attention first, compressed and cut to the budget."""
    terms = T.words(F.lit(QUESTIONS[1][1]))
    c, score = _attended(spark, folder).filter("text is not null"), F.round("score", 9)
    text = T.dense_sentences(T.compress(F.col("text")), terms)
    rows = c.select("video_id", "idx", (-score).alias("minus"), text.alias("text"))
    return folds.compress_to_budget(rows, ["video_id"], ["minus", "idx"], "text", BUDGET).select("video_id", "idx", "text", "tokens")


# --- intent, ranking, briefs -----------------------------------------------------------------------------------------
def _signal_sql(c: str) -> str:
    return ", ".join(f"len(regexp_extract_all({c}, '\\b(?:{rx})\\b')) AS c{k}" for k, (_, _, rx) in enumerate(knowledge.SIGNALS))


#: DuckDB's word boundary knows ASCII only; letters beyond it become one, so that boundaries are those of Unicode.
_ASCII_WORDS = "regexp_replace(lower(coalesce(query_text, '')), '[\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{2FF}\\x{370}-\\x{1FFF}\\x{3041}-\\x{3096}\\x{30A1}-\\x{30FA}\\x{30FC}-\\x{30FF}\\x{3400}-\\x{9FFF}]', 'x', 'g')"


def _intent_ctes(source: str, key: str, text: str) -> str:
    """``signals, scored, hinted, asked(key, ktype, score, rank)``: what each text of a table asks for."""
    names = list(dict.fromkeys(t for t, _, _ in knowledge.SIGNALS))
    parts = []
    for name in names:
        mine = [(k, w) for k, (t, w, _) in enumerate(knowledge.SIGNALS) if t == name]
        at = "CASE " + " ".join(f"WHEN c{k} > 0 THEN {k}" for k, _ in mine) + " ELSE 99 END"
        parts.append(f"SELECT {key}, '{name}' AS ktype, {' + '.join(f'c{k} * {w}' for k, w in mine)} AS score, {at} AS pos FROM signals")
    none = ", ".join(f"({k}, '{t}')" for k, t in enumerate(knowledge.NO_SIGNAL))
    return f"""signals AS (SELECT {key}, {_signal_sql(_ASCII_WORDS.replace("query_text", text))} FROM {source}), scored AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE score > 0),
      hinted AS (SELECT * FROM scored UNION ALL SELECT {key}, 'claim', 0.3, 100 FROM (SELECT DISTINCT {key} FROM scored) x WHERE NOT EXISTS (SELECT 1 FROM scored y WHERE y.{key} = x.{key} AND y.ktype = 'claim')
        UNION ALL SELECT {key}, t, 0.1, k FROM signals, (VALUES {none}) v(k, t) WHERE {key} NOT IN (SELECT {key} FROM scored)),
      asked AS (SELECT {key}, ktype, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(score, 6) DESC, pos) AS rank FROM hinted) WHERE rank <= 4)"""


@query(f"WITH {_LOG_SQL}, {_intent_ctes('log', 'request_id', 'query_text')} SELECT * FROM asked")
def question_intents(spark, folder):
    return knowledge.intents(_log(spark, folder, "query_text"), "request_id", "query_text")


def _ranked(spark, folder) -> DataFrame:
    """The best objects ranked for each stated question: lexical relevance in place of a model's similarity. A search over all videos knows no total length."""
    q = _questions(spark, folder)
    best = _bm25(spark, folder, 40)
    most = F.max("score").over(Window.partitionBy("qid"))
    cand = best.select("qid", "id", F.when(most > 0, F.col("score") / most).otherwise(0.0).alias("semantic"), F.col("rank").alias("cand"))
    types = knowledge.intents(q, "qid", "q").groupBy("qid").agg(F.collect_set("ktype").alias("types"))
    o = _objects(spark, folder, "video_id", "ktype", "content", "entities", "confidence", "ts_sec")
    rows = cand.join(o, "id").join(q, "qid").join(types, "qid")
    prior = F.coalesce(F.array_contains("types", F.col("ktype")), F.lit(False))
    score = knowledge.object_score(F.col("semantic"), prior, F.col("confidence"), F.col("entities"), T.words(F.col("q")), F.col("ts_sec"), F.lit(0.0))
    scored = rows.withColumn("score", F.round(score, 8)).withColumn("is_priority", prior)
    return retrieval.top_k(scored, ["qid"], [F.desc("score"), F.col("cand")], 40)


_LINE_SQL = "'[' || CAST(CAST(trunc(coalesce(ts_sec, 0)) AS BIGINT) AS VARCHAR) || 's] ' || coalesce(content, '')"
_RANKED_SQL = f"""{_BM25_SQL}, {_intent_ctes('questions', 'qid', 'q')}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS cand FROM bm) WHERE cand <= 40),
    rated AS (SELECT best.qid, best.cand, o.*, coalesce(o.ktype IN (SELECT ktype FROM asked WHERE asked.qid = best.qid), false) AS is_priority, list_distinct({_words_sql('q')}) AS qw, CASE WHEN max(best.score) OVER (PARTITION BY best.qid) > 0 THEN best.score / max(best.score) OVER (PARTITION BY best.qid) ELSE 0 END AS semantic,
        list_distinct(list_filter(string_split_regex(lower(coalesce(array_to_string(list_filter(entities, lambda e: e IS NOT NULL), ' '), '')), '[{_SPACE}]+'), lambda x: x <> '')) AS ew
      FROM best JOIN objects o ON o.id = best.id JOIN questions ON questions.qid = best.qid),
    placed AS (SELECT *, round(0.45 * semantic + 0.25 * CASE WHEN is_priority THEN 1.0 ELSE 0.2 END + 0.15 * coalesce(confidence, 0.8) + 0.10 * least(len(list_intersect(ew, qw)) / greatest(len(qw), 1), 1) + 0.05, 8) AS score FROM rated),
    ranked AS (SELECT qid, id, ktype, video_id, is_priority, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cand) AS rank, {_LINE_SQL} AS line FROM placed)"""


@query(f"WITH {_RANKED_SQL} SELECT qid, id, ktype, score, rank FROM ranked")
def ranked_objects(spark, folder):
    return _ranked(spark, folder).select("qid", "id", "ktype", "score", "rank")


def _ranked_lines(spark, folder) -> DataFrame:
    line = T.context_line(F.col("ts_sec"), F.col("content"))
    return _ranked(spark, folder).select("qid", "id", "ktype", "video_id", "is_priority", "rank", "score", line.alias("line"))


def _packed(spark, folder, rows: DataFrame | None = None) -> DataFrame:
    rows = _ranked_lines(spark, folder) if rows is None else rows
    return knowledge.assemble(rows, "qid", "is_priority", "rank", "line", BRIEF_BUDGET)


_PACKED_SQL = f"""{_RANKED_SQL}, queue AS (SELECT *, {_token_sql('line')} AS tok, row_number() OVER (PARTITION BY qid, is_priority ORDER BY rank) AS n, CASE WHEN is_priority THEN {int(BRIEF_BUDGET * 0.60)} ELSE {BRIEF_BUDGET - int(BRIEF_BUDGET * 0.60)} END AS cap FROM ranked),
    fit AS (SELECT qid, is_priority, n, CASE WHEN tok <= cap THEN tok ELSE 0 END AS used, tok <= cap AS taken FROM queue WHERE n = 1
      UNION ALL SELECT r.qid, r.is_priority, r.n, f.used + CASE WHEN f.used + r.tok <= r.cap THEN r.tok ELSE 0 END, f.used + r.tok <= r.cap FROM fit f JOIN queue r ON r.qid = f.qid AND r.is_priority = f.is_priority AND r.n = f.n + 1),
    packed AS (SELECT queue.*, CAST(used AS BIGINT) AS used FROM queue JOIN fit USING (qid, is_priority, n) WHERE taken)"""


@query(f"WITH RECURSIVE {_PACKED_SQL} SELECT qid, id, ktype, is_priority, rank, tok AS tokens, used FROM packed")
def budgeted_objects(spark, folder):
    return _packed(spark, folder).select("qid", "id", "ktype", "is_priority", "rank", "tokens", "used")


_BRIEF_SQL = f"""{_PACKED_SQL}, {_TYPES_SQL}, sections AS (SELECT qid, ord, title || chr(10) || string_agg('- ' || line, chr(10) ORDER BY rank) AS s FROM packed JOIN dim USING (ktype) GROUP BY qid, ord, title),
    brief AS (SELECT qid, string_agg(s, chr(10) || chr(10) ORDER BY ord) AS brief FROM sections GROUP BY qid)"""


@query(f"WITH RECURSIVE {_BRIEF_SQL} SELECT qid, brief FROM brief")
def briefs(spark, folder):
    return knowledge.render(_packed(spark, folder), "qid", "ktype", "rank", "line")


@query(
    f"""WITH RECURSIVE {_OBJECTS_SQL}, {_TYPES_SQL}, l AS (SELECT video_id, ktype IN ('risk', 'claim', 'metric', 'procedure') AS pri, id, CAST(trunc(len({_words_sql("'[' || CAST(CAST(trunc(coalesce(ts_sec, 0)) AS BIGINT) AS VARCHAR) || 's] ' || coalesce(content, '')")}) * CAST(1.35 AS DOUBLE)) AS INTEGER) AS tok, confidence FROM objects WHERE ktype IN (SELECT ktype FROM dim)),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id, pri ORDER BY confidence DESC NULLS LAST, id) AS n, CASE WHEN pri THEN 180 ELSE 120 END AS cap FROM l),
    f AS (SELECT video_id, pri, id, n, tok, cap, CASE WHEN tok <= cap THEN tok ELSE 0 END AS used, tok <= cap AS taken FROM r WHERE n = 1
      UNION ALL SELECT r.video_id, r.pri, r.id, r.n, r.tok, r.cap, f.used + CASE WHEN f.used + r.tok <= r.cap THEN r.tok ELSE 0 END, f.used + r.tok <= r.cap FROM f JOIN r ON r.video_id = f.video_id AND r.pri = f.pri AND r.n = f.n + 1)
    SELECT id, tok AS tokens, CAST(used AS BIGINT) AS used FROM f WHERE taken"""
)
def first_fit_by_video(spark, folder):
    dim = [t for t, _ in knowledge.TYPES]
    o = _objects(spark, folder, "video_id", "ktype", "content", "ts_sec", "confidence").filter(F.col("ktype").isin(*dim)).withColumn("pri", F.col("ktype").isin("risk", "claim", "metric", "procedure"))
    rows = o.select("video_id", "pri", "id", T.context_line(F.col("ts_sec"), F.col("content")).alias("line"), (-F.coalesce("confidence", F.lit(-1e9))).alias("minus"))
    sized = rows.withColumn("tokens", T.token_estimate(F.col("line"))).withColumn("cap", F.when(F.col("pri"), 180).otherwise(120))
    return folds.first_fit(sized.drop("line"), ["video_id", "pri"], ["minus", "id"], "tokens", "cap").filter("taken").select("id", "tokens", "used")


# --- extensions on events --------------------------------------------------------------------------------------------
@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_events(spark, folder):
    e = table(spark, folder, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.col("w.start").alias("window_start"), "event_type", "n")


QUERIES = Q
