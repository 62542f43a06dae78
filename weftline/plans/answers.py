"""Queries of prompts, answer records, costs, displays and sinks over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import knowledge, prompts, providers, retrieval, sinks
from weftline.plans import library as L
from weftline.session import written
from weftline.sources import captions
from weftline.sources.tables import latest, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Prices per million tokens and the exchange rate of the queries; parameters of the operator.
PRICES = (3.0, 15.0, 150.0)
#: Captions of one extraction prompt.
PART = 200


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- sources ---------------------------------------------------------------------------------------------------------
@query(
    """SELECT video_id, source, lang, automatic FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY source, rk, automatic, lang) AS rn FROM (
      SELECT video_id, idx % 3 AS source, coalesce(lang, '') AS lang, idx % 2 = 1 AS automatic, CASE WHEN lower(coalesce(lang, '')) LIKE 'ja%' THEN 0 WHEN lower(coalesce(lang, '')) LIKE 'en%' THEN 1 ELSE 2 END AS rk,
        sum(CASE WHEN length(trim(text)) > 0 THEN 1 ELSE 0 END) AS cues FROM segments GROUP BY ALL) WHERE cues > 0) WHERE rn = 1"""
)
def first_tracks(spark, folder):
    """Segments dealt to three sources and two kinds stand for tracks."""
    t = table(spark, folder, "segments").groupBy("video_id", (F.col("idx") % 3).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), (F.col("idx") % 2 == 1).alias("automatic")).agg(F.sum(F.when(F.length(F.trim("text")) > 0, 1).otherwise(0)).alias("cues"))
    return captions.first_track(t, "video_id", "source", "lang", "automatic", "cues")


@query(
    f"""WITH {L._LOG_SQL} SELECT request_id, CASE WHEN coalesce(answer, '') <> '' THEN 'found' WHEN regexp_matches(lower(coalesce(query_text, '')), '403|429|ip|block|cloud|sign in|bot') THEN 'blocked' ELSE 'missing' END AS outcome FROM log"""
)
def fetch_outcomes(spark, folder):
    return L._log(spark, folder, "query_text", "answer").select("request_id", captions.fetch_outcome(F.col("answer"), F.col("query_text")).alias("outcome"))


@query("SELECT k.video_id, coalesce(t.title, '') AS title, k.n FROM (SELECT video_id, count(*) AS n FROM knowledge_objects GROUP BY video_id) k LEFT JOIN (SELECT video_id, max(title) AS title FROM videos GROUP BY video_id) t USING (video_id)")
def titled_videos(spark, folder):
    n = table(spark, folder, "knowledge_objects").groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    return captions.titled(n, table(spark, folder, "videos").select("video_id", "title"), "video_id").select("video_id", "title", "n")


@query(f"WITH {L._RAW_SQL} SELECT video_id, start_sec + greatest(coalesce(duration, 0), 0) AS total FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx DESC) AS k FROM raw WHERE start_sec IS NOT NULL) WHERE k = 1")
def total_durations(spark, folder):
    """A video ends where its last segment ends, not where the latest does."""
    r = L._raw(spark, folder, "start_sec", "duration").filter("start_sec is not null")
    end = F.col("start_sec") + F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.0))
    return r.groupBy("video_id").agg(F.max_by(end, "idx").alias("total"))


# --- costs -----------------------------------------------------------------------------------------------------------
def _cost_sql(n: str, m: str, scale: str, digits: int) -> str:
    return f"floor((coalesce({n}, 0) * CAST({PRICES[0]} AS DOUBLE) + coalesce({m}, 0) * CAST({PRICES[1]} AS DOUBLE)) * {scale} / 1e{6 - digits} + 0.5) / 1e{digits}"


@query(f"WITH {L._LOG_SQL} SELECT request_id, {_cost_sql('input_tokens', 'output_tokens', '1', 5)} AS usd, {_cost_sql('input_tokens', 'output_tokens', f'CAST({PRICES[2]} AS DOUBLE)', 2)} AS local FROM log")
def request_costs(spark, folder):
    c = prompts.cost(F.col("input_tokens"), F.col("output_tokens"), *PRICES)
    return L._log(spark, folder, "input_tokens", "output_tokens").select("request_id", c.alias("c")).select("request_id", "c.usd", "c.local")


@query(f"WITH {L._LOG_SQL} SELECT video_id, count(*) AS requests, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens, {_cost_sql('sum(coalesce(input_tokens, 0))', 'sum(coalesce(output_tokens, 0))', '1', 5)} AS usd FROM log GROUP BY video_id")
def cost_totals(spark, folder):
    n, m = F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    g = L._log(spark, folder, "video_id", "input_tokens", "output_tokens").groupBy("video_id").agg(F.count(F.lit(1)).alias("requests"), F.sum(n).cast("bigint").alias("input_tokens"), F.sum(m).cast("bigint").alias("output_tokens"))
    return g.withColumn("usd", prompts.cost(F.col("input_tokens"), F.col("output_tokens"), *PRICES)["usd"])


# --- prompts ---------------------------------------------------------------------------------------------------------
_TITLES_SQL = "titles AS (SELECT video_id, max(title) AS title FROM videos GROUP BY video_id)"


def _titles(spark, folder) -> DataFrame:
    return table(spark, folder, "videos").groupBy("video_id").agg(F.max("title").alias("title"))


@query(
    f"""WITH {L._ATTENDED_SQL}, {_TITLES_SQL}, top AS (SELECT video_id, start_sec, '[' || CAST(CAST(round_even(start_sec, 0) AS BIGINT) AS VARCHAR) || 's–' || CAST(CAST(round_even(end_sec, 0) AS BIGINT) AS VARCHAR) || 's] ' || text AS line
        FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(score, 8) DESC, idx, text) AS k FROM attended WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL AND text IS NOT NULL) WHERE k <= 12)
    SELECT video_id, CASE WHEN coalesce(max(title), '') <> '' THEN '## Video: ' || max(title) || chr(10) || chr(10) ELSE '' END || '## Transcript Excerpts' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY start_sec, line) || chr(10) || chr(10) || '## Question' || chr(10) || '{L.QUESTIONS[1][1]}' AS prompt
    FROM top LEFT JOIN titles USING (video_id) GROUP BY video_id"""
)
def excerpt_prompts(spark, folder):
    """The twelve chunks of most attention of each video, in order of time, as a prompt."""
    known = L._attended(spark, folder).filter("start_sec is not null and end_sec is not null and text is not null")
    top = retrieval.top_k(known, ["video_id"], [F.desc(F.round("score", 8)), F.col("idx"), F.col("text")], 12)
    return prompts.excerpt_prompt(top.join(_titles(spark, folder), "video_id", "left"), ["video_id"], "start_sec", "end_sec", "text", F.col("title"), F.lit(L.QUESTIONS[1][1]))


@query(
    f"""WITH s AS (SELECT DISTINCT video_id, idx, text FROM cleaned_segments WHERE text IS NOT NULL AND video_id IS NOT NULL AND idx IS NOT NULL), c AS (SELECT video_id, idx, idx // {PART} AS part, {L._compress_sql('text')} AS t FROM s)
    SELECT video_id, part, 'Extract all knowledge objects from this transcript.' || chr(10) || chr(10) || 'Source: YouTube video ' || video_id || chr(10) || chr(10) || 'TRANSCRIPT:' || chr(10) || string_agg(t, ' ' ORDER BY idx, t) || chr(10) || chr(10) || 'Output the JSON array now:' AS prompt
    FROM c WHERE t <> '' GROUP BY video_id, part"""
)
def extraction_prompts(spark, folder):
    """Prompts over parts of transcripts, so that no row grows with a video."""
    s = table(spark, folder, "cleaned_segments").select("video_id", "idx", "text").filter("text is not null and video_id is not null and idx is not null").distinct()
    c = s.select("video_id", "idx", F.floor(F.col("idx") / PART).alias("part"), T.compress(F.col("text")).alias("t")).filter("t <> ''")
    one = c.groupBy("video_id", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"]), " ").alias("body"))
    return one.select("video_id", "part", prompts.extraction_prompt(F.col("video_id"), F.col("body")).alias("prompt"))


_SOURCES_SQL = f"""firsts AS (SELECT qid, video_id, min(rank) AS rank FROM ranked WHERE video_id IS NOT NULL GROUP BY qid, video_id), named AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM firsts) WHERE k <= 3),
    sources AS (SELECT qid, string_agg(video_id, '+' ORDER BY k) AS search_id, string_agg(nullif(title, ''), ', ' ORDER BY k) AS title FROM named LEFT JOIN titles USING (video_id) GROUP BY qid)"""


def _sources(spark, folder, ranked: DataFrame) -> DataFrame:
    """``qid, search_id, title``: the three videos of the best objects, joined, and their titles."""
    firsts = ranked.filter("video_id is not null").groupBy("qid", "video_id").agg(F.min("rank").alias("at"))
    named = retrieval.top_k(firsts, ["qid"], [F.col("at")], 3, "k").join(_titles(spark, folder), "video_id", "left")
    listed = F.sort_array(F.collect_list(F.struct("k", "video_id", "title")))
    one = named.groupBy("qid").agg(listed.alias("l"))
    shown = F.filter(F.transform("l", lambda x: x["title"]), lambda t: t.isNotNull() & (t != ""))
    return one.select("qid", F.array_join(F.transform("l", lambda x: x["video_id"]), "+").alias("search_id"), F.when(F.size(shown) > 0, F.array_join(shown, ", ")).alias("title"))


@query(f"WITH RECURSIVE {L._RANKED_SQL}, {_TITLES_SQL}, {_SOURCES_SQL} SELECT qid, search_id, title FROM sources")
def search_sources(spark, folder):
    return _sources(spark, folder, L._ranked(spark, folder).select("qid", "video_id", "rank"))


_PROMPT_SQL = f"""{L._BRIEF_SQL}, {_TITLES_SQL}, {_SOURCES_SQL}, prompted AS (SELECT qid, search_id, CASE WHEN coalesce(title, '') <> '' THEN '# Knowledge Base: ' || title || chr(10) ELSE '' END || brief || chr(10) || chr(10) || '## Question' || chr(10) || q AS prompt, brief
    FROM brief JOIN questions USING (qid) LEFT JOIN sources USING (qid))"""


def _ranked(spark, folder) -> DataFrame:
    """The ranked objects, searched once and read as often as needed."""
    return written(L._ranked_lines(spark, folder), "ranked")


def _prompted(spark, folder, packed: DataFrame, ranked: DataFrame) -> DataFrame:
    brief = knowledge.render(packed, "qid", "ktype", "rank", "line")
    rows = brief.join(L._questions(spark, folder), "qid").join(_sources(spark, folder, ranked), "qid", "left")
    return rows.select("qid", "search_id", "q", "brief", prompts.brief_prompt(F.col("brief"), F.col("title"), F.col("q")).alias("prompt"))


@query(f"WITH RECURSIVE {_PROMPT_SQL} SELECT qid, prompt FROM prompted")
def knowledge_prompts(spark, folder):
    ranked = _ranked(spark, folder)
    return _prompted(spark, folder, L._packed(spark, folder, ranked), ranked).select("qid", "prompt")


@query(
    f"""WITH RECURSIVE {_PROMPT_SQL}, met AS (SELECT qid, ktype, count(*) AS n, min((CASE WHEN is_priority THEN 0 ELSE 1 END) * 1000 + rank) AS place FROM packed JOIN dim USING (ktype) GROUP BY qid, ktype),
      shown AS (SELECT qid, CAST(sum(n) AS BIGINT) AS n_objects, list(ktype ORDER BY place) AS types FROM met GROUP BY qid)
    SELECT qid, search_id, n_objects, array_to_string(types, ',') AS types, {L._token_sql('brief')} AS brief_tokens, {L._token_sql("'" + prompts.ANSWER_SYSTEM + "'")} + {L._token_sql('prompt')} AS context_tokens FROM prompted JOIN shown USING (qid)"""
)
def answer_records(spark, folder):
    """What is reported of an answer: objects and types used (priority types first, each as first met), tokens of brief and context."""
    ranked = _ranked(spark, folder)
    return _records(spark, folder, ranked, L._packed(spark, folder, ranked))


def _records(spark, folder, ranked: DataFrame, packed: DataFrame) -> DataFrame:
    dim = [t for t, _ in knowledge.TYPES]
    used = prompts.types_in_order(packed.filter(F.col("ktype").isin(*dim)).withColumn("later", ~F.col("is_priority")), "qid", "ktype", ["later", "rank"])
    p = _prompted(spark, folder, packed, ranked)
    return p.join(used, "qid").select(
        "qid", "search_id", "n_objects", F.array_join("types", ",").alias("types"), T.token_estimate(F.col("brief")).alias("brief_tokens"), (T.token_estimate(F.lit(prompts.ANSWER_SYSTEM)) + T.token_estimate(F.col("prompt"))).alias("context_tokens")
    )


@query()
def answers_json(spark, folder):
    """The whole pipeline of a search as one JSON record per question; a stand-in answers in place of a model."""
    ranked = _ranked(spark, folder)
    packed = written(L._packed(spark, folder, ranked), "packed")
    r = _records(spark, folder, ranked, packed)
    p = _prompted(spark, folder, packed, ranked).select("qid", "prompt")
    said = providers.with_answers(p.withColumn("system", F.lit(prompts.ANSWER_SYSTEM)), "system", "prompt", providers.Echo()).select("qid", "answer", "input_tokens", "output_tokens")
    rows = r.join(said, "qid").withColumn("cost", prompts.cost(F.col("input_tokens"), F.col("output_tokens"), *PRICES)).withColumn("cached", F.lit(False))
    return sinks.json_rows(rows, "qid")


# --- fusion by text --------------------------------------------------------------------------------------------------
@query(
    f"""WITH {L._BM25_SQL}, {L._LISTS_SQL}, g AS (SELECT qid, content AS text, sum(part) AS score, min(source * 1000 + rank) AS first FROM u JOIN d USING (id) GROUP BY qid, content)
    SELECT qid, text, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first, text) AS rank FROM g) WHERE rank <= 15"""
)
def fused_texts(spark, folder):
    """Fusion by text: objects of one text add up, within a list too."""
    o = L._objects(spark, folder, "content").filter("content is not null").select("id", F.col("content").alias("text"))
    lists = [(x.select("qid", "id", "rank").join(o, "id"), "rank", w) for x, w in ((L._by_overlap(spark, folder), 0.6), (L._bm25(spark, folder, 30), 0.4))]
    return retrieval.fuse(lists, "qid", "text").withColumn("score", F.round("score", 9))


# --- displays --------------------------------------------------------------------------------------------------------
@query(
    f"""WITH {L._OBJECTS_SQL} SELECT id, '[' || CAST(CAST(floor(coalesce(ts_sec, 0) + 0.5) AS BIGINT) AS VARCHAR) || 's]' AS at, round(coalesce(confidence, 0.8), 2) AS confidence, array_to_string(list_filter(coalesce(entities, []), lambda e: e IS NOT NULL)[1:4], ', ') AS named FROM objects"""
)
def object_cards(spark, folder):
    e = F.slice(F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda x: x.isNotNull()), 1, 4)
    at = F.concat(F.lit("["), F.floor(F.coalesce("ts_sec", F.lit(0.0)) + 0.5).cast("bigint").cast("string"), F.lit("s]"))
    return L._objects(spark, folder, "ts_sec", "confidence", "entities").select("id", at.alias("at"), F.round(F.coalesce("confidence", F.lit(0.8)), 2).alias("confidence"), F.array_join(e, ", ").alias("named"))


@query("SELECT DISTINCT video_id, coalesce(duration, 0) // 60 || 'm' || lpad(CAST(coalesce(duration, 0) % 60 AS VARCHAR), 2, '0') || 's' AS shown FROM videos WHERE coalesce(duration, 0) >= 0")
def video_cards(spark, folder):
    d = F.coalesce("duration", F.lit(0))
    shown = F.concat(F.floor(d / 60).cast("string"), F.lit("m"), F.lpad((d % 60).cast("string"), 2, "0"), F.lit("s"))
    return table(spark, folder, "videos").filter(d >= 0).select("video_id", shown.alias("shown")).distinct()


@query(
    f"""WITH RECURSIVE {L._PACKED_SQL}, {L._TYPES_SQL}, used AS (SELECT DISTINCT qid, ktype FROM packed JOIN dim USING (ktype)), videos_met AS (SELECT DISTINCT qid, video_id FROM ranked WHERE video_id IS NOT NULL)
    SELECT qid, o.ktype, count(*) AS n FROM videos_met JOIN objects o USING (video_id) JOIN used USING (qid, ktype) GROUP BY qid, o.ktype"""
)
def panel_counts(spark, folder):
    """Across the videos of a search, how many objects of each type that the brief holds: counted per video first, so no object meets a question."""
    dim = [t for t, _ in knowledge.TYPES]
    ranked = _ranked(spark, folder)
    used = L._packed(spark, folder, ranked).filter(F.col("ktype").isin(*dim)).select("qid", "ktype").distinct()
    met = ranked.filter("video_id is not null").select("qid", "video_id").distinct()
    per_video = L._objects(spark, folder, "video_id", "ktype").groupBy("video_id", "ktype").agg(F.count(F.lit(1)).alias("n"))
    return met.join(per_video, "video_id").join(used, ["qid", "ktype"], "left_semi").groupBy("qid", "ktype").agg(F.sum("n").alias("n"))


@query("SELECT video_id, CAST(sum(n) AS BIGINT) AS total, string_agg(ktype || '=' || n, ',' ORDER BY ktype) AS by_type FROM (SELECT video_id, lower(ktype) AS ktype, count(DISTINCT id) AS n FROM knowledge_objects WHERE ktype IS NOT NULL GROUP BY ALL) GROUP BY video_id")
def extraction_stats(spark, folder):
    """Objects of a video in total and by type, as a route reports them."""
    n = table(spark, folder, "knowledge_objects").filter("ktype is not null").select("video_id", F.lower("ktype").alias("ktype"), "id").distinct().groupBy("video_id", "ktype").agg(F.count("id").alias("n"))
    listed = F.sort_array(F.collect_list(F.struct("ktype", "n")))
    return n.groupBy("video_id").agg(F.sum("n").alias("total"), F.array_join(F.transform(listed, lambda x: F.concat(x["ktype"], F.lit("="), x["n"].cast("string"))), ",").alias("by_type"))


@query("SELECT video_id || '_' || CAST(idx AS VARCHAR) AS chunk_key, max(text) AS text FROM cleaned_segments WHERE video_id IS NOT NULL AND idx IS NOT NULL GROUP BY 1")
def chunk_records(spark, folder):
    """Chunks under the keys they are stored by."""
    c = latest(table(spark, folder, "cleaned_segments").filter("video_id is not null and idx is not null"), ["video_id", "idx"], ["text"], ("text",))
    return c.select(sinks.chunk_ids("video_id", "idx").alias("chunk_key"), "text")
