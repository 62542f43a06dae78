"""Typed knowledge objects: parsing, storing, intent, ranking and briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.folds import first_fit
from weftline.operators.retrieval import top_k

#: Types in their order with the section titles of a brief.
TYPES = [
    ("claim", "## Key Claims"), ("procedure", "## Procedures / Steps"), ("comparison", "## Comparisons"), ("constraint", "## Constraints & Preconditions"), ("risk", "## Risks & Failure Modes"),
    ("metric", "## Metrics & Numbers"), ("principle", "## Principles & Rules"), ("relationship", "## Relationships"), ("definition", "## Definitions"), ("example", "## Examples"),
]
#: Words that tell what a question asks for, in order of ties.
SIGNALS = [
    ("metric", 1.0, r"how (?:much|many|fast|accurate|often)|performance|benchmark|score|rate|percent|number|count|speed|cost|price|size"),
    ("metric", 0.6, r"\d+"),
    ("procedure", 1.0, r"how to|steps?|process|procedure|method|implement|build|create|set up|install|configure|workflow"),
    ("comparison", 1.0, r"vs\.?|versus|compare|difference|better|worse|pros?|cons?|advantage|disadvantage|alternative|between"),
    ("constraint", 1.0, r"require[sd]?|requirements?|need[sd]?|prerequisite|limitation|condition|only (?:works?|when)|must have"),
    ("risk", 1.0, r"risks?|dangers?|fail(?:ure)?s?|problems?|issues?|bugs?|errors?|warn(?:ing)?s?|avoid|pitfall|caveat|don.?t|shouldn.?t|careful"),
    ("principle", 1.0, r"best practice|rule|principle|always|never|should|recommend|guideline|pattern"),
    ("relationship", 0.8, r"relation|connect|depend|enable|cause|affect|impact|between|interaction|role"),
    ("definition", 1.0, r"what is|what are|define|definition|mean|explain|describe"),
    ("claim", 0.8, r"why|because|reason|result|consequence|effect|outcome"),
]
#: The order of types for a question without any signal.
NO_SIGNAL = ["claim", "principle", "definition", "comparison", "metric", "procedure", "constraint", "risk", "relationship", "example"]


def parse_objects(df: DataFrame, video: str, raw: str) -> DataFrame:
    """``id, ktype, content, entities, confidence, video_id, ts_sec`` from a model's JSON answer.

    Code fences and prose around the array are tolerated; items that are no
    object, have an unknown type or blank content are dropped, but count in the
    ids; missing or unusable confidence, time and entities get 0.8, 0 and none.
    A root that is no array has no items.
    """
    bare = F.regexp_replace(T.strip(F.col(raw)), r"(?s)^```[a-z]*\s*|\s*```$", "")
    strict = F.try_parse_json(bare)
    sliced = F.try_parse_json(F.regexp_extract(bare, r"(?s)\[.*\]", 0))
    base = df.select(F.col(video).alias("video_id"), F.coalesce(strict, sliced).alias("v")).filter(F.schema_of_variant("v").startswith("ARRAY"))
    items = base.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select("video_id", "pos", "value")
    value = F.col("value")
    content = T.strip(F.try_variant_get(value, "$.content", "string"))
    return items.filter(F.schema_of_variant(value).startswith("OBJECT")).select(
        F.concat_ws("_", "video_id", F.col("pos").cast("string")).alias("id"),
        F.try_variant_get(value, "$.type", "string").alias("ktype"),
        content.alias("content"),
        F.coalesce(F.try_variant_get(value, "$.entities", "array<string>"), F.array().cast("array<string>")).alias("entities"),
        F.coalesce(F.try_variant_get(value, "$.confidence", "double"), F.lit(0.8)).alias("confidence"),
        "video_id",
        F.coalesce(F.try_variant_get(value, "$.timestamp", "double"), F.lit(0.0)).alias("ts_sec"),
    ).filter(F.col("ktype").isin(*[t for t, _ in TYPES]) & (F.col("content") != ""))


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace rows of ``existing`` with their key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new.select(*existing.columns))


def intents(queries: DataFrame, query_key: str, query: str, top: int = 4) -> DataFrame:
    """``query_key, ktype, score, rank``: the types a question asks for."""
    q = F.lower(F.coalesce(F.col(query), F.lit("")))
    counts = [F.regexp_count(q, F.lit(rf"\b(?:{rx})\b")) for _, _, rx in SIGNALS]
    names = list(dict.fromkeys(t for t, _, _ in SIGNALS))
    rows = queries.select(query_key, *[c.alias(f"c{k}") for k, c in enumerate(counts)])
    per_type = []
    for n, name in enumerate(names):
        mine = [(k, w) for k, (t, w, _) in enumerate(SIGNALS) if t == name]
        score = sum((F.col(f"c{k}") * w for k, w in mine), F.lit(0.0))
        # Of equal scores the type whose first matching rule comes first leads.
        at = F.coalesce(*[F.when(F.col(f"c{k}") > 0, F.lit(k)) for k, _ in mine], F.lit(99))
        per_type.append(F.struct(score.alias("score"), at.alias("at"), F.lit(name).alias("ktype")))
        del n
    listed = rows.select(query_key, F.array(*per_type).alias("all")).withColumn("hit", F.filter("all", lambda x: x["score"] > 0))
    base = F.when(F.exists("hit", lambda x: x["ktype"] == "claim"), F.col("hit")).otherwise(F.concat("hit", F.array(F.struct(F.lit(0.3).alias("score"), F.lit(100).alias("at"), F.lit("claim").alias("ktype")))))
    none = F.array(*[F.struct(F.lit(0.1).alias("score"), F.lit(k).alias("at"), F.lit(t).alias("ktype")) for k, t in enumerate(NO_SIGNAL)])
    chosen = listed.select(query_key, F.explode(F.when(F.size("hit") > 0, base).otherwise(none)).alias("x")).select(query_key, F.round("x.score", 6).alias("score"), "x.at", "x.ktype")
    return top_k(chosen, [query_key], [F.desc("score"), F.asc("at")], top).select(query_key, "ktype", "score", "rank")


def entity_overlap(entities: Column, query_terms: Column) -> Column:
    """Share of the query's distinct words that occur in the entities."""
    w = F.array_distinct(F.flatten(F.transform(F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda e: e.isNotNull()), lambda e: T.words(e))))
    q = F.array_distinct(query_terms)
    return F.least(F.size(F.array_intersect(w, q)) / F.greatest(F.size(q), F.lit(1)), F.lit(1.0))


def recency(seconds: Column, total: Column) -> Column:
    """0.6 in the last tenth of a whole of known length, else 1."""
    return F.when((total > 0) & (seconds / total > 0.9), 0.6).otherwise(F.lit(1.0))


def object_score(semantic: Column, is_priority: Column, confidence: Column, entities: Column, query_terms: Column, seconds: Column, total: Column) -> Column:
    type_part = F.when(is_priority, 1.0).otherwise(0.2)
    return 0.45 * semantic + 0.25 * type_part + 0.15 * F.coalesce(confidence, F.lit(0.8)) + 0.10 * entity_overlap(entities, query_terms) + 0.05 * recency(F.coalesce(seconds, F.lit(0.0)), total)


def assemble(ranked: DataFrame, query_key: str, priority: str, rank: str, line: str, budget: int = 6000) -> DataFrame:
    """The rows that fit: priority types share 60 % of the budget, the rest 40 %; what doesn't fit is skipped."""
    first = int(budget * 0.60)
    sized = ranked.withColumn("tokens", T.token_estimate(F.col(line))).withColumn("cap", F.when(F.col(priority), F.lit(first)).otherwise(F.lit(budget - first)).cast("int"))
    return first_fit(sized, [query_key, priority], [rank], "tokens", "cap").filter("taken").drop("taken", "cap")


def render(packed: DataFrame, query_key: str, ktype: str, rank: str, line: str) -> DataFrame:
    """``query_key, brief``: sections by type in fixed order, lines in rank order, empty types left out."""
    dim = packed.sparkSession.createDataFrame([(k, t, s) for k, (t, s) in enumerate(TYPES)], "ord int, t string, title string")
    rows = packed.join(F.broadcast(dim), F.col(ktype) == F.col("t"))  # ten rows
    section = rows.groupBy(query_key, "ord", "title").agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(line).alias("l")))).alias("ls"))
    text = F.concat(F.col("title"), F.lit("\n"), F.array_join(F.transform("ls", lambda x: F.concat(F.lit("- "), x["l"])), "\n"))
    whole = section.select(query_key, "ord", text.alias("s")).groupBy(query_key).agg(F.sort_array(F.collect_list(F.struct("ord", "s"))).alias("ss"))
    return whole.select(query_key, F.array_join(F.transform("ss", lambda x: x["s"]), "\n\n").alias("brief"))


def inspect(objects: DataFrame, video: str, ktype: str, seconds: str, content: str, key: str) -> DataFrame:
    """``video, position, line``: a video's objects by type and time as text lines."""
    dim = objects.sparkSession.createDataFrame([(k, t) for k, (t, _) in enumerate(TYPES)], "ord int, t string")
    rows = objects.join(F.broadcast(dim), F.col(ktype) == F.col("t"))  # ten rows
    at = F.row_number().over(Window.partitionBy(video, ktype).orderBy(F.col(seconds).asc_nulls_first(), F.col(key)))
    return rows.select(video, "ord", at.alias("position"), F.concat(F.lit("  "), T.context_line(F.col(seconds), F.col(content))).alias("line"))
