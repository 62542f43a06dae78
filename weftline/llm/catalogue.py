"""Queries and SQL of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import languages, neardups, pairs, personal, pieces, runs, tokens, turns, windows
from weftline.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.oversized(table(spark, folder, "segments"), ["video_id", "idx"], "text")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split(table(spark, folder, "segments"), ["video_id", "idx"], "text")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return runs.collapse(table(spark, folder, "raw_segments")).select("video_id", "first_idx", "last_idx")


def p2_events(spark: SparkSession, folder: str) -> DataFrame:
    return runs.collapse(table(spark, folder, "raw_segments"))


_PAIR = ("request_id", "query_text", "answer", "asked_at")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.first_defect(table(spark, folder, "query_log"), *_PAIR)


def p3_defects(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.by_id(table(spark, folder, "query_log"), *_PAIR)


def _labelled_texts(spark: SparkSession, folder: str) -> DataFrame:
    seg = table(spark, folder, "segments").select(F.lit("segments").alias("origin"), F.concat_ws(":", "video_id", F.col("idx").cast("string")).alias("item_key"), F.col("text"), F.col("lang"))
    ko = table(spark, folder, "knowledge_objects").select(F.lit("knowledge_objects").alias("origin"), F.col("id").alias("item_key"), F.col("content").alias("text"), F.col("lang"))
    return seg.unionByName(ko)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.faults(_labelled_texts(spark, folder), ["origin", "item_key"], "text", "lang")


def p4_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages.identify(_labelled_texts(spark, folder), ["origin", "item_key"], "text", "lang").drop("known_words")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardups.pairs(table(spark, folder, "knowledge_objects")).select("id_a", "id_b")


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardups.groups(table(spark, folder, "knowledge_objects"))


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    return neardups.classes(table(spark, folder, "knowledge_objects"))


def _transcripts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, folder, "raw_segments"), table(spark, folder, "segments"), table(spark, folder, "speakers")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return turns.turn_starts(*_transcripts(spark, folder))


def p7_turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns.turns(*_transcripts(spark, folder))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text")


def p9_windows(spark: SparkSession, folder: str) -> DataFrame:
    return windows.windows(table(spark, folder, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.found_lines(table(spark, folder, "documents"), table(spark, folder, "name_parts"))


def p10_masked(spark: SparkSession, folder: str) -> DataFrame:
    return personal.redact(table(spark, folder, "documents"), table(spark, folder, "name_parts"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_events": p2_events,
    "p3_found": p3_found,
    "p3_defects": p3_defects,
    "p4_found": p4_found,
    "p4_languages": p4_languages,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p6_classes": p6_classes,
    "p7_found": p7_found,
    "p7_turns": p7_turns,
    "p8_ids": p8_ids,
    "p9_windows": p9_windows,
    "p10_found": p10_found,
    "p10_masked": p10_masked,
}
#: White space as a DuckDB string, for ``trim``.
_BLANK = " || ".join(f"chr({c})" for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])

_RECORDS = """o AS (SELECT id, regexp_replace(lower(content), '[^\\pL\\pN]', '', 'g') AS n, list_distinct(list_filter(list_transform(coalesce(entities, []), lambda e: lower(trim(e))), lambda e: e <> '')) AS ents
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY content DESC NULLS LAST) AS rn FROM knowledge_objects WHERE id IS NOT NULL) WHERE rn = 1)"""
_SIMILAR = f"""{_RECORDS}, g AS (SELECT DISTINCT id, substr(n, i, 3) AS t FROM (SELECT id, n, unnest(generate_series(1, length(n) - 2)) AS i FROM o WHERE length(n) >= 3)),
      c AS (SELECT id, count(*) AS k FROM g GROUP BY id),
      b AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS n_both FROM g x JOIN g y ON x.t = y.t AND x.id < y.id GROUP BY x.id, y.id),
      similar_pairs AS (SELECT id_a, id_b FROM b JOIN c ca ON ca.id = id_a JOIN c cb ON cb.id = id_b JOIN o oa ON oa.id = id_a JOIN o ob ON ob.id = id_b
        WHERE 5 * n_both >= 4 * (ca.k + cb.k - n_both) AND (len(oa.ents) = 0 OR len(ob.ents) = 0 OR len(list_intersect(oa.ents, ob.ents)) > 0))"""

ORACLE: dict[str, str] = {
    "p1_found": f"SELECT DISTINCT video_id, idx FROM segments WHERE length(trim(text, {_BLANK})) > 300",
    "p6_found": f"WITH {_SIMILAR} SELECT id_a, id_b FROM similar_pairs",
    "p6_classes": f"WITH {_RECORDS} SELECT id, min(id) OVER w AS class_id, count(*) OVER w AS class_size FROM o WHERE length(n) >= 3 WINDOW w AS (PARTITION BY n, list_sort(ents))",
    "p6_groups": f"""WITH RECURSIVE {_SIMILAR}, e AS (SELECT id_a AS a, id_b AS b FROM similar_pairs UNION SELECT id_b, id_a FROM similar_pairs),
      reached AS (SELECT id, id AS other FROM o UNION SELECT r.id, e.b FROM reached r JOIN e ON e.a = r.other),
      links AS (SELECT a, count(*) AS k FROM e GROUP BY a)
      SELECT id, min(other) AS group_id, coalesce(max(k), 0) AS n_links FROM reached LEFT JOIN links ON a = id GROUP BY id""",
}
