"""Prompts, answer records and their costs: what goes to a model and what comes back, as columns.

System texts are parameters; headings and line formats are fixed values. A null
title counts as none, a null text as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T

#: Headings of the prompts.
EXCERPTS, QUESTION, VIDEO, BASE = "## Transcript Excerpts\n", "\n\n## Question\n", "## Video: ", "# Knowledge Base: "
ASK_EXTRACTION = ("Extract all knowledge objects from this transcript.\n\nSource: YouTube video ", "\n\nTRANSCRIPT:\n", "\n\nOutput the JSON array now:")
ANSWER_SYSTEM = "Answer from the knowledge given below and from nothing else; name the times you rely on, and say so if it holds no answer."


def excerpt_prompt(df: DataFrame, keys: list[str], start: str, end: str, text: str, title: Column, question: Column) -> DataFrame:
    """``keys, prompt``: the chunks of each key in order of time, ties by text, between title and question.

    A key's chunks meet in one row, as they do in the prompt; they are those a budget or a limit left.
    """
    line = T.chunk_line(F.col(start), F.col(end), F.coalesce(text, F.lit("")))
    lines = F.sort_array(F.collect_list(F.struct(F.col(start).alias("a"), line.alias("l"))))
    rows = df.withColumn("_title", title).withColumn("_q", question).groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("body"), F.max("_title").alias("t"), F.max("_q").alias("q"))
    head = F.when(F.coalesce("t", F.lit("")) != "", F.concat(F.lit(VIDEO), "t", F.lit("\n\n"))).otherwise("")
    return rows.select(*keys, F.concat(head, F.lit(EXCERPTS + "\n"), "body", F.lit(QUESTION), F.coalesce("q", F.lit(""))).alias("prompt"))


def brief_prompt(brief: Column, title: Column, question: Column) -> Column:
    """A brief under its title, then the question."""
    head = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(BASE), title, F.lit("\n"))).otherwise("")
    return F.concat(head, F.coalesce(brief, F.lit("")), F.lit(QUESTION), F.coalesce(question, F.lit("")))


def extraction_prompt(video: Column, transcript: Column) -> Column:
    a, b, c = ASK_EXTRACTION
    return F.concat(F.lit(a), video, F.lit(b), F.coalesce(transcript, F.lit("")), F.lit(c))


def cost(input_tokens: Column, output_tokens: Column, usd_in: float, usd_out: float, rate: float) -> Column:
    """``usd, local`` of a call at prices per million tokens and an exchange rate; null counts are 0."""
    n, m = F.coalesce(input_tokens, F.lit(0)).cast("double"), F.coalesce(output_tokens, F.lit(0)).cast("double")
    millionths = n * usd_in + m * usd_out
    # Halves go up; sums of whole tokens stay exact until they are divided.
    return F.struct((F.floor(millionths / 10 + 0.5) / 1e5).alias("usd"), (F.floor(millionths * rate / 1e4 + 0.5) / 100).alias("local"))


def types_in_order(df: DataFrame, key: str, ktype: str, order: list[str]) -> DataFrame:
    """``key, n_objects, types``: number of objects, and their types as they are first met in ``order``."""
    per_type = df.groupBy(key, ktype).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("at"))
    one = per_type.groupBy(key).agg(F.sum("n").alias("n_objects"), F.sort_array(F.collect_list(F.struct("at", F.col(ktype).alias("k")))).alias("ks"))
    return one.select(key, "n_objects", F.transform("ks", lambda x: x["k"]).alias("types"))
