"""Lexical and vector search, rank fusion and attention scores.

Queries are a DataFrame, so many are answered at once; everything is joins and
aggregations, with the smaller side left to the optimizer. Top-k per query is a
window with a limit, which Spark applies before the shuffle too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weftline.functions import text as T


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows per key with their rank from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query: str, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """``query_key, key, score`` of every document with a query term (others score 0).

    Terms that more than half of the documents hold have a negative weight; they
    get ``floor`` times the mean weight of the vocabulary instead. A term that a
    query repeats counts repeatedly.
    """
    tf, weight = _bm25_parts(docs, key, text, queries, query_key, query, k1, b, floor)
    hit = tf.join(weight, "t").groupBy("q", "d").agg(F.sum(F.col("qw") * F.col("dw")).alias("score"))
    return hit.select(F.col("q").alias(query_key), F.col("d").alias(key), "score")


def bm25_best(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query: str, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """``query_key, key, score, rank``: the ``k`` best of ``bm25`` for each query, scores to 8 digits, ties by key."""
    tf, weight = _bm25_parts(docs, key, text, queries, query_key, query, k1, b, floor)
    return _best(tf, weight, docs, queries, key, query_key, query, k)


def with_unmatched(best: DataFrame, docs: DataFrame, key: str, queries: DataFrame, query_key: str, k: int) -> DataFrame:
    """``best`` filled up to ``k`` rows per query with documents that hold no word of it: score 0, first by key.

    A query that lacks rows has fewer than ``k`` hits, so the first ``2 k``
    documents always hold enough others; only those are broadcast.
    """
    first = docs.select(key).orderBy(key).limit(2 * k)
    short = queries.select(query_key).join(best.groupBy(query_key).agg(F.count(F.lit(1)).alias("_n")), query_key, "left").filter(F.coalesce("_n", F.lit(0)) < k).select(query_key)
    more = short.crossJoin(F.broadcast(first)).join(best.select(query_key, key), [query_key, key], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(best.select(query_key, key, "score").unionByName(more), [query_key], [F.desc("score"), F.asc(key)], k)


def density_best(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query: str, k: int) -> DataFrame:
    """``query_key, key, score, rank``: for each query the ``k`` texts of the highest ``density`` above 0, to 8 digits, ties by key."""
    tokens = docs.select(F.col(key).alias("d"), T.words(F.col(text)).alias("w"))
    tf = tokens.select("d", F.size("w").cast("double").alias("norm"), F.explode("w").alias("t")).groupBy("d", "norm", "t").agg(F.count(F.lit(1)).cast("double").alias("dw"))
    terms = queries.select(F.col(query_key).alias("q"), F.explode(F.array_distinct(T.words(F.col(query)))).alias("t"), F.lit(1.0).alias("qw"))
    return _best(tf, terms, docs, queries, key, query_key, query, k)


def _bm25_parts(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query: str, k1: float, b: float, floor: float) -> tuple[DataFrame, DataFrame]:
    """``d, t, dw, norm`` of the documents and ``q, t, qw`` of the queries; the sum of ``qw * dw`` over the shared terms is the score."""
    tokens = docs.select(F.col(key).alias("d"), T.words(F.col(text)).alias("w"))
    stats = tokens.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("w")).alias("avg_dl"))
    tf = tokens.select("d", F.size("w").alias("dl"), F.explode("w").alias("t")).groupBy("d", "dl", "t").agg(F.count(F.lit(1)).alias("tf"))
    df_ = tf.groupBy("t").agg(F.count(F.lit(1)).alias("doc_freq"))
    raw = df_.crossJoin(F.broadcast(stats)).withColumn("raw_idf", F.log(F.col("n_docs") - F.col("doc_freq") + 0.5) - F.log(F.col("doc_freq") + 0.5))  # one row
    mean = raw.agg(F.avg("raw_idf").alias("mean_idf"))
    terms = queries.select(F.col(query_key).alias("q"), F.explode(T.words(F.col(query))).alias("t")).groupBy("q", "t").agg(F.count(F.lit(1)).alias("qf"))
    idf = F.when(F.col("raw_idf") < 0, floor * F.col("mean_idf")).otherwise(F.col("raw_idf"))
    weight = terms.join(raw, "t").crossJoin(F.broadcast(mean)).select("q", "t", (F.col("qf") * idf).alias("qw"))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return tf.crossJoin(F.broadcast(stats)).select("d", "t", part.alias("dw"), F.lit(1.0).alias("norm")), weight  # one row


#: Documents and queries of one block.
BLOCK_DOCS, BLOCK_QUERIES = 16_384, 16_384


def _best(postings: DataFrame, terms: DataFrame, docs: DataFrame, queries: DataFrame, key: str, query_key: str, query: str, k: int) -> DataFrame:
    """The ``k`` best documents of each query by the sum of ``qw * dw`` over shared terms, divided by ``norm``.

    Queries and documents meet in blocks, so that no pair of them is ever a
    row: a block sums its queries one by one over the lists of their terms and
    gives its ``k`` best of each; the best of all blocks are the best of all.
    """
    # Sizes and asked words come from the inputs, so that the weights are worked out once.
    postings = postings.join(queries.select(F.explode(T.words(F.col(query))).alias("t")).distinct(), "t", "left_semi")
    blocks = lambda df, size, name: df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("int").alias(name))
    sizes = blocks(docs, BLOCK_DOCS, "nd").crossJoin(blocks(queries, BLOCK_QUERIES, "nq"))  # one row
    left = postings.crossJoin(F.broadcast(sizes)).select("d", "t", "dw", "norm", F.pmod(F.xxhash64("d"), "nd").cast("int").alias("_db"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("_qb"))
    right = terms.crossJoin(F.broadcast(sizes)).select("q", "t", "qw", F.pmod(F.xxhash64("q"), "nq").cast("int").alias("_qb"), F.explode(F.sequence(F.lit(0), F.col("nd") - 1)).alias("_db"))
    schema = StructType([StructField(query_key, terms.schema["q"].dataType), StructField(key, postings.schema["d"].dataType), StructField("score", DoubleType())])
    names = [query_key, key, "score"]

    def block(docs: pa.Table, asked: pa.Table) -> pa.Table:
        return _block_best(docs, asked, k, names)

    best = left.groupBy("_db", "_qb").cogroup(right.groupBy("_db", "_qb")).applyInArrow(block, schema)
    return top_k(best, [query_key], [F.desc("score"), F.asc(key)], k)


def _block_best(docs: pa.Table, asked: pa.Table, k: int, names: list[str]) -> pa.Table:
    """Of every query of ``asked`` (``q, t, qw``) its ``k`` best documents of ``docs`` (``d, t, dw, norm``)."""
    none = pa.table({n: asked["q"].slice(0, 0) if i == 0 else docs["d"].slice(0, 0) if i == 1 else pa.array([], pa.float64()) for i, n in enumerate(names)})
    if not docs.num_rows or not asked.num_rows:
        return none
    ids = docs["d"].combine_chunks().unique().sort()
    place = {d: i for i, d in enumerate(ids.to_pylist())}
    at = np.fromiter((place[d] for d in docs["d"].to_pylist()), dtype=np.int64, count=docs.num_rows)
    dw = docs["dw"].to_numpy()
    norm = np.ones(len(ids))
    norm[at] = docs["norm"].to_numpy()
    number: dict[str, int] = {}
    term = np.fromiter((number.setdefault(t, len(number)) for t in docs["t"].to_pylist()), dtype=np.int64, count=docs.num_rows)
    order = np.argsort(term, kind="stable")
    at, dw = at[order], dw[order]
    bound = np.searchsorted(term[order], np.arange(len(number) + 1))
    wanted: dict = {}
    for q, t, w in zip(asked["q"].to_pylist(), asked["t"].to_pylist(), asked["qw"].to_pylist()):
        n = number.get(t)
        if n is not None:
            wanted.setdefault(q, []).append((n, w))
    qs, ds, ss = [], [], []
    for q, listed in wanted.items():
        listed.sort()
        where = np.concatenate([at[bound[n] : bound[n + 1]] for n, _ in listed])
        parts = np.concatenate([dw[bound[n] : bound[n + 1]] * w for n, w in listed])
        hit = np.flatnonzero(np.bincount(where, minlength=len(ids)))
        raw = np.bincount(where, weights=parts, minlength=len(ids))[hit] / norm[hit]
        score = np.copysign(np.floor(np.abs(raw) * 1e8 + 0.5) / 1e8, raw)
        if len(hit) > k:
            enough = score >= np.partition(score, len(score) - k)[len(score) - k]
            hit, score = hit[enough], score[enough]
        first = np.argsort(-score, kind="stable")[:k]
        qs += [q] * len(first)
        ds.append(hit[first])
        ss.append(score[first])
    if not qs:
        return none
    return pa.table({names[0]: pa.array(qs, asked["q"].type), names[1]: ids.take(pa.array(np.concatenate(ds))), names[2]: np.concatenate(ss)})


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


#: Most query vectors that are sent to the executors at once.
MOST_VECTORS = 2_000


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int, within: list[str] | None = None) -> DataFrame:
    """``query_key, key, similarity, rank`` of the ``k`` nearest rows of each query by cosine, ties by key.

    ``within`` names columns that a row must share with the query. A stated set
    of queries meets all rows in blocks: up to ``MOST_VECTORS`` queries are
    broadcast (their number is counted first), more are joined block by block.
    """
    q = queries.select(F.col(query_key).alias("_q"), F.col(query_vector).alias("_v"), *[F.col(c).alias(f"_w_{c}") for c in within or []])
    on = F.lit(True)
    for c in within or []:
        on = on & (F.col(c) == F.col(f"_w_{c}"))
    n = queries.count()
    blocks = max(1, -(-n // MOST_VECTORS))
    out = None
    for block in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == block)
        hit = vectors.join(F.broadcast(part), on).select(F.col("_q").alias(query_key), F.col(key), cosine(F.col(vector), F.col("_v")).alias("similarity"))
        best = top_k(hit.filter(F.col("similarity").isNotNull()), [query_key], [F.desc("similarity"), F.asc(key)], k)
        out = best if out is None else out.unionByName(best)
    return out


def fuse(lists: list[tuple[DataFrame, str, float]], query_key: str, key: str, k: int = 60, top: int = 15) -> DataFrame:
    """Reciprocal rank fusion of ranked lists ``(frame, rank column, weight)``; ties go to the earlier list, then the better rank."""
    rows = None
    for source, (df, rank, weight) in enumerate(lists):
        part = df.select(query_key, key, F.col(rank).cast("bigint").alias("r"), F.lit(source).alias("source"), (F.lit(float(weight)) / (F.lit(k) + F.col(rank))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    sums = rows.groupBy(query_key, key).agg(F.sum("part").alias("score"), F.min(F.struct("source", "r")).alias("first"))
    return top_k(sums, [query_key], [F.desc(F.round("score", 12)), F.col("first.source"), F.col("first.r"), F.col(key)], top).drop("first")


def density(text: Column, query_terms: Column) -> Column:
    """Share of a text's words that are query terms."""
    w = T.words(text)
    return F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: F.array_contains(query_terms, x))) / F.size(w)).otherwise(F.lit(0.0))


def position_score(start: Column, end: Column, total: Column) -> Column:
    """0.4 times the distance of the middle from the half of the whole; 0 if the whole is not positive or a bound is null."""
    return F.coalesce(F.when(total > 0, F.abs((start + end) / 2 / total - 0.5) * 0.4), F.lit(0.0))


def attention(relevance: Column, text: Column, query_terms: Column, start: Column, end: Column, total: Column) -> Column:
    return relevance + 0.15 * density(text, query_terms) + position_score(start, end, total)
