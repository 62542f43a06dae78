"""Chunk packing, fragment merging, windowed duplicate removal and budget packing.

All are greedy folds in a given order. Defined results: null texts count as
empty; ties in the order columns must be broken by them (the queries add the
index); empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.scan import ordered_scan


# --- consecutive duplicates ------------------------------------------------------------------------------------------
def drop_consecutive(df: DataFrame, entity: str, index: str, text: str, threshold: float = 0.85, chunk: int = 512) -> DataFrame:
    """Drops a text that is empty or like the last kept one (word Jaccard); adds ``new_idx`` from 0.

    Restart points: the Jaccard distance is a metric, so a text farther than
    ``2 (1 - threshold)`` from its neighbour before is farther than
    ``1 - threshold`` from whatever that neighbour was dropped for, and is kept in
    any case. The sequence is cut there; what is folded are short stretches of
    alike texts. Neighbours are found within blocks of the index, with one
    carried row per block, so a hot entity is spread over its blocks.
    """
    rows = df.withColumn("_w", F.array_distinct(T.words(F.col(text)))).filter(F.size("_w") > 0).withColumn("_b", F.floor(F.col(index) / chunk))
    inside = Window.partitionBy(entity, "_b").orderBy(index)
    blocks = Window.partitionBy(entity).orderBy("_b")
    carry = rows.groupBy(entity, "_b").agg(F.max_by("_w", index).alias("tail")).withColumn("_carry", F.lag("tail").over(blocks)).drop("tail")
    near = rows.withColumn("_p", F.lag("_w").over(inside)).join(carry, [entity, "_b"])
    before = F.coalesce("_p", "_carry")
    cut = before.isNull() | (T.jaccard(F.col("_w"), before) < 1 - 2 * (1 - threshold) - 1e-9)
    marked = near.withColumn("_cut", cut.cast("int")).drop("_p", "_carry")
    per_block = marked.groupBy(entity, "_b").agg(F.sum("_cut").alias("n"))
    base = per_block.withColumn("_base", F.coalesce(F.sum("n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    stretch = F.sum("_cut").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_base")
    numbered = marked.join(base, [entity, "_b"]).withColumn("_s", stretch)
    rest = [c for c in df.columns if c not in (entity,)]
    members = numbered.groupBy(entity, "_s").agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("_i"), F.col("_w").alias("_w"), F.struct(*rest).alias("_r")))).alias("m"))
    empty = F.struct(F.array().cast("array<string>").alias("last"), F.array().cast(members.schema["m"].dataType).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        dup = (F.size(s["last"]) > 0) & (T.jaccard(s["last"], x["_w"]) >= threshold)
        return F.when(dup, s).otherwise(F.struct(x["_w"].alias("last"), F.concat(s["kept"], F.array(x)).alias("kept")))

    kept = members.select(entity, F.explode(F.aggregate("m", empty, step, lambda s: s["kept"])).alias("k")).select(entity, *[F.col(f"k._r.{c}").alias(c) for c in rest])
    kept = kept.withColumn("_b", F.floor(F.col(index) / chunk))
    counts = kept.groupBy(entity, "_b").agg(F.count(F.lit(1)).alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    new = F.row_number().over(inside) - 1 + F.col("_base")
    return kept.join(counts, [entity, "_b"]).withColumn("new_idx", new).select(*df.columns, "new_idx")


# --- chunk packing ---------------------------------------------------------------------------------------------------
def pack_chunks(df: DataFrame, entity: str, index: str, text: str, start: str, end: str, limit: int = 120, overlap: int = 1) -> DataFrame:
    """Packs segments into chunks of at most ``limit`` words; a chunk begins with the last ``overlap`` segments before it."""

    def fold():
        buf: list[dict] = []
        size = 0
        number = 0

        def emit() -> dict:
            nonlocal number
            number += 1
            return {
                "chunk_id": number - 1,
                "text": " ".join(b["_t"] for b in buf),
                "chunk_start": buf[0]["_a"],
                "chunk_end": buf[-1]["_e"],
                "segment_indices": [b["_i"] for b in buf],
            }

        def step(row: dict | None) -> list[dict]:
            nonlocal buf, size
            if row is None:
                return [emit()] if buf else []
            out = []
            if size + row["_n"] > limit and buf:
                out.append(emit())
                buf = buf[max(0, len(buf) - overlap) :] if overlap else []
                size = sum(b["_n"] for b in buf)
            buf.append(row)
            size += row["_n"]
            return out

        return step

    rows = df.select(F.col(entity), F.col(index).cast("int").alias("_i"), F.coalesce(text, F.lit("")).alias("_t"), F.col(start).alias("_a"), F.col(end).alias("_e"), T.word_count(F.col(text)).alias("_n"))
    kind = df.schema[entity].dataType.simpleString()
    return ordered_scan(rows, [entity], ["_i"], fold, f"`{entity}` {kind}, chunk_id int, text string, chunk_start double, chunk_end double, segment_indices array<int>")


# --- fragments -------------------------------------------------------------------------------------------------------
_SENTENCE_EN = re.compile(r"\w[^.!?]*[.!?](?:\s|$)", re.A)


def _ended(text: str, lang: str) -> bool:
    t = text.rstrip()
    return t.endswith(("。", "！", "？")) if lang == "ja" else bool(_SENTENCE_EN.search(t))


def merges(a: dict, b: dict, gap: float, longest: int = 300) -> bool:
    """Whether fragment ``b`` continues ``a``."""
    if b["start"] - a["end"] > gap or len(a["text"]) + len(b["text"]) > longest or _ended(a["text"], a["lang"]):
        return False
    head = b["text"].lstrip()[:1]
    if a["lang"] == "en" and "a" <= head <= "z":
        return True
    if a["lang"] == "ja" and head and head in T.PARTICLES:
        return True
    size = len(re.sub(r"\s", "", a["text"])) if a["lang"] == "ja" else len(a["text"].split())
    return size <= 4


def join_texts(a: str, b: str, lang: str) -> str:
    if lang != "ja":
        return f"{a} {b}"
    ascii_word = re.compile(r"[a-zA-Z0-9]")
    return f"{a} {b}" if ascii_word.match(a[-1:]) and ascii_word.match(b[:1]) else a + b


def merge_fragments(df: DataFrame, entity: str, index: str, gap: float = 1.8) -> DataFrame:
    """Merges caption fragments (``text, start, end, lang``) into longer lines; adds ``original_count``."""

    def fold():
        cur: dict | None = None

        def show(c: dict) -> dict:
            return {"idx": c["idx"], "text": c["text"], "start": c["start"], "end": c["end"], "lang": c["lang"], "original_count": c["n"]}

        def step(row: dict | None) -> list[dict]:
            nonlocal cur
            if row is None:
                return [show(cur)] if cur else []
            row = row | {"n": 1}
            if cur is None:
                cur = row
                return []
            if merges(cur, row, gap):
                cur = cur | {"text": join_texts(cur["text"], row["text"], cur["lang"]), "end": row["end"], "n": cur["n"] + 1}
                return []
            out, cur = [show(cur)], row
            return out

        return step

    kind = df.schema[entity].dataType.simpleString()
    rows = df.select(entity, F.col(index).cast("int").alias("idx"), "text", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "lang")
    return ordered_scan(rows, [entity], ["start", "idx"], fold, f"`{entity}` {kind}, idx int, text string, start double, end double, lang string, original_count int")


# --- windowed duplicates ---------------------------------------------------------------------------------------------
def _compare(text: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text or "").lower() if unicodedata.category(c)[0] not in "PS" and not c.isspace())


def drop_windowed(df: DataFrame, entity: str, order: list[str], text: str, threshold: float = 0.72, window: int = 20) -> DataFrame:
    """Adds ``kept``: false for a text equal to any kept one, or like (trigram Jaccard) one of the last ``window`` kept ones."""

    def fold():
        recent: list[set[str]] = []
        keys: set[str] = set()

        def step(row: dict | None) -> list[dict]:
            if row is None:
                return []
            key = _compare(row[text])
            mine = {key[i : i + 3] for i in range(len(key) - 2)}
            dup = key in keys or any(mine and r and len(mine & r) / len(mine | r) >= threshold for r in recent)
            if not dup:
                keys.add(key)
                recent.append(mine)
                if len(recent) > window:
                    recent.pop(0)
            return [{k: v for k, v in row.items() if k != entity} | {"kept": not dup}]

        return step

    cols = [entity, *[c for c in df.columns if c != entity]]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols) + ", kept boolean"
    return ordered_scan(df.select(*cols), [entity], order, fold, schema)


# --- budgets ---------------------------------------------------------------------------------------------------------
def first_fit(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: str) -> DataFrame:
    """Adds ``taken`` and ``used``: in order, a row is taken if it still fits the budget of its key, else skipped."""

    def fold():
        used = 0

        def step(row: dict | None) -> list[dict]:
            nonlocal used
            if row is None:
                return []
            fits = used + (row[cost] or 0) <= row[budget]
            used += (row[cost] or 0) if fits else 0
            return [{k: v for k, v in row.items() if k not in keys} | {"taken": fits, "used": used}]

        return step

    cols = [*keys, *[c for c in df.columns if c not in keys]]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols) + ", taken boolean, used bigint"
    return ordered_scan(df.select(*cols), keys, order, fold, schema)


def compress_to_budget(df: DataFrame, keys: list[str], order: list[str], text: str, budget: int = 6000) -> DataFrame:
    """In order: texts are taken while the budget lasts; the one that exceeds it is cut to three words per four tokens left, if 30 are left."""

    def fold():
        used, done = 0, False

        def step(row: dict | None) -> list[dict]:
            nonlocal used, done
            if row is None or done or not row[text]:
                return []
            tokens = int(len(row[text].split()) * 1.35)
            if used + tokens > budget:
                left = budget - used
                if left < 30:
                    done = True
                    return []
                row = row | {text: " ".join(row[text].split()[: int(left * 0.75)])}
                tokens = int(len(row[text].split()) * 1.35)
            used += tokens
            done = used >= budget
            return [{k: v for k, v in row.items() if k not in keys} | {"tokens": tokens}]

        return step

    cols = [*keys, *[c for c in df.columns if c not in keys]]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols) + ", tokens int"
    return ordered_scan(df.select(*cols), keys, order, fold, schema)
