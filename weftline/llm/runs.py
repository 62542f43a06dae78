"""Problem 2: repeated consecutive events in sequences.

Method: boundary interval lookup. Captions of an entity are spread over chunks
of time. A caption that doesn't say the same as the one before it starts a run;
the run-start positions of a chunk form a sorted array, and each caption is
assigned to its run by binary search in it. Runs that reach over a chunk's edge
are tied through one summary row per chunk. What is aggregated afterwards are
only the members of runs of two or more.

Plan. Texts are normalised in one narrow Arrow stage; one shuffle makes equal
keys one record, one brings ``(entity, chunk)`` together and sorts it; the
comparison and the lookup run over that order in one Arrow stage. A hot entity
is as many groups as it has chunks. Windows over a whole entity see one row per
chunk.

When do two captions say the same? Case, character width, markup, annotations,
punctuation, spacing and fillers are left aside. Then at most ``SLACK`` words
may be misspelt, doubled or put in; a text mostly in Japanese may differ in
``SLACK`` characters. Different numbers, a negation on one side or another word
in a word's place make different events. All captions of a run must say the
same as each other, so a run whose wording drifts is split.

Defined results: null, blank and annotation-only captions (also captions of
nothing but punctuation) are skipped; rows with a null or NaN start are left
out; a null, NaN or negative duration counts as 0; a pause above ``PAUSE``
seconds ends a run; ties in start are ordered by index; rows with equal keys
are one record, the latest decides; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import written
from weftline.sources.tables import latest

PAUSE = 10.0
SLACK = 2
CHUNK_SECONDS = 600

#: Fillers of the six languages; phrases first.
FILLERS = [
    "you know", "i mean", "sort of", "kind of", "um+", "uh+", "er+", "erm+", "ah+", "hm+", "mhm", "huh", "like", "well", "euh+", "hein", "ben", "bah", "äh+", "ähm+", "öh+", "halt", "also", "tja",
    "este", "pues", "eh+", "né", "tipo", "então", "ahn", "é que", "o sea", "bueno", "quoi", "du coup", "sozusagen",
]
JA_FILLERS = ["えーと", "えっと", "ええと", "えー+", "あのー+", "あの、", "そのー+", "まあ、", "うーん", "なんか、", "んー+", "ま、", "えっと、"]
#: Words that deny.
NEGATIONS = {"not", "no", "never", "none", "nothing", "cannot", "cant", "dont", "doesnt", "didnt", "isnt", "wasnt", "wont", "without", "nicht", "kein", "keine", "keinen", "nie", "niemals", "ohne", "ne", "pas", "jamais", "aucun", "aucune", "sans", "nunca", "jamás", "sin", "não", "nem", "sem", "ni"}
JA_NEGATION = re.compile(r"ない|ません|ぬ|ず(?:に|、|$)")

_MUSIC = "♩♪♫♬♭♮♯"
_ANNOTATION = re.compile(rf"\[[^\]]*\]|\([^)]*\)|\{{[^}}]*\}}|【[^】]*】|「♪[^」]*」|〔[^〕]*〕|\*[^*\n]+\*|[{_MUSIC}][^{_MUSIC}\n]*[{_MUSIC}]|[{_MUSIC}]+")
_OPENS = re.compile(rf"[\[({{【「〔*{_MUSIC}]")
_OPEN = re.compile(r"\[[^\]]*$|\([^)]*$|^[^(]*\)|^[^\[]*\]")
_TAG = re.compile(r"<[^<>]{0,200}>")
_FILLER = re.compile(r"(?<!\w)(?:" + "|".join(FILLERS) + r")(?!\w)")
_JA_FILLER = re.compile("|".join(JA_FILLERS))
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*%?|[^\W\d_]+(?:['’][^\W\d_]+)*", re.U)
_JA = re.compile(r"[ぁ-ヿ㐀-鿿]")


def normal(text: str | None) -> str:
    """A caption without what is left aside: words with single blanks, or Japanese characters after ``\\x01``; empty if skipped."""
    if not text or not text.strip():
        return ""
    t = html.unescape(text) if "&" in text else text
    if "<" in t:
        t = _TAG.sub(" ", t)
    plain = t.isascii()
    t = t.lower() if plain else unicodedata.normalize("NFKC", t).lower()
    if _OPENS.search(t):
        t = _ANNOTATION.sub(" ", t)
    ja = 0 if plain else len(_JA.findall(t))
    if ja >= 3 and ja * 3 >= sum(map(str.isalpha, t)):
        t = _JA_FILLER.sub("", t)
        return "\x01" + "".join(re.findall(r"\d+(?:[.,]\d+)*|[^\W_]", t))
    words = _TOKEN.findall(_FILLER.sub(" ", t))
    return " ".join(words).replace("’", "'") or " ".join(_TOKEN.findall(t))


def _close(a: str, b: str) -> bool:
    """Two spellings of one word: an inserted, missing or exchanged letter, two swapped ones; two such slips in long words."""
    if a == b:
        return True
    if a[:1].isdigit() or b[:1].isdigit() or abs(len(a) - len(b)) > 2:
        return False
    short = min(len(a), len(b))
    if short < 3:
        return sorted(a) == sorted(b) and short > 1
    k = _distance(a, b, 2)
    if short < 5:
        return k <= 1 and (len(a) != len(b) or sorted(a) == sorted(b))
    return k <= 1 or (k <= 2 and short >= 6)


def _distance(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours; ``most + 1`` if above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most and (not two or min(one) > most):
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def _numbers(words: list[str]) -> list[str]:
    out: list[str] = []
    for w in words:
        if w[0].isdigit() and (not out or out[-1] != w):
            out.append(w)
    return out


def same(a: str, b: str, slack: int = SLACK) -> bool:
    """Whether two normalised captions say the same."""
    if a == b:
        return True
    if (a[:1] == "\x01") != (b[:1] == "\x01"):
        return False
    if a[:1] == "\x01":
        if re.findall(r"\d+(?:[.,]\d+)*", a) != re.findall(r"\d+(?:[.,]\d+)*", b) or len(JA_NEGATION.findall(a)) != len(JA_NEGATION.findall(b)):
            return False
        return min(len(a), len(b)) > 2 * slack and _distance(a, b, slack) <= slack
    x, y = a.split(" "), b.split(" ")
    if abs(len(x) - len(y)) > slack or len(set(x) ^ set(y)) > 2 * slack:
        return False
    if _numbers(x) != _numbers(y):
        return False
    while x and y and x[0] == y[0]:
        x, y = x[1:], y[1:]
    left = a.split(" ")[: len(a.split(" ")) - len(x)]
    right: list[str] = []
    while x and y and x[-1] == y[-1]:
        right.insert(0, x[-1])
        x, y = x[:-1], y[:-1]
    if len(left) + len(right) < 1 and min(len(x), len(y)) < 3:
        return False
    return _edits(x, y, left[-1] if left else "", right[0] if right else "", slack, "")


def _edits(x: list[str], y: list[str], before: str, after: str, slack: int, put: str) -> bool:
    """Whether ``x`` becomes ``y`` with at most ``slack`` words misspelt, doubled or put in.

    ``put`` is the side on which the step before put a word in: a word put in at
    once on the other side would be one word in another's place.
    """
    if not x and not y:
        return True
    if x and y and x[0] == y[0] and _edits(x[1:], y[1:], x[0], after, slack, ""):
        return True
    if slack == 0:
        return False
    if x and y and x[0] != y[0] and _close(x[0], y[0]):
        denies = x[0] in NEGATIONS or y[0] in NEGATIONS
        if (not denies or sorted(x[0]) == sorted(y[0])) and _edits(x[1:], y[1:], x[0], after, slack - 1, ""):
            return True
    for side in "xy":
        one = x if side == "x" else y
        if not one:
            continue
        w = one[0]
        doubled = w in (before, one[1] if len(one) > 1 else after)
        if not doubled and (w in NEGATIONS or w[0].isdigit() or w.endswith("n't") or put not in ("", side)):
            continue
        rest = (x[1:], y) if side == "x" else (x, y[1:])
        if _edits(*rest, w if doubled else before, after, slack - 1, "" if doubled else side):
            return True
    return False


def _normaliser(keys: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([normal(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keys], out], names=[*keys, "norm"])

    return run


def captions(df: DataFrame, entity: str, index: str, text: str, start: str, duration: str, order: str) -> DataFrame:
    """``entity, index, s, e, norm, chunk`` of the captions that count, one per key."""
    cols = [entity, index, start, duration, order]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)
    norm = df.select(*cols, text).mapInArrow(_normaliser(cols, text), f"{kinds}, norm string")
    one = latest(norm, [entity, index], [order, "norm"])
    s = F.col(start).cast("double")
    length = F.col(duration).cast("double")
    length = F.when(length.isNull() | F.isnan(length) | (length < 0), 0.0).otherwise(length)
    return (
        one.filter((F.col("norm") != "") & s.isNotNull() & ~F.isnan(s) & (F.abs(s) < 1e15))
        .select(F.col(entity), F.col(index), s.alias("s"), (s + length).alias("e"), "norm", F.floor(s / CHUNK_SECONDS).alias("chunk"))
    )


def _lookup(entity: str, index: str, pause: float):
    """Over rows sorted by entity, chunk, start and index: the run start of each caption, from the chunk's sorted array of run starts.

    Emits members and starts of runs that hold, or may hold, two captions.
    """

    def flush(rows: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(rows).combine_chunks()
        norm, before = t.column("norm").to_pylist(), t.column("p_norm").to_pylist()
        s, pe = t.column("s").to_numpy(), t.column("p_e").to_numpy(zero_copy_only=False)
        n = len(norm)
        kept = np.fromiter((before[k] is not None and not s[k] - pe[k] > pause and same(before[k], norm[k]) for k in range(n)), dtype=bool, count=n)
        first = t.column("first_in_chunk").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(first)
        chunk_start = edges[np.searchsorted(edges, np.arange(n), side="right") - 1]
        starts = np.flatnonzero(~kept)
        at = np.searchsorted(starts, np.arange(n), side="right") - 1
        run = np.where(at >= 0, starts[np.maximum(at, 0)] if len(starts) else 0, -1)
        run = np.where(run < chunk_start, -1, run)  # the run began in an earlier chunk
        following = np.append(kept[1:] & ~first[1:], False)
        last = np.append(first[1:], True)
        keep = np.flatnonzero(kept | following | last)
        here = run[keep]
        idx, sec = t.column(index).combine_chunks(), t.column("s").combine_chunks()
        take = pa.array(np.where(here >= 0, here, 0))
        null = pa.array(here < 0)
        pick = lambda a: pa.compute.if_else(null, pa.scalar(None, type=a.type), a.take(take))
        sub = t.take(pa.array(keep))
        cols = {entity: sub.column(entity), "chunk": sub.column("chunk"), index: sub.column(index), "s": sub.column("s"), "e": sub.column("e"), "norm": sub.column("norm"), "run_s": pick(sec), "run_i": pick(idx), "last": pa.array(last[keep])}
        return pa.table(cols).combine_chunks().to_batches()[0] if len(keep) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            first = np.flatnonzero(t.column("first_in_chunk").to_numpy(zero_copy_only=False))
            if held and len(first):
                # Only whole chunks are looked up; the tail waits for its rest.
                if first[0]:
                    held.append(t.slice(0, first[0]))
                out = flush(held)
                if out is not None:
                    yield out
                held, t, first = [], t.slice(first[0]), first - first[0]
            if len(first) > 1:
                out = flush([t.slice(0, first[-1])])
                if out is not None:
                    yield out
                t = t.slice(first[-1])
            held.append(t)
        if held:
            out = flush(held)
            if out is not None:
                yield out

    return run


def _splitter(entity: str, index: str):
    """Splits each chain of captions, each like the one before, into runs whose captions are all alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "first", "last", "s", "covered", "n")}
            for k, members in enumerate(batch.column(batch.schema.get_field_index("members")).to_pylist()):
                current: list[dict] = []
                texts: list[str] = []
                for m in [*members, None]:
                    if m is not None and all(t == m["norm"] or same(t, m["norm"]) for t in texts):
                        current.append(m)
                        if m["norm"] not in texts:
                            texts.append(m["norm"])
                        continue
                    if len(current) > 1:
                        covered, top = 0.0, current[0]["s"]
                        for c in current:
                            covered += max(0.0, c["e"] - max(top, c["s"]))
                            top = max(top, c["e"])
                        for name, v in (("row", k), ("first", current[0]["i"]), ("last", current[-1]["i"]), ("s", current[0]["s"]), ("covered", covered), ("n", len(current))):
                            out[name].append(v)
                    current, texts = ([m], [m["norm"]]) if m is not None else ([], [])
            entities = batch.column(batch.schema.get_field_index(entity)).take(pa.array(out["row"], type=pa.int64()))
            kind = batch.schema.field("members").type.value_type.field("i").type
            yield pa.RecordBatch.from_arrays(
                [entities, pa.array(out["first"], type=kind), pa.array(out["last"], type=kind), pa.array(out["s"], type=pa.float64()), pa.array(out["covered"], type=pa.float64()), pa.array(out["n"], type=pa.int64())],
                names=[entity, "first_idx", "last_idx", "first_start", "covered", "captions"],
            )

    return run


def collapse(df: DataFrame, entity: str = "video_id", index: str = "idx", text: str = "text", start: str = "start_sec", duration: str = "duration", order: str = "ingested_at", pause: float = PAUSE) -> DataFrame:
    """``entity, first_idx, last_idx, first_start, covered, captions``: each run of two or more captions as one event."""
    caps = captions(df, entity, index, text, start, duration, order).withColumn("_e", F.struct(entity))
    inside = Window.partitionBy("_e", "chunk").orderBy("s", index)
    row = F.struct("norm", "e")
    by_chunk = Window.partitionBy("_e").orderBy("chunk")
    carry = caps.groupBy("_e", "chunk").agg(F.max_by(row, F.struct("s", index)).alias("tail")).withColumn("carried", F.lag("tail").over(by_chunk)).drop("tail")
    # The window comes last: what it asks for, whole chunks in order, is what the lookup gets, whatever is done about skew below.
    lagged = caps.hint("merge").join(carry.hint("merge"), ["_e", "chunk"]).withColumn("prev", F.lag(row).over(inside)).withColumn("first_in_chunk", F.row_number().over(inside) == 1)
    before = F.when(F.col("first_in_chunk"), F.col("carried")).otherwise(F.col("prev"))
    ready = lagged.select(entity, index, "chunk", "s", "e", "norm", "first_in_chunk", before["norm"].alias("p_norm"), before["e"].alias("p_e"))
    e_kind, i_kind = caps.schema[entity].dataType.simpleString(), caps.schema[index].dataType.simpleString()
    members = ready.mapInArrow(_lookup(entity, index, pause), f"`{entity}` {e_kind}, chunk bigint, `{index}` {i_kind}, s double, e double, norm string, run_s double, run_i {i_kind}, last boolean")
    members = written(members, "runs-members")
    # A chunk's last run start, handed on to the chunks after it.
    tails = members.filter("last").select(
        F.col(entity).alias("c_entity"),
        F.col("chunk").alias("c_chunk"),
        F.last(F.when(F.col("run_s").isNotNull(), F.struct("run_s", "run_i")), ignorenulls=True)
        .over(Window.partitionBy(entity).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
        .alias("carried"),
    )
    tied = members.join(tails, F.col(entity).eqNullSafe(F.col("c_entity")) & (F.col("chunk") == F.col("c_chunk")), "left").select(
        entity, index, "s", "e", "norm", F.coalesce("run_s", "carried.run_s").alias("run_s"), F.coalesce("run_i", "carried.run_i").alias("run_i")
    )
    chains = (
        tied.groupBy(entity, "run_s", "run_i")
        .agg(F.sort_array(F.collect_list(F.struct("s", F.col(index).alias("i"), "e", "norm"))).alias("members"))
        .filter(F.size("members") > 1)
        .select(entity, "members")
    )
    return chains.mapInArrow(_splitter(entity, index), f"`{entity}` {e_kind}, first_idx {i_kind}, last_idx {i_kind}, first_start double, covered double, captions bigint")
