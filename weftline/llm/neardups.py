"""Problem 6: near-duplicate records with small edits.

Method: grouped prefix join. A record's text is the set of its distinct
character trigrams; two texts of a Jaccard similarity of at least ``t`` share a
trigram among the first ``n - ceil(t n) + 1`` of each in any global order, here
from rare to frequent. Records of equal text and entities collapse into one
class; classes whose prefixes share a trigram are paired and filtered by size,
by the position of the shared trigram and by signature; what is left is
verified exactly on the texts and expanded into members.

The signature holds the parities of the trigrams of 192 hash classes. Each
differing trigram flips one bit, so two signatures differ in at most as many
bits as the sets in elements, and texts that have nothing to do with each other
in about half of all bits, however long they are.

Where do prefixes meet? Two records must have an entity in common unless one
has none. Texts of one entity travel together, a row each with its prefix, and
the prefixes are joined inside the group; an entity of more than ``HOT`` texts
is split by trigram, one posting for each (entity, trigram). Only classes
without entities meet all texts on the bare trigram. Postings travel packed in
Arrow binaries, a row for each batch and bucket; the number of buckets follows
the number of postings, and a frequent trigram is laid out as a grid of cells of
at most about ``BLOCK`` postings of either side, so no task holds an unbounded
list. The pairing inside a bucket is a binary search in sorted arrays.

The order needs counts of trigrams over all texts, the splitting counts of
entities: both are counted in ``2**BUCKETS_LOG2`` hash buckets (any fixed order
is exact; the counts only make it selective), so what the driver collects and
broadcasts has a fixed size. All joins of tables are sort-merge joins.

Copies: a class is the records of equal text and equal entities. Pairs of ids
are written out for classes of up to ``FULL`` members; of a larger class the
smallest id stands for it in pairs with other records, and every member is
linked with it. ``classes`` lists every record with its class and the class's
size, and ``groups`` counts links by class sizes, the same below and above
``FULL``. If more than ``FULL`` classes of one text share an entity, they are
linked with the first of them instead of each other.

Defined results: texts of fewer than three letters or digits have no trigram
and are in no pair; null or blank entities don't count; a null id is no record;
rows with equal ids are one record (the greatest content and entities decide);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.once import once
from weftline.session import discard, written

BUCKETS_LOG2 = 17
FULL = 64
#: Texts of an entity that are joined in one piece, postings of a cell's side, postings of a bucket.
HOT, BLOCK, BUCKET = 1024, 65_536, 50_000
#: Pairs looked at at once; bounds memory only.
STEP = 150_000
SIGNATURE = 192
#: Unicode's White_Space property.
BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
_LOW52, _LOW44 = np.uint64((1 << 52) - 1), np.uint64((1 << 44) - 1)
_POSTING = np.dtype([("code", "<u4"), ("tid", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("role", "u1"), ("sig", "<u8", (3,))])
_HEAD = np.dtype([("ent", "<u8"), ("tid", "<i8"), ("n", "<i4"), ("size", "<i4"), ("sig", "<u8", (3,))])


def _hash(g: np.ndarray) -> np.ndarray:
    """Mixes 64 bits; different numbers stay different."""
    h = g.astype(np.uint64) * _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX2
    return h ^ (h >> np.uint64(29))


def records(df: DataFrame, key: str, text: str, entities: str) -> DataFrame:
    """``id, norm, ents, t1, t2`` of each record with a trigram; ``t1, t2`` are two hashes that stand for the text."""
    one = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.struct(F.col(text).alias("t"), F.col(entities).alias("e"))).alias("r"))
    norm = F.regexp_replace(F.lower("r.t"), r"[^\p{L}\p{N}]+", "")
    clean = F.transform(F.coalesce("r.e", F.array()), lambda x: F.lower(F.trim(x, F.lit(BLANKS))))
    ents = F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != ""))))
    texts = once(one, norm=norm, ents=ents).select("id", "norm", "ents").filter(F.length("norm") >= 3)
    return texts.withColumn("t1", F.xxhash64("norm")).withColumn("t2", F.xxhash64(F.lit(7), "norm"))


def class_rows(recs: DataFrame) -> DataFrame:
    """``cid, size, t1, t2, ents, norm``: the records of equal text and entities as one row; ``cid`` is the smallest id."""
    return recs.groupBy("t1", "t2", "ents").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("size"), F.first("norm").alias("norm"))


def prefix_length(n: np.ndarray | int, num: int, den: int):
    """``n - ceil(t n) + 1`` for the threshold ``num / den``."""
    return n - (-(-num * n // den)) + 1


def _parts(norms: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts handled at once."""
    begin, size = 0, 0
    for k, t in enumerate(norms):
        size += len(t)
        if size > 2_000_000 or k + 1 - begin == 2048:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(norms):
        yield begin, len(norms)


def distinct_grams(norms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash (52 bits) of each distinct trigram of at most 2048 texts, in order of both."""
    points = np.frombuffer("".join(norms).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(norms), dtype=np.uint64), [len(t) for t in norms])
    inside = owner[:-2] == owner[2:]
    g = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
    key = (owner[:-2][inside] << np.uint64(52)) | (_hash(g[inside]) >> np.uint64(12))
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return (key >> np.uint64(52)).astype(np.int64), key & _LOW52


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BUCKETS_LOG2, dtype=np.int64)
    for batch in batches:
        norms = batch.column(0).to_pylist()
        for b, e in _parts(norms):
            total += np.bincount((distinct_grams(norms[b:e])[1] >> np.uint64(52 - BUCKETS_LOG2)).astype(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def _filled(rows: DataFrame) -> np.ndarray:
    """``bucket, n`` rows as an array of fixed size."""
    got = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BUCKETS_LOG2, dtype=np.int64)
    out[got["bucket"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of trigrams in hash buckets over all texts."""
    return _filled(texts.select("norm").mapInArrow(_count, "bucket int, n bigint"))


def _entity_bucket(e: np.ndarray) -> np.ndarray:
    return (_hash(e) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def _count_entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BUCKETS_LOG2, dtype=np.int64)
    for batch in batches:
        total += np.bincount(_entity_bucket(batch.column(0).flatten().to_numpy(zero_copy_only=False)), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


class Index:
    """Packs the prefixes of batches of texts for their meeting places. Everything it holds has a fixed size."""

    def __init__(self, grams: np.ndarray, entities: np.ndarray, bare: int, buckets: int, num: int, den: int):
        self.levels = np.minimum(255, 12 * np.log2(1.0 + grams)).astype(np.uint64)
        self.entities, self.buckets, self.num, self.den = entities, np.uint64(buckets), num, den
        self.bare = bare
        most = 2.0 ** (np.arange(1, 257) / 12.0)  # of a level
        self.sides = (1 + np.minimum(most, bare) // BLOCK).astype(np.int64), (1 + most // BLOCK).astype(np.int64)

    def prefixes(self, norms: list[str]):
        """Number of trigrams and signature of each text; text, code and position of its prefix's trigrams."""
        own, h = distinct_grams(norms)
        n = np.bincount(own, minlength=len(norms))
        odd = np.bincount(own * SIGNATURE + (h % np.uint64(SIGNATURE)).astype(np.int64), minlength=len(norms) * SIGNATURE) & 1
        sig = np.packbits(odd.astype(np.uint8).reshape(len(norms), SIGNATURE), axis=1).view("<u8")
        key = (own.astype(np.uint64) << np.uint64(52)) | (self.levels[(h >> np.uint64(52 - BUCKETS_LOG2)).astype(np.int64)] << np.uint64(44)) | (h & _LOW44)
        key.sort()
        pos = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
        keep = pos < prefix_length(n, self.num, self.den)[own]
        return n, sig, own[keep], key[keep] & _LOW52, pos[keep]

    def _spread(self, code: np.ndarray, salt: np.ndarray, mine: np.ndarray, other: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Cells of postings: their own line of the grid crosses all lines of the other side. Gives posting and cell."""
        at = np.repeat(np.arange(len(code)), other)
        line = (salt[at] % mine[at].astype(np.uint64)).astype(np.uint64)
        cross = (np.arange(len(at)) - np.repeat(np.cumsum(other) - other, other)).astype(np.uint64)
        a, b = (line, cross) if first else (cross, line)
        return at, _hash(code[at] + a * np.uint64(0x165667B19E3779F9) + b * np.uint64(0x27D4EB2F165667C5))

    def pack(self, norms: list[str], tid: np.ndarray, sizes: np.ndarray, ents: np.ndarray) -> dict[int, list[tuple[bytes, bytes]]]:
        """By bucket: postings, and heads with their codes, of texts with ``sizes`` entities each (``ents``: hashes)."""
        n, sig, own, code, pos = self.prefixes(norms)
        out: dict[int, list[tuple[bytes, bytes]]] = {}
        salt = _hash(tid.view(np.uint64))
        level = (code >> np.uint64(44)).astype(np.int64)
        posts: list[tuple[np.ndarray, np.ndarray, int]] = []  # posting, cell, role
        if self.bare:
            a, b = self.sides[0][level], self.sides[1][level]
            star = _hash(code + np.uint64(1))
            mine = np.flatnonzero(sizes[own] == 0)
            at, cell = self._spread(star[mine], salt[own[mine]], a[mine], b[mine], True)
            posts.append((mine[at], cell, 1))
            at, cell = self._spread(star, salt[own], b, a, False)
            posts.append((at, cell, 0))
        holder = np.repeat(np.arange(len(norms)), sizes)
        seen = self.entities[_entity_bucket(ents)]
        hot = np.flatnonzero(seen > HOT)
        length = np.bincount(own, minlength=len(norms))
        first = np.cumsum(length) - length
        if len(hot):
            runs = length[holder[hot]]
            which = np.repeat(hot, runs)
            p = np.repeat(first[holder[hot]], runs) + np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs)
            both = _hash(code[p] ^ _hash(ents[which].view(np.uint64)))
            side = (1 + np.minimum(seen[which], 2.0 ** ((level[p] + 1) / 12.0)) // BLOCK).astype(np.int64)
            for role in (0, 1):
                at, cell = self._spread(both, salt[own[p]], side, side, bool(role))
                posts.append((p[at], cell, role))
        for p, cell, role in posts:
            rows = np.empty(len(p), dtype=_POSTING)
            rows["code"] = (cell & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows["tid"], rows["n"], rows["pos"], rows["role"], rows["sig"] = tid[own[p]], n[own[p]], pos[p], role, sig[own[p]]
            where = (cell >> np.uint64(32)) % self.buckets
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(where[order]) != 0]) if len(order) else []
            for part in np.split(order, cuts[1:]) if len(order) else []:
                out.setdefault(int(where[part[0]]), []).append((rows[part].tobytes(), b""))
        cold = np.flatnonzero(seen <= HOT)
        if len(cold):
            where = (_hash(ents[cold]) >> np.uint64(8)) % self.buckets
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(where[order]) != 0])
            short = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            for part in np.split(order, cuts[1:]):
                k = holder[cold[part]]
                head = np.empty(len(part), dtype=_HEAD)
                head["ent"], head["tid"], head["n"], head["size"], head["sig"] = ents[cold[part]].view(np.uint64), tid[k], n[k], length[k], sig[k]
                at = np.repeat(first[k], length[k]) + np.arange(int(length[k].sum())) - np.repeat(np.cumsum(length[k]) - length[k], length[k])
                out.setdefault(int(where[part[0]]), []).append((b"", head.tobytes() + short[at].tobytes()))
        return out


def _packer(parts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*parts.value)
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            norms, tid = get("norm").to_pylist(), get("t1").to_numpy(zero_copy_only=False)
            offsets = np.asarray(get("hashes").offsets)
            ents = get("hashes").values.to_numpy(zero_copy_only=False)
            bucket, posts, heads, counts = [], [], [], []
            packed: dict[int, list[tuple[bytes, bytes]]] = {}
            for b, e in _parts(norms):
                for k, v in index.pack(norms[b:e], tid[b:e], np.diff(offsets[b : e + 1]), ents[offsets[b] : offsets[e]]).items():
                    packed.setdefault(k, []).extend(v)
            for k, some in packed.items():
                bucket.append(k)
                posts.append(b"".join(p for p, _ in some))
                mine = [h for _, h in some if h]
                heads.append(b"".join(mine))
                counts.append([len(h) for h in mine])
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, type=pa.int64()), pa.array(posts, type=pa.binary()), pa.array(heads, type=pa.binary()), pa.array(counts, type=pa.list_(pa.int64()))],
                names=["bucket", "posts", "heads", "cuts"],
            )

    return run


def _unpacked(heads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Heads and codes of packed pieces ``heads..., codes...``."""
    hs, cs = [], []
    for piece in heads:
        # A head's size tells how many codes follow all heads.
        k, rest, total = 0, len(piece), 0
        ints = np.frombuffer(piece, dtype=np.uint8)
        while k * _HEAD.itemsize + 4 * total < rest:
            total += int(ints[k * _HEAD.itemsize + 20 : k * _HEAD.itemsize + 24].view("<i4")[0])
            k += 1
        hs.append(np.frombuffer(piece, dtype=_HEAD, count=k))
        cs.append(np.frombuffer(piece, dtype="<u4", offset=k * _HEAD.itemsize))
    return np.concatenate(hs), np.concatenate(cs)


def meetings(a: tuple, b: tuple, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of ``a`` and ``b`` (each: code below 2**32, size, position) of equal code that pass the filters of size and position."""
    (ca, na, pa_), (cb, nb, pb) = a, b
    top = np.int64((1 << 31) - 1)
    order = np.argsort((cb.astype(np.uint64) << np.uint64(32)) | nb.astype(np.uint64), kind="stable")
    key = ((cb.astype(np.uint64) << np.uint64(32)) | nb.astype(np.uint64))[order]
    na, nb, pb = na.astype(np.int64), nb.astype(np.int64)[order], pb.astype(np.int64)[order]
    # The overlap must reach num / (num + den) of both sizes together and can't pass what is left of either side.
    reach = np.clip((den * na - (num + den) * pa_.astype(np.int64)) // num, 0, top)
    back = ((den * nb - (num + den) * pb) // num).astype(np.int32)
    low = -(-num * na // den)
    base = ca.astype(np.uint64) << np.uint64(32)
    lo = np.searchsorted(key, base | low.astype(np.uint64), side="left")
    hi = np.searchsorted(key, base | np.maximum(reach, low - 1).astype(np.uint64), side="right")
    some = np.flatnonzero(hi > lo)
    lo, many, na = lo[some].astype(np.int32), (hi - lo)[some], na[some].astype(np.int32)
    edges = np.cumsum(many)
    begin = 0
    while begin < len(many):
        done = edges[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(edges, done + STEP, side="right")))
        size = many[begin:end]
        ib = np.arange(int(size.sum()), dtype=np.int32) + np.repeat(lo[begin:end] - (np.cumsum(size) - size).astype(np.int32), size)
        ok = np.flatnonzero(back[ib] >= np.repeat(na[begin:end], size))
        yield np.repeat(some[begin:end].astype(np.int32), size)[ok], order[ib[ok]]
        begin = end


class _Signed:
    """Keeps the pairs of different texts whose signatures are near enough; columns lie apart so that a look-up touches little."""

    def __init__(self, rows: np.ndarray):
        self.tid, self.n = rows["tid"].copy(), rows["n"].copy()
        self.words = [rows["sig"][:, k].copy() for k in range(SIGNATURE // 64)]

    def near(self, ia: np.ndarray, other: _Signed, ib: np.ndarray, num: int, den: int) -> np.ndarray:
        """``(smaller, greater)`` hashes of the pairs kept."""
        differ = np.zeros(len(ia), dtype=np.int32)
        for x, y in zip(self.words, other.words, strict=True):
            differ += np.bitwise_count(x[ia] ^ y[ib])
        ok = differ * (num + den) <= (self.n[ia] + other.n[ib]) * (den - num)
        x, y = self.tid[ia[ok]], other.tid[ib[ok]]
        x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
        return np.stack([x, y], axis=1)


def _joiner(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        posts = np.frombuffer(b"".join(table["posts"].to_pylist()), dtype=_POSTING)
        if len(posts):
            a, b = posts[posts["role"] == 1], posts[posts["role"] == 0]
            left, right = _Signed(a), _Signed(b)
            for ia, ib in meetings((a["code"], a["n"], a["pos"]), (b["code"], b["n"], b["pos"]), num, den):
                found.append(left.near(ia, right, ib, num, den))
        pieces: list[bytes] = []
        for whole, cuts in zip(table["heads"].to_pylist(), table["cuts"].to_pylist(), strict=True):
            at = 0
            for c in cuts:
                pieces.append(whole[at : at + c])
                at += c
        if pieces:
            heads, codes = _unpacked(pieces)
            size = heads["size"].astype(np.int64)
            own = np.repeat(np.arange(len(heads)), size)
            pos = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
            code = (_hash(codes ^ _hash(heads["ent"])[own]) >> np.uint64(32)).astype(np.uint32)
            side = (code, heads["n"][own], pos)
            texts = _Signed(heads)
            for ia, ib in meetings(side, side, num, den):
                x, y = own[ia], own[ib]
                once_ = x < y
                found.append(texts.near(x[once_], texts, y[once_], num, den))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pa.table({"ta": pa.array(pairs[:, 0].astype(np.int64)), "tb": pa.array(pairs[:, 1].astype(np.int64))})

    return run


def _verifier(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            keep, sims = [], []
            kept_text, kept = None, set()
            for k, (a, b) in enumerate(zip(get("norm_a").to_pylist(), get("norm_b").to_pylist(), strict=True)):
                if a != kept_text:
                    kept_text, kept = a, {a[i : i + 3] for i in range(len(a) - 2)}
                other = {b[i : i + 3] for i in range(len(b) - 2)}
                both = len(kept & other)
                either = len(kept) + len(other) - both
                if either and both * den >= num * either:
                    keep.append(k)
                    sims.append(both / either)
            at = pa.array(keep, type=pa.int64())
            yield pa.RecordBatch.from_arrays([get(c).take(at) for c in ("a1", "a2", "b1", "b2")] + [pa.array(sims, type=pa.float64())], names=["a1", "a2", "b1", "b2", "similarity"])

    return run


def candidates(cls: DataFrame, num: int, den: int) -> DataFrame:
    """``ta, tb``: pairs of texts (by first hash) that pass all filters at some meeting place."""
    sc = cls.sparkSession.sparkContext
    rows = cls.select("t1", "norm", F.transform("ents", lambda e: F.xxhash64(e)).alias("hashes"))
    n, bare = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.size("hashes") == 0).cast("long")), F.lit(0))).first()
    grams = gram_counts(rows)
    entities = _filled(rows.select("hashes").mapInArrow(_count_entities, "bucket int, n bigint"))
    postings = int(grams.sum() * (den - num) / den) + n
    index = sc.broadcast((grams, entities, bare, max(1, postings // BUCKET), num, den))
    packed = rows.mapInArrow(_packer(index), "bucket bigint, posts binary, heads binary, cuts array<bigint>")
    return packed.groupBy("bucket").applyInArrow(_joiner(num, den), "ta bigint, tb bigint").distinct()


def similar_texts(cls: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """``a1, a2, b1, b2, similarity`` of different texts, of classes that may meet, at or above ``num / den``."""
    pairs = candidates(cls, num, den)
    one = cls.groupBy("t1", "t2").agg(F.first("norm").alias("norm"))
    a = one.select(F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("norm").alias("norm_a")).hint("merge")
    b = one.select(F.col("t1").alias("b1"), F.col("t2").alias("b2"), F.col("norm").alias("norm_b")).hint("merge")
    both = pairs.hint("merge").join(a, F.col("ta") == F.col("a1")).hint("merge").join(b, F.col("tb") == F.col("b1"))
    return both.select("a1", "a2", "b1", "b2", "norm_a", "norm_b").mapInArrow(_verifier(num, den), "a1 bigint, a2 bigint, b1 bigint, b2 bigint, similarity double")


def class_pairs(cls: DataFrame, num: int, den: int, full: int) -> DataFrame:
    """``ca, cb, similarity`` with ``ca < cb``: classes that are similar and share an entity, or of which one has none."""
    texts = written(similar_texts(cls, num, den), "neardup-texts")
    several = cls.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    links = texts.unionByName(several.select(F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("t1").alias("b1"), F.col("t2").alias("b2"), F.lit(1.0).alias("similarity")))
    links = written(links, "neardup-links")
    met = links.select(F.col("a1").alias("t1"), F.col("a2").alias("t2")).unionByName(links.select(F.col("b1").alias("t1"), F.col("b2").alias("t2"))).distinct()
    mine = written(cls.select("t1", "t2", "cid", "ents").hint("merge").join(met.hint("merge"), ["t1", "t2"], "left_semi"), "neardup-met")
    bare = F.size("ents") == 0
    # What a class looks for on the other side, and what it is found by: an entity, any class, or one without entities.
    wants = mine.select("t1", "t2", "cid", F.explode(F.when(bare, F.array(F.lit("\x01any"))).otherwise(F.concat("ents", F.array(F.lit("\x01bare"))))).alias("k"))
    holds = mine.select("t1", "t2", "cid", F.explode(F.concat("ents", F.when(bare, F.array(F.lit("\x01any"), F.lit("\x01bare"))).otherwise(F.array(F.lit("\x01any"))))).alias("k"))

    def standing(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        sizes = rows.groupBy("t1", "t2", "k").agg(F.count(F.lit(1)).alias("c"), F.min("cid").alias("rep"))
        sized = rows.hint("merge").join(sizes.hint("merge"), ["t1", "t2", "k"])
        return sized.filter((F.col("c") <= full) | (F.col("cid") == F.col("rep"))).drop("c", "rep"), sized.filter((F.col("c") > full) & (F.col("cid") != F.col("rep")) & ~F.col("k").startswith("\x01"))

    seek, _ = standing(wants)
    held, rest = standing(holds)
    seek = seek.select(F.col("t1").alias("a1"), F.col("t2").alias("a2"), "k", F.col("cid").alias("x")).hint("merge")
    held = held.select(F.col("t1").alias("b1"), F.col("t2").alias("b2"), "k", F.col("cid").alias("y")).hint("merge")
    pairs = links.hint("merge").join(seek, ["a1", "a2"]).hint("merge").join(held, ["b1", "b2", "k"]).filter("x <> y").select(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb"), "similarity")
    return pairs.unionByName(rest.select(F.col("rep").alias("ca"), F.col("cid").alias("cb"), F.lit(1.0).alias("similarity"))).distinct()


def _prepared(df: DataFrame, key: str, text: str, entities: str) -> tuple[DataFrame, DataFrame]:
    recs = written(records(df, key, text, entities), "neardup-records")
    return recs, written(class_rows(recs), "neardup-classes")


def _members(recs: DataFrame, cls: DataFrame) -> DataFrame:
    """``id, cid, size`` of the records of classes with more than one."""
    return recs.select("id", "t1", "t2", "ents").hint("merge").join(cls.filter("size > 1").select("t1", "t2", "ents", "cid", "size").hint("merge"), ["t1", "t2", "ents"]).select("id", "cid", "size")


def pairs(df: DataFrame, key: str = "id", text: str = "content", entities: str = "entities", num: int = 4, den: int = 5, full: int = FULL) -> DataFrame:
    """``id_a, id_b, similarity`` with ``id_a < id_b``: similar records that share an entity, or of which one has none."""
    recs, cls = _prepared(df, key, text, entities)
    members = written(_members(recs, cls), "neardup-members")
    small = members.filter(F.col("size") <= full)
    other = class_pairs(cls, num, den, full)
    for c in ("ca", "cb"):
        some = small.select(F.col("cid").alias(c), F.col("id").alias(f"id_{c}")).hint("merge")
        other = other.hint("merge").join(some, c, "left").withColumn(f"id_{c}", F.coalesce(f"id_{c}", c))
    other = other.select(F.least("id_ca", "id_cb").alias("id_a"), F.greatest("id_ca", "id_cb").alias("id_b"), "similarity")
    x, y = small.select("cid", F.col("id").alias("id_a")), small.select("cid", F.col("id").alias("id_b"))
    equal = x.hint("merge").join(y.hint("merge"), "cid").filter("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("similarity"))
    star = members.filter((F.col("size") > full) & (F.col("id") != F.col("cid"))).select(F.col("cid").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("similarity"))
    return other.unionByName(equal).unionByName(star)


def classes(df: DataFrame, key: str = "id", text: str = "content", entities: str = "entities") -> DataFrame:
    """``id, class_id, class_size``: every record with a trigram and the class of its exact copies (letters and digits, same entities)."""
    recs = written(records(df, key, text, entities), "neardup-records")
    cls = class_rows(recs).select("t1", "t2", "ents", F.col("cid").alias("class_id"), F.col("size").alias("class_size"))
    return recs.select("id", "t1", "t2", "ents").hint("merge").join(cls.hint("merge"), ["t1", "t2", "ents"]).select("id", "class_id", "class_size")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of each node of undirected ``edges (a, b)``; the root is the component's smallest node.

    Alternating stars: each node links its greater neighbours, then its smaller
    ones, to the least node it knows. Every step is a minimum per node and a
    join, so no component is ever gathered; each round is written to the shared
    folder. The sum of all links falls with every round that changes anything,
    and the stars are reached after about log n rounds.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "components")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.hint("merge").join(least.hint("merge"), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.hint("merge").join(low.hint("merge"), "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, old = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "components"), e
        discard(old)
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
        if state == before:
            roots = e.select(F.col("v").alias("node")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        before = state


def groups(df: DataFrame, key: str = "id", text: str = "content", entities: str = "entities", num: int = 4, den: int = 5, full: int = FULL) -> DataFrame:
    """``id, group_id, n_links``: every record with the smallest id it is linked with, directly or through others, and the number of records it is linked with.

    Links are counted by class: the other members of the own class and all
    members of the linked classes. Nothing is expanded.
    """
    recs, cls = _prepared(df, key, text, entities)
    links = written(class_pairs(cls, num, den, full).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "neardup-class-links")
    roots = components(links)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = cls.select(F.col("cid").alias("b"), "size")
    degree = both.hint("merge").join(sizes.hint("merge"), "b").groupBy("a").agg(F.sum("size").alias("n"))
    per_class = (
        cls.select("t1", "t2", "ents", "cid", "size").hint("merge").join(roots.select(F.col("node").alias("cid"), "root").hint("merge"), "cid", "left")
        .hint("merge").join(degree.select(F.col("a").alias("cid"), "n").hint("merge"), "cid", "left")
        .select("t1", "t2", "ents", F.coalesce("root", "cid").alias("group_id"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    )
    found = recs.select("id", "t1", "t2", "ents").hint("merge").join(per_class.hint("merge"), ["t1", "t2", "ents"]).select("id", "group_id", "n_links")
    ids = df.select(F.col(key).alias("id")).filter(F.col("id").isNotNull()).distinct()
    return ids.hint("merge").join(found.hint("merge"), "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
