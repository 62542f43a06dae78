"""Exact set-similarity join of texts as sets of words, without candidates on disk.

Words are put in one order, rare before frequent. Two texts that are alike share
a word among the first few of each; the text travels once to every bucket that
holds one of its first words, from that word on. In a bucket the texts meet by
their first shared word. Where many meet, they go on to their second, third and
further shared words, whose places are bounded in the same way; only then pairs
are looked at, with bounds on sizes and places, a signature of 64 bits and at last
the exact count. Nothing is written but packed texts and the pairs that hold.

A word is a number: its place among the frequent ones (at most 65,536, whatever
the size of the collection), otherwise a hash of 64 bits, of which it is counted
beforehand that no two words share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.session import discard, written

#: Frequent words have two bytes.
FREQUENT = 1 << 16
#: So many texts that share a word are compared in pairs; with each further word they share, so many times more.
SMALL, MORE = 24, 4
#: Texts of the collection for each bucket, and the least number of buckets.
SHARE, BUCKETS = 10_000, 12
#: Postings and pairs that are held at a time.
HELD = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Alike: word Jaccard at least (or, if strict, above) ``num / den``."""

    num: int
    den: int
    strict: bool

    def shared(self, n):
        """Words that a set of ``n`` shares at least with any set like it."""
        return n * self.num // self.den + 1 if self.strict else -(-n * self.num // self.den)

    def needed(self, both):
        """Words that two sets of ``both`` words together share at least."""
        return both * self.num // (self.num + self.den) + 1 if self.strict else -(-both * self.num // (self.num + self.den))

    def slack(self, n, missed):
        """What two sets have of it must not add up to less than 0."""
        return n * (self.den - self.num) - missed * (self.den + self.num)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``counts`` items each: whose the item is, and its number from 0."""
    whose = np.repeat(np.arange(len(counts)), counts)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts, counts)


def _parts(counts: np.ndarray) -> Iterator[slice]:
    """Slices of about ``HELD`` items, at least one entry each."""
    ends, begin = np.cumsum(counts), 0
    while begin < len(counts):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HELD, "right")))
        yield slice(begin, end)
        begin = end


class Bucket:
    """Texts by number: ``n`` words, of which ``word[start : start + size]`` are here, the first at place ``off`` of the order."""

    def __init__(self, rule: Rule, n: np.ndarray, off: np.ndarray, size: np.ndarray, word: np.ndarray):
        self.rule, self.n, self.off, self.word = rule, n, off, word
        self.start, self.size = np.cumsum(size) - size, size
        self.last = n - rule.shared(n)
        self.words = int(word.max(initial=0)) + 1
        bit = np.uint64(1) << ((word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
        self.sign = np.bitwise_or.reduceat(bit, self.start) if len(n) else np.zeros(0, np.uint64)

    def pairs(self, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of texts that are alike and whose first shared word is at one of the given places."""
        found = list(self._met(text, place, np.zeros(len(text), np.int64), 1))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // len(self.n), both % len(self.n)

    def _met(self, text: np.ndarray, place: np.ndarray, group: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """Pairs, each as one number, of texts of a group whose ``k``-th shared word is at the given places."""
        if not len(text):
            return
        key = group * self.words + self.word[self.start[text] + place - self.off[text]]
        slack = self.rule.slack(self.n[text], place - k + 1)
        by = np.lexsort((-slack, key))
        text, place, key, slack = text[by], place[by], key[by], slack[by]
        # Only what has a partner: where the text with most slack can't make up for another's lack, none can.
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
        ok = slack + slack[first][group] >= 0
        text, place, group, slack = text[ok], place[ok], group[ok], slack[ok]
        count = np.bincount(group, minlength=len(first))
        later = (count > SMALL * MORE ** (k - 1))[group]
        # What shares ``k`` words and no more is alike only if both are short.
        now = ~later | (self.rule.shared(self.n[text]) <= k)
        yield from self._compared(text[now], place[now], group[now], slack[now], k)
        text, place, group = text[later], place[later], np.unique(group[later], return_inverse=True)[1]
        if not len(text):
            return
        more = np.minimum(self.last[text] + k, self.n[text] - 1) - place
        begins = np.searchsorted(group, np.arange(group[-1] + 2))
        for part in _parts(np.add.reduceat(more, begins[:-1])):
            at = slice(begins[part.start], begins[part.stop])
            whose, step = _spread(more[at])
            yield from self._met(text[at][whose], place[at][whose] + 1 + step, group[at][whose], k + 1)

    def _compared(self, text: np.ndarray, place: np.ndarray, group: np.ndarray, slack: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """All pairs within groups that are alike, each as one number. ``slack`` falls within a group."""
        if not len(text):
            return
        wide = 2 * int(np.abs(slack).max()) + 1
        first = np.searchsorted(group, group)
        # Those before it in the group with enough slack for both.
        partners = np.minimum(np.arange(len(text)), np.searchsorted(group * wide - slack, group * wide + slack, "right")) - first
        for part in _parts(partners):
            j, i = _spread(partners[part])
            j += part.start
            i += first[j]
            a, b = text[i], text[j]
            na, nb = self.n[a], self.n[b]
            need = self.rule.needed(na + nb)
            ok = k + np.minimum(na - place[i], nb - place[j]) - 1 >= need
            ok &= np.bitwise_count(self.sign[a] ^ self.sign[b]) <= na + nb - 2 * need
            if ok.any():
                pair = np.unique(np.minimum(a[ok], b[ok]) * len(self.n) + np.maximum(a[ok], b[ok]))
                yield pair[self._alike(pair // len(self.n), pair % len(self.n))]

    def _alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        size = self.size[a] + self.size[b]
        for part in _parts(size):
            pa_, ea = _spread(self.size[a[part]])
            pb_, eb = _spread(self.size[b[part]])
            held = np.r_[pa_ * self.words + self.word[self.start[a[part]][pa_] + ea], pb_ * self.words + self.word[self.start[b[part]][pb_] + eb]]
            held.sort()
            both = np.bincount(held[1:][held[1:] == held[:-1]] // self.words, minlength=part.stop - part.start)
            out[part] = both >= self.rule.needed(self.n[a[part]] + self.n[b[part]])
        return out


_COLUMNS = {"k": np.int64, "n": np.int32, "off": np.int32, "rare": np.int32, "hashes": np.int64, "places": np.uint16}
_PACKED = "bucket int, " + ", ".join(f"{c} binary" for c in _COLUMNS)


def _squeezed(values: np.ndarray, kind: type) -> bytes:
    """Numbers byte by byte, all first bytes before all second ones, after their count."""
    planes = np.ascontiguousarray(values, kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _unsqueezed(packed: bytes, kind: type) -> np.ndarray:
    count, width = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(packed[8:], count * width, asbytes=True) if count else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, count).T).view(kind).ravel()


def _packer(rule: Rule, frequent, buckets: int):
    """Texts with their words' hashes to one row per batch and bucket. ``frequent``: broadcast hashes of the frequent words, from rare to frequent."""
    schema = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in _COLUMNS]])

    def pack(batches):
        known = frequent.value
        by = np.argsort(known)
        ordered = known[by]
        for batch in batches:
            h = batch.column("h")
            word, n = h.flatten().to_numpy(), np.diff(h.offsets.to_numpy()).astype(np.int64)
            text, _ = _spread(n)
            at = np.minimum(np.searchsorted(ordered, word), max(0, len(ordered) - 1))
            common = ordered[at] == word if len(ordered) else np.zeros(len(word), bool)
            code = np.where(common, by[at] if len(by) else 0, word)
            o = np.lexsort((code, common, text))
            code, common = code[o], common[o]
            start, (_, place) = np.cumsum(n) - n, _spread(n)
            early = np.flatnonzero(place <= np.repeat(n - rule.shared(n), n))
            # The first place of each text in each bucket.
            key = np.mod(code[early], buckets) * len(n) + text[early]
            key, first = np.unique(key, return_index=True)
            bucket, whose, off = key // len(n), key % len(n), place[early][first]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            keys, rare = batch.column("k").to_numpy(), np.bincount(text, weights=~common, minlength=len(n)).astype(np.int64)
            rows = []
            for b in range(buckets):
                t, f = whose[ends[b] : ends[b + 1]], off[ends[b] : ends[b + 1]]
                if not len(t):
                    continue
                who, step = _spread(n[t] - f)
                c, g = code[(at := start[t][who] + f[who] + step)], common[at]
                held = {"k": keys[t], "n": n[t], "off": f, "rare": np.maximum(rare[t] - f, 0), "hashes": c[~g], "places": c[g]}
                rows.append({"bucket": b} | {x: _squeezed(held[x], kind) for x, kind in _COLUMNS.items()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pack


def _joiner(rule: Rule, buckets: int):
    def join(packed: pa.Table) -> pa.Table:
        def whole(c):
            return np.concatenate([_unsqueezed(x, _COLUMNS[c]) for x in packed.column(c).to_pylist()])

        bucket = packed.column("bucket")[0].as_py()
        k, n, off, rare = (whole(c).astype(np.int64) for c in ("k", "n", "off", "rare"))
        size = n - off
        hashes, of_hash = np.unique(whole("hashes"), return_inverse=True)
        # Rare words stand first in each text.
        whose, step = _spread(size)
        is_rare = step < rare[whose]
        word, place = np.empty(len(whose), np.int64), off[whose] + step
        word[is_rare] = of_hash + FREQUENT
        word[~is_rare] = whole("places")
        here = np.mod(word, buckets) == bucket
        here[is_rare] = (np.mod(hashes, buckets) == bucket)[of_hash]
        here &= place <= (n - rule.shared(n))[whose]
        a, b = Bucket(rule, n, off, size, word).pairs(whose[here], place[here])
        return pa.table({"a": np.minimum(k[a], k[b]), "b": np.maximum(k[a], k[b])})

    return join


def similar_pairs(df: DataFrame, key: str, text: str, num: int, den: int, strict: bool) -> DataFrame:
    """``a, b`` with ``a < b``: rows (``key`` is a bigint) whose word Jaccard is at least (or, if strict, above) ``num / den``. Empty texts match nothing."""
    rule, spark = Rule(num, den, strict), df.sparkSession
    sets = df.select(F.col(key).alias("k"), F.array_distinct(T.words(F.col(text))).alias("w")).filter(F.size("w") > 0)
    salt = 0
    while True:
        counts = sets.select(F.explode("w").alias("x")).groupBy(F.xxhash64(F.lit(salt), "x").alias("h")).agg(F.count(F.lit(1)).alias("f"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        counts = written(counts.select("h", "f", (F.col("lo") != F.col("hi")).alias("two")), "dedup-words")
        total, two = counts.agg(F.sum("f"), F.max("two")).first()
        if not two:
            break
        discard(counts)
        salt += 1
    # At most 65,536 words can reach this share of all words.
    often = counts.filter(F.col("f") * FREQUENT >= F.lit(total)).orderBy("f", "h").select("h").toArrow().column("h").to_numpy()
    discard(counts)
    frequent = spark.sparkContext.broadcast(np.array(often, np.int64))
    buckets = max(BUCKETS, -(-df.count() // SHARE))
    coded = sets.select("k", F.transform("w", lambda w: F.xxhash64(F.lit(salt), w)).alias("h"))
    packed = coded.mapInArrow(_packer(rule, frequent, buckets), _PACKED)
    return packed.groupBy("bucket").applyInArrow(_joiner(rule, buckets), "a bigint, b bigint").distinct()
