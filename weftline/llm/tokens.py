"""Problem 8: encoding the whole corpus with a public byte-level BPE tokenizer.

Method: corpus-level merge replay. The distinct pieces ("words") of all texts
of a task are laid out one after another; an inverted index from merge rank
(token pair) to positions then applies every merge in rank order, and a merge
touches only its two neighbours, whose new pairs enter the index. A merge
cannot create a pair of a smaller rank, so one sweep over the ranks gives
exactly the ids that encoding text by text gives. Words met before in the task
keep their ids, so each is replayed once per task.

Why per task and not per cluster: a cluster-wide word table would need every
word occurrence to be shuffled to its entry and back, tens of bytes for about
five bytes of text, while the replay costs seconds per task. The operator is
therefore narrow: no shuffle, no broadcast that grows with the data (the merge
table is the vocabulary's size), and a lost executor costs its tasks only.

Cutting texts into words (the tokenizer's pattern) is done for whole batches on
code-point arrays with numpy: class changes, the space that joins the next
word, the last character of white space before a word, and the contractions.

Defined results: a null text and an empty text have the empty list of ids;
special-token strings in a text are ordinary text; texts of any length are
encoded whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Code points handled at once, and words remembered per task; both only bound memory.
CHUNK = 1_000_000
REMEMBERED = 1_500_000

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Unicode's White_Space property (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def load_merges(path: str) -> tuple[np.ndarray, np.ndarray]:
    """``byte_ids`` (256) and ``pairs`` (merges x 2) of the tokenizer's JSON file; merge r makes token 256 + r."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes the vocabulary shows as themselves
    hidden = [b for b in range(256) if b not in set(shown)]
    char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    byte_ids = np.array([vocab[char[b]] for b in range(256)], dtype=np.int32)
    pairs = np.array([[vocab[x] for x in (m if isinstance(m, list) else m.split(" "))] for m in model["merges"]], dtype=np.int32)
    return byte_ids, pairs


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[WHITE] = SPACE
    return table


_powers_kept: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers_kept[0]) < n:
        size = max(n, CHUNK + 100_000)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers_kept[k] = np.multiply.accumulate(p)
    return _powers_kept[0], _powers_kept[1]


def word_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where words begin in the code points of texts laid end to end; ``text_starts`` are those of non-empty texts."""
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n, dtype=bool)
    first[text_starts] = True
    starts = first.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    after_white = np.flatnonzero(starts[1:] & ~first[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    starts[after_white - 1] = True
    starts[after_white[points[after_white - 1] == 32]] = False
    quote = np.flatnonzero(starts[:-1] & (points[:-1] == 39) & ~first[1:]) if n > 1 else np.empty(0, np.int64)
    if len(quote):
        one = points[quote + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        q = quote[short]
        starts[q + 1] = False
        starts[q[q + 2 < n] + 2] = True
        rest = quote[~short]
        rest = rest[rest + 2 < n]
        rest = rest[~first[rest + 2]]
        a, b = points[rest + 1], points[rest + 2]
        long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        q = rest[long]
        starts[q + 1] = False
        starts[q[q + 3 < n] + 3] = True
    return np.flatnonzero(starts)


class Replay:
    """Ids of words by replaying all merges over them; remembers words across batches."""

    def __init__(self, byte_ids: np.ndarray, pairs: np.ndarray):
        self.byte_ids = byte_ids
        self.left, self.right = pairs[:, 0].tolist(), pairs[:, 1].tolist()
        codes = (pairs[:, 0].astype(np.int64) << 20) | pairs[:, 1]
        self.rank = dict(zip(codes.tolist(), range(len(codes)), strict=True))
        order = np.argsort(codes)
        self.codes, self.code_rank = codes[order], order.astype(np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one word after another, and the number of ids of each."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        first = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)].astype(np.int64)
        n = len(first)
        at = np.arange(n, dtype=np.int64)
        after, before = at + 1, at - 1
        after[ends - 1] = -1
        before[ends - sizes] = -1
        code = (first[:-1] << 20) | first[1:]
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = np.flatnonzero((self.codes[k] == code) & (after[:-1] >= 0))
        ranks = self.code_rank[k[hit]]
        order = np.argsort(ranks, kind="stable")
        ranks, hit = ranks[order], hit[order]
        cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else np.empty(0, np.int64)
        index: dict[int, list[int]] = {}
        for r, part in zip(ranks[cuts].tolist(), np.split(hit, cuts[1:]), strict=False):
            index[r] = part.tolist()
        heap = sorted(index)
        sym, nxt, prv, rank, left, right = first.tolist(), after.tolist(), before.tolist(), self.rank, self.left, self.right
        while heap:
            r = heapq.heappop(heap)
            a, b, new = left[r], right[r], 256 + r
            places = index.pop(r)
            if a == b:
                places.sort()  # of overlapping pairs the leftmost merges
            for p in places:
                if sym[p] != a:
                    continue
                q = nxt[p]
                if q < 0 or sym[q] != b:
                    continue
                sym[p], sym[q] = new, -1
                q = nxt[p] = nxt[q]
                if q >= 0:
                    prv[q] = p
                    s = rank.get((new << 20) | sym[q])
                    if s is not None:
                        if s in index:
                            index[s].append(p)
                        else:
                            index[s] = [p]
                            heapq.heappush(heap, s)
                q = prv[p]
                if q >= 0:
                    s = rank.get((sym[q] << 20) | new)
                    if s is not None:
                        if s in index:
                            index[s].append(q)
                        else:
                            index[s] = [q]
                            heapq.heappush(heap, s)
        out = np.array(sym, dtype=np.int32)
        alive = out >= 0
        return out[alive], np.add.reduceat(alive.astype(np.int32), ends - sizes) if n else np.empty(0, np.int32)

    def batch(self, texts: list[str | None], with_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids one text after another."""
        if len(self.known) > REMEMBERED:
            self.forget()
        chunks: list[tuple[int, int]] = []
        size, begin = 0, 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size >= CHUNK:
                chunks.append((begin, k + 1))
                begin, size = k + 1, 0
        if begin < len(texts):
            chunks.append((begin, len(texts)))
        fresh: list[bytes] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []  # of each chunk: word index of each word, words of each text
        known = self.known
        for b, e in chunks:
            part = [t or "" for t in texts[b:e]]
            whole = "".join(part)
            lens = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            if not whole:
                found.append((np.empty(0, np.int64), np.zeros(len(part), np.int64)))
                continue
            points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            tops = np.cumsum(lens)
            starts = word_starts(points, (tops - lens)[lens > 0])
            ends = np.append(starts[1:], len(points))
            up, down = _powers(len(points) + 1)
            sums = np.zeros(len(points) + 1, dtype=np.uint64)
            np.cumsum((points + np.uint32(1)).astype(np.uint64) * up[: len(points)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * down[starts]
            h ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            uniq, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            place = np.empty(len(uniq), dtype=np.int64)
            s, t = starts[at].tolist(), ends[at].tolist()
            for j, key in enumerate(uniq.tolist()):
                w = known.get(key)
                if w is None:
                    w = known[key] = len(known)
                    fresh.append(whole[s[j] : t[j]].encode("utf-8", "surrogatepass"))
                place[j] = w
            cuts = np.searchsorted(starts, np.r_[0, tops])
            found.append((place[inverse], np.diff(cuts)))
        if fresh:
            ids, lengths = self.replay(fresh)
            self.ids.append(ids)
            self.lengths.append(lengths)
            self.ids, self.lengths = [np.concatenate(self.ids)], [np.concatenate(self.lengths)]
        if not self.ids:
            return np.zeros(len(texts), np.int64), np.empty(0, np.int32)
        ids, lengths = self.ids[0], self.lengths[0].astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        counts, all_ids = [], []
        for words, per_text in found:
            n = lengths[words]
            run = np.concatenate([[0], np.cumsum(n)])
            edge = np.concatenate([[0], np.cumsum(per_text)])
            counts.append(np.diff(run[edge]))
            if with_ids and len(words):
                all_ids.append(ids[np.repeat(begins[words] - run[:-1], n) + np.arange(run[-1])])
        return np.concatenate(counts) if counts else np.empty(0, np.int64), np.concatenate(all_ids) if all_ids else np.empty(0, np.int32)


def _encoder(merges, with_ids: bool, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = Replay(*merges.value)
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            counts, ids = replay.batch(batch.column(batch.schema.get_field_index(text)).to_pylist(), with_ids)
            if with_ids:
                offsets = np.zeros(len(counts) + 1, dtype=np.int32)
                np.cumsum(counts, out=offsets[1:])
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, out], names=[key, "ids"])
            else:
                yield pa.RecordBatch.from_arrays([keys, pa.array(counts.astype(np.int32))], names=[key, "n_tokens"])

    return run


def _apply(df: DataFrame, key: str, text: str, tokenizer: str, with_ids: bool) -> DataFrame:
    merges = df.sparkSession.sparkContext.broadcast(load_merges(tokenizer))  # the vocabulary's size, about 0.5 MB
    kind = df.schema[key].dataType.simpleString()
    out = "ids array<int>" if with_ids else "n_tokens int"
    return df.select(key, text).mapInArrow(_encoder(merges, with_ids, key, text), f"`{key}` {kind}, {out}")


def encode(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, ids``: the token ids of each text."""
    return _apply(df, key, text, tokenizer, True)


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, n_tokens``: the number of token ids of each text."""
    return _apply(df, key, text, tokenizer, False)
