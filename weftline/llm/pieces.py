"""Problem 1: cutting oversized texts at natural boundaries.

Method: pointer doubling. Every place where a piece may end is a boundary, with
a strength (paragraph, line, sentence, clause, word, anywhere). Each boundary
is joined with its farthest legal successor, the last boundary within the limit
counted from where a piece after it starts (the overlap lies before the
boundary). Squaring the successor table again and again doubles the number of
cuts each pointer spans, so the set of cuts reached from a text's start is
complete after log2(cuts) rounds, for all texts of a batch at once and without
walking a text cut by cut.

Plan. One narrow Arrow stage; a batch's boundaries are arrays laid end to end,
the join is a binary search in them. No shuffle but the one that makes equal
keys one record, and that only sees texts above the limit.

Which boundary is taken: within the window of a piece the strongest kind in its
last ``1 - LEAST_FILL`` share decides, of several the last; if the window holds
none stronger than "anywhere", the piece ends at the limit.

Defined results: a null or blank text has no pieces (white space is any character Unicode counts as such); a text within the limit is
one piece; white space at both ends of a text is dropped, everything between is
kept, so that the pieces without their overlaps, in order, are the text; an
overlap is at most the asked length, begins at a word where there is one and is
empty where a text has no break in reach; rows with equal keys are one record
(the greatest text decides); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 300
OVERLAP = 40
#: A natural boundary counts if it fills the window at least so far.
LEAST_FILL = 0.5

_KINDS = [  # strength, what ends at a boundary; the white space after it belongs to the piece
    (5, re.compile(r"(?:\r?\n[ \t]*){2,}")),
    (4, re.compile(r"\r?\n[ \t]*")),
    (3, re.compile(r"[.!?…]+[\"'»”’)\]]*\s+|[。！？…]+[」』）]*\s*")),
    (2, re.compile(r"[,;:]\s+|\s[–—-]\s+|[、，；：]\s*")),
    (1, re.compile(r"\s+")),
]
ANYWHERE = 0


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where a piece may end and their strengths; 0 and the text's length are always among them."""
    strength: dict[int, int] = {}
    for k, rx in _KINDS:
        for m in rx.finditer(text):
            strength.setdefault(m.end(), k)
    strength[0] = strength[len(text)] = 6
    at = np.fromiter(strength, dtype=np.int64, count=len(strength))
    order = np.argsort(at)
    return at[order], np.fromiter(strength.values(), dtype=np.int64, count=len(strength))[order]


def _with_hard_cuts(at: np.ndarray, kind: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Adds boundaries of strength 0 where two neighbours lie more than ``step`` apart, so that a successor always exists."""
    gap = np.diff(at)
    wide = np.flatnonzero(gap > step)
    if not len(wide):
        return at, kind
    more = np.concatenate([np.arange(at[k] + step, at[k + 1], step) for k in wide])
    at, kind = np.concatenate([at, more]), np.concatenate([kind, np.full(len(more), ANYWHERE)])
    order = np.argsort(at, kind="stable")
    return at[order], kind[order]


def successors(at: np.ndarray, kind: np.ndarray, begin: np.ndarray, tops: np.ndarray, limit: int) -> np.ndarray:
    """For each boundary its farthest legal successor; ``begin`` is where a piece after it starts, ``tops`` the index of its text's end."""
    n = len(at)
    index = np.arange(n)
    far = np.minimum(np.searchsorted(at, begin + limit, side="right") - 1, tops)
    best = np.where(far > index, far, np.minimum(index + 1, tops))
    least = begin + int(limit * LEAST_FILL)
    open_ = far < tops
    for strength in (1, 2, 3, 4, 5):
        places = np.flatnonzero(kind >= strength)
        last = places[np.maximum(np.searchsorted(places, far, side="right") - 1, 0)] if len(places) else np.zeros(n, dtype=np.int64)
        good = open_ & (last > index) & (at[last] >= np.maximum(least, at + 1)) & (last <= far)
        best = np.where(good, last, best)
    return best


def reached(succ: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Boundaries reached from the roots by any number of steps: the reached set doubles its range as the table is squared."""
    mark = np.zeros(len(succ), dtype=bool)
    mark[roots] = True
    jump = succ
    while True:
        before = int(mark.sum())
        mark[jump[np.flatnonzero(mark)]] = True
        squared = jump[jump]
        if int(mark.sum()) == before and np.array_equal(squared, jump):
            return mark
        jump = squared


def cut(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[tuple[int, int, int]]]:
    """For each text its pieces ``(start of the overlap, start, end)``."""
    ats, kinds, tops, roots, starts = [], [], [], [], []
    base, index = 0, 0
    room = max(1, limit - overlap)
    for t in texts:
        at, kind = _with_hard_cuts(*boundaries(t), room)
        # Where the overlap of a piece after each boundary starts: at the first word in reach.
        words = at[kind >= 1]
        k = np.searchsorted(words, at - overlap, side="left")
        begin = np.minimum(words[np.minimum(k, len(words) - 1)], at) if overlap else at
        ats.append(at + base)
        kinds.append(kind)
        starts.append(begin + base)
        tops.append(np.full(len(at), index + len(at) - 1))
        roots.append(index)
        base += len(t) + limit + 1  # texts lie so far apart that no window reaches the next
        index += len(at)
    if not texts:
        return []
    at, begin = np.concatenate(ats), np.concatenate(starts)
    succ = successors(at, np.concatenate(kinds), begin, np.concatenate(tops), limit)
    mark = reached(succ, np.array(roots))
    out = []
    for k, r in enumerate(roots):
        e = roots[k + 1] if k + 1 < len(roots) else index
        cuts = r + np.flatnonzero(mark[r:e])
        zero = at[r]
        places = at[cuts] - zero
        over = begin[cuts] - zero
        out.append([(int(over[j]), int(places[j]), int(places[j + 1])) for j in range(len(cuts) - 1)])
    return out


def _cutter(keys: list[str], text: str, limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").strip() for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            row, number, piece, lap = [], [], [], []
            for k, parts in enumerate(cut(texts, limit, overlap)):
                for j, (o, s, e) in enumerate(parts):
                    row.append(k)
                    number.append(j)
                    piece.append(texts[k][o:e])
                    lap.append(s - o)
            take = pa.array(row, type=pa.int64())
            columns = [batch.column(batch.schema.get_field_index(c)).take(take) for c in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number, type=pa.int32()), pa.array(piece, type=pa.string()), pa.array(lap, type=pa.int32())], names=[*keys, "piece_no", "piece", "overlap"])

    return run


def split(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = False) -> DataFrame:
    """``keys, piece_no, piece, overlap``: the pieces of each record; ``overlap`` characters of a piece repeat the one before.

    With ``oversized_only`` texts within the limit are left out before they reach Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    records = df.select(*keys, text)
    if oversized_only:
        records = records.filter(F.length(text) > limit)
    records = records.groupBy(*keys).agg(F.max(text).alias(text))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return records.mapInArrow(_cutter(keys, text, limit, overlap), f"{kinds}, piece_no int, piece string, overlap int")


def oversized(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``keys`` of the records that had to be cut: those with a second piece."""
    return split(df, keys, text, limit, overlap, oversized_only=True).filter(F.col("piece_no") == 1).select(*keys)
