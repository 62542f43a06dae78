"""Problem 9: filling context windows of fixed capacity with texts.

Method: swap-based local search. Texts are first laid into windows in the order
they come, which wastes about a fifteenth of the room. Then every window with
room, the fullest first, takes what fills it best out of any other one: by a
move, a swap of one for one (found in one sorted list of all texts in windows
with room) or of two for one (out of the least filled windows). Each exchange
fills a window further at the cost of a lesser filled one and so increases the
sum of squared fills; room gathers in the least filled windows until they are
empty and go. Where the search gets stuck, the windows with room are laid out
anew, longest text first, and it goes on. It ends when no window can go any more or nothing moves.

Plan. Sizes come from the tokenizer's counting operator (narrow). Rows then go
to groups by a hash of their id: the groups are even whatever the data looks
like, because the id is unique and no attribute of a text decides. Each group
of about ``GROUP`` texts is packed in one task; only id and size are shuffled,
12 bytes a text. Groups do not exchange texts: the price is at most about one
underfull window per group, a fraction of a thousandth of the windows.

Defined results: a text above the capacity is cut into pieces of exactly the
capacity (which fill windows of their own) and a rest that is packed like other
texts; null and empty texts have no tokens and are assigned to a window too,
taking no room; ids must be unique (rows with equal ids would be packed as
pieces of their own); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokens

CAPACITY = 6000
#: Texts of a packing group. Bounds a task's memory; the share of room lost falls with it.
GROUP = 40_000
#: Least filled windows that are asked for two texts at once, and rounds of the search; both only bound its time.
GIVERS, ROUNDS = 16, 40


def in_order(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows as lists of item numbers: items in the given order, a new window where one doesn't fit any more."""
    windows: list[list[int]] = []
    room = -1
    for i, n in enumerate(sizes.tolist()):
        if n > room:
            windows.append([])
            room = capacity
        windows[-1].append(i)
        room -= n
    return windows


def longest_first(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows as lists of item numbers: longest item first, each into the fullest window it fits."""
    windows: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room, window) in order
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        k = bisect_left(free, (n, -1))
        if k == len(free):
            windows.append([])
            insort(free, (capacity, len(windows) - 1))
            k = len(free) - 1
        room, w = free.pop(k)
        windows[w].append(i)
        insort(free, (room - n, w))
    return windows


class _Search:
    """Windows with room, and all their items in order of size."""

    def __init__(self, windows: list[list[int]], sizes: np.ndarray, capacity: int):
        self.capacity = capacity
        self.items = [sorted((int(sizes[i]), i) for i in w if sizes[i]) for w in windows]
        self.fill = [sum(s for s, _ in w) for w in self.items]
        self.where = {i: k for k, w in enumerate(self.items) for _, i in w}
        self.index = sorted(x for k, w in enumerate(self.items) if self.fill[k] < capacity for x in w)

    def _single(self, w: int) -> tuple[int, list, list]:
        """The best move into ``w`` or swap of one for one: gain, items in, items out."""
        room, mine, index = self.capacity - self.fill[w], self.fill[w], self.index
        best: tuple[int, list, list] = (0, [], [])
        for t in [(0, -1), *self.items[w]]:
            k = bisect_right(index, (t[0] + room, 1 << 62)) - 1
            while k >= 0 and (gain := index[k][0] - t[0]) > best[0]:
                g = self.where[index[k][1]]
                if g != w and self.fill[g] < mine + gain:
                    best = (gain, [index[k]], [t] if t[1] >= 0 else [])
                    break
                k -= 1
            if best[0] == room:
                break
        return best

    def _double(self, w: int, givers: list[int], least: int) -> tuple[int, list, list]:
        """The best swap of two items of a giver for one of ``w`` (or for none) that gains more than ``least``."""
        room, mine = self.capacity - self.fill[w], self.fill[w]
        best: tuple[int, list, list] = (least, [], [])
        for g in givers:
            give = self.items[g]
            if g == w or not self.fill[g] < mine + room:
                continue
            for t in [(0, -1), *self.items[w]]:
                want = t[0] + room
                for j in range(len(give) - 1, 0, -1):
                    k = bisect_right(give, (want - give[j][0], 1 << 62), 0, j) - 1
                    if k < 0:
                        continue
                    gain = give[j][0] + give[k][0] - t[0]
                    if gain > best[0] and self.fill[g] < mine + gain:
                        best = (gain, [give[k], give[j]], [t] if t[1] >= 0 else [])
                        if gain == room:
                            return best
        return best

    def _exchange(self, w: int, come: list, go: list) -> None:
        g = self.where[come[0][1]]
        for x in come:
            self.items[g].remove(x)
            insort(self.items[w], x)
            self.where[x[1]] = w
        for x in go:
            self.items[w].remove(x)
            insort(self.items[g], x)
            self.where[x[1]] = g
        gain = sum(s for s, _ in come) - sum(s for s, _ in go)
        self.fill[g] -= gain
        self.fill[w] += gain
        if self.fill[w] == self.capacity:
            for x in self.items[w]:
                del self.index[bisect_left(self.index, x)]

    def round(self) -> bool:
        """Every window with room, the fullest first, takes what fills it best. Whether anything moved."""
        open_ = sorted((w for w, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda w: (-self.fill[w], w))
        moved = False
        for w in open_:
            while 0 < self.fill[w] < self.capacity:
                gain, come, go = self._single(w)
                if gain < self.capacity - self.fill[w]:
                    least = sorted((g for g in open_[-4 * GIVERS :] if self.fill[g]), key=lambda g: (self.fill[g], g))[:GIVERS]
                    more = self._double(w, least, gain)
                    if more[1]:
                        gain, come, go = more
                if not come:
                    break
                self._exchange(w, come, go)
                moved = True
        return moved


def local_search(windows: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Fills windows by moves, swaps of one for one and of two for one, out of any window of lesser fill, and drops those that become empty.

    Every exchange increases the sum of squared fills, so the search ends; after
    ``ROUNDS`` rounds it ends anyway, which costs room but no item.
    """
    s = _Search(windows, sizes, capacity)
    for k in range(ROUNDS):
        rest = [w for w, f in enumerate(s.fill) if 0 < f < capacity]
        # No window can go any more once those with room are as few as they can be.
        if len(rest) <= -(-sum(s.fill[w] for w in rest) // capacity):
            break
        if k % 8 != 7 and s.round():
            continue
        # Stuck, or for long busy with little: the windows with room are laid out anew, if that takes fewer of them.
        mine = [i for w in rest for _, i in s.items[w]]
        anew = longest_first(sizes[mine], capacity)
        if len(anew) >= len(rest):
            if k % 8 != 7:
                break
            continue
        full = [[i for _, i in w] for w, f in zip(s.items, s.fill, strict=True) if f == capacity]
        s = _Search(full + [[mine[j] for j in w] for w in anew], sizes, capacity)
    out = [[i for _, i in w] for w in s.items if w]
    nothing = [i for w in windows for i in w if not sizes[i]]
    if nothing:
        out = out or [[]]
        out[-1] += nothing
    return out


def _packer(key: str, capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece"], kind="stable", na_position="last").reset_index(drop=True)
        sizes = pdf["n_tokens"].to_numpy(dtype=np.int64)
        full = np.flatnonzero(sizes == capacity)
        rest = np.flatnonzero(sizes < capacity)
        windows = [[int(i)] for i in full]
        inner = local_search(in_order(sizes[rest], capacity), sizes[rest], capacity) if len(rest) else []
        windows += [[int(rest[i]) for i in w] for w in inner]
        number = np.empty(len(pdf), dtype=np.int64)
        for k, w in enumerate(windows):
            number[w] = k
        group = pdf["grp"].to_numpy(dtype=np.int64)
        return pdf.assign(window_id=group * 10_000_000 + number)[[key, "piece", "n_tokens", "window_id"]]

    return pack


def pack(counts: DataFrame, key: str, n_rows: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``key, piece, n_tokens, window_id`` from ``key, n_tokens``. Pieces are counted from 0.

    ``n_rows`` (the table's row count, known from its footers) sets the number of groups.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    last = F.greatest(F.ceil(n / F.lit(capacity)) - 1, F.lit(0)).cast("int")
    pieces = counts.select(key, n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    groups = max(1, -(-n_rows // group))
    sized = pieces.select(
        key,
        "piece",
        F.least(F.col("n") - F.col("piece") * F.lit(capacity), F.lit(capacity)).cast("int").alias("n_tokens"),
        F.pmod(F.xxhash64(key, "piece"), F.lit(groups)).alias("grp"),
    )
    kind = counts.schema[key].dataType.simpleString()
    return sized.groupBy("grp").applyInPandas(_packer(key, capacity), f"`{key}` {kind}, piece int, n_tokens int, window_id bigint")


def windows(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """Assignment of each text of ``df`` (or its pieces) to windows of ``capacity`` tokens."""
    return pack(tokens.token_counts(df, key, text, tokenizer), key, df.count(), capacity)
