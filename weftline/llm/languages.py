"""Problem 4: missing or wrong language labels.

Method: language-bitmask n-gram filters. Character n-grams and words are hashed
into bit-sliced Bloom filters: one byte per slot, one bit per language, so that
the AND of a few slots returns all languages that may hold an n-gram. Per
language the hits of a stretch of text are counted (popcount), corrected for the
filter's share of false positives, and the counts decide.

The filters are fitted on a bounded sample of labelled rows (``TRAIN_ROWS``,
drawn by hash). Labels are partly wrong and texts partly mixed, so an n-gram
enters a language's filter only if it is not much rarer there than in the
language where it is most frequent. Everything else runs over all rows.

Plan. The filters are one megabyte and are broadcast; tagging is a narrow Arrow
stage that handles a batch's stretches as one array of code points. Rows with
equal keys meet once, in the shuffle of keys and results.

A text is cut into stretches at ends of sentences, line breaks and separators
between blanks; annotations, markup and tokens with digits are no language. A
stretch counts as a sentence of a language if it has ``LEAST_WORDS`` words of it
and leads clearly; other stretches take the language of the sentence before
them, or else after them.

Defined results: a null, blank or wordless text has a null language, confidence
0 and no stretches; a label counts as right if it spells the language in any
known way (code, three-letter code, region code, English or own name); rows with
equal keys are one record; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.tables import drawn, thinned

LANGUAGES = ["en", "ja", "de", "fr", "es", "pt"]
#: Labelled rows the filters are fitted on; bounds the driver's work.
TRAIN_ROWS = 8_000
TRAIN_LONGEST = 4_000
SLOTS_LOG2, HASHES = 20, 2
NGRAMS = (3, 4, 5)
#: An n-gram belongs to a language if its rate there is at least this share of its highest rate, and it was seen so often.
SHARE, LEAST_SEEN = 0.25, 3
LEAST_WORDS = 3

#: Spellings of the languages.
SPELLINGS = {
    "en": ["en", "eng", "english", "englisch", "anglais", "inglés", "inglês", "英語"],
    "ja": ["ja", "jp", "jpn", "japanese", "japanisch", "japonais", "japonés", "japonês", "日本語"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "alemão", "ドイツ語"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "francês", "フランス語"],
    "es": ["es", "spa", "spanish", "español", "espanol", "spanisch", "espagnol", "castellano", "espanhol", "スペイン語"],
    "pt": ["pt", "por", "portuguese", "português", "portugues", "portugiesisch", "portugais", "portugués", "ポルトガル語"],
}

_NOISE = re.compile(r"<[^<>]{0,200}>|\[[^\]]{0,80}\]|\([^)]{0,60}\)|\{[^}]{0,60}\}|【[^】]*】|（[^）]{0,40}）|\*[^*\n]{1,40}\*|[♩-♯]+|https?://\S+|&[a-z]+;|(?:(?<!\S)|(?<=[>\])}】）*♩-♯;]))[^\s]*[\d_%@#][^\sぁ-ヿ一-鿿]*")
_NOISY = re.compile(r"[<\[({【（*♩-♯&\d_%@#]|http")
_END = re.compile(r"(?=[.!?…。！？/\s])(?:[.!?…]+[\"'»”’)\]]*(?=\s|$)|[。！？]+[」』）]*|[\r\n]+|\s[/|–—\-•·]+\s|\s?///?\s?)")
_WORD = re.compile(r"[^\W\d_ぁ-ヿ一-鿿ー々]+(?:['’][^\W\d_]+)?|[ぁ-ヿ一-鿿ー々]+")
_JA = re.compile(r"[ぁ-ヿ一-鿿]")
_HESITATION = {"um", "uh", "er", "hm", "hmm", "ah", "eh", "euh", "äh", "ähm", "えっと", "あのー", "えーと"}
_P = np.uint64(0x100000001B3)
_K = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def label(lang: Column) -> Column:
    """The two-letter code a label spells, else null."""
    low = F.lower(F.trim(lang))
    head = F.regexp_extract(low, r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    out = F.lit(None).cast("string")
    for code, names in SPELLINGS.items():
        out = F.when(low.isin(*names) | head.isin(*[n for n in names if len(n) <= 3 and n.isascii()]), F.lit(code)).otherwise(out)
    return out


def stretches(text: str) -> list[tuple[int, int, list[str]]]:
    """Begin, end and words of each stretch of a text."""
    clean = _NOISE.sub(lambda m: " " * len(m[0]), text) if _NOISY.search(text) else text
    out, at = [], 0
    for m in [*_END.finditer(clean), None]:
        end = m.end() if m else len(text)
        words = [w for w in _WORD.findall(clean, at, end) if w not in _HESITATION]
        if words:
            out.append((at, end, words))
        elif out and end > at:
            out[-1] = (out[-1][0], end, out[-1][2])
        at = end
    return out


def _layout(groups: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all groups, each as `` word word ``; group, word starts and word of each point."""
    parts = [" " + " ".join(g).lower() + " " for g in groups]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    group = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    blank = points == 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    return points, group, starts, blank


def features(groups: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, group and kind (1: a whole word, 0: an n-gram) of all features of the groups."""
    points, group, starts, blank = _layout(groups)
    hashes, owner, kind = [], [], []
    n = len(points)
    h = points[:0] if n < 1 else (points ^ np.uint64(3)) * _P
    for size in range(2, max(NGRAMS) + 1):
        if n < size:
            break
        h = (h[:-1] ^ points[size - 1 :]) * _P  # a longer n-gram goes on where the shorter one ended
        if size not in NGRAMS:
            continue
        inside = group[: n - size + 1] == group[size - 1 :]
        hashes.append(h[inside])
        owner.append(group[: n - size + 1][inside])
        kind.append(np.zeros(int(inside.sum()), dtype=np.int8))
    if len(starts):
        # A word's hash: a sum over its points, weighted by their place in it.
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        place = np.arange(n) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, n]))
        mixed = (points + np.uint64(977)) * _K[2]
        mixed ^= mixed >> np.uint64(29)
        weight = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _K[1]
        sums = np.r_[np.uint64(0), np.cumsum(mixed * weight)]
        w = sums[ends] - sums[starts]
        hashes.append(w * _P ^ np.uint64(0xFFFF))
        owner.append(group[starts])
        kind.append(np.ones(len(starts), dtype=np.int8))
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.concatenate(owner) if owner else np.empty(0, np.int64), np.concatenate(kind) if kind else np.empty(0, np.int8)


def slots(h: np.ndarray, log2: int = SLOTS_LOG2) -> list[np.ndarray]:
    out = []
    for k in range(HASHES):
        x = (h ^ (h >> np.uint64(31))) * _K[k]
        out.append((x >> np.uint64(64 - log2)).astype(np.int64))
    return out


class Filters:
    """Bit-sliced Bloom filters of all languages: ``table[slot]`` has bit k for language k."""

    def __init__(self, table: np.ndarray):
        self.table = table
        fill = np.array([((table >> k) & 1).mean() for k in range(len(LANGUAGES))])
        self.false = fill**HASHES

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> Filters:
        groups = [[w for _, _, words in stretches(t) for w in words] for t in texts]
        h, owner, _ = features(groups)
        lang = np.array([LANGUAGES.index(x) for x in labels], dtype=np.int64)
        # Each n-gram once per text: a hash of both decides.
        _, once = np.unique((h ^ (h >> np.uint64(33))) * _K[1] + owner.astype(np.uint64) * _K[0], return_index=True)
        grams, where = np.unique(h[once], return_inverse=True)
        cell = np.bincount(where.astype(np.int64) * len(LANGUAGES) + lang[owner[once].astype(np.int64)], minlength=len(grams) * len(LANGUAGES))
        seen = cell.reshape(len(grams), len(LANGUAGES)).astype(float)
        total = np.maximum(np.bincount(lang, minlength=len(LANGUAGES)), 1)
        rate = seen / total
        member = (seen >= LEAST_SEEN) & (rate >= SHARE * rate.max(1, keepdims=True))
        table = np.zeros(1 << SLOTS_LOG2, dtype=np.uint8)
        for k in range(len(LANGUAGES)):
            for s in slots(grams[member[:, k]]):
                table[s] |= np.uint8(1 << k)
        return cls(table)

    def counts(self, groups: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For each group and language: n-grams found, corrected for false positives, and words found."""
        n = len(groups)
        grams, words = np.zeros((n, len(LANGUAGES))), np.zeros((n, len(LANGUAGES)))
        if not n:
            return grams, words
        h, owner, kind = features(groups)
        mask = np.bitwise_and.reduce([self.table[s] for s in slots(h)]) if len(h) else np.empty(0, np.uint8)
        size = np.bincount(owner, minlength=n)
        for k in range(len(LANGUAGES)):
            hit = ((mask >> k) & 1).astype(bool)
            grams[:, k] = np.bincount(owner[hit], minlength=n)
            words[:, k] = np.bincount(owner[hit & (kind == 1)], minlength=n)
        grams = np.maximum(0, (grams - size[:, None] * self.false) / (1 - self.false))
        return grams, words


def _first_two(row: list[float]) -> tuple[int, float, float]:
    """Place of the greatest number (the first of equal ones), it, and the greatest of the rest."""
    best = max(row)
    k = row.index(best)
    return k, best, max(row[:k] + row[k + 1 :])


def decide(parts: list[tuple[int, int, list[str]]], grams: list[list[float]], words: list[list[float]]) -> tuple[str | None, float, list[tuple[int, int, str, float]]]:
    """Language and confidence of a text, and its stretches, joined where neighbours agree."""
    if not parts:
        return None, 0.0, []
    total = [sum(column) for column in zip(*grams, strict=True)]
    main = _first_two(total)[0]
    sure: list[tuple[int, float] | None] = []
    for (_, _, w), g, n in zip(parts, grams, words, strict=True):
        k, most, rest = _first_two(g)
        lead = (most - rest) / (most + 1.0)
        enough = n[k] >= LEAST_WORDS or (LANGUAGES[k] == "ja" and sum(len(x) for x in w if _JA.match(x)) >= 6)
        sure.append((k, lead) if enough and lead >= 0.12 else None)
    found = [s[0] for s in sure if s]
    langs, last = [], None
    for s in sure:
        last = s[0] if s else last
        langs.append(last)
    nxt = found[0] if found else main
    langs = [nxt if k is None else k for k in langs]
    if found:
        mass: Counter = Counter()
        for k, g in zip(langs, grams, strict=True):
            mass[k] += sum(g) + 1e-9
        main = max(mass, key=lambda k: (mass[k], -k))
    second = max(total[:main] + total[main + 1 :])
    confidence = total[main] / (total[main] + second) if total[main] + second > 0 else 0.0
    joined: list[list] = []
    for (b, e, _), k, s in zip(parts, langs, sure, strict=True):
        c = 0.5 + s[1] / 2 if s else 0.0
        if joined and joined[-1][2] == k:
            joined[-1][1] = e
            joined[-1][3] = max(joined[-1][3], c)
        else:
            joined.append([b, e, k, c])
    return (LANGUAGES[main] if total[main] > 0 else None), confidence, [(b, e, LANGUAGES[k], c) for b, e, k, c in joined]


def _tagger(filters, keys: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filters(filters.value)
        for whole in batches:
            for b in range(0, whole.num_rows, 2000):
                batch = whole.slice(b, 2000)
                parts = [stretches(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                grams, words = (x.tolist() for x in f.counts([w for p in parts for _, _, w in p]))
                lang, conf, known, spans, ends = [], [], [], [], [0]
                at = 0
                for p in parts:
                    g, n = grams[at : at + len(p)], words[at : at + len(p)]
                    at += len(p)
                    x, c, s = decide(p, g, n)
                    lang.append(x)
                    conf.append(c)
                    spans += s
                    ends.append(len(spans))
                    if x and x != "ja":
                        k = LANGUAGES.index(x)
                        known.append(int(sum(row[k] for row in n)))
                    else:
                        known.append(LEAST_WORDS if sum(len(w) for _, _, ws in p for w in ws if _JA.match(w)) >= 6 else 0)
                begin, end, which, sure = zip(*spans, strict=True) if spans else ((), (), (), ())
                begin = np.array(begin, dtype=np.int32)
                flat = pa.StructArray.from_arrays(
                    [pa.array(begin), pa.array(np.array(end, dtype=np.int32) - begin), pa.array(which, type=pa.string()), pa.array(sure, type=pa.float64())], names=["begin", "length", "lang", "confidence"]
                )
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(batch.schema.get_field_index(c)) for c in keys], pa.array(lang, type=pa.string()), pa.array(conf, type=pa.float64()), pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), flat), pa.array(known, type=pa.int32())],
                    names=[*keys, "true_lang", "confidence", "stretches", "known_words"],
                )

    return run


def fitted(df: DataFrame, text: str, lang: str, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """The filters' table from at most ``train_rows`` labelled rows of at most ``TRAIN_LONGEST`` characters, drawn by a hash of the text."""
    # Thinned by the text before anything else is asked of a row.
    some = thinned(df.select(F.col(text).alias("t"), F.col(lang).alias("l")), train_rows, ["t"], df.count())
    labelled = some.select("t", label(F.col("l")).alias("l")).filter(F.col("l").isNotNull() & F.length("t").between(1, TRAIN_LONGEST))
    rows = drawn(labelled, train_rows, ["t", "l"], train_rows, copies=LEAST_SEEN).collect()
    return Filters.fit([r.t for r in rows], [r.l for r in rows]).table


def identify(df: DataFrame, keys: list[str], text: str, lang: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``keys, label, true_lang, confidence, stretches, known_words`` of each record."""
    filters = df.sparkSession.sparkContext.broadcast(fitted(df, text, lang, train_rows))
    rows = df.select(*keys, F.coalesce(label(F.col(lang)), F.lit("")).alias("label"), text)
    cols = [*keys, "label"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in cols)
    out = f"{kinds}, true_lang string, confidence double, stretches array<struct<begin: int, length: int, lang: string, confidence: double>>, known_words int"
    tagged = rows.mapInArrow(_tagger(filters, cols, text), out)
    return tagged.groupBy(*keys).agg(F.max(F.struct("known_words", "true_lang", "confidence", "stretches", "label")).alias("r")).select(*keys, "r.label", "r.true_lang", "r.confidence", "r.stretches", "r.known_words")


def faults(df: DataFrame, keys: list[str], text: str, lang: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``keys, true_lang``: a row for each language of a record whose label is missing or wrong or whose text is mixed."""
    found = identify(df, keys, text, lang, train_rows)
    own = F.array_distinct(F.transform(F.filter("stretches", lambda s: s["confidence"] > 0), lambda s: s["lang"]))
    langs = F.when(F.size(own) > 1, own).otherwise(F.array("true_lang"))
    case = (F.size(own) > 1) | ((F.col("known_words") >= LEAST_WORDS) & (F.col("label") != F.col("true_lang")))
    return found.filter(F.col("true_lang").isNotNull() & case).select(*keys, F.explode(langs).alias("true_lang"))
