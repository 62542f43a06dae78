"""Problem 7: speech transcripts into clean speaker turns.

Method: every token of a row is tagged as speaker, timestamp, annotation,
filler or speech by a hidden Markov model over token shapes, decoded by Viterbi
for all rows of a batch at once; turns are assembled from the tags. The label
state is split in two (inside and end of a label), so that a name only becomes a
label if it is closed by a colon or bracket. The model starts from a prior table
and is refined by Viterbi training on a bounded sample of rows (``TRAIN_ROWS``,
taken by hash); a shape depends on the video's roster (a name of the roster, one
slip in its spelling allowed, is another shape than a word).

Plan. The rows of listed videos meet their roster in one join and are tagged in
one Arrow stage; what is left of them (parts of rows with words) is written
once. Assembly works on ``(origin, video, chunk of time)`` groups, so a hot
video is spread over its chunks; one summary row per chunk carries the last
speaker into the next chunk.

Defined results: words before a video's first label belong to nobody and are
left out; a label that names nobody of the roster, or more than one, is no
label; rows with null text, or with a null or NaN start, are skipped; of a video
with labels in both tables the one with more labels counts; rows with equal keys
are one record, the latest decides; videos without a roster, and empty tables,
give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import written
from weftline.sources.tables import drawn, latest

CHUNK_SECONDS = 600
TRAIN_ROWS = 3000
#: Tokens decoded at once, padding included; bounds memory only.
CELLS = 100_000

#: Sounds of hesitation, and fillers that are words.
HESITATION = r"u+m+|u+h+|e+r+m?|h+m+|m+h*m+|a+h+|e+h+|e+u+h+|[äö]+h+m?|ahn|hein|あのー*|そのー*|え[ーえ]+と?|えっと|ええと|う[ーう]+ん*|んー+|あー+|まあ"
PHRASES = r"you know|i mean|sort of|kind of|o sea|du coup|sozusagen"
ROLES = ("host", "guest", "moderator")

SHAPES = ["clock", "bracket_name", "bracket", "name", "initial", "generic", "number", "role", "colon", "arrow", "dash", "hesitation", "phrase", "punct", "word"]
STATES = ["time", "label", "label_end", "annotation", "filler", "speech"]
TIME, LABEL, LABEL_END, ANNOTATION, FILLER, SPEECH = range(6)
_S = {k: i for i, k in enumerate(SHAPES)}
#: Prior: how often a state shows a shape, and how often a state follows another (rows: start, then states).
_SHOWS = {
    TIME: {"clock": 90, "dash": 9, "punct": 1},
    LABEL: {"name": 50, "initial": 8, "generic": 14, "number": 7, "role": 8, "arrow": 8, "dash": 5},
    LABEL_END: {"colon": 70, "bracket_name": 30},
    ANNOTATION: {"bracket": 95, "arrow": 3, "punct": 2},
    FILLER: {"hesitation": 57, "phrase": 13, "punct": 30},
    SPEECH: {"word": 84, "number": 5, "punct": 6, "name": 0.3, "initial": 0.2, "generic": 0.05, "role": 0.1, "colon": 1, "dash": 1, "clock": 0.02, "phrase": 0.02, "arrow": 0.02, "hesitation": 0.02},
}
_FOLLOWS = [  # time, label, label_end, annotation, filler, speech
    [18, 20, 12, 8, 6, 36],
    [10, 30, 10, 8, 8, 34],
    [0.001, 40, 60, 0.001, 0.001, 0.001],
    [1, 1, 1, 8, 14, 75],
    [4, 6, 4, 14, 10, 62],
    [0.5, 2, 1.5, 5, 25, 66],
    [0.2, 1, 1, 3, 8, 86],
]
#: Weight of the prior, in rows' worth of counts, against the sample.
PRIOR = 200.0

_TOKEN = re.compile(
    rf"<[^<>]{{0,120}}>|\[[^\]]*\]|\([^)]*\)|\{{[^}}]*\}}|【[^】]*】|\*[^*\n]+\*|[♩-♯]+(?:[^♩-♯\n]*[♩-♯]+)*|>>|\d{{1,2}}:\d\d(?::\d\d)?(?!\d)|SPK_\d+|(?<![^\W_])(?:{PHRASES})(?![^\W_])|\d+(?:[.,]\d+)*"
    r"|[ぁ-ヿ㐀-鿿々ー]+|[A-ZÀ-ÖØ-Þ]\.(?=\s*:)|[^\W\d_ぁ-ヿ㐀-鿿]+(?:['’\-][^\W\d_ぁ-ヿ㐀-鿿]+)*|\.{2,}|\S",
    re.I,
)
_CLOCK = re.compile(r"[\[(]?\s*\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d+)?\s*[\])]?\Z")
_HESITATES = re.compile(rf"(?:{HESITATION})\Z", re.I)
_PHRASE = re.compile(rf"(?:{PHRASES})\Z", re.I)
_JA_HESITATION = re.compile(r"^(?:あのー+|えーと|えっと、?|ええと|えー+、|うーん|んー+)")


def _one_slip(a: str, b: str) -> bool:
    """One letter missing, put in, exchanged, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :] or (a[k + 2 :] == b[k + 2 :] and a[k : k + 2] == b[k : k + 2][::-1])


class Roster:
    """The speakers of a video; finds who a label names."""

    def __init__(self, people: tuple[tuple[int, str, str], ...]):
        self.people = [(no, [p.casefold() for p in unicodedata.normalize("NFKC", name or "").split()], (role or "").casefold()) for no, name, role in people if no is not None]
        self.kept: dict[str, int | None] = {}

    def part(self, word: str) -> bool:
        """Whether a word is a given or family name of the roster, or nearly a given name."""
        w = word.casefold()
        return any(w in parts or (parts and len(w) > 3 and _one_slip(w, parts[0])) for _, parts, _ in self.people)

    def who(self, label: str) -> int | None:
        if label not in self.kept:
            self.kept[label] = self._who(label)
        return self.kept[label]

    def _who(self, label: str) -> int | None:
        words = [w for w in re.split(r"[\s:：>\-–\[\]()<]+", unicodedata.normalize("NFKC", label).casefold()) if w and w != "v"]
        # Hyphenated family names stay whole.
        whole = [w for w in re.split(r"[\s:：>\[\]()<]+", unicodedata.normalize("NFKC", label).casefold()) if w and w not in ("v", "-", "–")]
        if not whole:
            return None
        m = re.fullmatch(r"(?:spk_?|speaker ?)(\d+)", " ".join(whole))
        if m:
            return next((no for no, _, _ in self.people if no == int(m[1])), None)
        if len(whole) == 1 and whole[0] in ROLES:
            hits = [no for no, _, role in self.people if role == whole[0]]
            return hits[0] if len(hits) == 1 else None
        for slip in (False, True):
            hits = [no for no, parts, _ in self.people if self._names(whole, parts, slip)]
            if hits:
                return hits[0] if len(hits) == 1 else None
        return None if words == whole else self._who(" ".join(words)) if len(words) != len(whole) else None

    @staticmethod
    def _names(words: list[str], parts: list[str], slip: bool) -> bool:
        if not parts:
            return False
        like = _one_slip if slip else str.__eq__
        if len(words) == 1:
            return like(words[0], parts[0]) or (len(parts) > 1 and like(words[0], parts[-1]))
        if len(words) == 2 and len(words[1].rstrip(".")) == 1:
            return like(words[0], parts[0]) and parts[-1].startswith(words[1].rstrip("."))
        return len(words) == len(parts) and all(like(a, b) for a, b in zip(words, parts, strict=True))


def tokens(text: str) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for m in _TOKEN.finditer(text):
        x = m[0]
        j = _JA_HESITATION.match(x)
        if j and j.end() < len(x):  # Japanese has no blanks between a sound and the words
            out.append((m.start(), m.start() + j.end(), j[0]))
            out.append((m.start() + j.end(), m.end(), x[j.end() :]))
        else:
            out.append((m.start(), m.end(), x))
    return out


def shape(token: str, roster: Roster) -> int:
    c = token[0]
    if c in "[({<【" and len(token) > 1:
        inner = token[1:-1].strip()
        if _CLOCK.match(inner):
            return _S["clock"]
        if c == "<" and inner[:2] == "v ":
            inner = inner[2:]
        return _S["bracket_name"] if c != "{" and inner and roster.who(inner) is not None else _S["bracket"]
    if (c == "*" and len(token) > 1) or "♩" <= c <= "♯":
        return _S["bracket"]
    if c.isdigit():
        return _S["clock"] if ":" in token else _S["number"]
    if token == ">>":
        return _S["arrow"]
    if c in ":：":
        return _S["colon"]
    if c in "-–—":
        return _S["dash"]
    if not (c.isalpha()):
        return _S["punct"]
    if token[:4] == "SPK_" or token.casefold() == "speaker":
        return _S["generic"]
    if token.casefold() in ROLES:
        return _S["role"]
    if _HESITATES.match(token):
        return _S["hesitation"]
    if _PHRASE.match(token):
        return _S["phrase"]
    if len(token) == 2 and token[1] == ".":
        return _S["initial"]
    return _S["name"] if c.isupper() and roster.part(token) else _S["word"]


def prior() -> tuple[np.ndarray, np.ndarray]:
    """Counts: shapes by state, and states by state before (row 0 is the start)."""
    shows = np.full((len(STATES), len(SHAPES)), 1e-3)
    for s, row in _SHOWS.items():
        for k, v in row.items():
            shows[s, _S[k]] = v
    return shows * PRIOR / 100, np.array(_FOLLOWS) * PRIOR / 100


def logs(shows: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.log(shows / shows.sum(1, keepdims=True)), np.log(follows / follows.sum(1, keepdims=True))


def viterbi(rows: list[list[int]], model: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The likeliest states of each row of shapes. Rows are decoded together, longest first, so each step is one array operation."""
    shows, follows = model
    order = sorted(range(len(rows)), key=lambda k: -len(rows[k]))
    lens = np.array([len(rows[k]) for k in order], dtype=np.int64)
    out: list[np.ndarray] = [np.empty(0, np.int8)] * len(rows)
    live = int((lens > 0).sum())
    if not live:
        return out
    b = e = 0
    while e < live:
        b = e
        # Rows are padded to the longest of their block: the longer they are, the fewer.
        e = min(live, b + max(1, CELLS // int(lens[b])))
        size = lens[b:e]
        n, top = e - b, int(size[0])
        back = np.zeros((top, n, len(STATES)), dtype=np.int8)
        final = np.zeros((n, len(STATES)))
        obs = np.zeros((top, n), dtype=np.int64)
        for j in range(n):
            obs[: size[j], j] = rows[order[b + j]]
        score = follows[0] + shows[:, obs[0]].T
        for t in range(1, top):
            m = int((size > t).sum())
            final[m : len(score)] = score[m:]
            step = score[:m, :, None] + follows[1:]
            back[t, :m] = step.argmax(1)
            score = step.max(1) + shows[:, obs[t, :m]].T
        final[: len(score)] = score
        final[:, LABEL] -= 20  # a row doesn't end inside a label
        state = final.argmax(1)
        path = np.zeros((top, n), dtype=np.int8)
        for t in range(top - 1, -1, -1):
            m = int((size > t).sum())
            path[t, :m] = state[:m]
            if t:
                state[:m] = back[t, np.arange(m), state[:m]]
        for j in range(n):
            out[order[b + j]] = path[: size[j], j]
    return out


def train(sample: list[list[int]], rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi training from the prior: decode the sample, count, decode again."""
    model = logs(*prior())
    for _ in range(rounds):
        shows, follows = prior()
        for obs, path in zip(sample, viterbi(sample, model), strict=True):
            if len(obs):
                np.add.at(shows, (path, obs), 1)
                np.add.at(follows, (np.r_[0, path[:-1].astype(np.int64) + 1], path), 1)
        model = logs(shows, follows)
    return model


@lru_cache(maxsize=20_000)
def _roster(people: tuple[tuple[int, str, str], ...]) -> Roster:
    return Roster(people)


def parts(text: str, toks: list[tuple[int, int, str]], obs: list[int], path: np.ndarray, roster: Roster) -> list[tuple[int | None, str, int]]:
    """Parts of a row that hold words: ``(speaker or None, clean text, 1 if labelled)``."""
    out: list[tuple[int | None, str, int]] = []
    who: int | None = None
    label: list[str] = []
    words: list[tuple[int, int]] = []
    spoken = False

    def close() -> None:
        if spoken:
            clean, end = [], None
            for b, e in words:
                if end is not None and text[end:b].strip() != text[end:b]:
                    clean.append(" ")
                elif end is not None and b > end and clean:
                    clean.append(" ")
                clean.append(text[b:e])
                end = e
            out.append((who, re.sub(r"\s+([,.;!?…])", r"\1", re.sub(r"\s+", " ", "".join(clean))).strip(" ,-–"), int(who is not None)))

    for (b, e, x), o, s in zip(toks, obs, path.tolist(), strict=True):
        if s == LABEL:
            label.append(x)
        elif s == LABEL_END:
            name = x[1:-1] if o == _S["bracket_name"] else " ".join(label)
            found = roster.who(name)
            if found is not None:
                close()
                who, words, spoken = found, [], False
            label = []
        elif s == SPEECH:
            words.append((b, e))
            spoken = spoken or o in (_S["word"], _S["number"], _S["name"], _S["phrase"], _S["role"], _S["generic"])
        elif s == FILLER and o == _S["phrase"]:
            spoken = True
    close()
    return out


def _tagger(model, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            texts = get("text").to_pylist()
            people = get("people").to_pylist()
            rosters = [_roster(tuple((p["no"], p["name"], p["role"]) for p in some or ())) for some in people]
            toks = [tokens(t) for t in texts]
            obs = [[shape(x, r) for _, _, x in row] for row, r in zip(toks, rosters, strict=True)]
            at, no, who, clean, seen = [], [], [], [], []
            for k, path in enumerate(viterbi(obs, model.value)):
                for j, (w, c, labelled) in enumerate(parts(texts[k], toks[k], obs[k], path, rosters[k])):
                    at.append(k)
                    no.append(j)
                    who.append(w)
                    clean.append(c)
                    seen.append(labelled)
            take = pa.array(at, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[get(c).take(take) for c in keys], pa.array(no, type=pa.int32()), pa.array(who, type=pa.int32()), pa.array(clean, type=pa.string()), pa.array(seen, type=pa.int32())],
                names=[*keys, "part", "speaker", "words", "labelled"],
            )

    return run


def _rows(df: DataFrame, origin: str, order: Column | None) -> DataFrame:
    """One record per key of a transcript table."""
    s = F.col("start_sec").cast("double")
    base = df.select("video_id", F.col("idx"), "text", s.alias("s"), (order if order is not None else F.lit(0)).alias("o"))
    one = latest(base, ["video_id", "idx"], ["o", "text", "s"])
    return one.filter(F.col("text").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s") & (F.abs("s") < 1e15)).select(F.lit(origin).alias("origin"), "video_id", "idx", "s", "text")


def labelled_parts(raw: DataFrame, segments: DataFrame, speakers: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``origin, video_id, idx, s, part, speaker, words, labelled`` of each part of a row with words."""
    roster = speakers.filter(F.col("speaker_no").isNotNull()).groupBy("video_id").agg(
        F.sort_array(F.collect_set(F.struct(F.col("speaker_no").cast("int").alias("no"), F.col("speaker_name").alias("name"), F.col("speaker_role").alias("role")))).alias("people")
    )
    listed = roster.select("video_id")
    sources = [(raw, "raw_segments", F.col("ingested_at")), (segments, "segments", None)]
    rows = None
    for df, name, order in sources:
        one = _rows(df.join(listed, "video_id", "left_semi"), name, order)
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.join(roster, "video_id")
    total = raw.count() + segments.count()
    some = drawn(rows, train_rows, ["origin", "video_id", "idx"], total).select("text", "people").collect()
    sample = [[shape(x, r) for _, _, x in tokens(t.text)] for t in some for r in [_roster(tuple((p["no"], p["name"], p["role"]) for p in t.people))]]
    model = raw.sparkSession.sparkContext.broadcast(train(sample))
    keys = ["origin", "video_id", "idx", "s"]
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "text", "people").mapInArrow(_tagger(model, keys), f"{kinds}, part int, speaker int, words string, labelled int")


def spoken(parts_: DataFrame) -> DataFrame:
    """Parts with the speaker their words belong to (``who``) and whether they begin a turn; only the table that carries the video's labels."""
    p = parts_.withColumn("chunk", F.floor(F.col("s") / CHUNK_SECONDS))
    keys = ["origin", "video_id", "chunk"]
    at = F.struct("s", "idx", "part")
    before = Window.partitionBy("origin", "video_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    summary = p.groupBy(*keys).agg(F.max_by("speaker", F.when(F.col("speaker").isNotNull(), at)).alias("last_speaker"), F.sum("labelled").alias("labels"))
    totals = summary.groupBy("video_id").agg(*[F.sum(F.when(F.col("origin") == o, F.col("labels")).otherwise(0)).alias(o) for o in ("raw_segments", "segments")])
    carried = summary.select(*keys, F.last("last_speaker", ignorenulls=True).over(before).alias("carried")).join(totals, "video_id").filter(
        F.when(F.col("origin") == "raw_segments", (F.col("raw_segments") >= F.col("segments")) & (F.col("raw_segments") > 0)).otherwise(F.col("segments") > F.col("raw_segments"))
    )
    inside = Window.partitionBy(*keys).orderBy("s", "idx", "part")
    own = p.withColumn("own", F.last("speaker", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = own.withColumn("own_before", F.lag("own").over(inside))
    joined = own.join(carried.select(*keys, "carried"), keys)
    who = F.coalesce("own", "carried")
    prev = F.coalesce("own_before", "carried")
    return joined.withColumn("who", who).withColumn("begins", who.isNotNull() & (prev.isNull() | (prev != who))).filter(F.col("who").isNotNull())


def turn_starts(raw: DataFrame, segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """``origin, video_id, first_idx, speaker_no``: one row for each turn."""
    p = written(labelled_parts(raw, segments, speakers), "turn-parts")
    return spoken(p).filter("begins").select("origin", "video_id", F.col("idx").alias("first_idx"), F.col("who").alias("speaker_no"))


def turns(raw: DataFrame, segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """``origin, video_id, turn_no, first_idx, speaker_no, speaker_name, start_sec, text``: the clean turns in order.

    Turns are numbered within a video through running counts per chunk. A turn's
    parts are the only rows that meet in one group.
    """
    p = written(labelled_parts(raw, segments, speakers), "turn-parts")
    s = written(spoken(p), "turn-words")
    keys = ["origin", "video_id", "chunk"]
    starts = F.sum(F.col("begins").cast("int"))
    base = s.groupBy(*keys).agg(starts.alias("n")).select(*keys, F.coalesce(F.sum("n").over(Window.partitionBy("origin", "video_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*keys).orderBy("s", "idx", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = s.withColumn("k", starts.over(inside)).join(base, keys).withColumn("turn_no", F.col("k") + F.col("base"))
    one = numbered.groupBy("origin", "video_id", "turn_no").agg(
        F.min_by("idx", F.struct("s", "idx", "part")).alias("first_idx"),
        F.min("who").alias("speaker_no"),
        F.min("s").alias("start_sec"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "idx", "part", "words"))), lambda x: x["words"]), " ").alias("text"),
    )
    names = speakers.groupBy("video_id", F.col("speaker_no").cast("int").alias("speaker_no")).agg(F.min("speaker_name").alias("speaker_name"))
    return one.join(names, ["video_id", "speaker_no"], "left").select("origin", "video_id", "turn_no", "first_idx", "speaker_no", "speaker_name", "start_sec", "text")
