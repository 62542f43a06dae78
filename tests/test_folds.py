import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import cleaner, dedup, folds, overlaps
from weftline.sources import captions


def words(t):
    return set((t or "").lower().split())


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def some_texts(rng, n):
    pool = ["alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon zeta eta", "one two three", "one two three four", "", None, "  ", "completely different words here"]
    return [rng.choice(pool) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_consecutive(spark, seed):
    rng = random.Random(seed)
    rows = [(v, i, t, "extra") for v in "ab" for i, t in enumerate(some_texts(rng, 60))]
    exp = []
    for v in "ab":
        last, k = None, 0
        for vv, i, t, _ in rows:
            if vv != v or not words(t):
                continue
            if last is not None and jac(last, words(t)) >= 0.85:
                continue
            exp.append((v, i, k))
            last, k = words(t), k + 1
    df = spark.createDataFrame(rows, "video_id string, idx int, text string, kept string")
    got = sorted((r.video_id, r.idx, r.new_idx) for r in folds.drop_consecutive(df, "video_id", "idx", "text", chunk=8).collect())
    assert got == sorted(exp)
    assert folds.drop_consecutive(df.limit(0), "video_id", "idx", "text").count() == 0


def test_chunks(spark):
    rows = [("v", i, "w " * 20, float(i), float(i + 1)) for i in range(5)]
    df = spark.createDataFrame(rows, "video_id string, idx int, text string, a double, b double")
    got = [(r.chunk_id, r.segment_indices) for r in folds.pack_chunks(df, "video_id", "idx", "text", "a", "b", limit=30).orderBy("chunk_id").collect()]
    assert got == [(0, [0]), (1, [0, 1]), (2, [1, 2]), (3, [2, 3]), (4, [3, 4])]
    none = folds.pack_chunks(df, "video_id", "idx", "text", "a", "b", limit=50, overlap=0).orderBy("chunk_id").collect()
    assert [r.segment_indices for r in none] == [[0, 1], [2, 3], [4]]


def test_fragments(spark):
    rows = [("v", 0, "this is", 0.0, 1.0, "en"), ("v", 1, "a test.", 1.1, 2.0, "en"), ("v", 2, "Next one", 2.0, 3.0, "en"), ("v", 3, "far away", 9.0, 10.0, "en"), ("j", 0, "これ", 0.0, 1.0, "ja"), ("j", 1, "は本です", 1.0, 2.0, "ja")]
    df = spark.createDataFrame(rows, "video_id string, idx int, text string, start double, end double, lang string")
    got = sorted((r.video_id, r.text, r.original_count) for r in folds.merge_fragments(df, "video_id", "idx").collect())
    assert got == [("j", "これは本です", 2), ("v", "Next one", 1), ("v", "far away", 1), ("v", "this is a test.", 2)]


def test_windowed(spark):
    rows = [("v", 0, "hello world again"), ("v", 1, "Hello, world again!"), ("v", 2, "hello world agains"), ("v", 3, "something else"), ("v", 4, None)]
    df = spark.createDataFrame(rows, "video_id string, idx int, text string")
    got = {r.idx: r.kept for r in folds.drop_windowed(df, "video_id", ["idx"], "text").collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: True}


def test_first_fit_skips_and_goes_on(spark):
    rows = [(1, 0, 5, 10), (1, 1, 7, 10), (1, 2, 5, 10), (1, 3, 1, 10), (2, 0, 11, 10)]
    df = spark.createDataFrame(rows, "q int, r int, cost int, cap int")
    got = {(r.q, r.r): (r.taken, r.used) for r in folds.first_fit(df, ["q"], ["r"], "cost", "cap").collect()}
    assert got == {(1, 0): (True, 5), (1, 1): (False, 5), (1, 2): (True, 10), (1, 3): (False, 10), (2, 0): (False, 0)}


def test_compress_to_budget(spark):
    rows = [("v", k, "w " * 100) for k in range(5)]
    df = spark.createDataFrame(rows, "video_id string, idx int, text string")
    got = folds.compress_to_budget(df, ["video_id"], ["idx"], "text", 200).orderBy("idx").collect()
    assert [r.tokens for r in got] == [135, int(int(65 * 0.75) * 1.35)]


def greedy(rows, num, den, strict, source=False):
    kept = []
    for r in rows:
        w = words(r[1])
        hit = False
        for k in kept:
            o = words(k[1])
            if not w or not o or (source and k[2] == r[2]):
                continue
            a, b = len(w & o) * den, len(w | o) * num
            if a > b if strict else a >= b:
                hit = True
                break
        if not hit:
            kept.append(r)
    return sorted(r[0] for r in kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_dedup(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(14)]
    rows = [(i, " ".join(rng.sample(vocab, rng.randint(1, 9))), rng.choice("xyz")) for i in range(120)] + [(200, "", "x"), (201, None, "y")]
    df = spark.createDataFrame(rows, "id int, content string, src string")
    got = sorted(r.id for r in dedup.deduplicate(df, "content", [F.col("id")]).collect())
    assert got == greedy(rows, 7, 10, False)
    got = sorted(r.id for r in dedup.merge_sources(df, "content", "src", [F.col("id")]).collect())
    assert got == greedy(rows, 3, 4, True, True)


def test_greedy_chain_is_followed_to_its_end(spark):
    """Each row is like the one before it only: every second stays, whatever the chain's length."""
    pairs = spark.createDataFrame([(k, k + 1) for k in range(9)], "a bigint, b bigint")
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert sorted(r.k for r in dedup.greedy_keep(rows, "k", pairs).collect()) == [0, 2, 4, 6, 8]


@pytest.mark.parametrize(("num", "den", "strict", "small"), [(3, 4, True, 24), (3, 4, True, 1), (7, 10, False, 2), (1, 1, False, 3)])
def test_similar_pairs_against_all_pairs(spark, monkeypatch, num, den, strict, small):
    """Few words in many texts, so that most meet in large groups; copies, short texts and, for small numbers, steps of a few items."""
    monkeypatch.setattr(overlaps, "SMALL", small)
    monkeypatch.setattr(overlaps, "MORE", 2)
    monkeypatch.setattr(overlaps, "HELD", 1 << 20 if small == 24 else 50)
    rng = random.Random(small)
    texts = [" ".join(rng.sample([f"w{k}" for k in range(12)], rng.randint(1, 9))) for _ in range(150)] + ["same"] * 30 + ["two words"] * 3 + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    got = sorted(map(tuple, overlaps.similar_pairs(df, "k", "t", num, den, strict).collect()))
    w = [words(t) for t in texts]
    both = {(a, b): (len(w[a] & w[b]) * den, len(w[a] | w[b]) * num) for a in range(len(w)) for b in range(a + 1, len(w)) if w[a] and w[b]}
    assert got == sorted(p for p, (o, u) in both.items() if (o > u if strict else o >= u))
    assert overlaps.similar_pairs(df.limit(0), "k", "t", num, den, strict).count() == 0


def test_similar_pairs_with_rare_words(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "FREQUENT", 4)
    rng = random.Random(5)
    texts = [" ".join([f"r{rng.randint(0, 60)}" for _ in range(3)] + rng.sample("abcdef", 5)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    w = [words(t) for t in texts]
    assert sorted(map(tuple, overlaps.similar_pairs(df, "k", "t", 3, 5, False).collect())) == [(a, b) for a in range(200) for b in range(a + 1, 200) if jac(w[a], w[b]) >= 0.6]


def test_merged_sources_holds_no_candidates(spark):
    """Two thousand texts of the same common words with nothing alike: what is shuffled follows the texts, not the pairs that share a word."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.sample([f"w{k}" for k in range(60)], 12)), "xy"[i % 2]) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, content string, src string")
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup("merged", "merged")
    assert dedup.merge_sources(df, "content", "src", [F.col("id")]).count() == 2000
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in tracker.getJobIdsForGroup("merged") for s in tracker.getJobInfo(j).stageIds}
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 50_000


def test_cleaner(spark):
    rows = [("v", 0, "[Music]", 0.0, 1.0), ("v", 1, "...", 1.0, 1.0), ("v", 2, None, 2.0, 1.0), ("v", 3, "um, this is a good sentence about pumps.", 3.0, 2.0), ("v", 4, "um, this is a good sentence about pumps.", 9.0, 2.0)]
    df = spark.createDataFrame(rows, "video_id string, idx int, text string, start_sec double, duration double")
    got = cleaner.clean(df, "video_id", "idx", "text", "start_sec", "duration").collect()
    assert [r.text for r in got] == ["this is a good sentence about pumps."]
    st = cleaner.stats(df, cleaner.staged(df, "video_id", "idx", "text", "start_sec", "duration"), "video_id").first()
    assert (st.input_segments, st.output_segments, st.removed_duplicates) == (5, 1, 1)
    assert cleaner.clean(df.limit(0), "video_id", "idx", "text", "start_sec", "duration").count() == 0


def test_vtt(spark):
    doc = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500\n<c>Hello</c>\nthere\n\n01:02.0 --> 01:03.0\nshort clock\n\n00:00:05.000 --> 00:00:06.000\n \n"
    df = spark.createDataFrame([("d", doc), ("e", ""), ("f", None)], "k string, c string")
    got = [tuple(r) for r in captions.parse_vtt(df, "k", "c").collect()]
    assert got == [("d", 0, "Hello there", 1.0, 1.5)]


def test_events(spark):
    doc = '{"events":[{"tStartMs":1000,"dDurationMs":500,"segs":[{"utf8":"a"},{"utf8":" b"}]},{"tStartMs":2000},{"segs":[{"utf8":"\\n"}]}]}'
    df = spark.createDataFrame([("d", doc), ("bad", "{"), ("n", None)], "k string, c string")
    assert [tuple(r) for r in captions.parse_events(df, "k", "c").collect()] == [("d", 0, "a b", 1.0, 0.5)]
