import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.once import once


def one(spark, value, expr, kind="string"):
    df = spark.createDataFrame([(value,)], f"t {kind}")
    return once(df, r=expr(F.col("t"))).first()["r"]


@pytest.mark.parametrize("raw,clean", [("[Music] hello  (inaudible) you know world", "hello  world"), ("♪ la la ♪ um", ""), ("a &amp; <b>b</b>", "a b"), (None, None), ("", "")])
def test_caption_clean(spark, raw, clean):
    got = one(spark, raw, T.caption_clean)
    assert got == clean or (got is not None and " ".join(got.split()) == " ".join(clean.split()))


def test_counts(spark):
    assert one(spark, "a b c", T.word_count) == 3
    assert one(spark, None, T.word_count) == 0
    assert one(spark, " ".join("w" * 100), T.token_estimate) == 135
    assert one(spark, "", T.token_estimate) == 0


@pytest.mark.parametrize("iso,sec", [("PT1H2M3S", 3723), ("PT15M", 900), ("PT", 0), ("", 0), ("P1D", 0), ("x", 0), (None, 0)])
def test_iso(spark, iso, sec):
    assert one(spark, iso, T.iso_seconds) == sec


def test_video_id(spark):
    assert one(spark, "https://x.test/watch?v=abcdefghi-_&t=1", T.video_id) == "abcdefghi-_"
    assert one(spark, "abcdefghi-_", T.video_id) == "abcdefghi-_"
    assert one(spark, "too short", T.video_id) is None


@pytest.mark.parametrize(
    "raw,clean",
    [("ＡＢＣ１２３", "ABC123"), ("[音楽] こんにちは", "こんにちは"), ("すごい！！！", "すごい!"), ("test test test word", "test word"), ("a\x00b", "ab"), ("a    b", "a b"), ("- start here", "start here"), ("機械学習機械学習機械学習", "機械学習"), ("", "")],
)
def test_normalize(spark, raw, clean):
    assert one(spark, raw, T.normalize_line) == clean


@pytest.mark.parametrize("t,lang", [("これは日本語です", "ja"), ("this is english", "en"), ("AIは機械学習", "ja"), ("machine learning の話 is here today", "en")])
def test_language(spark, t, lang):
    assert one(spark, t, T.script_language) == lang


def test_sentence_ends(spark):
    en, ja = F.lit("en"), F.lit("ja")
    assert one(spark, "It works.", lambda c: T.ends_sentence(c, en)) is True
    assert one(spark, "...", lambda c: T.ends_sentence(c, en)) is False
    assert one(spark, "no end", lambda c: T.ends_sentence(c, en)) is False
    assert one(spark, "そうです。", lambda c: T.ends_sentence(c, ja)) is True
    assert one(spark, "そうです", lambda c: T.ends_sentence(c, ja)) is False


@pytest.mark.parametrize("t,bad", [("", True), ("a", True), ("!!!", True), ("12 34.", True), ("hello", False), (None, True), ("こんにちは", False)])
def test_unrecoverable(spark, t, bad):
    assert one(spark, t, T.unrecoverable) is bad


def brute_repetition(text):
    words = text.split()
    if len(words) < 4:
        return 0.0
    pairs = {}
    for a, b in zip(words, words[1:], strict=False):
        pairs[a + "_" + b] = pairs.get(a + "_" + b, 0) + 1
    total = float(sum(n - 1 for n in pairs.values()))
    solid = "".join(text.split())
    if len(solid) >= 6:
        tri = {}
        for i in range(len(solid) - 2):
            tri[solid[i : i + 3]] = tri.get(solid[i : i + 3], 0) + 1
        total += sum((n - 2) * 0.5 for n in tri.values() if n > 2)
    return min(total / len(words), 1.0)


@pytest.mark.parametrize("t", ["a b", "go on go on go on go", "the cat sat on the mat the cat sat", "aaaa bbbb aaaa bbbb aaaa cccc", "one two three four five", "", "x x x x"])
def test_repetition(spark, t):
    assert one(spark, t, T.repetition) == pytest.approx(brute_repetition(t))


def test_noise_factors(spark):
    n = one(spark, "...", lambda c: T.noise_factors(c, F.lit("en")))
    assert n["length"] == 0.95 and n["symbols"] == 1.0 and 0.4 < n["total"] < 0.72
    n = one(spark, "This is a clean and complete sentence about networks.", lambda c: T.noise_factors(c, F.lit("en")))
    assert n["total"] < 0.3
    n = one(spark, "", lambda c: T.noise_factors(c, F.lit("en")))
    assert n["length"] == 1.0


def test_fillers(spark):
    assert one(spark, "um, so basically it works", lambda c: T.tidy(T.strip_fillers(c, F.lit("en")))) == "it works"
    assert one(spark, "えっとなんか難しい", lambda c: T.tidy(T.strip_fillers(c, F.lit("ja")))) == "難しい"


def test_lines(spark):
    df = spark.createDataFrame([(2.5, 3.5, "x", None)], "a double, b double, t string, n double")
    r = df.select(T.chunk_line(F.col("a"), F.col("b"), F.col("t")).alias("c"), T.context_line(F.col("n"), F.col("t")).alias("d")).first()
    assert r["c"] == "[2s–4s] x" and r["d"] == "[0s] x"


def test_dense_sentences(spark):
    terms = F.array(F.lit("pump"))
    text = "The pump runs hot today again now. Nothing here at all is of any use whatsoever. Short one."
    assert one(spark, text, lambda c: T.dense_sentences(c, terms)) == "The pump runs hot today again now. Short one."
    other = "Nothing here at all is of any use whatsoever."
    assert one(spark, other, lambda c: T.dense_sentences(c, terms)) == other


def test_cache_key_ignores_case_and_blanks(spark):
    df = spark.createDataFrame([("v", " What? "), ("v", "what?")], "v string, q string")
    assert len({r[0] for r in df.select(T.cache_key(F.col("v"), F.col("q"))).collect()}) == 1
