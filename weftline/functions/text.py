"""Column functions on text. Everything stays in the JVM but ``nfkc``.

White space is Unicode white space (``(?U)\\s``), as in the languages the rules
come from; ``\\b`` is Unicode-aware too. A null text gives null, or 0 where a
count is asked, unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the caption rules.
CAPTION_NOISE = [r"\[.*?\]", r"\(.*?\)", r"♪.*?♪", r"&amp;|&lt;|&gt;", r"<[^>]+>", r"(?U)\s{2,}"]
CAPTION_FILLERS = ["um", "uh", "like", "you know", "i mean", "kind of", "sort of", "basically", "literally", "actually"]
REDUNDANT = r"as i (?:said|mentioned|was saying)|like i said|you know what i mean|let me (?:tell|show) you|so basically|anyway|alright so"
JA_HESITATIONS = ["あー+", "えー+", "うー+", "おー+", "んー+", "あのー*", "そのー*", "えっと", "えーと", "うーん"]
JA_FILLERS = ["なんか", "まあ", "ちょっと", "やっぱり", "やっぱ", "要するに", "いわゆる", "つまり", "そういう", "みたいな", "っていうか", "というか", "みたいに", "ですね", "ですよね", "ですよ", "じゃないですか"]
JA_OPENERS = ["じゃあ", "それで", "それから", "そして", "でも", "ところで", "ちなみに"]
EN_HESITATIONS = r"um+|uh+|er+|ah+|hmm+|huh|mhm"
EN_FILLERS = r"like|you know|i mean|kind of|sort of|basically|literally|actually|right\?|okay so|alright so|so basically|anyway|you see|i guess|i think|to be honest|honestly|frankly"
EN_OPENERS = r"so|well|now|okay|right|alright|anyway"
BRACKETS = r"[\[【《〔].*?[\]】》〕]|\(.*?\)|♪.*?♪|&[a-z]+;|<[^>]+>"
CJK = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
PARTICLES = "はがをにでものとからまでより"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Lower-cased words between white space; an empty array for null."""
    return F.coalesce(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""), F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def token_estimate(c: Column) -> Column:
    """About 1.35 tokens a word, rounded towards 0."""
    return (word_count(c) * F.lit(1.35)).cast("int")


def caption_clean(c: Column) -> Column:
    """Annotations, entities and tags become blanks; fillers vanish; ends are trimmed."""
    for rx in CAPTION_NOISE:
        c = F.regexp_replace(c, rx, " ")
    return strip(F.regexp_replace(c, rf"(?iU)\b(?:{'|'.join(CAPTION_FILLERS)})\b", ""))


def compress(c: Column) -> Column:
    """Drops redundant phrases and collapses white space."""
    return strip(F.regexp_replace(F.regexp_replace(c, rf"(?iU)\b(?:{REDUNDANT})\b", ""), r"(?U)\s{2,}", " "))


def sentences(c: Column) -> Column:
    return F.split(c, r"(?U)(?<=[.!?])\s+")


def dense_sentences(c: Column, query_terms: Column, threshold: float = 0.05) -> Column:
    """Keeps sentences that share enough words with the query, or are short; all of the text if none is kept."""

    def keep(s: Column) -> Column:
        w = F.array_distinct(words(s))
        n = F.size(w)
        return (n > 0) & ((F.size(F.array_intersect(w, query_terms)) / F.greatest(n, F.lit(1)) >= threshold) | (word_count(s) < 6))

    kept = F.filter(sentences(c), keep)
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(c)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def video_id(c: Column) -> Column:
    """The 11-character id in a watch or short link, or the whole text if it is one; else null."""
    linked = F.regexp_extract(c, r"(?:v=|youtu\.be/)([A-Za-z0-9_\-]{11})", 1)
    return F.when(linked != "", linked).when(c.rlike(r"^[A-Za-z0-9_\-]{11}$"), c)


def iso_seconds(c: Column) -> Column:
    """Seconds of ``PT#H#M#S``; 0 for anything else."""
    rx = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?"
    part = lambda k: F.coalesce(F.regexp_extract(c, rx, k).try_cast("int"), F.lit(0))
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0))


def cache_key(video: Column, query: Column) -> Column:
    return F.sha2(F.concat_ws("::", video, F.lower(strip(query))), 256)


def collection_name(c: Column) -> Column:
    return F.translate(c, "-", "_")


def context_line(seconds: Column, content: Column) -> Column:
    """``[12s] content``; a null time counts as 0."""
    return F.concat(F.lit("["), F.coalesce(seconds, F.lit(0.0)).cast("bigint").cast("string"), F.lit("s] "), F.coalesce(content, F.lit("")))


def chunk_line(start: Column, end: Column, text: Column) -> Column:
    """``[1s–9s] text`` with whole seconds, halves to even."""
    return F.concat(F.lit("["), F.rint(start).cast("bigint").cast("string"), F.lit("s–"), F.rint(end).cast("bigint").cast("string"), F.lit("s] "), text)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """NFKC form. ASCII texts skip the Python stage's work: they reach it as null."""
    plain = F.coalesce(~c.rlike(r"[^\x00-\x7F]"), F.lit(True))
    return F.when(plain, c).otherwise(_nfkc(F.when(~plain, c)))


# --- cleaner ---------------------------------------------------------------------------------------------------------
def normalize_line(c: Column) -> Column:
    """NFKC, no annotations, no control characters, no leading dash, repeats collapsed, blanks collapsed."""
    c = F.regexp_replace(nfkc(c), BRACKETS, "")
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    c = F.regexp_replace(c, r"(?U)^[-–—]\s*", "")
    c = F.regexp_replace(c, r"([!?。！？~～…])[!?。！？~～…]+", "$1")
    c = F.regexp_replace(c, r"(?i)\b(\w{3,})\s+\1(?:\s+\1)+\b", "$1")
    c = F.regexp_replace(c, r"([\x{3040}-\x{9FFF}]{2,8})\1{2,}", "$1")
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def unrecoverable(c: Column) -> Column:
    return c.isNull() | (F.length(c) < 2) | c.rlike(r"(?U)^[\s\p{P}\p{S}]+$") | c.rlike(r"(?U)^[0-9\s\p{P}]+$")


def _solid(c: Column) -> Column:
    """Length without white space."""
    return F.length(F.regexp_replace(c, r"(?U)\s", ""))


def script_language(c: Column) -> Column:
    """``ja`` if more than a quarter of the characters is Japanese, else ``en``."""
    return F.when(F.regexp_count(c, F.lit(CJK)) / F.greatest(_solid(c), F.lit(1)) > 0.25, F.lit("ja")).otherwise(F.lit("en"))


def ends_sentence(c: Column, lang: Column) -> Column:
    t = F.regexp_replace(c, r"(?U)\s+$", "")
    return F.when(lang == "ja", t.rlike("[。！？]$")).otherwise(t.rlike(r"\w[^.!?]*[.!?](?:\s|$)"))


def repair_line(c: Column) -> Column:
    """Drops a leading lower-case token of one or two letters."""
    return strip(F.regexp_replace(c, r"(?U)^[a-z]{1,2}\s+", ""))


def strip_fillers(c: Column, lang: Column) -> Column:
    ja = F.regexp_replace(c, "|".join([*JA_HESITATIONS, *JA_FILLERS]), "")
    ja = F.regexp_replace(ja, rf"^(?:{'|'.join(JA_OPENERS)})[、。]?", "")
    ja = F.regexp_replace(ja, r"(?U)([^\s]{2,10})\1{2,}", "$1")
    en = F.regexp_replace(c, rf"(?i)\b(?:{EN_HESITATIONS})\b[,.]?", "")
    en = F.regexp_replace(en, rf"(?i)\b(?:{EN_FILLERS})\b", "")
    en = F.regexp_replace(en, rf"(?i)^(?:{EN_OPENERS})[,\s]+", "")
    return F.when(lang == "ja", ja).otherwise(en)


def tidy(c: Column) -> Column:
    """Collapses blanks and drops leading punctuation that filler removal leaves."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?U)\s{2,}", " "), r"(?U)^[\s、。,.\-]+", ""))


def compare_form(c: Column) -> Column:
    """NFKC, lower case, letters and digits only: what duplicates are compared by."""
    return F.regexp_replace(F.lower(nfkc(c)), r"(?U)[\p{P}\p{S}\s]", "")


def filler_ratio(c: Column, lang: Column) -> Column:
    found = lambda rx: F.aggregate(F.regexp_extract_all(c, F.lit(rx), F.lit(0)), F.lit(0), lambda n, x: n + F.length(x))
    ja = found("|".join([*JA_HESITATIONS, *JA_FILLERS]))
    en = found(rf"(?i)\b(?:{EN_HESITATIONS})\b[,.]?") + found(rf"(?i)\b(?:{EN_FILLERS})\b")
    n = _solid(c)
    return F.when(n > 0, F.least(F.when(lang == "ja", ja).otherwise(en) / n, F.lit(1.0))).otherwise(F.lit(0.0))


def repetition(c: Column) -> Column:
    """Repeated word pairs, and half of the character trigrams beyond two of a kind, per word; at most 1."""
    w = F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")
    n = F.size(w)
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit("_"), y))
    solid = F.regexp_replace(c, r"(?U)\s", "")
    m = F.length(solid)
    chars = F.split(solid, "")
    size = F.greatest(m - 2, F.lit(0))
    two = F.zip_with(F.slice(chars, F.lit(1), size), F.slice(chars, F.lit(2), size), lambda x, y: F.concat(x, y))
    tri = F.array_sort(F.zip_with(two, F.slice(chars, F.lit(3), size), lambda x, y: F.concat(x, y)))
    # In sorted trigrams, one that equals the one two places before is the third or a later of its kind.
    k = F.size(tri)
    later = F.when(k >= 3, F.size(F.filter(F.zip_with(F.slice(tri, F.lit(3), k), F.slice(tri, F.lit(1), k - 2), lambda x, y: x == y), lambda e: e))).otherwise(0)
    half = F.when(m >= 6, later * 0.5).otherwise(0.0)
    twice = F.size(pairs) - F.size(F.array_distinct(pairs))
    return F.when(n >= 4, F.least((twice + half) / n, F.lit(1.0))).otherwise(F.lit(0.0))


def length_penalty(c: Column) -> Column:
    n = _solid(c)
    return F.when(n == 0, 1.0).when(n < 4, 0.95).when(n < 8, 0.6).when(n < 12, 0.25).otherwise(0.0)


def incompleteness(c: Column, lang: Column) -> Column:
    n = word_count(c)
    return F.when(ends_sentence(c, lang), 0.0).when(n <= 3, 0.9).when(n <= 6, 0.4).otherwise(0.1)


def symbol_noise(c: Column) -> Column:
    n = _solid(c)
    ratio = F.regexp_count(c, F.lit(r"[\p{L}\p{N}]")) / F.greatest(n, F.lit(1))
    return F.when(n == 0, 1.0).when(ratio >= 0.5, 0.0).otherwise((F.lit(0.5) - ratio) * 2)


def noise_factors(c: Column, lang: Column) -> Column:
    """The five factors and the weighted total, clamped to 0..1."""
    f, r, n, i, u = filler_ratio(c, lang), repetition(c), length_penalty(c), incompleteness(c, lang), symbol_noise(c)
    total = f * 0.40 + r * 0.10 + n * 0.25 + i * 0.20 + u * 0.05
    return F.struct(
        f.alias("filler"), r.alias("repetition"), n.alias("length"), i.alias("incompleteness"), u.alias("symbols"),
        F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)).alias("total"),
    )
