"""Encoding, windows, pieces, personal data and question-answer pairs."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import pairs, personal, pieces, tokens, windows

HAVE = os.path.exists(tokens.TOKENIZER)
TEXTS = [
    (1, "it's we're 'street I'll 've\n's  \n\n x \t y"), (2, "<|endoftext|> a"), (3, ""), (4, None), (5, " "), (6, "日本語のテスト １２３ ½x"), (7, "🙂🙂 é a'"), (8, "aaaaaaaaaaaaaaaaaaaaaaa" * 50),
    (9, "a　\u0085b\x1c c\r\n\r\nd"), (10, "''s 're\n're"), (11, "x" * 200_000),
]


@pytest.mark.skipif(not HAVE, reason="no tokenizer file here")
def test_ids_equal_the_reference_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.TOKENIZER)
    t.encode_special_tokens = True
    df = spark.createDataFrame([(k, x, "clash") for k, x in TEXTS], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", "text").collect()}
    assert got == {k: t.encode(x or "", add_special_tokens=False).ids for k, x in TEXTS}
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, "doc_id", "text").collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.skipif(not HAVE, reason="no tokenizer file here")
def test_ids_of_random_texts_and_forgetting(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.TOKENIZER)
    t.encode_special_tokens = True
    rng = random.Random(3)
    alphabet = "ab 'st\n\t1٣é日_-<>|🙂 re"
    replay = tokens.Replay(*tokens.load_merges(tokens.TOKENIZER))
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "CHUNK", 60)
    for _ in range(60):
        batch = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(8)]
        counts, ids = replay.batch(batch)
        at = 0
        for x, n in zip(batch, counts, strict=True):
            assert ids[at : at + n].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
            at += n


def test_windows_hold_everything_once(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(n)) for i, n in enumerate(rng.integers(0, 4000, 900))] + [(5000, 13_500), (5001, 12_000), (5002, 0), (5003, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    got = windows.pack(df, "doc_id", len(rows), group=300).collect()
    fill, total = {}, {}
    for r in got:
        fill[r.window_id] = fill.get(r.window_id, 0) + r.n_tokens
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {k: n or 0 for k, n in rows}
    assert max(fill.values()) <= windows.CAPACITY
    assert sum(1 for r in got if r.doc_id == 5000) == 3 and sum(1 for r in got if r.doc_id == 5001) == 2
    whole = sum(total.values())
    assert len(fill) <= whole / windows.CAPACITY * 1.03 + 4
    assert windows.pack(df.limit(0), "doc_id", 0).count() == 0


def best_fit(sizes, capacity):
    """Windows of best fit, longest first: what the search is held against."""
    room = []
    for n in sorted(sizes, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return len(room)


def test_local_search_empties_windows():
    sizes = np.array([3000, 3000, 2000, 2000, 2000, 1000, 1000, 0])
    out = windows.local_search([[0, 5], [1, 6], [2, 3], [4, 7]], sizes, 6000)
    assert len(out) == 3 and sorted(i for w in out for i in w) == list(range(8))
    # A one-for-one swap is needed: 4 + 3 and 2 + 1 into windows of 6.
    out = windows.local_search([[0, 1], [2, 3], [4]], np.array([4, 1, 3, 2, 2]), 6)
    assert len(out) == 2
    # Two for one: 3 + 2 for 4 makes the window full.
    search = windows._Search([[0, 1], [2, 3, 4]], np.array([4, 5, 3, 2, 4]), 10)
    assert search._double(0, [1], 0) == (1, [(2, 3), (3, 2)], [(4, 0)])
    assert windows.local_search([], np.array([], dtype=int), 6) == [] and windows.local_search([[0, 1]], np.array([0, 0]), 6) == [[0, 1]]


@pytest.mark.parametrize("low,high,n", [(1000, 3000, 1000), (1500, 4000, 1000), (1, 900, 3000)])
def test_local_search_against_best_fit(low, high, n):
    sizes = np.random.default_rng(7).integers(low, high + 1, n)
    start = windows.in_order(sizes, 6000)
    out = windows.local_search(start, sizes, 6000)
    assert sorted(i for w in out for i in w) == list(range(n)) and max(sizes[w].sum() for w in out) <= 6000
    least = -(-int(sizes.sum()) // 6000)
    assert least <= len(out) < len(start) and len(out) <= 1.01 * best_fit(sizes.tolist(), 6000)
    if (low, high) == (1000, 3000):  # best fit alone wastes a twentieth here
        assert best_fit(sizes.tolist(), 6000) > 1.04 * least and len(out) < 1.015 * least
    if high == 900:
        assert len(out) == least


def greedy(t, limit, overlap):
    """The cuts one after another, straight from the rule."""
    if not t:
        return []
    at, kind = pieces._with_hard_cuts(*pieces.boundaries(t), limit - overlap)
    at, kind = at.tolist(), kind.tolist()
    words = [a for a, k in zip(at, kind, strict=True) if k >= 1]
    out, i = [], 0
    while i < len(at) - 1:
        o = min(next((w for w in words if w >= at[i] - overlap), at[i]), at[i]) if overlap else at[i]
        far = max(j for j in range(len(at)) if at[j] <= o + limit)
        cut = max(far, i + 1)
        if far < len(at) - 1:
            for s in (1, 2, 3, 4, 5):
                hits = [j for j in range(i + 1, far + 1) if kind[j] >= s and at[j] >= max(o + limit // 2, at[i] + 1)]
                cut = hits[-1] if hits else cut
        out.append((o, at[i], at[cut]))
        i = cut
    return out


@pytest.mark.parametrize("limit,overlap", [(300, 40), (50, 0), (30, 29)])
def test_pieces_against_greedy(limit, overlap):
    rng = random.Random(11)
    texts = ["", "a" * 1000, "日本語です。" * 100, "x " * 400]
    for _ in range(60):
        texts.append("".join(rng.choice(["word ", "longerword ", "end. ", "line\n", "\n\n", "b" * 80, "句。", "half, "]) for _ in range(rng.randint(1, 60))).strip())
    for t, p in zip(texts, pieces.cut(texts, limit, overlap), strict=True):
        assert p == greedy(t, limit, overlap)
        assert "".join(t[s:e] for _, s, e in p) == t
        assert all(e - o <= limit and 0 <= s - o <= overlap for o, s, e in p)


def test_split_records(spark):
    rows = [("v", 0, "a. " * 200, "x"), ("v", 0, "a. " * 200, "x"), ("v", 1, "  " + "b" * 300 + "　", "x"), ("v", 2, None, "x"), ("v", 3, "", "x"), (None, 4, "c" * 301, "x")]
    df = spark.createDataFrame(rows, "video_id string, idx int, text string, piece string")
    got = {(r.video_id, r.idx) for r in pieces.oversized(df, ["video_id", "idx"], "text").collect()}
    assert got == {("v", 0), (None, 4)}
    n = {}
    for r in pieces.split(df, ["video_id", "idx"], "text").collect():
        n[(r.video_id, r.idx)] = n.get((r.video_id, r.idx), 0) + 1
        assert len(r.piece) <= 300
    assert set(n) == {("v", 0), ("v", 1), (None, 4)} and n[("v", 0)] >= 2 and n[("v", 1)] == 1 and n[(None, 4)] == 2
    assert pieces.split(df.limit(0), ["video_id", "idx"], "text").count() == 0
    with pytest.raises(ValueError):
        pieces.split(df, ["video_id"], "text", 10, 10)


NAMES = personal.Names({"ysolde", "renske"}, {"kolbringer", "pomerance-vale"})


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("Author: Ysolde Kolbringer <y.k@mail.example.test>", ["name", "email"]),
        ("Reported by Kolbringer, Ysolde over the phone (020 7946 0697).", ["name", "phone"]),
        ("pull git@code.example.test:a/b.git", []),
        ("db = pg://app:secret@db.internal.invalid/x", []),
        ("mail ysolde(at)example(dot)test or y at example dot test now", ["email", "email"]),
        ("call +1-896-555-0138 today", ["phone"]),
        ("call (382) 555-0183 or 424-555-0106 ext. 45", ["phone", "phone"]),
        ("rev = 48218829031  # row 882", []),
        ("build: 20230142-1632-789, lot 48-2217-417, 192.0.2.53:8443, sum = 020 + 7946 + 615", []),
        ("SSN 994-24-8413 and QQ 33 50 33 C", ["id_number", "id_number"]),
        ("passport no. X15097717; DNI 43327744-F; ssn=957423496", ["id_number"] * 3),
        ("lives at 70a Kiln Road, Flat 3 and", ["address"]),
        ("at Gerberallee 185, 01258 Ostenhafen or\n5 rue des Tilleuls-Neufs, 00648 Saint-Orvain", ["address", "address"]),
        ("On site at Avda. de las Norias 61, 5º B, Puerto Liral we", ["address"]),
        ("住所は94b Tanner Road, Flat 3でした。", ["address"]),
        ("class HarvestRoad(Street): 12 drizzle steps, Part of the Granite Pebble project", []),
        ("Émeline Dunmorrow wrote from here", ["name"]),
        ("Ask Renske Pomerance-Vale if in doubt. K. Kolbringer", ["name", "name"]),
        ("ysolde_k renskeKolbringer", []),
        ("Author: Łukasz Wiśniewski <l.w@mail.example.test>\nReviewed-by: Zoë Dvořáková", ["name", "email", "name"]),
        ("", []), (None, []),
    ],
)
def test_personal_data(text, kinds):
    assert [k for _, _, k, _ in personal.find(text, NAMES)] == kinds


def test_checksums():
    assert personal.luhn("79927398713") and not personal.luhn("79927398710")
    assert personal.mod23("12345678", "Z") and not personal.mod23("12345678", "A")
    assert personal.mod11_10("86095742719") and not personal.mod11_10("86095742718")
    n = "1850578006084"
    assert personal.mod97(n + f"{97 - int(n) % 97:02d}") and not personal.mod97(n + "00")


def test_redaction_and_lines(spark):
    rows = [(1, "x\nmail a@b.test\r\nand a@b.test, c@d.test", "k"), (2, None, "k"), (3, "", "k"), (3, "", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    parts = spark.createDataFrame([("Ysolde", "given"), (None, "given"), ("", "family")], "name_part string, part_kind string")
    assert sorted((r.doc_id, r.line_no, r.kind) for r in personal.found_lines(df, parts).collect()) == [(1, 2, "email"), (1, 3, "email")]
    got = personal.redact(df, parts).collect()
    assert sorted((r.doc_id, r.masked_text, len(r.finds)) for r in got if r.doc_id != 2) == [(1, "x\nmail [EMAIL]\r\nand [EMAIL], [EMAIL]", 3), (3, "", 0), (3, "", 0)]
    assert [r.masked_text for r in got if r.doc_id == 2] == [None]
    assert personal.found_lines(df.limit(0), parts.limit(0)).count() == 0


PAIRS = [
    ("What is a pump?", None, ["empty"]), ("What is a pump?", " ​", ["empty"]), ("What is a pump?", "N/A", ["empty"]), ("What is a pump?", "[]", ["empty"]), ("What is a pump?", "None.", ["empty"]),
    ("What happens when the pump stops?", "You asked: what happens when the pump stops", ["echo", "truncated"]), ("What happens when the pump stops?", "What hapens when the pump stops?", ["echo"]),
    ("What is a pump?", "I'm sorry, but I can't help with that.", ["refusal"]), ("Was ist das?", "Dazu kann ich keine Auskunft geben.", ["refusal"]), ("これは何ですか", "申し訳ありませんが、お答えできません。", ["refusal"]),
    ("What happens to the pump?", "The speaker says they cannot recommend it, but it is the best of them.", []),
    ("What is the use of the pump?", "Der Druck ist nicht zu hoch und die Pumpe ist neu.", ["wrong_language"]),
    ("Bitte auf Deutsch antworten. What is the use of the pump?", "Der Druck ist nicht zu hoch und die Pumpe ist neu.", []),
    ("What is the use of the pump?", "It moves water. The other one moves the", ["truncated"]), ("What is the use?", "It works.\n```\nrun --now\n```", []), ("What is the use?", "It works.\n```\nrun --", ["truncated"]),
    ("Steps?", "Steps:\n1. Lift the lid\n2. Close the lid", []), ("Steps?", "1. Lift the lid\n2.", ["truncated"]), ("How many?", "About 6 percent", []), ("How many?", "42", []), ("How many?", "42,", ["truncated"]), ("What is a pump?", "I'm sorry, but I can't help with that. " + "There are many reasons for it and none of them is yours. " * 8, ["refusal"]), ("Is it?", "Yes", []), ("Is it?", "It is the best of all the pumps here. (see 12:30)", []), (None, "It works.", []), (None, None, ["empty"]),
]


def test_pairs(spark):
    df = spark.createDataFrame([(k, q, a, "clash") for k, (q, a, _) in enumerate(PAIRS)], "k int, q string, a string, words string")
    got = {r.k: r.defects for r in pairs.defects(df, "q", "a").collect()}
    assert {k: got[k] for k in got if got[k] != PAIRS[k][2]} == {}


LONG = "What happens when the training split becomes slow?"
REPEATED = [
    (LONG, f"{LONG} {LONG}", ["echo"]), (LONG, f"{LONG}\n{LONG}\n{LONG}", ["echo"]), (LONG, f"{LONG} {LONG.replace('happens', 'hapens')}", ["echo"]),
    (f"{LONG} Please answer in German.", f"{LONG} {LONG}", ["echo"]), (LONG, f"{LONG} It takes twice as long, and the speaker waits for the second run.", []),
]


def test_pairs_repeated_question(spark):
    df = spark.createDataFrame([(k, q, a) for k, (q, a, _) in enumerate(REPEATED)], "k int, q string, a string")
    got = {r.k: r.defects for r in pairs.defects(df, "q", "a").collect()}
    assert {k: got[k] for k in got if got[k] != REPEATED[k][2]} == {}


def test_pairs_latest_record(spark):
    rows = [(1, "What is it?", None, 1), (1, "What is it?", "It is a pump.", 2), (2, "What is it?", "It is a pump.", 1), (2, "What is it?", "null", 2), (2, "What is it?", "null", 2)]
    df = spark.createDataFrame(rows, "rid bigint, q string, a string, at int")
    assert [tuple(r) for r in pairs.first_defect(df, "rid", "q", "a", "at").collect()] == [(2, "empty")]
    assert pairs.first_defect(df.limit(0), "rid", "q", "a", "at").count() == 0
    assert df.select(F.col("rid")).count() == 5
