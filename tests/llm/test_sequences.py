"""Runs, turns, languages and near-duplicates."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import languages, neardups, runs, turns

SAME = [
    ("The trick with the prsesure gauge is that", "The trick really with the pressure gauge is that"), ("SERIES 25 TOURNE", "seies 25 tourne"), ("which&nbsp;means that nobody", "<i>which means</i> that nobody"),
    ("sans le câble de hein, frein", "sans le câble de frein euh"), ("雨量計がれほど長く使える", "雨量計がこれほど長く使える"), ("found 52.1 mnutes of slack in the", "found 52.1 minutes of slack in in the"),
]
OTHER = [
    ("you can move the store now", "you can not move the store now"), ("take 55 seconds off", "take 60 seconds off"), ("the cat sat on the mat", "the dog sat on the mat"), ("it is safe to open", "it is not safe to open"), ("窓を開けても大丈夫です", "窓を開けても大丈夫ではないです"), ("yes", "no"),
]


def test_same_captions():
    for a, b in SAME:
        assert runs.same(runs.normal(a), runs.normal(b)), (a, b)
        assert runs.same(runs.normal(b), runs.normal(a)), (a, b)
    for a, b in OTHER:
        assert not runs.same(runs.normal(a), runs.normal(b)), (a, b)
    assert [runs.normal(t) for t in (None, " ", "[Music]", "♪ la ♪", "*coughs*", "（笑）", "...")] == [""] * 7


def brute_runs(rows, pause):
    latest = {}
    for v, i, t, s, d, at in rows:
        if (v, i) not in latest or at > latest[(v, i)][-1]:
            latest[(v, i)] = (v, i, t, s, d, at)
    out, cur = [], []
    for v, i, t, s, d, _ in sorted((r for r in latest.values() if r[3] is not None), key=lambda r: (r[0], r[3], r[1])):
        n = runs.normal(t)
        if not n:
            continue
        if cur and cur[-1][0] == v and s - cur[-1][2] <= pause and all(runs.same(c[3], n) for c in cur):
            cur.append((v, i, s + max(d or 0, 0), n))
            continue
        if len(cur) > 1:
            out.append((cur[0][0], cur[0][1], cur[-1][1], len(cur)))
        cur = [(v, i, s + max(d or 0, 0), n)]
    if len(cur) > 1:
        out.append((cur[0][0], cur[0][1], cur[-1][1], len(cur)))
    return sorted(out)


@pytest.mark.parametrize("chunk", [5, 600])
def test_runs_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(runs, "CHUNK_SECONDS", chunk)
    rng = random.Random(2)
    texts = ["we moved the pump away", "we moved teh pump away", "We moved the pump away!", "we moved the the pump away", "another line entirely here", "[Music]", None, "", "it is 5 now", "it is 6 now"]
    rows = []
    for v in ("a", "b"):
        s = 0.0
        for i in range(150):
            rows.append((v, i, rng.choice(texts[:4] if rng.random() < 0.6 else texts), s, rng.choice([1.0, None, -2.0, 0.5]), 1))
            s = round(s + rng.choice([0.0, 1.0, 2.0, 12.0]), 2)
    rows += [("a", 3, "changed later on", rows[3][3], 1.0, 2), rows[10], ("a", 999, "no time", None, 1.0, 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "video_id string, idx int, text string, start_sec double, duration double, ingested_at int, norm string")
    got = sorted((r.video_id, r.first_idx, r.last_idx, r.captions) for r in runs.collapse(df).collect())
    assert got == brute_runs(rows, runs.PAUSE)
    assert runs.collapse(df.limit(0)).count() == 0


ROSTER = turns.Roster(((1, "Ysolde Pomerance-Vale", "host"), (2, "Mattis Ostrobel", "guest"), (3, "Borvik Oldmere", "guest")))


@pytest.mark.parametrize(
    "label,who",
    [("Ysolde", 1), ("YSOLDE POMERANCE-VALE :", 1), ("Mattis O.:", 2), ("Matis:", 2), ("SPK_03:", 3), ("Speaker 2 :", 2), ("Host:", 1), ("Guest:", None), ("- Borvik:", 3), (">> Borivk:", 3), ("note:", None), ("Speaker 9:", None), ("", None)],
)
def test_who(label, who):
    assert ROSTER.who(label) == who


def tagged(texts):
    toks = [turns.tokens(t) for t in texts]
    obs = [[turns.shape(x, ROSTER) for _, _, x in row] for row in toks]
    paths = turns.viterbi(obs, turns.train(obs))
    return [turns.parts(t, k, o, p, ROSTER) for t, k, o, p in zip(texts, toks, obs, paths, strict=True)]


def test_tags():
    texts = [
        "00:00:05 [Ysolde] [Applause] they keep er the pump", "(0:36) >> Mattis: and found 176 rows", "Borvik Oldmere: um", "one more thing: the pump is off", "[laughs]", "<v Mattis Ostrobel> ♪ branch er, share. Borvik: the mount",
        "the ratio was 3:1 and Ysolde said so", "", "01:03 - Speaker 1: every season",
    ]
    got = [[(w, c) for w, c, _ in p] for p in tagged(texts)]
    assert got[0] == [(1, "they keep the pump")]
    assert got[1] == [(2, "and found 176 rows")]
    assert got[2] == [] and got[4] == [] and got[7] == []
    assert got[3] == [(None, "one more thing: the pump is off")]
    assert [w for w, _ in got[5]] == [2, 3]
    assert [w for w, _ in got[6]] == [None]
    assert got[8] == [(1, "every season")]


def test_viterbi_does_not_hang_on_blocks(monkeypatch):
    rng = random.Random(6)
    rows = [[rng.randrange(len(turns.SHAPES)) for _ in range(rng.choice([0, 1, 5, 30, 400]))] for _ in range(60)]
    model = turns.logs(*turns.prior())
    whole = turns.viterbi(rows, model)
    monkeypatch.setattr(turns, "CELLS", 500)
    assert all((a == b).all() for a, b in zip(whole, turns.viterbi(rows, model), strict=True))


@pytest.mark.parametrize("chunk", [3, 600])
def test_turns(spark, monkeypatch, chunk):
    monkeypatch.setattr(turns, "CHUNK_SECONDS", chunk)
    raw = [("v", 0, "before any label", 0.0, 1), ("v", 1, "Ysolde: hello there", 1.0, 1), ("v", 2, "and more words", 2.0, 1), ("v", 3, "Mattis: um", 5.0, 1), ("v", 4, "still hers", 6.0, 1), ("v", 5, "yes of course. [Mattis] no not now", 7.0, 1), ("v", 6, "Mattis: again", 8.0, 1), ("v", 6, "Mattis: again", 8.0, 2), ("v", 7, None, 9.0, 1), ("w", 0, "Ysolde: not listed", 0.0, 1)]
    seg = [("v", 0, "no labels here", 0.0), ("x", 0, "Host: hi all of you", 3.0), ("x", 1, "Guest: hello to you", 4.0)]
    people = [("v", 1, "Ysolde Pomerance-Vale", "host"), ("v", 2, "Mattis Ostrobel", "guest"), ("x", 1, "Ysolde Pomerance-Vale", "host"), ("x", 2, "Mattis Ostrobel", "guest"), ("z", None, None, None)]
    r = spark.createDataFrame([(*x, "c") for x in raw], "video_id string, idx int, text string, start_sec double, ingested_at int, part string")
    s = spark.createDataFrame(seg, "video_id string, idx int, text string, start_sec double")
    p = spark.createDataFrame(people, "video_id string, speaker_no int, speaker_name string, speaker_role string")
    got = sorted((x.origin, x.video_id, x.first_idx, x.speaker_no) for x in turns.turn_starts(r, s, p).collect())
    assert got == [("raw_segments", "v", 1, 1), ("raw_segments", "v", 5, 2), ("segments", "x", 0, 1), ("segments", "x", 1, 2)]
    full = {(x.video_id, x.turn_no): x.text for x in turns.turns(r, s, p).collect()}
    assert full[("v", 1)] == "hello there and more words still hers yes of course." and full[("v", 2)] == "no not now again"
    assert turns.turn_starts(r.limit(0), s.limit(0), p).count() == 0


SENTENCES = {
    "en": ["the pump is in the old barn", "we moved the box because it was too loud", "nobody thought that it would last so long"],
    "de": ["die Pumpe steht in der alten Scheune", "wir haben die Kiste verschoben weil sie zu laut war", "niemand hätte gedacht dass es so lange hält"],
    "fr": ["la pompe est dans la vieille grange", "nous avons déplacé la caisse parce que elle était trop bruyante", "personne ne pensait que cela tiendrait si longtemps"],
    "es": ["la bomba está en el viejo granero", "movimos la caja porque era demasiado ruidosa", "nadie pensaba que pudiera durar tanto tiempo"],
    "pt": ["a bomba está no velho celeiro", "mudámos a caixa porque era muito barulhenta", "ninguém pensava que pudesse durar tanto tempo"],
    "ja": ["ポンプは古い倉庫にあります", "箱がうるさかったので動かしました", "こんなに長く使えるとは思っていませんでした"],
}


def test_languages(spark):
    rows, k = [], 0
    for lang, some in SENTENCES.items():
        for n in range(12):
            rows.append((f"t{k}", some[n % 3] + ".", lang if n else "xx", "c"))
            k += 1
    rows += [("mixed", "The pump is in the old barn. Die Pumpe steht in der alten Scheune.", "en", "c"), ("region", SENTENCES["de"][0], "de-AT", "c"), ("name", SENTENCES["ja"][0], "Japanese", "c"), ("null", None, None, "c"), ("empty", "", "en", "c"), ("music", "[Music] um", None, "c"), ("wrong", SENTENCES["fr"][1], "es", "c"), ("wrong", SENTENCES["fr"][1], "es", "c")]
    df = spark.createDataFrame(rows, "item_key string, text string, lang string, confidence string")
    got = sorted((r.item_key, r.true_lang) for r in languages.faults(df, ["item_key"], "text", "lang").collect())
    first = [(f"t{12 * k}", lang) for k, lang in enumerate(SENTENCES)]
    assert got == sorted([*first, ("mixed", "de"), ("mixed", "en"), ("wrong", "fr")])
    all_ = {r.item_key: r for r in languages.identify(df, ["item_key"], "text", "lang").collect()}
    assert all_["null"].true_lang is None and all_["null"].confidence == 0.0 and all_["empty"].stretches == []
    assert [s.lang for s in all_["mixed"].stretches] == ["en", "de"]
    assert languages.faults(df.limit(0), ["item_key"], "text", "lang").count() == 0


def brute_pairs(rows):
    one = {}
    for i, c, e in rows:
        if i is not None:
            one[i] = max(one.get(i, (c or "", e)), (c or "", e), key=lambda x: x[0])
    recs = []
    for i, (c, e) in one.items():
        n = "".join(ch for ch in c.lower() if ch.isalnum())
        if len(n) >= 3:
            recs.append((i, {n[k : k + 3] for k in range(len(n) - 2)}, {x.strip().lower() for x in e or [] if x and x.strip()}))
    out = set()
    for k, a in enumerate(recs):
        for b in recs[k + 1 :]:
            if 5 * len(a[1] & b[1]) >= 4 * len(a[1] | b[1]) and (not a[2] or not b[2] or a[2] & b[2]):
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return sorted(out)


def test_neardups_against_brute_force(spark):
    rng = random.Random(9)
    base = ["we moved the drum sander next to the kiln shelf because it was loud", "the second version makes the fuse box less damp than before", "鉱山の古い倉庫で新しい送風機を動かしました", "abcd", "ab", "the second version makes the fuse box less dump than before"]
    rows = []
    for k in range(120):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(t) + 1)
            t = t[:p] + rng.choice("xyz ") + t[p:]
        ents = rng.choice([None, [], ["Ax"], [" ax ", None], ["B", "Ax"], ["b"], ["", "  "]])
        rows.append((f"id{k:03d}", t, ents))
    rows += [rows[0], ("n1", None, ["ax"]), ("n2", "", None), (None, base[0], None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, content string, entities array<string>, tid string")
    got = [(r.id_a, r.id_b) for r in neardups.pairs(df).collect()]
    assert len(got) == len(set(got)) and sorted(got) == brute_pairs(rows)
    assert neardups.pairs(df.limit(0)).count() == 0


def test_large_classes_of_copies_are_stars(spark):
    rows = [(f"c{k}", "exactly the same text in all of them", ["e"]) for k in range(10)] + [("d", "exactly the same text in all of them!!", ["e"]), ("f", "exactly the same text in all of themx", ["e"])]
    df = spark.createDataFrame(rows, "id string, content string, entities array<string>")
    got = sorted((r.id_a, r.id_b) for r in neardups.pairs(df, full=3).collect())
    assert ("c0", "c9") in got and ("c1", "c2") not in got and ("c0", "f") in got
    assert len(got) == 11


def test_classes_and_link_counts(spark):
    text = "exactly the same text in all of them"
    rows = [(f"c{k}", text, ["e"]) for k in range(10)] + [("d", text + "!!", ["e"]), ("f", text + "x", ["e", "g"]), ("h", text + "y", ["other"]), ("n", None, ["e"])]
    df = spark.createDataFrame(rows, "id string, content string, entities array<string>")
    got = {r.id: (r.class_id, r.class_size) for r in neardups.classes(df).collect()}
    assert got == {**{f"c{k}": ("c0", 11) for k in range(10)}, "d": ("c0", 11), "f": ("f", 1), "h": ("h", 1)}
    for full in (64, 3):  # links are counted alike below and above the size from which pairs are no longer written out
        counts = {r.id: (r.group_id, r.n_links) for r in neardups.groups(df, full=full).collect()}
        assert counts == {**{k: ("c0", 11) for k in ["d", *[f"c{k}" for k in range(10)]]}, "f": ("c0", 11), "h": ("h", 0), "n": ("n", 0)}


def test_frequent_trigrams_and_entities_are_split(spark, monkeypatch):
    """Grids of cells, many buckets and entities split by trigram find the same pairs."""
    rng = random.Random(3)
    base = ["we moved the drum sander next to the kiln shelf because it was loud", "the second version makes the fuse box less damp than before", "the second version makes the fuse box less dump than before"]
    rows = [(f"id{k:03d}", "".join(rng.choice("qz") if rng.random() < 0.02 else c for c in rng.choice(base)), rng.choice([None, ["ax"], ["ax", "b"], ["b"]])) for k in range(90)]
    df = spark.createDataFrame(rows, "id string, content string, entities array<string>")
    cls = neardups.class_rows(neardups.records(df, "id", "content", "entities")).select("t1", "norm", F.transform("ents", lambda e: F.xxhash64(e)).alias("hashes")).collect()
    norms, tid = [r.norm for r in cls], np.array([r.t1 for r in cls])
    sizes, ents = np.array([len(r.hashes) for r in cls]), np.array([h for r in cls for h in r.hashes], dtype=np.int64)
    grams = np.bincount((neardups.distinct_grams(norms)[1] >> np.uint64(35)).astype(np.int64), minlength=1 << 17)
    seen = np.bincount(neardups._entity_bucket(ents), minlength=1 << 17)
    found = []
    for hot, block, buckets in ((1024, 65536, 1), (5, 65536, 3), (5, 7, 50)):
        monkeypatch.setattr(neardups, "HOT", hot)
        monkeypatch.setattr(neardups, "BLOCK", block)
        packed = neardups.Index(grams, seen, int((sizes == 0).sum()), buckets, 4, 5).pack(norms, tid, sizes, ents)
        pairs = set()
        for some in packed.values():
            heads = [h for _, h in some if h]
            got = neardups._joiner(4, 5)(pa.table({"posts": [b"".join(p for p, _ in some)], "heads": [b"".join(heads)], "cuts": [[len(h) for h in heads]]}))
            pairs |= set(zip(got["ta"].to_pylist(), got["tb"].to_pylist(), strict=True))
        found.append(pairs)
    exact = {(min(a, b), max(a, b)) for a, b in ((x, y) for x in tid.tolist() for y in tid.tolist() if x < y) if _alike(norms[tid.tolist().index(a)], norms[tid.tolist().index(b)])}
    meet = {t: set(r.hashes) for t, r in zip(tid.tolist(), cls, strict=True)}
    exact = {(a, b) for a, b in exact if not meet[a] or not meet[b] or meet[a] & meet[b]}
    assert exact and all(exact <= f for f in found)


def _alike(a, b):
    x, y = ({t[k : k + 3] for k in range(len(t) - 2)} for t in (a, b))
    return 5 * len(x & y) >= 4 * len(x | y)


def test_components_and_groups(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [(f"p{k:02d}", f"p{k + 1:02d}") for k in range(30)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in neardups.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    rows = [("c", "the second version makes it less damp than before", ["e"]), ("a", "the second version makes it less damp than beforex", ["e"]), ("b", "nothing alike here at all", ["e"]), ("d", None, None), (None, "x", None)]
    df = spark.createDataFrame(rows, "id string, content string, entities array<string>")
    assert sorted(tuple(r) for r in neardups.groups(df).collect()) == [("a", "a", 1), ("b", "b", 0), ("c", "a", 1), ("d", "d", 0)]
