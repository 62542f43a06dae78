import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import cache, knowledge, providers, retrieval
from weftline.streaming import streams


def test_parse_objects(spark):
    raw = 'Sure:\n```json\n[{"type":"claim","content":" A ","confidence":0.5,"timestamp":3,"entities":["x"]}, 7, {"type":"nope","content":"B"}, {"type":"risk","content":"  "}, {"type":"metric","content":"C","confidence":null}]\n```'
    df = spark.createDataFrame([("v", raw), ("w", "no json"), ("o", '{"type":"claim","content":"x"}'), ("n", None)], "video_id string, raw string")
    got = {r.id: r for r in knowledge.parse_objects(df, "video_id", "raw").collect()}
    assert set(got) == {"v_0", "v_4"}
    assert (got["v_0"].content, got["v_0"].entities, got["v_0"].ts_sec) == ("A", ["x"], 3.0)
    assert (got["v_4"].confidence, got["v_4"].entities, got["v_4"].ts_sec) == (0.8, [], 0.0)


def test_intents(spark):
    qs = [(1, "how much does it cost"), (2, "what is the difference between a and b"), (3, "hello there"), (4, None), (5, "rates and rules")]
    got = {}
    for r in knowledge.intents(spark.createDataFrame(qs, "qid int, q string"), "qid", "q").orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.ktype)
    assert got[1][0] == "metric" and "claim" in got[1]
    assert got[2] == ["comparison", "definition", "relationship", "claim"]
    assert got[3] == got[4] == got[5] == ["claim", "principle", "definition", "comparison"]


def test_bm25_formula(spark):
    docs = [(1, "a a b"), (2, "a c"), (3, "a d e f"), (4, ""), (5, "b b b")]
    words = {k: t.split() for k, t in docs}
    query = "a b b zz"
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    vocab = {w for ws in words.values() for w in ws}
    df = {w: sum(w in ws for ws in words.values()) for w in vocab}
    idf = {w: math.log(n - df[w] + 0.5) - math.log(df[w] + 0.5) for w in vocab}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    exp = {}
    for k, ws in words.items():
        s = sum(idf[t] * ws.count(t) * 2.5 / (ws.count(t) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for t in query.split() if t in idf)
        if any(t in ws for t in query.split()):
            exp[k] = s
    d = spark.createDataFrame(docs, "id int, t string")
    q = spark.createDataFrame([(1, query)], "qid int, q string")
    got = {r.id: r.score for r in retrieval.bm25(d, "id", "t", q, "qid", "q").collect()}
    assert got.keys() == exp.keys() and all(got[k] == pytest.approx(exp[k]) for k in exp)


def test_searches_ask_every_twentieth_request(spark, tmp_path, monkeypatch):
    from weftline.plans import library

    ko = [(f"v_{i:02d}", "risk" if i % 2 else "claim", ["pump wet", "the pump the", "hose and pump", "a kiln", "kiln b c pump", None][i % 6], ["Pump"], 0.5, "v", float(i)) for i in range(40)]
    spark.createDataFrame(ko, "id string, ktype string, content string, entities array<string>, confidence double, video_id string, ts_sec double").write.parquet(str(tmp_path / "knowledge_objects.parquet"))
    log = [(20, "old kiln", 1), (20, "the wet pump pump", 2), (40, "Kiln a", 1), (60, " ", 1), (80, None, 1), (100, "nothing here", 1), (41, "hose", 1)]
    spark.createDataFrame([(k, None, t, "x", at) for k, t, at in log], "request_id bigint, video_id string, query_text string, answer string, asked_at int").write.parquet(str(tmp_path / "query_log.parquet"))
    asked = spark.createDataFrame([(20, "the wet pump pump"), (40, "Kiln a")], "qid bigint, q string")
    docs = spark.createDataFrame([(r[0], r[2]) for r in ko if r[2]], "id string, content string")
    full = retrieval.bm25(docs, "id", "content", asked, "qid", "q").withColumn("score", F.round("score", 8))
    exp = {(r.qid, r.id, r["rank"]) for r in retrieval.top_k(full, ["qid"], [F.desc("score"), F.col("id")], 20).collect()}
    dense = docs.crossJoin(asked).select("qid", "id", F.round(retrieval.density(F.col("content"), T.words(F.col("q"))), 8).alias("s")).filter("s > 0")
    shared = {(r.qid, r.id, r["rank"]) for r in retrieval.top_k(dense, ["qid"], [F.desc("s"), F.col("id")], 30).collect()}
    for size in (16_384, 7):
        monkeypatch.setattr(retrieval, "BLOCK_DOCS", size)
        monkeypatch.setattr(retrieval, "BLOCK_QUERIES", -(-size // 7))
        assert {(r.qid, r.id, r["rank"]) for r in library.bm25_top(spark, str(tmp_path)).collect()} == exp
        assert {(r.qid, r.id, r["rank"]) for r in library._by_overlap(spark, str(tmp_path)).collect()} == shared
    for name in ("fused_top", "ranked_objects", "budgeted_objects", "briefs"):
        assert {r.qid for r in library.QUERIES[name](spark, str(tmp_path)).select("qid").collect()} == {20, 40}, name


def _stored(spark, folder, rows):
    spark.createDataFrame(rows, "id string, ktype string, content string, entities array<string>, confidence double, video_id string, ts_sec double, lang string").write.parquet(str(folder / "knowledge_objects.parquet"))


def test_objects_of_types_of_any_video(spark, tmp_path):
    from weftline.plans import library

    _stored(spark, tmp_path, [(f"{v}_0", t, "x", [], 0.5, v, 1.0, "en") for v, t in (("abc", "risk"), ("Abc", "Metric"), ("0bc", "risk"), ("-bc", "metric"), ("_bc", "risk"), ("bcd", "claim"))])
    assert {r.id for r in library.objects_of_types(spark, str(tmp_path)).collect()} == {"abc_0", "Abc_0", "0bc_0", "-bc_0", "_bc_0"}


def test_types_of_a_video_are_named_once(spark, tmp_path):
    from weftline.plans import library

    _stored(spark, tmp_path, [(f"{v}_{k}", t, "x", [], 0.5, v, 1.0, "en") for k, (v, t) in enumerate((("a", "risk"), ("a", "Risk"), ("a", "claim"), ("a", "risk"), ("b", "metric"), ("b", None), ("b", "nope"), ("c", None)))])
    assert {r.video_id: r.types for r in library.types_by_video(spark, str(tmp_path)).collect()} == {"a": "claim,risk", "b": "metric"}


def test_objects_of_all_asked_videos(spark, tmp_path):
    from weftline.plans import library

    _stored(spark, tmp_path, [(f"{v}_0", "risk", "x", [], 0.5, v, 1.0, "en") for v in ("a", "b", "c")])
    spark.createDataFrame([(1, "b"), (2, "c"), (3, "c"), (4, None)], "request_id bigint, video_id string").write.parquet(str(tmp_path / "query_log.parquet"))
    assert sorted(r.id for r in library.objects_of_video(spark, str(tmp_path)).collect()) == ["b_0", "c_0"]


def test_entities_with_null_elements(spark, tmp_path):
    from weftline.plans import library

    _stored(spark, tmp_path, [("a", "risk", "x", ["Pump", None], 0.5, "v", 1.0, "en"), ("b", "risk", "x", [None], 0.5, "v", 1.0, "en"), ("c", "risk", "x", None, 0.5, "v", 1.0, "en")])
    assert sorted(tuple(r) for r in library.entities_json(spark, str(tmp_path)).collect()) == [("a", '["Pump",null]', 2), ("b", "[null]", 1), ("c", "[]", 0)]


def test_attention_of_every_chunk(spark, tmp_path, monkeypatch):
    from weftline.plans import library

    rows = [("v", 0, "Pump one.", 40.0, 60.0, 0.2), ("v", 1, "Pump two.", 90.0, 100.0, 0.2), ("v", 2, "Pump three.", None, 50.0, 0.5), ("v", 3, "Pump four.", 0.0, 10.0, None)]
    spark.createDataFrame(rows, "video_id string, idx int, text string, start_sec double, end_sec double, noise_score double").write.parquet(str(tmp_path / "cleaned_segments.parquet"))
    got = {r.idx: r.attention for r in library.attention_scores(spark, str(tmp_path)).collect()}
    assert got == {0: 0.8, 1: 0.98, 2: 0.5, 3: 0.18}
    assert {r.idx for r in library.compressed_to_budget(spark, str(tmp_path)).collect()} == {0, 1, 2, 3}
    monkeypatch.setattr(library, "BUDGET", 2)
    assert [r.idx for r in library.compressed_to_budget(spark, str(tmp_path)).collect()] == [1]


def test_nearest_blocks_and_zero_vectors(spark, monkeypatch):
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(30)] + [(99, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id int, e array<double>")
    q = v.filter("id < 9").select(F.col("id").alias("qid"), F.col("e").alias("qe"))
    whole = sorted(tuple(r) for r in retrieval.nearest(v, "id", "e", q, "qid", "qe", 3).collect())
    monkeypatch.setattr(retrieval, "MOST_VECTORS", 2)
    assert sorted(tuple(r) for r in retrieval.nearest(v, "id", "e", q, "qid", "qe", 3).collect()) == whole
    assert all(r[1] != 99 for r in whole) and len(whole) == 27


def test_fusion_prefers_the_first_list_on_ties(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid int, id string, r int")
    b = spark.createDataFrame([(1, "z", 1), (1, "y", 3)], "qid int, id string, r int")
    got = [r.id for r in retrieval.fuse([(a, "r", 0.5), (b, "r", 0.5)], "qid", "id").orderBy("rank").collect()]
    assert got == ["y", "x", "z"]


def test_assemble_and_render(spark):
    rows = [(1, f"o{i}", "claim" if i % 2 else "risk", i % 2 == 1, i, "word " * 50) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "qid int, id string, ktype string, is_priority boolean, rank int, line string")
    packed = knowledge.assemble(df, "qid", "is_priority", "rank", "line", 400)
    used = {r.is_priority: r.u for r in packed.groupBy("is_priority").agg(F.sum("tokens").alias("u")).collect()}
    assert used == {True: 201, False: 134}
    brief = knowledge.render(packed, "qid", "ktype", "rank", "line").first()["brief"]
    assert brief.index("## Key Claims") < brief.index("## Risks & Failure Modes")
    assert knowledge.render(packed.limit(0), "qid", "ktype", "rank", "line").count() == 0


def test_scores(spark):
    df = spark.createDataFrame([(["Big Pump", None], 95.0, 100.0)], "e array<string>, s double, t double")
    terms = T.words(F.lit("the pump"))
    r = df.select(knowledge.entity_overlap(F.col("e"), terms).alias("o"), knowledge.recency(F.col("s"), F.col("t")).alias("r"), knowledge.recency(F.col("s"), F.lit(0.0)).alias("z"), retrieval.position_score(F.lit(0.0), F.lit(0.0), F.lit(10.0)).alias("p")).first()
    assert (r.o, r.r, r.z, r.p) == (0.5, 0.6, 1.0, 0.2)


def test_upsert_and_inspect(spark):
    a = spark.createDataFrame([("1", "old"), ("2", "old")], "id string, v string")
    b = spark.createDataFrame([("2", "new"), ("3", "new")], "id string, v string")
    assert sorted(tuple(r) for r in knowledge.upsert(a, b).collect()) == [("1", "old"), ("2", "new"), ("3", "new")]
    assert knowledge.upsert(a, b.limit(0)).count() == 2


def test_cache(spark):
    rows = [(1, "v", "Q ", "one", 0), (2, "v", "q", "two", 100), (3, "v", "q", "three", 90_000), (4, None, "q", "x", 5)]
    df = spark.createDataFrame(rows, "rid int, v string, q string, a string, sec int").withColumn("at", F.timestamp_seconds("sec"))
    e = cache.entries(df, "v", "q", ["a"], "at")
    asked = df.select("rid", "at", T.cache_key(F.coalesce("v", F.lit("search")), F.col("q")).alias("key"))
    got = {r.rid: (r.hit, r.cached_a) for r in cache.lookup(asked, e, "at", ["a"]).collect()}
    assert got == {1: (False, None), 2: (True, "one"), 3: (False, None), 4: (False, None)}
    assert cache.invalidate(e, e.filter("a = 'x'")).count() == 3
    assert cache.stats(e.limit(0), F.length("a")).first()["entries"] == 0


def test_providers(spark):
    df = spark.createDataFrame([("s", "line one\nlast line")], "s string, u string")
    r = providers.with_answers(df, "s", "u", providers.Echo()).first()
    assert (r.answer, r.input_tokens, r.output_tokens) == ("last line", 5, 2)
    assert len(providers.with_embeddings(df, "u").first()["embedding"]) == providers.DIMENSIONS


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:10", "a"), (2, "2024-01-01 00:20:00", "a"), (3, "2024-01-01 02:00:00", "a")]
    spark.createDataFrame(rows, "id int, t string, k string").select("id", F.to_timestamp("t").alias("ts"), "k").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("id int, ts timestamp, k string").parquet(str(tmp_path / "e"))
    for name, df, n in (("tc", streams.tumbling_counts(stream, "ts", "k"), 2), ("ss", streams.sessions(stream, "ts", "k"), 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n
    texts = [("v", 0, "a b c"), ("v", 1, "a b c"), ("v", 2, "x y"), ("v", 3, None)]
    spark.createDataFrame(texts, "video_id string, idx int, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    s = streams.consecutive(spark.readStream.schema("video_id string, idx int, text string").parquet(str(tmp_path / "t")), "video_id", "idx", "text")
    q = s.writeStream.format("memory").queryName("cons").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.idx for r in spark.table("cons").collect()) == [0, 2]
