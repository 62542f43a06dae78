from pyspark.sql import functions as F

from weftline.operators import prompts, providers, retrieval, sinks
from weftline.sources import captions
from weftline.sources.tables import latest


def test_excerpts_in_order_of_time(spark):
    rows = [(1, 60.0, 70.0, "third"), (1, 0.0, 9.5, "first"), (1, 30.0, 41.0, None), (2, 1.0, 2.0, "x")]
    df = spark.createDataFrame(rows, "k int, a double, e double, prompt string")
    got = {r.k: r.prompt for r in prompts.excerpt_prompt(df, ["k"], "a", "e", "prompt", F.when(F.col("k") == 1, "T"), F.lit("why?")).collect()}
    assert got[1] == "## Video: T\n\n## Transcript Excerpts\n\n[0s–10s] first\n[30s–41s] \n[60s–70s] third\n\n## Question\nwhy?"
    assert got[2].startswith("## Transcript Excerpts\n\n[1s–2s] x")
    assert prompts.excerpt_prompt(df.limit(0), ["k"], "a", "e", "prompt", F.lit(None).cast("string"), F.lit("q")).count() == 0


def test_costs(spark):
    r = spark.createDataFrame([(5000, 500), (None, None)], "n bigint, m bigint").select(prompts.cost(F.col("n"), F.col("m"), 3.0, 15.0, 150.0).alias("c")).collect()
    assert [(x.c.usd, x.c.local) for x in r] == [(0.0225, 3.38), (0.0, 0.0)]


def test_types_as_first_met(spark):
    df = spark.createDataFrame([(1, "risk", 3), (1, "claim", 1), (1, "risk", 2), (2, "metric", 1)], "q int, t string, r int")
    got = {r.q: (r.n_objects, r.types) for r in prompts.types_in_order(df, "q", "t", ["r"]).collect()}
    assert got == {1: (3, ["claim", "risk"]), 2: (1, ["metric"])}


def test_stored_versions(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert sinks.read(spark, folder) is None
    a = spark.createDataFrame([("1", "old", 1.0), ("2", "old", 1.0), (None, "x", 1.0)], "id string, v string, s double")
    sinks.upsert(a, folder)
    sinks.upsert(spark.createDataFrame([("2", "new", 2.0), ("3", "a", 2.0), ("3", "b", 2.0)], "id string, v string, s double"), folder)
    sinks.upsert(a.limit(0), folder)
    assert sorted((r.id, r.v) for r in sinks.read(spark, folder).collect()) == [("1", "old"), ("2", "new"), ("3", "b")]
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("v-")]) == 1
    o = spark.createDataFrame([("a", "risk", "x", 0.5, "v-1", 1.0), ("b", None, "x", 0.5, "v", 1.0)], "id string, ktype string, content string, confidence double, video_id string, ts_sec double")
    r = sinks.vectors(o, providers.with_embeddings).collect()
    assert [(x.id, x.embedded_text, x.collection) for x in r] == [("a", "risk: x", "ko_v_1")]
    assert sinks.json_rows(o, "id").filter("id = 'b'").first()["response"] == '{"id":"b","ktype":null,"content":"x","confidence":0.5,"video_id":"v","ts_sec":1.0}'


def test_sources_of_captions(spark):
    t = spark.createDataFrame([("v", 1, "en", False, 3), ("v", 0, "ja", False, 0), ("v", 1, "ja-x", True, 2), ("v", 1, "ja", False, 2), ("w", 0, None, None, 1), ("z", 0, "en", False, 0)], "v string, s int, l string, a boolean, n int")
    got = {r.v: (r.s, r.l, r.a) for r in captions.first_track(t, "v", "s", "l", "a", "n").collect()}
    assert got == {"v": (1, "ja", False), "w": (0, "", False)}
    m = spark.createDataFrame([("text", None), ("", "HTTP 429"), (None, "no track"), (None, None)], "t string, m string")
    assert [r.o for r in m.select(captions.fetch_outcome(F.col("t"), F.col("m")).alias("o")).collect()] == ["found", "blocked", "missing", "missing"]
    d = captions.titled(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "A"), ("a", None)], "id string, title string"), "id")
    assert {r.id: r.title for r in d.collect()} == {"a": "A", "b": ""}


def test_searches_fill_up_with_unmatched_documents(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["x", "pump", "y", "pump z", "w"])], "id int, t string")
    asked = spark.createDataFrame([(1, "pump"), (2, "nothing")], "qid int, q string")
    best = retrieval.with_unmatched(retrieval.bm25_best(docs, "id", "t", asked, "qid", "q", 4), docs, "id", asked, "qid", 4)
    got = sorted((r.qid, r["rank"], r.id, r.score > 0) for r in best.collect())
    assert got == [(1, 1, 1, True), (1, 2, 3, True), (1, 3, 0, False), (1, 4, 2, False), (2, 1, 0, False), (2, 2, 1, False), (2, 3, 2, False), (2, 4, 3, False)]


def test_only_asked_columns_are_read(spark, tmp_path):
    spark.createDataFrame([(1, "a", "x", 1), (1, "b", "y", 2)], "k int, v string, w string, at int").write.parquet(str(tmp_path / "t"))
    df = latest(spark.read.parquet(str(tmp_path / "t")), ["k"], ["at"], ("v",))
    assert [tuple(r) for r in df.collect()] == [(1, "b")]
    assert "w:string" not in df._jdf.queryExecution().toString().split("ReadSchema")[1]
