import os
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import accounts, chat, metrics, retrieval
from weftline.sources import tables
from weftline.sources.settings import Settings
from weftline.sources.web import PageSource
from weftline.streaming import stateful

T0 = dt.datetime(2024, 1, 1)


def vectors(spark, n=60, d=8, seed=1):
    v = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")


def test_top_k_is_exact_and_clamped(spark):
    v, e = vectors(spark)
    q = v[7].tolist()
    d = ((v.astype(float) - np.array(q)) ** 2).sum(1)
    want = np.lexsort((np.arange(len(v)), d))[:5].tolist()
    assert [r["vec_id"] for r in retrieval.top_k(e, q).collect()] == want
    assert [r["vec_id"] for r in retrieval.top_k(e, q, 0).collect()] == want
    assert retrieval.top_k(e.limit(3), q, 5).count() == 3
    assert retrieval.top_k(e.limit(0), q).count() == 0


def test_top_k_batch_equals_single(spark):
    v, e = vectors(spark)
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {}
    for r in retrieval.top_k_batch(e, queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in (0, 20, 40):
        d = ((v.astype(float) - v[q].astype(float)) ** 2).sum(1)
        assert got[q] == np.lexsort((np.arange(len(v)), d))[:4].tolist()
    assert retrieval.top_k_batch(e, queries.limit(0)).count() == 0


def test_scores(spark):
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "d double").select(retrieval.score(F.col("d"))).collect()] == [1.0, 0.5, 0.25]


@pytest.mark.parametrize(("sizes", "kept"), [((700, 700, 200), 2), ((1000, 600, 100), 1), ((1000, 500), 2), ((1501,), 0)])
def test_packing_stops_at_the_first_overflow(spark, sizes, kept):
    head = len("[Source: t]\n")
    rows = [(1, i, "t", "x" * (n - head)) for i, n in enumerate(sizes)] + [(1, 99, "t", "  ")]
    p = retrieval.pack(spark.createDataFrame(rows, "g int, o int, title string, content string"), group="g", order=["o"], title="title", content="content", budget=1500)
    assert p.count() == kept


def test_embeddings(spark):
    d = spark.createDataFrame([("a b a",), (None,)], "x string")
    rows = retrieval.embed(d, "x").collect()
    assert all(len(r["embedding"]) == retrieval.DIMENSIONS and r["embed_error"] is None for r in rows)

    def fails(texts):
        raise ValueError("no model")

    assert {r["embed_error"] for r in retrieval.embed(d, "x", encode=fails).collect()} == {"no model"}


def msgs(spark, n):
    return spark.createDataFrame([(f"m{i:03}", "c", "user" if i % 2 == 0 else "assistant", f"t{i}", T0 + dt.timedelta(minutes=i)) for i in range(n)], "id string, conversation_id string, role string, content string, created_at timestamp_ntz")


def test_history(spark):
    assert [r["id"] for r in chat.last_turns(msgs(spark, 15), 10).orderBy("back").collect()] == [f"m{i:03}" for i in range(14, 4, -1)]
    assert chat.transcript(msgs(spark, 3)).first()["transcript"] == "Human: t0\nAssistant: t1\nHuman: t2"
    d = spark.createDataFrame([("user",), ("assistant",), ("system",)], "r string")
    assert [r[0] for r in d.select(chat.speaker_line(F.col("r"), F.lit("x"))).collect()] == ["Human: x", "Assistant: x", "Assistant: x"]


def test_generators(spark):
    p = spark.createDataFrame([(0, "s\nUser Question: how much is it\n\nAssistant:")], "i int, prompt string")
    r = chat.generate(p).first()
    assert (r["content"], r["tokens_used"], r["error"]) == ("how much is it", 4, None)

    def down(prompts, n, t):
        raise RuntimeError("down")

    assert chat.generate(p, generator=down).first()["error"] == "down"


def test_model_choice(spark):
    m = spark.createDataFrame([("a", 0, False), ("b", 1, True), ("c", 2, True)], "name string, rank int, available boolean")
    assert [chat.best_model(m, r).first()["name"] for r in (None, "c", "a", "zz")] == ["b", "c", "b", "b"]
    assert chat.best_model(m.filter("NOT available")).first()["name"] is None


def events(spark, kinds):
    return spark.createDataFrame([("u", T0 + dt.timedelta(minutes=i), i, k) for i, k in enumerate(kinds)], "k string, t timestamp_ntz, i long, e string")


@pytest.mark.parametrize(("kinds", "at"), [("FFFFSFFFFFS", 9), ("FFFF", None), ("FFFFFSFFFFF", 4), ("SSS", None)])
def test_lockout_batch_and_stream(spark, tmp_path, kinds, at):
    e = events(spark, kinds)
    want = [T0 + dt.timedelta(minutes=at)] if at is not None else []
    got = accounts.lockouts(e, key="k", ts="t", tie="i", failed=F.col("e") == "F", succeeded=F.col("e") == "S").collect()
    assert [r["locked_at"] for r in got] == want
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")).select("k", F.col("t").cast("timestamp").alias("t"), "i", (F.col("e") == "F").alias("failed"))
    out = stateful.run_once(stateful.stream_lockouts(s), str(tmp_path / "run"), "append")
    assert [r["locked_at"] for r in out.collect()] == want


def test_sessions(spark):
    d = spark.createDataFrame([(T0,), (None,)], "t timestamp_ntz")
    end = T0 + dt.timedelta(hours=24)
    valid = lambda at: [r["valid"] for r in accounts.sessions_valid(d, ts="t", as_of=F.lit(at).cast("timestamp_ntz")).collect()]
    assert valid(end) == [True, False]
    assert valid(end + dt.timedelta(microseconds=1)) == [False, False]


def test_names_and_sources(spark):
    w, h = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in (["Ann", "bob", "Cy"], ["BOB", None]))
    assert sorted(r[0] for r in accounts.free_names(w, h, "name").collect()) == ["Ann", "Cy"]
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert sorted(map(tuple, accounts.first_source([a, b], "k", "v").collect())) == [(1, "x", 0), (2, "z", 1)]


def test_insert_if_absent(spark, tmp_path):
    path, ddl = str(tmp_path / "t"), "id string, v string"
    first = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "n")], ddl)
    assert tables.insert_if_absent(first, path, ddl) == 2
    assert tables.insert_if_absent(first, path, ddl) == 0
    assert tables.insert_if_absent(spark.createDataFrame([("2", "x"), ("3", "c"), ("3", "d")], ddl), path, ddl) == 1
    assert dict(map(tuple, spark.read.parquet(path).collect()))["2"] == "b"


def test_cascade(spark, tmp_path):
    root = str(tmp_path)
    rows = {
        "users": [("u1",), ("u2",)], "conversations": [("c1", "u1"), ("c2", "u2"), ("c3", None)],
        "messages": [("m1", "c1", None), ("m2", "c2", "u2"), ("m3", None, "u1"), ("m4", "c3", None)],
    }
    for n, ddl in (("users", "id string"), ("conversations", "id string, user_id string"), ("messages", "id string, conversation_id string, user_id string")):
        spark.createDataFrame(rows[n], ddl).write.parquet(f"{root}/{n}")
    assert not tables.delete_user(spark, root, "zz")
    assert spark.read.parquet(f"{root}/messages").count() == 4
    assert tables.delete_user(spark, root, "u1")
    left = lambda n: sorted(r["id"] for r in spark.read.parquet(f"{root}/{n}").select("id").collect())
    assert (left("users"), left("conversations"), left("messages")) == (["u2"], ["c2", "c3"], ["m2", "m4"])


def test_update_and_rebuild(spark, tmp_path):
    t = spark.createDataFrame([("1", "a", T0, "s"), ("2", "b", T0, "s")], "id string, bio string, updated_at timestamp_ntz, hashed_password string")
    p = spark.createDataFrame([("1", "new", "hacked"), ("2", None, "x")], "id string, bio string, hashed_password string")
    now = T0 + dt.timedelta(days=1)
    got = {r["id"]: tuple(r)[1:] for r in tables.updated(t, p, at=F.lit(now).cast("timestamp_ntz")).collect()}
    assert got == {"1": ("new", now, "s"), "2": (None, now, "s")}
    path = str(tmp_path / "d")
    assert tables.rebuild(spark, t, t, path)
    assert not tables.rebuild(spark, t.limit(0), t.limit(0), path)
    assert spark.read.parquet(path).count() == 2
    assert tables.load_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_tables_are_created_once(spark):
    tables.create_tables(spark, ("audit_logs",))
    tables.create_tables(spark, ("audit_logs",))
    assert spark.table("audit_logs").count() == 0


def test_metrics(spark):
    ddl = "operation string, duration double, items double, threaded boolean, success boolean"
    m = spark.createDataFrame([("a", 2.0, 0.0, True, True), ("a", 4.0, 0.0, False, True), ("b", 1.0, 5.0, False, False)], ddl)
    rep = {r["operation"]: tuple(r)[1:] for r in metrics.report(m).collect()}
    assert rep == {"a": (2, 2, 3.0, True), "b": (1, 0, 0.0, False)}
    c = {r["operation"]: r for r in metrics.comparison(m).collect()}
    assert (c["a"]["time_improvement_percent"], c["a"]["throughput_improvement_percent"], c["a"]["speedup_factor"]) == (50.0, None, 2.0)
    assert c["b"]["speedup_factor"] is None
    assert [tuple(r) for r in metrics.recommendations(metrics.comparison(m)).collect()] == [("a", "excellent")]
    log = []
    with metrics.monitored(log, "x"):
        pass
    with pytest.raises(ValueError), metrics.monitored(log, "x"):
        raise ValueError("no")
    assert [r["success"] for r in log] == [True, False]


def test_settings():
    s = Settings.from_env({"CHUNK_SIZE": "9", "ENABLE_MFA": "FALSE", "TEMPERATURE": "0"})
    assert (s.chunk_size, s.enable_mfa, s.temperature, s.top_k_results) == (9, False, 0.0, 5)


def test_page_source(spark, tmp_path):
    (tmp_path / "a.html").write_text("<title>A</title>")
    spark.dataSource.register(PageSource)
    rows = spark.read.format("pages").option("urls", f"file://{tmp_path}/a.html\nfile://{tmp_path}/none.html").load().collect()
    got = {r["url"].rsplit("/", 1)[1]: r for r in rows}
    assert got["a.html"]["html"] == "<title>A</title>"
    assert got["none.html"]["html"] is None and got["none.html"]["error"]


def test_stream_history_keeps_the_last(spark, tmp_path):
    m = msgs(spark, 60).select(F.col("conversation_id").alias("c"), "id", "content", F.col("created_at").cast("timestamp").alias("t"))
    m.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))
    out = stateful.run_once(stateful.stream_history(s), str(tmp_path / "run"), "update").agg(F.max("kept")).first()[0]
    assert out == 50


def test_unreadable_tables_change_nothing(spark, tmp_path):
    root = str(tmp_path)
    for name, rows in (("users", [("u1",), ("u2",)]), ("messages", [("m1",)])):
        cols = tables.SCHEMAS[name]
        tables.append_rows(spark.createDataFrame(rows, "id string"), f"{root}/{name}", cols)
    os.makedirs(f"{root}/conversations")
    with open(f"{root}/conversations/part-0.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader raises
        tables.delete_user(spark, root, "u1")
    assert sorted(r["id"] for r in spark.read.parquet(f"{root}/users").collect()) == ["u1", "u2"] and os.path.exists(f"{root}/conversations/part-0.parquet")


def test_a_failed_move_is_undone(spark, tmp_path, monkeypatch):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for p in (a, b):
        spark.range(2).write.parquet(p)
    real, calls = tables._rename, []

    def rename(s, path, to):
        calls.append(path)
        if to == b and len(calls) == 4:
            raise OSError("full")
        real(s, path, to)

    monkeypatch.setattr(tables, "_rename", rename)
    with pytest.raises(OSError):
        tables.swap_in(spark, {a: spark.range(5), b: spark.range(6)})
    assert spark.read.parquet(a).count() == 2 and spark.read.parquet(b).count() == 2


def test_one_patch_counts_as_a_whole_and_clear_by_key(spark, tmp_path):
    ddl = "id string, bio string, phone string, is_active boolean, email string"
    t = spark.createDataFrame([("1", "a", "p", True, "e")], ddl)
    p = spark.createDataFrame([("1", "x", "1", False, "no"), ("1", "b", "2", True, "no")], ddl)
    assert tuple(tables.updated(t, p).first()) in (("1", "x", "1", False, "e"), ("1", "b", "2", True, "e"))
    path = str(tmp_path / "t")
    spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c")], "id string, bio string").write.parquet(path)
    tables.clear(spark, path, "id string, bio string", "id", "1")
    assert sorted(r["bio"] for r in spark.read.parquet(path).collect()) == ["b", "c"]


def test_a_bad_prompt_voids_only_itself(spark):
    p = spark.range(20).selectExpr("id", "concat('User Question: ', IF(id = 7, 'bad', 'good')) AS prompt").coalesce(1)

    def picky(prompts, n, t):
        if any("bad" in x for x in prompts):
            raise RuntimeError("no")
        return [{"content": "yes", "tokens_used": 1, "error": None} for _ in prompts]

    got = {r["id"]: (r["content"], r["error"]) for r in chat.generate(p, generator=picky).collect()}
    assert got[7] == (None, "no") and all(got[k] == ("yes", None) for k in range(20) if k != 7)


def test_index_by_batches_tells_its_progress(spark, tmp_path):
    rows = spark.range(25).selectExpr("id AS vector_id", "concat('word', id) AS chunk_text")
    told = []

    def encode(texts):
        if "word12" in texts:
            raise RuntimeError("down")
        return [[1.0]] * len(texts)

    n = retrieval.index_batches(rows, str(tmp_path / "i"), batch=10, encode=encode, progress=lambda done, all_: told.append((done, all_)))
    assert n == 3 and told == [(1, 3), (2, 3), (3, 3)] and spark.read.parquet(str(tmp_path / "i")).count() < 25


@pytest.mark.parametrize(("base", "path", "want"), [("https://a.b/x/y", "z", "https://a.b/x/z"), ("https://a.b", "z", "https://a.b/z"), ("https://a.b/x/", "/q", "https://a.b/q"), ("https://a.b/x", "//c.d/e", "https://c.d/e"), ("https://a.b/x", "http://e", "http://e"), ("https://a.b/x?u=/1/", "", "https://a.b/x?u=/1/")])
def test_resolved_addresses(spark, base, path, want):
    from weftline.functions import text

    assert spark.range(1).select(text.resolved(F.lit(base), F.lit(path))).first()[0] == want


def test_grid_of_queries_and_vectors(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    m = rng.integers(0, 4, (90, 3)).astype(float)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(900, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m[:30])], "query_id long, query array<double>")
    want = {(i, int(k), r + 1) for i in range(30) for r, k in enumerate(np.lexsort((np.arange(90), ((m - m[i]) ** 2).sum(1)))[:4])}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 20)
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in retrieval.top_k_batch(v, q, 4).collect()} == want
    assert retrieval.top_k_batch(v.limit(0), q).count() == retrieval.top_k_batch(v, q.limit(0)).count() == 0


def test_a_cluster_must_name_its_folder():
    from types import SimpleNamespace as N

    from weftline.sources import staging

    cluster = N(conf=N(get=lambda k, d=None: d), sparkContext=N(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        staging.shared_dir(cluster)
