"""Composed queries: pages to an index, questions to stored answers, and the smaller operators around them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import text as X
from weftline.operators import accounts, chat, chunks, metrics, retrieval
from weftline.plans import sqltext as S
from weftline.plans.catalog import AS_OF, SYSTEM, _query, _runs, _RUNS, _t
from weftline.sources import tables, web
from weftline.sources.staging import materialize, new_path

# Pages with tables, cards and several content places, put together around suppliers and nations


def _nation_pages(spark, sf) -> DataFrame:
    """(nation, html): one page a nation; twenty-five, whatever the size, with the first twenty suppliers each."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = _t(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name").withColumn("_n", F.row_number().over(w)).filter("_n <= 20")
    lists = s.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("l"))
    each = lambda left, middle, right: F.array_join(F.transform("l", lambda x: F.concat(F.lit(left), x["s_suppkey"].cast("string"), F.lit(middle), x["s_name"], F.lit(right))), "")
    page = F.concat(
        F.lit("<html><head><title>"), "n_name", F.lit("</title></head><body><article><p>About "), "n_name", F.lit("</p></article><div class=\"content\">short</div><main>"),
        F.array_join(F.transform("l", lambda x: F.concat(F.lit("<p>"), x["s_name"], F.lit("</p>"))), ""), F.lit("</main><table><tr><th>key</th><th>name</th></tr>"),
        each("<tr><td>", "</td><td>", "</td></tr>"), F.lit("</table>"), each("<div class=\"staff-card\"><i>", "</i> <b>", "</b></div>"), F.lit("</body></html>"))
    nations = _t(spark, sf, "nation").select("n_nationkey", "n_name")
    return nations.join(lists, nations["n_nationkey"] == lists["s_nationkey"]).select(F.col("n_name").alias("nation"), page.alias("html"))


_NATIONS = """(SELECT n_name AS nation, list(s_suppkey::VARCHAR ORDER BY s_suppkey) AS k, list(s_name ORDER BY s_suppkey) AS s, list(s_suppkey::VARCHAR || ' | ' || s_name ORDER BY s_suppkey) AS r, list(s_suppkey::VARCHAR || ' ' || s_name ORDER BY s_suppkey) AS c,
list(s_suppkey::VARCHAR || chr(10) || s_name ORDER BY s_suppkey) AS p FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) JOIN nation ON s_nationkey = n_nationkey WHERE n <= 20 GROUP BY n_name)"""
_PLACE_TEXT = """CASE WHEN length(array_to_string(s, chr(10))) > 100 THEN array_to_string(s, chr(10)) ELSE concat('About ', nation, chr(10), 'short', chr(10), array_to_string(s, chr(10)), chr(10), 'key', chr(10), 'name', chr(10), array_to_string(p, chr(10)), chr(10), array_to_string(p, chr(10))) END"""


@_query("page_places", f"""SELECT nation, sha256(concat({_PLACE_TEXT}, chr(10), chr(10), 'TABLE: key | name', chr(10), array_to_string(r, chr(10)))) AS content, CASE WHEN length(array_to_string(s, chr(10))) > 100 THEN 'main' ELSE 'body' END AS method,
concat('About ', nation) AS first_place, sha256(array_to_string(list_filter(c, lambda x: length(x) > 10), chr(10))) AS items, CAST(len(c) AS BIGINT) AS n FROM {_NATIONS}""")
def page_places(spark, sf):
    p = _nation_pages(spark, sf).select("nation", H.page_parts(F.col("html")).alias("p"))
    return p.select("nation", F.sha2(H.page_content(F.col("p")), 256).alias("content"), "p.method", F.col("p.first").alias("first_place"), F.sha2(F.array_join("p.items", "\n"), 256).alias("items"), F.size("p.items").cast("bigint").alias("n"))


@_query("pages_fetched", f"SELECT nation AS title, CAST(len(s) AS BIGINT) AS names, 200 AS status FROM {_NATIONS}")
def pages_fetched(spark, sf):
    """Pages written as files are fetched by address; one that isn't there is a row with an error, and left out."""
    path = new_path(spark, "pages")
    _nation_pages(spark, sf).select("nation", "html").repartition("nation").write.partitionBy("nation").text(path)
    urls = spark.read.text(path).inputFiles()
    spark.dataSource.register(web.PageSource)
    got = web.fetched(spark.read.format("pages").option("urls", "\n".join([*urls, urls[0] + ".missing"])).load())
    return got.select(H.title(F.col("html")).alias("title"), F.regexp_count("html", F.lit("staff-card")).cast("bigint").alias("names"), "status")


@_query("url_resolved", r"""SELECT DISTINCT id, CASE WHEN url IS NOT NULL THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)', 1) || '/courses/' END AS absolute,
CASE WHEN url IS NOT NULL THEN CASE WHEN ends_with(f, '/') THEN f ELSE f || '/' END || 'more?x=1' END AS relative FROM (SELECT id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+(?:/(?:[^/?#]*/)*)?)', 1) AS f FROM university_data)""")
def url_resolved(spark, sf):
    u = _t(spark, sf, "university_data").select("id", "url").distinct()
    return u.select("id", X.resolved(F.col("url"), F.lit("/courses/")).alias("absolute"), X.resolved(F.col("url"), F.lit("more?x=1")).alias("relative"))


_TYPES = ", ".join(f"('{p}', '{k}')" for p, k in (*web.SECTIONS, *web.SPECIAL))


@_query("url_types", rf"""WITH t AS (SELECT * FROM (VALUES {_TYPES}) t(path, kind)), u AS (SELECT DISTINCT id, regexp_extract(url, '^[A-Za-z]+://[^/?#]+/([^/?#]+)/', 1) AS first, regexp_extract(url, '/([^/?#]+)/?(?:[?#].*)?$', 1) AS last FROM university_data WHERE url IS NOT NULL)
SELECT coalesce(a.kind, b.kind, 'general') AS kind, count(*) AS pages FROM u LEFT JOIN t a ON a.path = '/' || u.first || '/' LEFT JOIN t b ON b.path = u.last GROUP BY 1""")
def url_types(spark, sf):
    u = _t(spark, sf, "university_data").select("id", "url").filter("url IS NOT NULL").distinct()
    u = u.select(F.concat(F.lit("/"), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+/([^/?#]+)/", 1), F.lit("/")).alias("first"), F.regexp_extract("url", r"/([^/?#]+)/?(?:[?#].*)?$", 1).alias("last"))
    t = web.section_types(spark)
    by = lambda c: F.broadcast(t.select(F.col("path").alias(c), F.col("kind").alias(f"{c}_kind")))
    return u.join(by("first"), "first", "left").join(by("last"), "last", "left").groupBy(F.coalesce("first_kind", "last_kind", F.lit("general")).alias("kind")).agg(F.count("*").alias("pages"))


_CLEAN = S.clean("text")
_WITH_TITLE = S.clean("concat(coalesce(title, ''), ' ', coalesce(text, ''))")


@_query("doc_gate_fallback", f"SELECT * FROM (SELECT doc_id, CAST(length(CASE WHEN length({_CLEAN}) >= 100 THEN {_CLEAN} ELSE {_WITH_TITLE} END) AS BIGINT) AS n FROM documents) WHERE n >= 50")
def doc_gate_fallback(spark, sf):
    d = _t(spark, sf, "documents")
    fuller = X.clean(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    return d.select("doc_id", X.first_long([X.clean(F.col("text")), fuller], 100, 50).alias("c")).filter("c IS NOT NULL").select("doc_id", F.length("c").cast("bigint").alias("n"))


@_query("page_metadata_json", """SELECT DISTINCT id, CAST(to_json({'scraping_method': 'requests', 'page_length': length(coalesce(content, '')), 'tables_found': 0, 'source_path': coalesce(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '')}) AS VARCHAR) AS metadata FROM university_data""")
def page_metadata_json(spark, sf):
    d = _t(spark, sf, "university_data").select("id", "url", "content").distinct()
    path = F.coalesce(F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), F.lit(""))
    facts = F.struct(F.lit("requests").alias("scraping_method"), F.length(F.coalesce("content", F.lit(""))).alias("page_length"), F.lit(0).alias("tables_found"), path.alias("source_path"))
    return d.select("id", F.to_json(facts).alias("metadata")).distinct()


# From documents to an index


def _chunks_sql(text: str, where: str = "TRUE") -> str:
    return f"""(SELECT doc_id, i AS chunk_index, substr(text, CAST(i * 462 + 1 AS BIGINT), 512) AS chunk_text FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil((length(text) - 50) / 462.0) AS BIGINT)))) AS i FROM (SELECT doc_id, {text} AS text FROM documents) WHERE text IS NOT NULL AND text <> '' AND {where})
WHERE length({S.strip("substr(text, CAST(i * 462 + 1 AS BIGINT), 512)")}) >= 50)"""


@_query("chunk_records", f"""SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS BIGINT) AS vector_id, coalesce(nullif(source, ''), 'Unknown') AS source, coalesce(nullif(title, ''), 'Untitled') AS title,
coalesce(nullif(content_type, ''), 'general') AS content_type, coalesce(strftime(scraped_at, '%Y-%m-%dT%H:%M:%S'), '') AS scraped_at FROM {_chunks_sql("text")} JOIN documents USING (doc_id)""")
def chunk_records(spark, sf):
    return chunks.chunk_records(_t(spark, sf, "documents")).orderBy("doc_id", "chunk_index").select("doc_id", "chunk_index", "vector_id", "source", "title", "content_type", "scraped_at")


@_query("knowledge_refresh", f"SELECT doc_id, count(*) AS chunks, min(v) AS first_vector, max(v) AS last_vector, 384 AS width FROM (SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS BIGINT) AS v FROM {_chunks_sql(_CLEAN, 'length(text) >= 100')}) GROUP BY doc_id")
def knowledge_refresh(spark, sf):
    """Documents cleaned, gated, cut, numbered, embedded and stored in an index that replaces the old one."""
    d = _t(spark, sf, "documents").withColumn("text", X.clean(F.col("text"))).filter(F.length("text") >= 100)
    records = materialize(chunks.chunk_records(d), "chunk-records")
    if records.isEmpty():
        return records.select("doc_id", F.lit(0).cast("bigint").alias("chunks"), F.col("vector_id").alias("first_vector"), F.col("vector_id").alias("last_vector"), F.lit(384).alias("width"))
    path = new_path(spark, "index")
    retrieval.index_batches(records, path)
    index = spark.read.parquet(path)
    return index.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min("vector_id").alias("first_vector"), F.max("vector_id").alias("last_vector"), F.max(F.size("embedding")).alias("width"))


_WORDS = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{S.SPACE}+'), lambda w: w <> '')"


@_query("embed_hashed", f"""WITH w AS (SELECT doc_id, md5_number_upper(unnest({_WORDS})) AS h FROM documents), v AS (SELECT doc_id, CAST(h % 384 AS BIGINT) AS dim, sum(CASE WHEN (h // 384) % 2 = 1 THEN 1 ELSE -1 END) AS x FROM w GROUP BY ALL)
SELECT d.doc_id, 384 AS width, CAST(coalesce(sum(CASE WHEN x > 0 THEN dim END), 0) AS BIGINT) AS positive, CAST(coalesce(sum(CASE WHEN x < 0 THEN dim END), 0) AS BIGINT) AS negative, coalesce(bool_or(x <> 0), false) AS unit FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id""")
def embed_hashed(spark, sf):
    e = retrieval.embed(_t(spark, sf, "documents").select("doc_id", "text"), "text").filter("embed_error IS NULL")
    dims = lambda keep: F.aggregate(F.transform("embedding", lambda x, i: F.when(keep(x), i.cast("bigint")).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a + b)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return e.select("doc_id", F.size("embedding").alias("width"), dims(lambda x: x > 0).alias("positive"), dims(lambda x: x < 0).alias("negative"), (F.abs(norm - 1) < 1e-4).alias("unit"))


@_query("separator_invariants", f"SELECT doc_id, true AS inside, true AS bounded FROM documents WHERE length({S.strip('text')}) >= 50 AND length({S.strip('text')}) <= 512")
def separator_invariants(spark, sf):
    """Of texts that fit one chunk: the chunk is the text's own, and no longer than allowed."""
    d = _t(spark, sf, "documents").filter(F.length(X.strip(F.col("text"))).between(50, 512))
    c = chunks.chunk_by_separator(d, "doc_id", "text").join(d.select("doc_id", "text"), "doc_id")
    return c.groupBy("doc_id").agg(F.bool_and(F.contains("text", F.col("chunk_text"))).alias("inside"), F.max(F.length("chunk_text") <= 512).alias("bounded"))


# From questions to stored answers

_DIST = S.distance("e.embedding", "q.embedding")
_RAG = f"""WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
hit AS (SELECT * FROM (SELECT q.query_id, e.vec_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {_DIST}, e.vec_id) AS rank FROM embeddings e, q) WHERE rank <= 5),
c AS (SELECT query_id, rank, source, coalesce(nullif(title, ''), 'Unknown') AS title, {S.strip(f"substr({_CLEAN}, 1, 512)")} AS content FROM hit JOIN documents ON doc_id = vec_id),
p AS (SELECT query_id, rank, concat('[Source: ', title, ']', chr(10), content) AS piece FROM c WHERE content <> ''),
u AS (SELECT *, sum(length(piece)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM p),
x AS (SELECT query_id, string_agg(piece, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank) AS context FROM u WHERE used <= 1500 GROUP BY query_id),
s AS (SELECT query_id, string_agg(coalesce(source, ''), '|' ORDER BY rank) AS sources FROM c WHERE rank <= 3 GROUP BY query_id),
a AS (SELECT q.query_id, coalesce(nullif({S.strip("coalesce(d.title, '')")}, ''), 'What is new?') AS question, coalesce(s.sources, '') AS sources, x.context FROM q LEFT JOIN documents d ON d.doc_id = q.query_id LEFT JOIN x USING (query_id) LEFT JOIN s USING (query_id)),
w AS (SELECT *, concat_ws(chr(10), '{SYSTEM}', CASE WHEN context IS NOT NULL THEN concat(chr(10), chr(10), 'Relevant Information:', chr(10), '{retrieval.CONTEXT_HEAD}', chr(10), chr(10), context, chr(10), chr(10), '{retrieval.CONTEXT_TAIL.replace(chr(39), chr(39) * 2)}') END,
concat(chr(10), chr(10), 'User Question: ', question), concat(chr(10), chr(10), 'Assistant:')) AS prompt FROM a)
"""


def _asked(spark, sf) -> DataFrame:
    """(query_id, question, sources, prompt): the nearest documents packed into each question's prompt."""
    e, d = _t(spark, sf, "embeddings"), _t(spark, sf, "documents")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    hits = retrieval.top_k_batch(e, q)
    # A hit without a document is passed over.
    found = materialize(hits.join(d.select(F.col("doc_id").alias("vec_id"), "source", "title", F.substring(X.clean(F.col("text")), 1, 512).alias("content")), "vec_id"), "rag-hits")
    packed = retrieval.pack(found, group="query_id", order=["rank"], title="title", content="content", budget=1500)
    context = retrieval.context_text(packed, "query_id", "rank")
    by_rank = F.sort_array(F.collect_list(F.struct("rank", F.coalesce("source", F.lit("")).alias("s"))))
    sources = found.filter("rank <= 3").groupBy("query_id").agg(F.array_join(F.transform(by_rank, lambda x: x["s"]), "|").alias("sources"))
    title = F.nullif(X.strip(F.coalesce("title", F.lit(""))), F.lit(""))
    asked = q.select("query_id").join(d.select(F.col("doc_id").alias("query_id"), title.alias("question")), "query_id", "left").join(context, "query_id", "left").join(sources, "query_id", "left")
    asked = asked.withColumn("question", F.coalesce("question", F.lit("What is new?")))
    prompt = chat.rag_prompt(F.col("question"), retrieval.wrapped_context(F.col("context")), F.lit(None).cast("string"), SYSTEM)
    return asked.select("query_id", "question", F.coalesce("sources", F.lit("")).alias("sources"), prompt.alias("prompt"))


@_query("rag_prompts", _RAG + "SELECT query_id, question, sources, sha256(prompt) AS prompt FROM w")
def rag_prompts(spark, sf):
    return _asked(spark, sf).withColumn("prompt", F.sha2("prompt", 256))


_ECHO = f"array_to_string(list_filter(regexp_split_to_array(question, '{S.SPACE}+'), lambda w: w <> '')[1:500], ' ')"


@_query("rag_answers", _RAG + f"""SELECT sha256(concat_ws('|', 'c' || query_id, role, said, '{AS_OF}')) AS id, 'c' || query_id AS conversation_id, role, model_used, sha256(said) AS said FROM (
SELECT query_id, 'user' AS role, NULL AS model_used, question AS said FROM w UNION ALL SELECT query_id, 'assistant', 'echo', {_ECHO} FROM w)""")
def rag_answers(spark, sf):
    """The whole way: retrieval, packing, prompt, generation, and the two message rows of each question."""
    g = chat.generate(_asked(spark, sf).withColumn("conversation_id", F.concat(F.lit("c"), F.col("query_id").cast("string"))).withColumn("user_id", F.lit(None).cast("string")))
    return chat.message_rows(g, F.to_timestamp_ntz(F.lit(AS_OF))).select("id", "conversation_id", "role", "model_used", F.sha2("content", 256).alias("said"))


@_query("model_requests", """WITH m AS (SELECT model_used AS name, row_number() OVER (ORDER BY count(*) DESC, model_used) AS rank, count(*) % 2 = 0 AS available FROM messages WHERE model_used IS NOT NULL GROUP BY model_used)
SELECT requested, name, count(*) AS n FROM (SELECT g.model_used AS requested, coalesce(o.name, (SELECT arg_min(name, rank) FROM m WHERE available)) AS name FROM messages g LEFT JOIN m o ON o.name = g.model_used AND o.available) GROUP BY 1, 2""")
def model_requests(spark, sf):
    m = _t(spark, sf, "messages")
    used = m.filter("model_used IS NOT NULL").groupBy(F.col("model_used").alias("name")).agg(F.count("*").alias("n"))
    # A registry of a few models.
    models = used.select("name", F.row_number().over(Window.orderBy(F.col("n").desc(), "name")).alias("rank"), (F.col("n") % 2 == 0).alias("available"))
    return chat.best_models(m.select(F.col("id").alias("request_id"), F.col("model_used").alias("requested")), models).groupBy("requested", "name").agg(F.count("*").alias("n"))


@_query("model_statistics_json", """SELECT count(*) AS total_models, CAST(to_json(map_from_entries(list({'k': name, 'v': {'answers': n, 'tokens': t}} ORDER BY name))) AS VARCHAR) AS detail FROM (SELECT model_used AS name, count(*) AS n, CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS t FROM messages WHERE model_used IS NOT NULL GROUP BY 1)""")
def model_statistics_json(spark, sf):
    g = _t(spark, sf, "messages").filter("model_used IS NOT NULL").groupBy("model_used").agg(F.count("*").alias("answers"), F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("bigint").alias("tokens"))
    entries = F.sort_array(F.collect_list(F.struct("model_used", F.struct("answers", "tokens").alias("facts"))))
    return g.agg(F.count("*").alias("total_models"), F.to_json(F.map_from_entries(entries)).alias("detail"))


@_query("system_status", f"""SELECT TIMESTAMP '{AS_OF}' AS timestamp, (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT model_used AS m FROM messages WHERE model_used IS NOT NULL)) AS models, (SELECT count(*) FROM embeddings) AS total_vectors, true AS connected, 512 AS chunk_size, 2048 AS max_tokens, 0.7::DOUBLE AS temperature, 5 AS top_k_results""")
def system_status(spark, sf):
    from weftline.sources.settings import Settings

    s = Settings()
    models = _t(spark, sf, "messages").filter("model_used IS NOT NULL").select("model_used").distinct().agg(F.array_join(F.sort_array(F.collect_list("model_used")), ",").alias("models"))
    vectors = _t(spark, sf, "embeddings").agg(F.count("*").alias("total_vectors"))
    return models.crossJoin(vectors).select(
        F.to_timestamp_ntz(F.lit(AS_OF)).alias("timestamp"), "models", "total_vectors", F.lit(True).alias("connected"), F.lit(s.chunk_size).alias("chunk_size"), F.lit(s.max_tokens).alias("max_tokens"), F.lit(s.temperature).alias("temperature"), F.lit(s.top_k_results).alias("top_k_results"))


@_query("chat_latency", """SELECT id, round((epoch_us(created_at) - epoch_us(b)) / 1e6, 6) AS seconds FROM (SELECT *, lag(created_at) OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS b FROM (SELECT DISTINCT id, conversation_id, role, created_at FROM messages WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL))
WHERE b IS NOT NULL AND lower(trim(role)) = 'assistant'""")
def chat_latency(spark, sf):
    m = _t(spark, sf, "messages").filter("conversation_id IS NOT NULL AND created_at IS NOT NULL").select("id", "conversation_id", "role", "created_at").distinct()
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    before = F.lag("created_at").over(Window.partitionBy("conversation_id").orderBy("created_at", "id"))
    return m.withColumn("b", before).filter(F.col("b").isNotNull() & (F.lower(F.trim("role")) == "assistant")).select("id", F.round((micros(F.col("created_at")) - micros(F.col("b"))) / 1e6, 6).alias("seconds"))


# Accounts, appends, metrics


@_query("session_sweep", f"""SELECT s.event_id, s.user_id, s.ts + INTERVAL 24 HOUR AS expires_at, min(e.ts) IS NULL OR min(e.ts) > TIMESTAMP '{AS_OF}' AS is_active, TIMESTAMP '{AS_OF}' > s.ts + INTERVAL 24 HOUR AS swept
FROM (SELECT * FROM events WHERE event_type = 'signup') s LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') e ON e.user_id = s.user_id AND e.ts > s.ts GROUP BY s.event_id, s.user_id, s.ts""")
def session_sweep(spark, sf):
    e = _t(spark, sf, "events")
    return accounts.sessions(e.filter("event_type = 'signup'"), e.filter("event_type = 'purchase'"), key="event_id", owner="user_id", ts="ts", as_of=F.to_timestamp_ntz(F.lit(AS_OF)))


@_query("reset_tokens", f"SELECT event_id, event_type = 'signup' AND ts <= TIMESTAMP '{AS_OF}' AND TIMESTAMP '{AS_OF}' <= ts + INTERVAL 600 MINUTE AS valid FROM events")
def reset_tokens(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "password_reset").otherwise("access")
    return _t(spark, sf, "events").select("event_id", accounts.token_valid(F.col("ts"), kind, F.to_timestamp_ntz(F.lit(AS_OF)), 600).alias("valid"))


@_query("audit_append", "SELECT event_type AS action, 2 * count(*) AS n, count(DISTINCT event_id) AS ids FROM events WHERE event_type = 'error' GROUP BY 1")
def audit_append(spark, sf):
    path = new_path(spark, "audit")
    rows = _t(spark, sf, "events").filter("event_type = 'error'").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("action"), F.col("ts").alias("timestamp"), F.lit(1).alias("other"))
    for _ in range(2):
        tables.append_rows(rows, path, tables.SCHEMAS["audit_logs"])
    return tables.load_or_empty(spark, path, tables.SCHEMAS["audit_logs"]).groupBy("action").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@_query("perf_history", f"SELECT 'one' AS asked, operation, count(*) AS runs FROM {_RUNS} WHERE operation = 'click' GROUP BY 2 UNION ALL SELECT 'all', operation, count(*) FROM {_RUNS} GROUP BY 2")
def perf_history(spark, sf):
    ask = lambda name, op: metrics.report(_runs(spark, sf), op).select(F.lit(name).alias("asked"), "operation", F.col("total_runs").alias("runs"))
    return ask("one", "click").unionByName(ask("all", None))


@_query("workload_estimates", """SELECT k AS workers, round(k * 0.7::DOUBLE, 4) AS estimated, CASE WHEN k >= 4 THEN 'sufficient' ELSE 'limited' END AS cores, round(avg(value) / 1024 / 1024, 9) AS megabytes FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events) WHERE k IS NOT NULL GROUP BY k""")
def workload_estimates(spark, sf):
    e = _t(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("workers"), "value").filter("workers IS NOT NULL").groupBy("workers").agg(F.avg("value").alias("v"))
    return e.select("workers", F.round(metrics.estimated_speedup(F.col("workers")), 4).alias("estimated"), metrics.cores_advice(F.col("workers")).alias("cores"), F.round(metrics.megabytes(F.col("v")), 9).alias("megabytes"))


@_query("system_info")
def system_info(spark, sf):
    """The driver's machine: not comparable."""
    return metrics.system_info(spark)


# Formats, maps, JSON


@_query("number_formats", """SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS grouped, printf('%.1f%%', round(o_totalprice / 1000, 1)) AS share, printf('%+.1f%%', round(o_totalprice / 1000, 1)) AS signed, trim('/' || o_orderstatus || '/x/', '/') AS path FROM orders""")
def number_formats(spark, sf):
    share = F.round(F.col("o_totalprice") / 1000, 1)
    return _t(spark, sf, "orders").select(
        "o_orderkey", X.grouped(F.floor("o_totalprice")).alias("grouped"), X.percent_text(share).alias("share"), X.percent_text(share, signed=True).alias("signed"),
        X.stripped_of(F.concat(F.lit("/"), "o_orderstatus", F.lit("/x/")), "/").alias("path"))


@_query("map_lookup", """WITH m AS (SELECT content_type AS k, count(*) AS n FROM university_data WHERE content_type IS NOT NULL GROUP BY 1)
SELECT d.content_type, count(*) AS documents, coalesce(max(m.n), CASE WHEN d.content_type = 'notice' THEN 7 END, 0) AS pages, max(m.n) IS NOT NULL OR coalesce(d.content_type = 'notice', false) AS known FROM documents d LEFT JOIN m ON m.k = d.content_type GROUP BY d.content_type""")
def map_lookup(spark, sf):
    """Counts by type as a map of one row: put with a default for one key, get with a default, contains."""
    types = _t(spark, sf, "university_data").filter("content_type IS NOT NULL").groupBy("content_type").agg(F.count("*").alias("n"))
    m = types.agg(F.map_from_entries(F.collect_list(F.struct("content_type", "n"))).alias("m"))
    put = m.select(F.when(F.map_contains_key("m", F.lit("notice")), F.col("m")).otherwise(F.map_concat("m", F.create_map(F.lit("notice"), F.lit(7).cast("bigint")))).alias("m"))
    d = _t(spark, sf, "documents").groupBy("content_type").agg(F.count("*").alias("documents")).crossJoin(F.broadcast(put))
    get = F.try_element_at("m", F.col("content_type"))
    return d.select("content_type", "documents", F.coalesce(get, F.lit(0)).alias("pages"), get.isNotNull().alias("known"))


@_query("nested_catalogue", r"""SELECT coalesce(section, 'none') AS section, count(*) AS pairs, count(DISTINCT pair_id) AS ids, CAST(sum(length(coalesce(question, ''))) AS BIGINT) AS chars FROM (SELECT DISTINCT pair_id, section, question, answer, updated_at FROM fees_data) GROUP BY 1""")
def nested_catalogue(spark, sf):
    """Pairs written as nested JSON documents over several lines, at most a thousand pairs each, and read back."""
    f = _t(spark, sf, "fees_data").distinct().withColumn("section", F.coalesce("section", F.lit("none"))).withColumn("part", F.floor(F.col("pair_id") / 1000))
    docs = f.groupBy("section", "part").agg(F.collect_list(F.struct("pair_id", F.struct("question", "answer").alias("text"))).alias("pairs"))
    body = F.concat(F.lit("{\n \"section\": "), F.to_json(F.array("section")), F.lit(",\n \"pairs\":\n"), F.to_json("pairs"), F.lit("\n}"))
    path = new_path(spark, "nested")
    docs.select(F.xxhash64("section", "part").alias("doc"), body.alias("value")).repartition("doc").write.partitionBy("doc").text(path)
    schema = "section array<string>, pairs array<struct<pair_id: bigint, text: struct<question: string, answer: string>>>"
    back = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("section")[0].alias("section"), F.explode("pairs").alias("p"))
    return back.groupBy("section").agg(F.count("*").alias("pairs"), F.count_distinct("p.pair_id").alias("ids"), F.sum(F.length(F.coalesce("p.text.question", F.lit("")))).cast("bigint").alias("chars"))


@_query("json_shape_dispatch", """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN CAST(to_json({'error': coalesce(title, '')}) AS VARCHAR) ELSE coalesce(title, '') END AS text FROM documents""")
def json_shape_dispatch(spark, sf):
    title = F.coalesce("title", F.lit(""))
    said = F.struct(title.alias("generated_text"))
    j = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array(said))).when(F.col("doc_id") % 3 == 1, F.to_json(said)).otherwise(F.to_json(F.struct(title.alias("error"))))
    return _t(spark, sf, "documents").select("doc_id", X.generated_text(j).alias("text"))
