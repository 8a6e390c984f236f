"""The catalogue of queries over the reference tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import text as X
from weftline.operators import accounts, chat, chunks, metrics, retrieval
from weftline.plans import sqltext as S
from weftline.session import ship_package
from weftline.sources import tables
from weftline.sources.staging import new_path
from weftline.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
AS_OF = "2024-01-20 00:00:00"
SYSTEM = "You answer questions about the campus from the given pages."


def _query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(spark, sf_dir, name)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """university_data, one row per delivered id, with an HTML page around it."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    d = _t(spark, sf_dir, "university_data").select("id", "url", "title", "content").distinct()
    return d.withColumn("html", F.concat(
        F.lit("<html><head><title>"), esc(F.col("title")), F.lit('</title><style>p{}</style></head><body><nav>Menu</nav><script>var s="<p>x</p>";</script><!-- note --><h1>'), esc(F.col("url")),
        F.lit("</h1><main><p>"), F.replace(esc(F.col("content")), F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p></main><footer>Imprint</footer></body></html>")))


_PAGES = f"(SELECT *, {S.HTML} AS html FROM (SELECT DISTINCT id, url, title, content FROM university_data))"

# Pages and texts


@_query("page_title", f"SELECT id, coalesce(nullif({S.strip(S.plain(chr(39) + chr(39) + ' || ' + 'regexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1)'))}, ''), nullif({S.strip(S.plain('regexp_extract(html, ' + chr(39) + '(?is)<h1[^>]*>(.*?)</h1>' + chr(39) + ', 1)'))}, ''), 'Untitled') AS title FROM {_PAGES}")
def page_title(spark, sf):
    return _pages(spark, sf).select("id", H.title(F.col("html")).alias("title"))


@_query("page_doc_id", "SELECT DISTINCT id, sha256(coalesce(url, '') || coalesce(title, '')) AS doc_id FROM university_data")
def page_doc_id(spark, sf):
    return _pages(spark, sf).select("id", F.sha2(F.concat(F.coalesce("url", F.lit("")), F.coalesce("title", F.lit(""))), 256).alias("doc_id"))


_BODY = S.plain("regexp_extract(" + "regexp_replace(" * 5 + "html" + "".join(f", '(?is)<{t}\\b.*?</{t}\\s*>', ' ', 'g')" for t in H.DROPPED) + ", '(?is)<body\\b[^>]*>(.*)</body>', 1)")


@_query("page_body_fallback", f"SELECT id, sha256({_BODY}) AS body, CAST(length({_BODY}) AS BIGINT) AS page_length FROM {_PAGES}")
def page_body_fallback(spark, sf):
    b = _pages(spark, sf).select("id", H.body_text(F.col("html")).alias("b"))
    return b.select("id", F.sha2("b", 256).alias("body"), F.length("b").cast("bigint").alias("page_length"))


_MAIN = S.plain("regexp_extract(html, '(?is)<main\\b[^>]*>(.*?)</main\\s*>', 1)")


@_query("page_article_text", f"SELECT id, sha256(CASE WHEN length({_MAIN}) > 100 THEN {_MAIN} ELSE {_BODY} END) AS text FROM {_PAGES}")
def page_article_text(spark, sf):
    h = F.col("html")
    return _pages(spark, sf).select("id", F.sha2(F.coalesce(H.first_substantial([H.element_text(h, "main"), H.element_text(h, "article")]), H.body_text(h)), 256).alias("text"))


_LINES = f"list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda l: {S.strip('l')}), lambda l: l <> '')"
_DOM = f"array_to_string({_LINES}, chr(10))"


@_query("page_dom_text", f"SELECT id, sha256(CASE WHEN length({_DOM}) > 100 THEN {_DOM} ELSE array_to_string(list_filter([{S.strip(chr(99) + 'oalesce(url, ' + chr(39) * 2 + ')')}], lambda l: l <> '') || {_LINES}, chr(10)) END) AS text, CASE WHEN length({_DOM}) > 100 THEN 'main' ELSE 'body' END AS method, 0::BIGINT AS tables_found FROM {_PAGES}")
def page_dom_text(spark, sf):
    p = _pages(spark, sf).select("id", H.page_parts(F.col("html")).alias("p"))
    return p.select("id", F.sha2("p.text", 256).alias("text"), "p.method", F.size("p.tables").cast("bigint").alias("tables_found"))


@_query("page_url_parts", r"SELECT DISTINCT id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS path FROM university_data WHERE url IS NOT NULL")
def page_url_parts(spark, sf):
    u = lambda part: F.coalesce(F.try_parse_url("url", F.lit(part)), F.lit(""))
    return _pages(spark, sf).filter("url IS NOT NULL").select("id", F.lower(u("PROTOCOL")).alias("scheme"), F.lower(u("HOST")).alias("host"), u("PATH").alias("path"))


@_query("page_content_type", """SELECT kind, count(*) AS pages FROM (SELECT CASE WHEN contains(lower(url), 'admission') THEN 'admission' WHEN contains(lower(url), 'course') OR contains(lower(url), 'academic') THEN 'courses'
WHEN contains(lower(url), 'about') THEN 'about' WHEN contains(lower(url), 'facilit') THEN 'facilities' ELSE 'general' END AS kind FROM university_data) GROUP BY kind""")
def page_content_type(spark, sf):
    return _t(spark, sf, "university_data").groupBy(X.content_type_of(F.col("url")).alias("kind")).agg(F.count("*").alias("pages"))


@_query("page_metadata", "SELECT id, json_extract_string(extra_metadata, '$.scraping_method') AS method, coalesce(CAST(json_extract_string(extra_metadata, '$.response_status') AS BIGINT), -1) AS status, count(*) AS deliveries FROM university_data GROUP BY ALL")
def page_metadata(spark, sf):
    j = lambda k: F.get_json_object("extra_metadata", f"$.{k}")
    return _t(spark, sf, "university_data").groupBy("id", j("scraping_method").alias("method"), F.coalesce(j("response_status").cast("bigint"), F.lit(-1)).alias("status")).agg(F.count("*").alias("deliveries"))


@_query("doc_clean", f"SELECT doc_id, sha256({S.clean('text')}) AS text, CAST(length({S.clean('text')}) AS BIGINT) AS n FROM documents")
def doc_clean(spark, sf):
    c = _t(spark, sf, "documents").select("doc_id", X.clean(F.col("text")).alias("c"))
    return c.select("doc_id", F.sha2("c", 256).alias("text"), F.length("c").cast("bigint").alias("n"))


_LEGACY = f"trim(regexp_replace(regexp_replace(regexp_replace({S.strip(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}, '\\\\s+', ' ', 'g'), '[^a-zA-Z0-9\\\\s.,;:!?()\\-]', ' ', 'g'), ' +', ' ', 'g'))"


@_query("doc_clean_legacy", f"SELECT doc_id, sha256({_LEGACY}) AS text FROM documents")
def doc_clean_legacy(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.sha2(X.clean_legacy(F.col("text")), 256).alias("text"))


@_query("doc_length_gate", "SELECT source, lang, count(*) AS docs, count(*) FILTER (WHERE length(text) >= 100) AS long_docs, count(*) FILTER (WHERE length(text) >= 50) AS kept_docs FROM documents GROUP BY source, lang")
def doc_length_gate(spark, sf):
    n = F.coalesce(F.length("text"), F.lit(0))
    return _t(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.count_if(n >= 100).alias("long_docs"), F.count_if(n >= 50).alias("kept_docs"))


_CHUNKS = f"""(SELECT doc_id, i AS chunk_index, substr(text, CAST(i * 462 + 1 AS BIGINT), 512) AS chunk_text FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil((length(text) - 50) / 462.0) AS BIGINT)))) AS i FROM documents WHERE text IS NOT NULL AND text <> '')
WHERE length({S.strip("substr(text, CAST(i * 462 + 1 AS BIGINT), 512)")}) >= 50)"""


@_query("doc_chunks_fixed", f"SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, doc_id || '_chunk_' || chunk_index AS chunk_id, sha256(chunk_text) AS chunk_hash FROM {_CHUNKS}")
def doc_chunks_fixed(spark, sf):
    c = chunks.chunk_fixed(_t(spark, sf, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_index", "chunk_id", F.sha2("chunk_text", 256).alias("chunk_hash"))


@_query("doc_chunks_separator")
def doc_chunks_separator(spark, sf):
    return chunks.chunk_by_separator(_t(spark, sf, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "chunk_id", F.length("chunk_text").alias("n"))


_KEYS = ["committee", "scholarship", "laboratory"]
_KEYLINE = S.strip("l")


@_query("doc_keyword_lines", f"SELECT doc_id, count(*) AS lines, CAST(sum(length({_KEYLINE})) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length({_KEYLINE}) > 20 AND (" + " OR ".join(f"contains(lower(l), '{k}')" for k in _KEYS) + ") GROUP BY doc_id")
def doc_keyword_lines(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.explode(X.keyword_lines(F.col("text"), _KEYS)).alias("l"))
    return d.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("l")).cast("bigint").alias("chars"))


@_query("doc_insert_if_absent", "SELECT source, count(*) AS stored FROM (SELECT id, min(source) AS source FROM (SELECT doc_id % 700 AS id, 'b' AS source FROM documents WHERE doc_id % 2 = 1) WHERE id NOT IN (SELECT doc_id % 900 FROM documents WHERE doc_id % 2 = 0) GROUP BY id) GROUP BY source")
def doc_insert_if_absent(spark, sf):
    d = _t(spark, sf, "documents")
    held = d.filter("doc_id % 2 = 0").select((F.col("doc_id") % 900).alias("id"))
    new = d.filter("doc_id % 2 = 1").select((F.col("doc_id") % 700).alias("id"), F.lit("b").alias("source"))
    return tables.absent(new, held).groupBy("source").agg(F.count("*").alias("stored"))


@_query("doc_dedup_first", "SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def doc_dedup_first(spark, sf):
    return _t(spark, sf, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@_query("token_estimate", f"SELECT doc_id, CAST(floor(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{S.SPACE}+'), lambda w: w <> '')) * 1.3) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


# Statistics of the knowledge base


@_query("kb_stats_by_type", "SELECT coalesce(nullif(content_type, ''), 'unknown') AS content_type, count(*) AS documents, max(scraped_at) AS latest, count(DISTINCT coalesce(title, '')) AS titles FROM documents GROUP BY 1")
def kb_stats_by_type(spark, sf):
    return _t(spark, sf, "documents").groupBy(X.or_default(F.col("content_type"), "unknown").alias("content_type")).agg(F.count("*").alias("documents"), F.max("scraped_at").alias("latest"), F.count_distinct(F.coalesce("title", F.lit(""))).alias("titles"))


@_query("kb_stats_nested", """SELECT CAST(sum(n) AS BIGINT) AS total_documents, CAST(to_json(map_from_entries(list({'k': t, 'v': n} ORDER BY t))) AS VARCHAR) AS content_types, max(latest) AS latest_scrape
FROM (SELECT coalesce(nullif(content_type, ''), 'unknown') AS t, count(*) AS n, max(scraped_at) AS latest FROM documents GROUP BY 1)""")
def kb_stats_nested(spark, sf):
    g = kb_stats_by_type(spark, sf)
    types = F.map_from_entries(F.sort_array(F.collect_list(F.struct("content_type", "documents"))))
    return g.agg(F.sum("documents").alias("total_documents"), F.to_json(types).alias("content_types"), F.max("latest").alias("latest_scrape"))


@_query("rag_stats", f"SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, 512 AS chunk_size, 50 AS overlap FROM {_CHUNKS}")
def rag_stats(spark, sf):
    return chunks.chunk_fixed(_t(spark, sf, "documents"), "doc_id", "text").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents")).select("*", F.lit(512).alias("chunk_size"), F.lit(50).alias("overlap"))


@_query("chunk_parent_join", f"SELECT d.source, count(*) AS chunks, CAST(sum(length(c.chunk_text)) AS BIGINT) AS chars FROM {_CHUNKS} c JOIN documents d USING (doc_id) GROUP BY d.source")
def chunk_parent_join(spark, sf):
    d = _t(spark, sf, "documents")
    c = chunks.chunk_fixed(d, "doc_id", "text")
    return c.join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).cast("bigint").alias("chars"))


@_query("union_scan", "SELECT origin, count(*) AS n FROM (SELECT 'page' AS origin FROM university_data UNION ALL SELECT 'document' FROM documents UNION ALL SELECT 'faq' FROM fees_data) GROUP BY origin")
def union_scan(spark, sf):
    part = lambda t, o: _t(spark, sf, t).select(F.lit(o).alias("origin"))
    return part("university_data", "page").unionByName(part("documents", "document")).unionByName(part("fees_data", "faq")).groupBy("origin").agg(F.count("*").alias("n"))


# Lookups, sorts, projections


@_query("lookup_by_key", "SELECT id, username, email FROM users WHERE username = (SELECT min(username) FROM users) ORDER BY id LIMIT 1")
def lookup_by_key(spark, sf):
    u = _t(spark, sf, "users")
    first = u.agg(F.min("username").alias("username"))
    return u.join(F.broadcast(first), "username", "left_semi").orderBy("id").limit(1).select("id", "username", "email")


@_query("lookup_optional_filter", "SELECT 'all' AS asked, count(*) AS n FROM university_data UNION ALL SELECT 'courses', count(*) FROM university_data WHERE content_type = 'courses' UNION ALL SELECT 'empty', count(*) FROM university_data")
def lookup_optional_filter(spark, sf):
    d = _t(spark, sf, "university_data")
    pick = lambda v: d.filter(F.col("content_type") == v) if v else d
    out = [pick(v).agg(F.count("*").alias("n")).select(F.lit(name).alias("asked"), "n") for name, v in (("all", None), ("courses", "courses"), ("empty", ""))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@_query("recent_conversations_limit", "SELECT id, user_id, updated_at FROM (SELECT DISTINCT id, user_id, updated_at FROM conversations WHERE is_active) ORDER BY updated_at DESC NULLS LAST, id LIMIT 50")
def recent_conversations_limit(spark, sf):
    return _t(spark, sf, "conversations").filter("is_active").select("id", "user_id", "updated_at").distinct().orderBy(F.col("updated_at").desc_nulls_last(), "id").limit(50)


@_query("oldest_messages_limit", "SELECT id, created_at FROM (SELECT DISTINCT id, created_at FROM messages) ORDER BY created_at NULLS FIRST, id LIMIT 100")
def oldest_messages_limit(spark, sf):
    return _t(spark, sf, "messages").select("id", "created_at").distinct().orderBy(F.col("created_at").asc_nulls_first(), "id").limit(100)


@_query("active_conjunction", "SELECT user_id, count(*) AS n FROM conversations WHERE is_active AND user_id IS NOT NULL GROUP BY user_id")
def active_conjunction(spark, sf):
    return _t(spark, sf, "conversations").filter(F.col("is_active") & F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count("*").alias("n"))


@_query("pages_sorted", "SELECT id, scraped_at FROM (SELECT DISTINCT id, scraped_at FROM university_data WHERE is_active)")
def pages_sorted(spark, sf):
    return _t(spark, sf, "university_data").filter("is_active").select("id", "scraped_at").distinct().orderBy(F.col("scraped_at").desc_nulls_last(), "id")


@_query("audit_recent_limit", "SELECT event_id, user_id, event_type, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 100")
def audit_recent_limit(spark, sf):
    return _t(spark, sf, "events").filter("event_type = 'error'").orderBy(F.col("ts").desc(), "event_id").limit(100).select("event_id", "user_id", "event_type", "ts")


@_query("document_projection", "SELECT doc_id, coalesce(nullif(title, ''), 'Untitled') AS title, coalesce(nullif(content_type, ''), 'general') AS content_type, strftime(scraped_at, '%Y-%m-%dT%H:%M:%S') AS scraped_at FROM documents")
def document_projection(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.or_default(F.col("title"), "Untitled").alias("title"), X.or_default(F.col("content_type"), "general").alias("content_type"), F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss").alias("scraped_at"))


@_query("profile_view", "SELECT id, coalesce(full_name, '') AS full_name, coalesce(phone, '') AS phone, CASE WHEN mfa_enabled THEN 'Yes' ELSE 'No' END AS mfa, coalesce(strftime(created_at, '%Y-%m-%d %H:%M'), '') AS member_since FROM users")
def profile_view(spark, sf):
    blank = lambda c: F.coalesce(c, F.lit(""))
    return _t(spark, sf, "users").select("id", blank(F.col("full_name")).alias("full_name"), blank(F.col("phone")).alias("phone"), F.when(F.col("mfa_enabled"), "Yes").otherwise("No").alias("mfa"), blank(F.date_format("created_at", "yyyy-MM-dd HH:mm")).alias("member_since"))


# Retrieval


def _first_vector(spark, sf):
    return _t(spark, sf, "embeddings").orderBy("vec_id").limit(1).select("embedding").first()[0]


_D1 = S.distance("e.embedding", "q.embedding")


@_query("vector_topk", f"SELECT e.vec_id, round({_D1}, 6) AS distance, round(1 / (1 + {_D1}), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY {_D1}, e.vec_id LIMIT 5")
def vector_topk(spark, sf):
    r = retrieval.top_k(_t(spark, sf, "embeddings"), _first_vector(spark, sf))
    return r.select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@_query("vector_topk_batch", f"SELECT query_id, vec_id, distance, CAST(rank AS BIGINT) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round({_D1}, 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D1}, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q) WHERE rank <= 5")
def vector_topk_batch(spark, sf):
    e = _t(spark, sf, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.top_k_batch(e, q).withColumn("distance", F.round("distance", 6))


@_query("vector_sources_top3", f"SELECT vec_id, CAST(label AS BIGINT) AS source FROM (SELECT e.vec_id, e.label, {_D1} AS d FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q) ORDER BY d, vec_id LIMIT 3")
def vector_sources_top3(spark, sf):
    return retrieval.top_k(_t(spark, sf, "embeddings"), _first_vector(spark, sf), 3).select("vec_id", F.col("label").cast("bigint").alias("source"))


@_query("vector_index_roundtrip", "SELECT count(*) AS vectors, count(DISTINCT label) AS labels FROM embeddings")
def vector_index_roundtrip(spark, sf):
    path = new_path(spark, "index")
    e = _t(spark, sf, "embeddings")
    tables.rebuild(spark, e, e, path)
    return tables.load_or_empty(spark, path, "vec_id bigint, embedding array<float>, label int").agg(F.count("*").alias("vectors"), F.count_distinct("label").alias("labels"))


_PIECE = f"concat('[Source: ', coalesce(nullif(role, ''), 'Unknown'), ']', chr(10), {S.strip('content')})"
_PACKED = f"""(SELECT * FROM (SELECT conversation_id, id, created_at, {_PIECE} AS piece, sum(length({_PIECE})) OVER (PARTITION BY conversation_id ORDER BY created_at NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS used
FROM (SELECT DISTINCT conversation_id, id, role, content, created_at FROM messages WHERE conversation_id IS NOT NULL) WHERE {S.strip('content')} <> '') WHERE used <= 1500)"""


def _packed(spark, sf):
    m = _t(spark, sf, "messages").filter("conversation_id IS NOT NULL").select("conversation_id", "id", "role", "content", "created_at").distinct()
    return retrieval.pack(m, group="conversation_id", order=["created_at", "id"], title="role", content="content", budget=1500)


@_query("context_pack", f"SELECT conversation_id, id, CAST(used AS BIGINT) AS used FROM {_PACKED}")
def context_pack(spark, sf):
    return _packed(spark, sf).select("conversation_id", "id", "used")


@_query("context_text", f"SELECT conversation_id, sha256(string_agg(piece, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY used, id)) AS context FROM {_PACKED} GROUP BY conversation_id")
def context_text(spark, sf):
    return retrieval.context_text(_packed(spark, sf), "conversation_id", "used").withColumn("context", F.sha2("context", 256))


# Chat

_M = "(SELECT DISTINCT id, conversation_id, role, content, created_at FROM messages WHERE conversation_id IS NOT NULL)"


def _messages(spark, sf):
    return _t(spark, sf, "messages").filter("conversation_id IS NOT NULL").select("id", "conversation_id", "role", "content", "created_at").distinct()


@_query("chat_last_n", f"SELECT conversation_id, id, CAST(back AS BIGINT) AS back FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC NULLS LAST, id DESC) AS back FROM {_M}) WHERE back <= 10")
def chat_last_n(spark, sf):
    return chat.last_turns(_messages(spark, sf), 10).select("conversation_id", "id", "back")


@_query("chat_trim", f"SELECT conversation_id, count(*) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC NULLS LAST, id DESC) AS back FROM {_M}) WHERE back <= 50 GROUP BY conversation_id")
def chat_trim(spark, sf):
    return chat.last_turns(_messages(spark, sf), 50).groupBy("conversation_id").agg(F.count("*").alias("kept"))


_LINE = "concat(CASE WHEN lower(trim(role)) = 'user' THEN 'Human: ' ELSE 'Assistant: ' END, coalesce(content, ''))"
_TRANSCRIPT = f"(SELECT conversation_id, string_agg({_LINE}, chr(10) ORDER BY back DESC) AS transcript FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC NULLS LAST, id DESC) AS back FROM {_M}) WHERE back <= 10 GROUP BY conversation_id)"


@_query("chat_transcript", f"SELECT conversation_id, sha256(transcript) AS transcript FROM {_TRANSCRIPT}")
def chat_transcript(spark, sf):
    return chat.transcript(_messages(spark, sf)).withColumn("transcript", F.sha2("transcript", 256))


@_query("chat_roles", "SELECT lower(trim(role)) AS role, count(*) AS n FROM messages GROUP BY 1")
def chat_roles(spark, sf):
    return _t(spark, sf, "messages").groupBy(F.lower(F.trim("role")).alias("role")).agg(F.count("*").alias("n"))


_CMD = S.strip("lower(content)")


@_query("chat_commands", f"SELECT CASE WHEN {_CMD} IN ('exit', 'quit', 'bye') THEN 'leave' WHEN {_CMD} IN ('/status', '/models', '/stats', '/clear', '/profile', '/help') THEN substr({_CMD}, 2, 20) WHEN starts_with({_CMD}, '/') THEN 'unknown' WHEN {_CMD} = '' THEN 'nothing' ELSE 'question' END AS command, count(*) AS n FROM messages GROUP BY 1")
def chat_commands(spark, sf):
    return _t(spark, sf, "messages").groupBy(X.command_of(F.col("content")).alias("command")).agg(F.count("*").alias("n"))


@_query("prompt_build", f"SELECT conversation_id, sha256(concat_ws(chr(10), '{SYSTEM}', CASE WHEN nullif(transcript, '') IS NOT NULL THEN concat(chr(10), chr(10), 'Conversation History:', chr(10), transcript) END, concat(chr(10), chr(10), 'User Question: ', conversation_id), concat(chr(10), chr(10), 'Assistant:'))) AS prompt FROM {_TRANSCRIPT}")
def prompt_build(spark, sf):
    t = chat.transcript(_messages(spark, sf))
    return t.select("conversation_id", F.sha2(X.prompt(F.col("conversation_id"), F.lit(None).cast("string"), F.col("transcript"), SYSTEM), 256).alias("prompt"))


def _answered(spark, sf):
    t = chat.transcript(_messages(spark, sf)).withColumn("question", F.substring_index("transcript", "\n", -1))
    p = t.withColumn("prompt", X.prompt(F.col("question"), F.lit(None).cast("string"), F.col("transcript"), SYSTEM))
    return chat.generate(p).withColumn("user_id", F.lit(None).cast("string"))


_QUESTION = "string_split(transcript, chr(10))[-1]"
_ECHOED = f"list_filter(regexp_split_to_array({_QUESTION}, '{S.SPACE}+'), lambda w: w <> '')[1:500]"
_ROW_ID = "sha256(concat_ws('|', conversation_id, role, said, '" + AS_OF + "'))"


@_query("generate_batch", f"SELECT CAST(row_number() OVER (ORDER BY conversation_id) - 1 AS BIGINT) AS idx, conversation_id, 'echo' AS model, CAST(len({_ECHOED}) AS BIGINT) AS tokens_used, sha256(array_to_string({_ECHOED}, ' ')) AS answer, NULL::VARCHAR AS error FROM {_TRANSCRIPT}")
def generate_batch(spark, sf):
    numbered = chunks.dense_ids(_answered(spark, sf).select("conversation_id", "model", "tokens_used", F.sha2("content", 256).alias("answer"), "error"), ["conversation_id"], "idx")
    return numbered.orderBy("idx").select("idx", "conversation_id", "model", "tokens_used", "answer", "error")


@_query("chat_pipeline", f"""SELECT {_ROW_ID} AS id, conversation_id, role, model_used FROM (SELECT conversation_id, 'user' AS role, {_QUESTION} AS said, NULL AS model_used FROM {_TRANSCRIPT} UNION ALL SELECT conversation_id, 'assistant', array_to_string({_ECHOED}, ' '), 'echo' FROM {_TRANSCRIPT})""")
def chat_pipeline(spark, sf):
    return chat.message_rows(_answered(spark, sf), F.to_timestamp_ntz(F.lit(AS_OF))).select("id", "conversation_id", "role", "model_used")


@_query("model_statistics", "SELECT model_used, count(*) AS answers, round(avg(response_time), 6) AS avg_seconds, CAST(sum(tokens_used) AS BIGINT) AS tokens FROM messages WHERE model_used IS NOT NULL GROUP BY model_used")
def model_statistics(spark, sf):
    return _t(spark, sf, "messages").filter("model_used IS NOT NULL").groupBy("model_used").agg(F.count("*").alias("answers"), F.round(F.avg("response_time"), 6).alias("avg_seconds"), F.sum("tokens_used").cast("bigint").alias("tokens"))


# Accounts

_NAME_CASES = "CASE WHEN length(username) < 3 THEN 'too_short' WHEN length(username) > 30 THEN 'too_long' WHEN NOT regexp_full_match(username, '[a-zA-Z0-9_.\\-]+') THEN 'bad_characters' WHEN starts_with(username, '.') OR ends_with(username, '.') THEN 'outer_dot' END"


@_query("username_valid", f"SELECT id, {_NAME_CASES} AS issue FROM users")
def username_valid(spark, sf):
    return _t(spark, sf, "users").select("id", X.username_issue(F.col("username")).alias("issue"))


_P = "hashed_password"
_ISSUES = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in (
    (f"length({_P}) < 8", "length"), (f"NOT regexp_matches({_P}, '[A-Z]')", "uppercase"), (f"NOT regexp_matches({_P}, '[a-z]')", "lowercase"), (f"NOT regexp_matches({_P}, '[0-9]')", "digit"),
    (f"NOT regexp_matches({_P}, '[!@#$%^&*(),.?\":{{}}|<>]')", "special"), (f"lower({_P}) IN ('password', '123456', 'qwerty', 'abc123', 'password123')", "common"))) + ")"


@_query("password_issues", f"SELECT id, {_ISSUES} AS issues FROM users")
def password_issues(spark, sf):
    return _t(spark, sf, "users").select("id", F.array_join(X.password_issues(F.col("hashed_password")), ",").alias("issues"))


@_query("email_valid", r"""SELECT id, CASE WHEN regexp_full_match(email, '[A-Za-z0-9.!#$%&''*+/=?^_`{|}~\-]+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+') AND NOT regexp_matches(email, '^\.|\.@|\.\.') THEN concat(string_split(email, '@')[1], '@', lower(string_split(email, '@')[2])) END AS email FROM users""")
def email_valid(spark, sf):
    return _t(spark, sf, "users").select("id", X.email_normalised(F.col("email")).alias("email"))


@_query("availability_anti_join", "SELECT DISTINCT full_name FROM users WHERE full_name IS NOT NULL AND lower(full_name) NOT IN (SELECT lower(username) FROM users WHERE username IS NOT NULL)")
def availability_anti_join(spark, sf):
    u = _t(spark, sf, "users")
    held = u.select(F.col("username").alias("full_name"))
    return accounts.free_names(u.filter("full_name IS NOT NULL").select("full_name").distinct(), held, "full_name")


_LOCKOUT = """SELECT user_id, min(ts) AS locked_at FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS n FROM (
SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events WHERE event_type IN ('error', 'signup')) WHERE event_type = 'error') WHERE n = 5 GROUP BY user_id"""


@_query("lockout_time", _LOCKOUT)
def lockout_time(spark, sf):
    return accounts.lockouts(_t(spark, sf, "events"), key="user_id", ts="ts", tie="event_id", failed=F.col("event_type") == "error", succeeded=F.col("event_type") == "signup")


@_query("session_expiry", f"SELECT event_id, ts + INTERVAL 24 HOUR AS expires_at, ts + INTERVAL 24 HOUR >= TIMESTAMP '{AS_OF}' AS valid FROM events WHERE event_type = 'signup'")
def session_expiry(spark, sf):
    e = _t(spark, sf, "events").filter("event_type = 'signup'")
    return accounts.sessions_valid(e, ts="ts", as_of=F.to_timestamp_ntz(F.lit(AS_OF))).select("event_id", "expires_at", "valid")


@_query("cascade_delete", """WITH gone AS (SELECT id FROM users WHERE NOT is_active), c AS (SELECT id FROM conversations WHERE user_id IN (SELECT id FROM gone))
SELECT 'users' AS kept, count(*) AS n FROM users WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'conversations', count(*) FROM conversations WHERE coalesce(user_id, '') NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'messages', count(*) FROM messages WHERE coalesce(user_id, '') NOT IN (SELECT id FROM gone) AND coalesce(conversation_id, '') NOT IN (SELECT id FROM c)""")
def cascade_delete(spark, sf):
    u = _t(spark, sf, "users")
    rest = tables.cascade(u, _t(spark, sf, "conversations"), _t(spark, sf, "messages"), u.filter("NOT is_active").select("id"))
    out = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("kept"), "n") for n, df in rest.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@_query("profile_update", f"SELECT u.id, u.email, CASE WHEN c.user_id IS NOT NULL THEN 'has chats' ELSE u.bio END AS bio, CASE WHEN c.user_id IS NULL THEN u.phone END AS phone, CASE WHEN c.user_id IS NOT NULL THEN true ELSE u.is_active END AS is_active, CASE WHEN c.user_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE u.updated_at END AS updated_at FROM users u LEFT JOIN (SELECT DISTINCT user_id FROM conversations) c ON u.id = c.user_id")
def profile_update(spark, sf):
    patch = _t(spark, sf, "conversations").filter("user_id IS NOT NULL").select(F.col("user_id").alias("id"), F.lit("has chats").alias("bio"), F.lit(None).cast("string").alias("phone"), F.lit(True).alias("is_active"), F.lit("x@y.z").alias("email"))
    return tables.updated(_t(spark, sf, "users"), patch, at=F.to_timestamp_ntz(F.lit(AS_OF))).select("id", "email", "bio", "phone", "is_active", "updated_at")


@_query("cache_then_db", "SELECT coalesce(c.c_custkey, s.s_suppkey) AS key, coalesce(s.s_acctbal, c.c_acctbal) AS value, CASE WHEN s.s_suppkey IS NOT NULL THEN 0 ELSE 1 END::BIGINT AS source FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey")
def cache_then_db(spark, sf):
    a = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"))
    return accounts.first_source([a, _t(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))], "key", "value")


# Metrics


def _runs(spark, sf):
    return _t(spark, sf, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("duration"), F.get_json_object("props", "$.k").cast("double").alias("items"), (F.col("user_id") % 2 == 0).alias("threaded"), (F.col("value") > 5).alias("success"))


_RUNS = "(SELECT event_type AS operation, value AS duration, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS items, user_id % 2 = 0 AS threaded, value > 5 AS success FROM events)"
_PER = "coalesce(CASE WHEN items > 0 AND duration > 0 THEN items / duration END, 0)"
_COMPARED = f"""(SELECT operation, count(*) FILTER (WHERE threaded) AS threaded_runs, count(*) FILTER (WHERE NOT threaded) AS sequential_runs, avg(duration) FILTER (WHERE threaded) AS td, avg(duration) FILTER (WHERE NOT threaded) AS sd,
avg({_PER}) FILTER (WHERE threaded) AS tt, avg({_PER}) FILTER (WHERE NOT threaded) AS st FROM {_RUNS} WHERE success GROUP BY operation)"""


@_query("perf_report", f"SELECT operation, count(*) AS total_runs, count(*) FILTER (WHERE success) AS successful_runs, round(coalesce(avg(duration) FILTER (WHERE success), 0), 6) AS avg_duration, bool_or(threaded) AS threaded FROM {_RUNS} GROUP BY operation")
def perf_report(spark, sf):
    return metrics.report(_runs(spark, sf))


@_query("perf_comparison", f"SELECT operation, threaded_runs, sequential_runs, round(td, 6) AS avg_threaded_duration, round(sd, 6) AS avg_sequential_duration, round(tt, 6) AS avg_threaded_throughput, round(st, 6) AS avg_sequential_throughput, round((sd - td) / sd * 100, 6) AS time_improvement_percent, round((tt - st) / st * 100, 6) AS throughput_improvement_percent, round(sd / td, 6) AS speedup_factor FROM {_COMPARED}")
def perf_comparison(spark, sf):
    return metrics.comparison(_runs(spark, sf))


@_query("perf_recommendation", f"SELECT operation, CASE WHEN sd / td > 1.5 THEN 'excellent' WHEN sd / td > 1.2 THEN 'good' ELSE 'minimal' END AS advice FROM {_COMPARED} WHERE sd / td IS NOT NULL")
def perf_recommendation(spark, sf):
    return metrics.recommendations(metrics.comparison(_runs(spark, sf)))


@_query("progress_percent", "SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) AS BIGINT) AS done, round(100.0 * row_number() OVER (ORDER BY event_type) / count(*) OVER (), 6) AS percent FROM (SELECT DISTINCT event_type FROM events)")
def progress_percent(spark, sf):
    # A handful of tasks: one partition is enough.
    w = Window.orderBy("event_type")
    n = F.row_number().over(w)
    return _t(spark, sf, "events").select("event_type").distinct().select("event_type", n.cast("bigint").alias("done"), F.round(100.0 * n / F.count("*").over(Window.partitionBy()), 6).alias("percent"))


# JSON, time, money


@_query("props_json", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def props_json(spark, sf):
    return _t(spark, sf, "events").groupBy(F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k")).agg(F.count("*").alias("n"))


@_query("fee_amounts", r"SELECT pair_id, updated_at, coalesce(CAST(nullif(regexp_replace(regexp_extract(answer, '₹([0-9,]+)', 1), '[^0-9]', '', 'g'), '') AS BIGINT), -1) AS amount, coalesce(CAST(nullif(regexp_extract(answer, '(\d+)%', 1), '') AS BIGINT), -1) AS share FROM fees_data")
def fee_amounts(spark, sf):
    return _t(spark, sf, "fees_data").select("pair_id", "updated_at", F.coalesce(X.money(F.regexp_extract("answer", "₹([0-9,]+)", 1)), F.lit(-1)).alias("amount"), F.coalesce(X.percentage(F.col("answer")), F.lit(-1)).alias("share"))


@_query("hour_bucket", "SELECT CASE WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon' ELSE 'evening' END AS daytime, count(*) AS n FROM events GROUP BY 1")
def hour_bucket(spark, sf):
    return _t(spark, sf, "events").groupBy(X.daytime(F.col("ts")).alias("daytime")).agg(F.count("*").alias("n"))


@_query("greedy_batches", "SELECT CAST((row_number() OVER (ORDER BY doc_id) - 1) // greatest(1, count(*) OVER () // 4) AS BIGINT) AS batch_id, doc_id FROM documents")
def greedy_batches(spark, sf):
    return chunks.batches_of(_t(spark, sf, "documents").select("doc_id"), "doc_id").select("batch_id", "doc_id")


# Streams


def _stream(spark, sf, name):
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet" if not sf.endswith("/") else "*.parquet").parquet(_stream_dir(sf, name))


def _stream_dir(sf: str, name: str) -> str:
    import os

    return f"{sf}/{name}.parquet" if os.path.isdir(f"{sf}/{name}.parquet") else sf


def _streamed(spark, stream: DataFrame, mode: str) -> DataFrame:
    return stateful.run_once(stream, new_path(spark, "stream"), mode)


@_query("stream_lockout", _LOCKOUT)
def stream_lockout(spark, sf):
    e = _stream(spark, sf, "events").filter("event_type IN ('error', 'signup')").select(F.col("user_id").cast("string").alias("k"), F.col("ts").cast("timestamp").alias("t"), F.col("event_id").alias("i"), (F.col("event_type") == "error").alias("failed"))
    return _streamed(spark, stateful.stream_lockouts(e), "append").select(F.col("k").cast("bigint").alias("user_id"), F.col("locked_at").cast("timestamp_ntz").alias("locked_at"))


@_query("stream_dedup", "SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, sf):
    e = _stream(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    return _streamed(spark, stateful.stream_first(e, "user_id", "t", "400 days"), "append").select("user_id")


@_query("stream_history", "SELECT conversation_id AS c, least(50, count(*)) AS kept, sha256(coalesce(arg_max(coalesce(content, ''), (created_at, id, content)), '')) AS newest FROM messages WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1")
def stream_history(spark, sf):
    m = _stream(spark, sf, "messages").filter("conversation_id IS NOT NULL AND created_at IS NOT NULL").select(F.col("conversation_id").alias("c"), "id", "content", F.col("created_at").cast("timestamp").alias("t"))
    s = _streamed(spark, stateful.stream_history(m), "update")
    return s.groupBy("c").agg(F.max("kept").alias("kept"), F.sha2(F.max_by("last", "kept"), 256).alias("newest"))


_TUMBLING = "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@_query("window_tumbling", _TUMBLING)
def window_tumbling(spark, sf):
    return stateful.windowed_counts(_t(spark, sf, "events"), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("stream_windows", _TUMBLING)
def stream_windows(spark, sf):
    return _streamed(spark, stateful.windowed_counts(_stream(spark, sf, "events"), "ts", "event_type"), "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("window_session", """SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def window_session(spark, sf):
    return stateful.session_counts(_t(spark, sf, "events"), "ts", "user_id").withColumn("started", F.col("started").cast("timestamp_ntz"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
