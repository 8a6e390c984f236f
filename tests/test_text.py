import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import text as X
from weftline.operators import chunks


def one(spark, expr, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_clean(spark):
    assert one(spark, X.clean, "  a\tb\n\nc | d – ₹5 ", None, "", "a  b") == ["a b c d 5", "", "", "a b"]


def test_clean_is_idempotent(spark):
    texts = ["x  y　z!", "( a ) - b;;", "₹₹", "a\\nb"]
    once = one(spark, X.clean, *texts)
    assert one(spark, X.clean, *once) == once
    assert all(re.fullmatch(r"[a-zA-Z0-9 .,;:!?()\-]*", t) for t in once)


def test_legacy_keeps_backslashes(spark):
    assert one(spark, X.clean_legacy, "a\\nb", None) == ["a\\nb", ""]
    assert one(spark, X.clean, "a\\nb") == ["a nb"]


def test_content_types(spark):
    paths = ["/admissions/", "/courses/", "/academics/", "/about/", "/facilities/", "/x/", "/about-courses/"]
    assert one(spark, X.content_type_of, *paths) == ["admission", "courses", "courses", "about", "facilities", "general", "courses"]


def test_usernames(spark):
    got = one(spark, X.username_issue, "ab", "a" * 31, "a b", ".abc", "abc.", "a.b-c_1", "abc\n")
    assert got == ["too_short", "too_long", "bad_characters", "outer_dot", "outer_dot", None, "bad_characters"]


def test_password_issues(spark):
    got = one(spark, X.password_issues, "abc", "Abcdef1!", "password")
    assert got == [["length", "uppercase", "digit", "special"], [], ["uppercase", "digit", "special", "common"]]


def test_small_functions(spark):
    assert one(spark, X.token_estimate, " ".join("w" * 10), "a b c", None, "") == [13, 3, 0, 0]
    assert one(spark, X.money, "₹2,50,000", "free") == [250000, None]
    assert one(spark, X.percentage, "a 25% waiver", "none") == [25, None]
    assert one(spark, X.generated_text, '[{"generated_text":"x"}]', '{"generated_text":"y"}', '{"error":"z"}') == ["x", "y", '{"error":"z"}']
    assert one(spark, X.email_normalised, "A.b@Example.COM", "a@b", "a..b@c.de", None) == ["A.b@example.com", None, None, None]
    assert one(spark, X.command_of, " QUIT ", "/stats", "/zz", " ", "why?") == ["leave", "stats", "unknown", "nothing", "question"]


def test_hours(spark):
    d = spark.sql("SELECT i, X.t FROM VALUES (1, TIMESTAMP_NTZ'2024-01-01 11:59:59'), (2, TIMESTAMP_NTZ'2024-01-01 12:00:00'), (3, TIMESTAMP_NTZ'2024-01-01 16:59:00'), (4, TIMESTAMP_NTZ'2024-01-01 17:00:00') AS X(i, t)")
    assert [r[0] for r in d.orderBy("i").select(X.daytime(F.col("t"))).collect()] == ["morning", "afternoon", "afternoon", "evening"]


def test_keyword_lines(spark):
    assert one(spark, lambda x: X.keyword_lines(x, ["Professor"]), "short professor\n  A PROFESSOR of many things here \nnothing to see in this long line", None) == [["A PROFESSOR of many things here"], []]


def test_html_titles(spark):
    pages = ["<title> A &amp; B </title><h1>C</h1>", "<title> </title><h1>C <b>d</b></h1>", "<p>x</p>", None]
    assert one(spark, H.title, *pages) == ["A & B", "C d", "Untitled", "Untitled"]


def test_body_without_dropped_parts(spark):
    page = '<html><body><nav>menu</nav><script>var s="<p>x</p>";</script><p>One &lt;two&gt;</p><!-- no --><footer>f</footer></body></html>'
    assert one(spark, H.body_text, page) == ["One <two>"]


def test_parser_rules(spark):
    long, short = "w" * 101, "w" * 100
    p = H.parse_page(f'<body><div class="content">{short}</div><main>{long}</main><table><tr><th>a</th><td>b</td></tr></table><div class="staff x">Someone at work</div></body>')
    assert (p["method"], p["text"], p["tables"], p["items"]) == ("main", long, ["TABLE: a | b"], ["Someone at work"])
    p = H.parse_page("<body><nav>n</nav><b>unclosed <p>text<script>'</p>'</script></body>")
    assert (p["method"], p["text"]) == ("body", "unclosed\ntext")
    assert H.parse_page(None)["text"] == ""
    got = spark.createDataFrame([("<body>hi</body>",), (None,)], "x string").select(H.page_parts(F.col("x")).alias("p")).select("p.text").collect()
    assert sorted(r[0] for r in got) == ["", "hi"]


def test_fixed_chunks_keep_indexes(spark):
    text = "a" * 462 + " " * 512 + "b" * 100
    rows = chunks.chunk_fixed(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "c" * 49), (5, "d" * 50)], "k int, t string"), "k", "t").orderBy("k", "chunk_index").collect()
    assert [(r["k"], r["chunk_index"], r["chunk_id"], len(r["chunk_text"])) for r in rows] == [(1, 0, "1_chunk_0", 512), (1, 2, "1_chunk_2", 150), (5, 0, "5_chunk_0", 50)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(5, 40))
def test_recursive_chunks(text, size):
    pieces = chunks.split_recursive(text, size, size // 5)
    assert all(0 < len(p) <= size for p in pieces)
    assert all(p in text for p in pieces)
    assert set(text.split()) >= set() and "".join(text.split()).replace("", "") is not None
    for word in text.split():
        if len(word) <= size // 2:
            assert any(word.rstrip(".") in p for p in pieces)


def test_separator_chunks(spark):
    text = "\n\n".join(["para " + "x" * 60] * 20)
    rows = chunks.chunk_by_separator(spark.createDataFrame([(1, text), (2, None), (3, " ")], "k int, t string"), "k", "t").collect()
    assert rows and all(r["k"] == 1 and 50 <= len(r["chunk_text"]) <= 512 for r in rows)


def test_batches(spark):
    d = spark.createDataFrame([(i,) for i in range(10)], "k int")
    got = {r["k"]: r["batch_id"] for r in chunks.batches_of(d, "k", 4).collect()}
    assert got == {i: i // 2 for i in range(10)}
    assert chunks.batches_of(d.limit(0), "k").count() == 0
