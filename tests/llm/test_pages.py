"""Repeated lines, main body, residue and history: small pages, brute force, odd rows."""

import datetime as dt
import random
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import history_dedup, main_body, repeated_lines, residue
from weftline.llm.common import materialize

DDL = "id string, url string, title string, content string, scraped_at timestamp_ntz, site string, low int, h int, t int, n int"
T0 = dt.datetime(2025, 1, 1)
WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split() for b in "lan mer tok vis nor pel das rim gop quet".split()]


def prose(rnd, n=12, k=9):
    return "\n".join(" ".join(rnd.choice(WORDS) for _ in range(k)).capitalize() + "." for _ in range(n))


def page(rnd, site, i, body=None, title="A page"):
    menu = "Home\nStaff\nNews"
    foot = f"Printed 1{i} times\nAll rights reserved by {site}."
    return (f"{site}-{i}", f"https://www.{site}/p/{i}", title, f"{menu}\n{body if body is not None else prose(rnd)}\n{foot}", T0 + dt.timedelta(minutes=i), "x", 1, 2, 3, 4)


ODD = [("null", "https://www.a.example/n", None, None, None, None, None, None, None, None), ("empty", "https://a.example/e", "", "", T0, None, None, None, None, None), ("blank", None, " ", " \n ", T0, None, None, None, None, None)]


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(5)
    rows = [page(rnd, s, i) for s in ("a.example", "b.example") for i in range(40)]
    rows += [("long", "http://a.example/long", "T", prose(rnd, 3000), T0, *[None] * 5)]
    return spark.createDataFrame([*rows, rows[3], *ODD], DDL)


def brute_repeated(rows):
    site = lambda u: u.split("//")[1].split("/")[0].removeprefix("www.") if u else None
    norm = lambda x: "".join(c for c in x.lower() if c.isalpha())
    seen = {r["id"]: r for r in rows}
    pages_of, df = Counter(), Counter()
    for r in seen.values():
        if s := site(r["url"]):
            pages_of[s] += 1
            for x in {norm(x) for x in (r["content"] or "").split("\n")} - {""}:
                df[s, x] += 1
    return {(r["id"], k) for r in seen.values() if (s := site(r["url"])) for k, x in enumerate((r["content"] or "").split("\n")) if norm(x) and df[s, norm(x)] >= 5 and df[s, norm(x)] >= pages_of[s] * 0.1}


def test_repeated_lines_by_brute_force(pages):
    got = {(r["id"], r["line_no"]) for r in repeated_lines.repeated_lines(pages).collect()}
    assert got == brute_repeated(pages.collect()) and got


def test_removal_keeps_the_rest(pages):
    out = {r["id"]: r["content"] for r in repeated_lines.remove_repeated(pages).collect()}
    given = {r["id"]: r["content"] for r in pages.collect()}
    assert out["a.example-3"] == "\n".join(given["a.example-3"].split("\n")[3:-2])
    assert out["null"] is None and out["empty"] == "" and out["long"] == given["long"]


def test_log_likelihood(spark):
    d = spark.createDataFrame([(50, 100, 0, 1000), (1, 100, 10, 1000), (5, 50, 5, 5000)], "a int, b int, c int, d int")
    g = [r[0] for r in d.select(repeated_lines.log_likelihood(*map(F.col, "abcd"))).collect()]
    assert g[0] > 200 and g[1] == 0.0 and 20 < g[2] < g[0]


def test_main_body(pages):
    got = defaultdict(set)
    for r in main_body.outside_lines(pages).collect():
        got[r["id"]].add(r["line_no"])
    for i in range(40):
        n = 3 + 12 + 2
        assert got[f"a.example-{i}"] == {0, 1, 2, n - 2, n - 1}
    assert not got["long"] and "null" not in got and "empty" not in got


def test_looks():
    assert [main_body.look(x) for x in ("  ", "- an item", "1) two", "A | 2 | 3", "This is a sentence.", "A heading", "w " * 17)] == ["z", "b", "b", "t", "p", "h", "l"]
    assert main_body.letters("A-1 b₹ç!") == "abç"


def test_pages_on_empty_tables(spark):
    none = spark.createDataFrame([], DDL)
    for f in (repeated_lines.repeated_lines, repeated_lines.remove_repeated, main_body.outside_lines, residue.residue_pages, history_dedup.repeated_records):
        assert f(none).count() == 0


def test_residue(spark):
    rnd = random.Random(9)
    rows = [page(rnd, "a.example", i, prose(rnd, 14)) for i in range(30)]
    bad = {
        "placeholder": "Dear {{ name }}, welcome.\n" + prose(rnd, 14), "error": "404 Not Found\nThe requested address /x was not found on this server.", "script": "Please enable JavaScript to view this page.",
        "filler": "Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore.", "title": prose(rnd, 14),
    }
    rows += [(k, f"https://a.example/{k}", "Page: [INSERT TITLE]" if k == "title" else "About us", "Home\nStaff\nNews\n" + b, T0, *[None] * 5) for k, b in bad.items()]
    fine = {"spoken": "The template exercise asks students to replace names in double braces such as {{ city }} by real values.\n" + prose(rnd, 14), "about": "The error rate fell, and Access to the hall is denied after 6 pm.\n" + prose(rnd, 14)}
    rows += [(k, f"https://a.example/{k}", "About us", "Home\nStaff\nNews\n" + b, T0, *[None] * 5) for k, b in fine.items()]
    d = spark.createDataFrame([*rows, rows[0], *ODD], DDL)
    assert sorted(r["id"] for r in residue.found_pages(d).collect()) == sorted(bad)


def test_residue_on_long_pages(spark):
    rnd = random.Random(11)
    menu = "\n".join(f"Section {a} {b}" for a in WORDS[:20] for b in WORDS[20:40])
    texts = {f"real{i}": menu + "\n" + prose(rnd, 14) for i in range(30)}
    texts |= {"error": menu + "\n404 Not Found\nThe requested address /x was not found on this server.", "filler": "Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor. " * 120}
    assert all(len(x) > 6000 for x in texts.values())
    d = spark.createDataFrame([(k, f"https://a.example/{k}", "About us", x, T0, *[None] * 5) for k, x in texts.items()], DDL)
    assert sorted(r["id"] for r in residue.found_pages(d).collect()) == ["error", "filler"]


@pytest.mark.parametrize(("text", "is_case"), [("The fee for NaN is due", True), ("Welcome to ${city}!", True), ("{% block x %}", True), ("Seats left: undefined", True), ("Undefined terms are read in the usual sense.", False), ("None of them came.", False), (None, False), ("a null hypothesis", False)])
def test_placeholders(text, is_case):
    assert residue.placeholder_in(text) is is_case


def words(n, seed):
    rnd = random.Random(seed)
    return [rnd.choice(WORDS) for _ in range(n)]


def test_history_by_brute_force(spark):
    rnd = random.Random(3)
    docs, kinds = [], []
    for g in range(12):
        base = words(300, g)
        docs.append((g * 100, base))
        for k in range(4):
            w = list(base)
            if k == 0:
                pass
            elif k == 1:
                del w[40:70]
            elif k == 2:
                for _ in range(12):
                    w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            else:
                w[:150] = words(150, 1000 + g)
            docs.append((g * 100 + 1 + k, w))
    rnd.shuffle(docs)
    rows = []
    for t, w in docs:
        text = " ".join(w).upper() if t % 3 == 0 else "\n".join(" ".join(w[i : i + 9]) + "," for i in range(0, len(w), 9))
        rows.append((f"d{t}", f"https://s{t}.example/x", "t", text, T0 + dt.timedelta(minutes=t), *[None] * 5))
    d = spark.createDataFrame([*rows, rows[0], ("short", "https://q.example", "t", "too short to judge", T0, *[None] * 5), *ODD], DDL)
    accepted, want = [], set()
    for t, w in sorted(docs):
        if any(SequenceMatcher(None, w, a, autojunk=False).ratio() >= 0.8 for a in accepted):
            want.add(f"d{t}")
        else:
            accepted.append(w)
    assert {r["id"] for r in history_dedup.repeated_records(d).collect()} == want


@pytest.mark.parametrize(("n", "share"), [(400, 0.1), (400, 0.15), (400, 0.19), (60, 0.15), (60, 0.19)])
def test_copies_with_scattered_changes(spark, n, share):
    rnd, rows, want = random.Random(n), [], set()
    for g in range(20):
        base = words(n, 5000 + g)
        w = list(base)
        for k in rnd.sample(range(n), int(n * share)):
            w[k] = f"new{g}x{k}"
        for i, (x, day) in enumerate(((base, 0), (w, 1))):
            rows.append((f"d{g}-{i}", f"https://s{g}.example/{i}", "t", " ".join(x), T0 + dt.timedelta(days=day, minutes=g), *[None] * 5))
        want.add(f"d{g}-1")
    assert {r["id"] for r in history_dedup.repeated_records(spark.createDataFrame(rows, DDL)).collect()} == want


def test_an_earlier_holder_that_is_no_match_hides_none(spark):
    a, other = words(300, 71), words(200, 72)
    patch = [*a[:120], *other]
    copy = [w if k % 9 else f"odd{k}" for k, w in enumerate(a)]
    rows = [(f"d{i}", f"https://s{i}.example/", "t", " ".join(x), T0 + dt.timedelta(days=i), *[None] * 5) for i, x in enumerate((patch, a, copy))]
    assert {r["id"] for r in history_dedup.repeated_records(spark.createDataFrame(rows, DDL)).collect()} == {"d2"}


def test_decide_follows_chains(spark):
    e = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 3), (5, 1)], "h long, to_h long")
    assert sorted(r["h"] for r in history_dedup.decide(e).collect()) == [2, 4, 5]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=400), st.integers(0, 400))
def test_sketches_hold_runs_of_the_body(xs, at):
    h = np.array(xs, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    own = set(history_dedup.runs(h, 6, 10**6).tolist())
    part = h[at : at + 100]
    if len(part) >= 6:
        assert set(history_dedup.runs(part, 6, 10**6).tolist()) <= own
    assert len(history_dedup.sketch(h)) <= 48 and set(history_dedup.runs(h, 6, 32).tolist()) <= own


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.lists(st.integers(0, 5), max_size=60))
def test_common_words_in_sequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    assert history_dedup.common_in_sequence(a, b) == row[-1]


def signed(spark, texts, day):
    d = spark.createDataFrame([(k, f"https://{k}.example", "t", v, T0 + dt.timedelta(days=day, minutes=m), *[None] * 5) for m, (k, v) in enumerate(texts.items())], DDL)
    low, shared = main_body.style_tree(d.select(F.lit("x").alias("site"), "content"))
    return materialize(history_dedup.signatures(d, low, spark.sparkContext.broadcast(main_body.load_cutter(shared))), "signed")


def test_history_in_batches(spark, tmp_path, monkeypatch):
    h = history_dedup.History(spark, str(tmp_path / "h"), buckets=4)
    a, b = " ".join(words(200, 1)), " ".join(words(200, 2))
    refused = lambda texts, day: sorted(r[0] for r in h.accept(signed(spark, texts, day)).collect())
    assert refused({"a": a, "b": b, "c": a, "b2": b + " more words"}, 0) == ["b2", "c"]
    # A load that ends halfway adds nothing and can be given again.
    with monkeypatch.context() as m:
        m.setattr(h, "_folder", lambda: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            h.accept(signed(spark, {"x": " ".join(words(200, 9))}, 1))
    held = h.held("bodies").count()
    monkeypatch.setattr(h, "_append", lambda *x, done=[], real=h._append: 1 / 0 if done else done.append(real(*x)))
    with pytest.raises(ZeroDivisionError):
        h.accept(signed(spark, {"x": " ".join(words(200, 9))}, 1))
    monkeypatch.undo()
    assert h.held("bodies").count() == held == 2 and h.held("exact").count() == 3
    new = {"d": a.upper(), "e": b + " more words here", "f": " ".join(words(200, 3)), "f2": " ".join(words(200, 3)), "x": " ".join(words(200, 9)), "b": b}
    assert refused(new, 2) == ["d", "e", "f2"]
    # Another session's view of the same folder goes on from there; a copy of what was refused is refused as well.
    h.drop()
    h = history_dedup.History(spark, str(tmp_path / "h"), buckets=4)
    assert len(h.loads()) == 2 and refused({"g": b + " more words here", "k": " ".join(words(200, 4))}, 3) == ["g"]


@pytest.mark.parametrize("loads", [1, 4])
def test_loads_give_the_same_result(spark, loads):
    rnd, rows, want = random.Random(4), [], set()
    for g in range(6):
        base = words(120, 300 + g)
        for day in range(6):
            w = [x if rnd.random() > 0.05 else f"n{day}{g}" for x in base]
            rows.append((f"d{g}-{day}", f"https://s{g}.example/{day}", "t", " ".join(w), T0 + dt.timedelta(days=day, minutes=g), *[None] * 5))
            want |= {f"d{g}-{day}"} if day else set()
    assert {r["id"] for r in history_dedup.repeated_records(spark.createDataFrame(rows, DDL), loads=loads).collect()} == want


def test_pages_on_the_subject_of_an_error_are_none(spark):
    rnd = random.Random(31)
    rows = [page(rnd, "alpha", i) for i in range(12)]
    real = {"seats": ("404 seats filled", "404 seats filled in the spring round."), "card": ("Card reader", "Please enable the card reader before use."), "fee": ("Refund of the fee", "The fee cannot be refunded after May.")}
    bad = {"gone": ("Spring round", "Error 404: page not found."), "js": ("Library hours", "Please enable JavaScript to continue."), "lorem": ("Sports day", "Lorem ipsum dolor sit amet consectetur adipiscing elit. " * 150)}
    for n, (i, (title, body)) in enumerate([*real.items(), *bad.items()]):
        slug = title.lower().replace(" ", "-")
        rows.append((i, f"https://alpha/p/{slug}", title, f"Home\nStaff\nNews\n{body}\nAll rights reserved by alpha.", T0 + dt.timedelta(minutes=n), "x", 1, 2, 3, 4))
    assert {r["id"] for r in residue.found_pages(spark.createDataFrame(rows, DDL)).collect()} == set(bad)


def test_excess_is_measured_against_other_sites(spark):
    rnd = random.Random(17)
    rows = [(f"{s}{i}", f"https://{s}.example/{i}", "t", "\n".join(["Home", f"Office of {s}", "Shared by few" if (s, i) in {("a", 1), ("b", 2)} else "x", prose(rnd, 3)]), T0, *[None] * 5) for s in "abc" for i in range(8)]
    d = spark.createDataFrame(rows, DDL)
    got = {(r["site"], r["pages"], r["background"], r["others"]) for r in repeated_lines.excess_lines(d).filter("significant AND background = 0").collect()}
    # The line of one site is held against the sixteen pages of the others; one that is dense everywhere against lines in general.
    assert got == {(f"{s}.example", 8, 0.0, 16) for s in "abc"}
    assert repeated_lines.excess_lines(d).filter("significant").count() >= 6


def test_words_and_letters_by_bytes():
    rnd = random.Random(8)
    signs = "abzAZ09 _-.,'\n\x00\x1f\x85\xa0é₹—“ßÅſKİΣ²½٣①हिन्दी中"
    for text in ["".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 80))) for _ in range(2000)]:
        h = history_dedup.Words()
        want = re.findall(r"[^\W_]+", text.lower())
        assert h.of(text).tolist() == [xxhash.xxh3_64_intdigest(w) for w in want] and set(h) == {w.encode() for w in want}
        assert main_body.letters(text) == re.sub(r"[\W\d_]+", "", text.lower())
    a = h.of("one two three one two three one two three")
    assert history_dedup.runs(a, 3, 2).view(np.uint64).tolist() == sorted(set(history_dedup.runs(a, 3, 99).view(np.uint64).tolist()))[:2]


def test_rows_of_one_id_and_time_are_told_apart(spark, tmp_path):
    h = history_dedup.History(spark, str(tmp_path / "h"), buckets=4)
    a, b = " ".join(words(200, 21)), " ".join(words(200, 22))
    rows = [(k, f"https://{k}.example", "t", v, T0 + dt.timedelta(minutes=m), *[None] * 5) for m, k, v in ((0, "x", a), (0, "x", b), (0, "x", a), (1, "y", a + " more words"), (2, "z", b + " more words"))]
    d = spark.createDataFrame(rows, DDL)
    low, shared = main_body.style_tree(d.select(F.lit("x").alias("site"), "content"))
    s = materialize(history_dedup.signatures(d, low, spark.sparkContext.broadcast(main_body.load_cutter(shared))), "signed")
    # The first row of the record counts, with its paragraphs and its words.
    kept = s.filter("id = 'x'").orderBy("row").first()["words"]
    like = "y" if kept == s.filter("id = 'y'").first()["words"][:200] else "z"
    assert s.select("row").distinct().count() == 5 and {r[0] for r in h.accept(s).collect()} == {like}
    assert h.held("bodies").count() == 2


def test_letters_of_lines_and_sketches_of_many_bodies():
    rnd = random.Random(9)
    signs = "abzAZ09 _-.,'\n\n\n\x1f\x85\xa0é₹—ßſKİΣ²½٣①हि中"
    for text in ["".join(rnd.choice(signs) for _ in range(rnd.randrange(0, 90))) for _ in range(1000)]:
        assert [x.decode() for x in main_body.line_letters(text)] == [main_body.letters(x) for x in text.split("\n")]
    bodies = [np.array([rnd.randrange(1 << 64) for _ in range(n)], np.uint64) for n in [1, 2, 3, 5, 6, 7, 199, 200, 450, *(rnd.randrange(1, 30) for _ in range(600))]]
    for h, got in zip(bodies, history_dedup.sketches(bodies), strict=True):
        want = history_dedup.runs(h, history_dedup.LONG_RUN, history_dedup.LONG_SKETCH).tolist()
        if len(h) < history_dedup.SHORT_BODY:
            want += history_dedup.runs(h, history_dedup.SHORT_RUN, history_dedup.SHORT_SKETCH).tolist()
        assert got.tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=60), st.lists(st.integers(0, 5000), max_size=9), st.integers(0, 60))
def test_agreement_is_exact_from_the_least_share_on(a, new, at):
    b = a[:at] + new + a[at + len(new) :]
    share = 2 * history_dedup.common_in_sequence(a, b) / (len(a) + len(b))
    got = history_dedup.agreement(np.array(a, np.int32), np.array(b, np.int32))
    assert got == share if share >= history_dedup.SAME else got < history_dedup.SAME


def test_a_load_reads_its_own_rows_alone(spark, monkeypatch):
    read = []
    accept = history_dedup.History.accept

    def seen(self, signed):
        read.append((signed.count(), spark.read.parquet(*{r[0] for r in signed.select(F.input_file_name()).collect()}).count()))
        return accept(self, signed)

    monkeypatch.setattr(history_dedup.History, "accept", seen)
    a, b = " ".join(words(200, 31)), " ".join(words(200, 32))
    rows = [(k, f"https://{k}.example", "t", v, T0 + dt.timedelta(days=day), *[None] * 5) for day, k, v in ((0, "x", a), (1, "y", b), (8, "z", a), (9, "w", b + " more words"))]
    got = {r["id"] for r in history_dedup.repeated_records(spark.createDataFrame(rows, DDL).coalesce(1)).collect()}
    assert got == {"z", "w"}
    # Nothing but the rows of a load lies in the files it reads.
    assert read == [(2, 2), (2, 2)]
