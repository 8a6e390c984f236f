"""Encoding, leakage and abusive content."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import abuse, encode, leakage

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    t = tokenizers.Tokenizer.from_file(encode.default_vocabulary())
    t.encode_special_tokens = True
    return encode.encoder(encode.default_vocabulary()), t


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_tokenizer(text):
    e = encode.encoder(encode.default_vocabulary())
    t = test_ids_equal_the_tokenizer.__dict__.setdefault("t", tokenizers.Tokenizer.from_file(encode.default_vocabulary()))
    t.encode_special_tokens = True
    assert e.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_long_pieces_and_special_strings(both):
    e, t = both
    rnd = random.Random(1)
    for text in (" " * 5000, "a" * 20000, "ab" * 5000, "<|endoftext|> x", "".join(rnd.choice("abcdefgh") for _ in range(20000)), "🎓" * 300, "हिन्दी" * 200, "\r\n\t \n"):
        assert e.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_encode_table(spark, both):
    d = spark.createDataFrame([(1, "Hello world", 9), (2, None, 9), (3, "", 9), (1, "Hello world", 9)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in encode.encode_texts(d).collect())
    hello = tuple(both[1].encode("Hello world").ids)
    assert got == [(1, hello), (1, hello), (2, ()), (3, ())]
    assert encode.encode_texts(d.limit(0)).count() == 0


NOUNS = "almanac bell causeway diary engine folio garden hammer island jacket kettle lantern meadow needle orchard pillar quarry ribbon saddle temple umbrella valley window yarn zebra".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(NOUNS) + str(rnd.randrange(90)) for _ in range(n))


def test_leaks(spark):
    rnd = random.Random(4)
    items = {i: sentence(rnd, 60) for i in range(5)}
    w = {i: t.split() for i, t in items.items()}
    changed = w[1][5:35]
    changed[12] = "other"
    docs = {
        1: sentence(rnd, 50) + " " + items[0] + " " + sentence(rnd, 20), 2: sentence(rnd, 30) + " " + " ".join(changed).upper().replace(" ", ",\n") + " end", 3: " ".join(w[2][:12]) + " " + sentence(rnd, 100), 4: None, 5: "", 6: "  ",
        7: sentence(rnd, 30000) + " " + " ".join(w[3][20:41]), 8: " ".join(w[4][:22]).replace("0", "\\u0030").replace("1", "&#49;"), 9: " ".join(w[0][:9] + ["x", "y", "z"] + w[0][12:20]),
    }
    d = spark.createDataFrame([*docs.items(), (1, docs[1])], "doc_id long, text string").selectExpr("*", "1 AS item_id", "'q' AS seed", "2 AS at")
    e = spark.createDataFrame([*items.items(), (77, None), (78, "")], "item_id long, text string").selectExpr("*", "3 AS doc_id")
    want = {(1, 0), (2, 1), (7, 3), (8, 4)}
    assert {tuple(r) for r in leakage.found_leaks(d, e).collect()} == want
    assert leakage.found_leaks(d, e.limit(0)).count() == leakage.found_leaks(d.limit(0), e).count() == 0


@pytest.mark.parametrize("lookup", [3, 10**6])
def test_short_items_are_found_whole(spark, monkeypatch, lookup):
    monkeypatch.setattr(leakage, "LOOKUP_ROWS", lookup)
    rnd = random.Random(8)
    items = {n: " ".join(f"w{n}x{k}" for k in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 12, 19)} | {100: "- one, two -- three!"}
    around = lambda t: f"{sentence(rnd, 30)} {t.upper()}. {sentence(rnd, 5)} {t} {sentence(rnd, 9)}"
    docs = {**{n: around(t) for n, t in items.items()}, **{200 + n: around(" ".join(t.split()[:-1])) for n, t in items.items() if n > 1}}
    d = spark.createDataFrame([*docs.items()], "doc_id long, text string")
    e = spark.createDataFrame([*items.items()], "item_id long, text string")
    assert {tuple(r) for r in leakage.found_leaks(d, e).collect()} == {(n, n) for n in items}


def test_leaks_without_lookup_table(spark, monkeypatch):
    monkeypatch.setattr(leakage, "LOOKUP_ROWS", 3)
    rnd = random.Random(6)
    item = sentence(rnd, 40)
    d = spark.createDataFrame([(1, "so " + item), (2, sentence(rnd, 40))], "doc_id long, text string")
    assert [tuple(r) for r in leakage.found_leaks(d, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()] == [(1, 5)]


def test_masks_find_every_stretch_with_two_changes():
    for i in range(20):
        for j in range(i + 1, 20):
            same = [k not in (i, j) for k in range(20)]
            assert any(all(same[s + k] for k, c in enumerate(m) if c == "1") for m in leakage.MASKS for s in range(20 - len(m) + 1)), (i, j)


def test_plain():
    assert leakage.plain("It&#39;s A\\u0041 café so­ft") == "its aa café soft"


def test_undisguised():
    assert abuse.undisguised("You i d i o t, l053r, fooool, m​oron") == "you idiot, loser, fol, moron"
    assert "bt-487" in abuse.undisguised("Order BT-487 is late")


BAD = ["You are a {} and everyone hates you.", "Shut your mouth, you {} clown!", "What a pathetic {} that clerk is."]
SLURS = ["idiot", "moron", "loser", "scumbag", "imbecile", "dumbass"]


def toxic_table(rnd, n):
    plain = lambda: " ".join(f"The {rnd.choice(NOUNS)} of {rnd.choice(NOUNS)} holds {rnd.randrange(99)} {rnd.choice(NOUNS)}s at the {rnd.choice(NOUNS)}." for _ in range(6))
    good = [plain() for _ in range(n)]
    bad = [plain() + " " + rnd.choice(BAD).format(rnd.choice(SLURS)) + " " + plain() for _ in range(n // 10)]
    return good, bad


def test_held_out_abuse(spark):
    rnd = random.Random(12)
    good, bad = toxic_table(rnd, 300)
    docs = [(i, t, f"s{i % 3}") for i, t in enumerate([*bad, *good])]
    labels = [(i, rnd.choice(abuse.BAD)) for i in range(len(bad))] + [(len(bad) + i, "none") for i in range(80)] + [(0, None), (1, "unsure"), (None, "none")]
    d = spark.createDataFrame([*docs, (9001, None, "s0"), (9002, "", "s1"), (9003, " \n", None), (9004, "word " * 100000, "s2")], "doc_id long, text string, source string").selectExpr("*", "true AS bad", "0.5 AS score")
    lab = spark.createDataFrame(labels, "doc_id long, category string").selectExpr("*", "'x' AS bad")
    got = {r["doc_id"] for r in abuse.found_bad(d, lab).collect()}
    truth = set(range(len(bad)))
    assert len(got & truth) >= 0.9 * len(truth) and len(got - truth) <= 0.02 * len(good)
    rates = {r["source"]: r for r in abuse.source_rates(d, lab).collect()}
    assert sum(r["documents"] for r in rates.values()) == len(docs) + 4
    assert abuse.found_bad(d, lab.limit(0)).count() == 0 and abuse.found_bad(d.limit(0), lab).count() == 0
    model = abuse.fit(d, lab)
    fresh_good, fresh_bad = toxic_table(random.Random(99), 100)
    assert np.mean([model.text(t) > model.threshold for t in fresh_bad]) >= 0.9 and np.mean([model.text(t) > model.threshold for t in fresh_good]) <= 0.03


def test_prior_and_threshold():
    rng = np.random.default_rng(1)
    bad, clear = rng.normal(3, 1, 400), rng.normal(-3, 1, 4000)
    mixed = np.concatenate((rng.normal(3, 1, 500), rng.normal(-3, 1, 9500)))
    assert abs(abuse.estimated_prior(bad, clear, mixed) - 0.05) < 0.01
    # Reviewed texts over-represent bad ones; the rarer those are, the higher the threshold.
    assert abuse.best_threshold(bad, clear + 4, 0.01) > abuse.best_threshold(bad, clear + 4, 0.3)


def test_scores_of_texts_together_and_alone():
    rnd = random.Random(3)
    good, bad = toxic_table(rnd, 120)
    model = abuse.train(bad[:12], good[:60], good[60:], 0.05)
    texts = [*bad, None, "", "\n \n", "x", "中文没有空格。第二句！", *good[:20], "word " * 5000]
    alone = np.array([model.text(t) for t in texts])
    assert np.allclose(model.texts(texts), alone) and (alone[len(bad) : len(bad) + 3] == abuse.NOTHING).all()
    # The worst stretch of a long passage counts: plain words around it change little.
    assert model.text("the hall holds four tables " * 30 + bad[0].split(". ")[0]) >= model.text("the hall holds four tables " * 30) - 1e-6


def test_longest_is_the_best_overlap_that_counts():
    rng = np.random.default_rng(5)
    for _ in range(300):
        item, document = rng.integers(0, 3, int(rng.integers(1, 50))).astype(np.uint64), rng.integers(0, 3, int(rng.integers(1, 80))).astype(np.uint64)
        words = np.sort(rng.integers(0, len(item), len(item))).astype(np.int32)
        shifts = np.arange(-len(item), len(document))
        best = max(leakage.overlap(item, words, document, int(s)) for s in shifts)
        least = min(leakage.LEAST_WORDS, int(words[-1] - words[0]) + 1)
        got = leakage.longest(item, words, document, shifts)
        assert got == best if best >= least else got < least
