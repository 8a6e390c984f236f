"""Conversations, pairs and personal information."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import conversations as C
from weftline.llm import pairs as P
from weftline.llm import pii

DDL = "id string, conversation_id string, role string, content string, created_at timestamp_ntz, user_id string, part int, rank int, c string, said string, hot boolean"
T0 = dt.datetime(2025, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def rows(c, turns):
    return [(f"{c}{i}", c, role, text, at(s) if s is not None else None, *[None] * 6) for i, (role, text, s) in enumerate(turns)]


CASES = {
    "fine": ([("system", "Be kind.", 0), (" USER ", "a", 1), ("bot", "b", 2), ("Human", "c", 60), ("model", "d", 60)], False),
    "twice": ([("user", "a", 1), ("user", "a", 9), ("assistant", "b", 20), ("assistant", "b", 30)], False),
    "late_repeat": ([("user", "a", 1), ("user", "a", 12), ("assistant", "b", 20)], True),
    "equal_times": ([("assistant", "b", 5), ("user", "a", 5)], False),
    "no_reply": ([("user", "a", 1)], True),
    "starts_wrong": ([("assistant", "b", 1), ("user", "a", 2), ("assistant", "c", 3)], True),
    "no_time": ([("user", "a", 1), ("assistant", "b", None)], True),
    "role": ([("user", "a", 1), ("tool", "x", 2), ("assistant", "b", 3)], True),
    "null_role": ([("user", "a", 1), (None, "b", 2)], True),
    "blank": ([("user", "?!", 1), ("assistant", "b", 2)], True),
    "null_text": ([("user", None, 1), ("assistant", "b", 2)], True),
    "only_system": ([("system", "x", 1)], True),
}


@pytest.fixture(scope="module")
def messages(spark):
    out = [r for c, (turns, _) in CASES.items() for r in rows(c, turns)]
    return spark.createDataFrame([*out, out[2], ("lost", None, "user", "x", at(1), *[None] * 6)], DDL)


def talks(spark):
    return spark.createDataFrame([("fine",), ("nobody",), (None,)], "id string")


def want():
    return sorted([c for c, (_, bad) in CASES.items() if bad] + ["nobody"])


def test_broken_conversations(spark, messages):
    assert sorted(r[0] for r in C.broken_conversations(messages, talks(spark)).collect()) == want()


def test_links_reach_as_far_as_the_score(spark, monkeypatch):
    def at_back(back):
        said = [("user", "where does library parking permit renewal happen", 0)] + [("user", f"other{k} matter{k} stands{k} here{k}", 1 + k * 30) for k in range(back - 1)]
        return rows(f"far{back}", [*said, ("assistant", "library parking permit renewal does happen where", back * 30)])

    d = spark.createDataFrame([x for back in (2, 4, 9, 12) for x in at_back(back)], DDL)
    links = lambda: {(r["id"], r["parent"], r["score"]) for r in C.reply_links(d).collect()}
    whole = links()
    assert {(f"far{b}{b}", f"far{b}0") for b in (2, 4, 9, 12)} <= {x[:2] for x in whole}
    monkeypatch.setattr(C, "HOT", 1)
    monkeypatch.setattr(C, "BLOCK", 3)
    assert links() == whole


def test_hot_conversations_give_the_same(spark, messages, monkeypatch):
    monkeypatch.setattr(C, "HOT", 1)
    assert sorted(r[0] for r in C.broken_conversations(messages, talks(spark)).collect()) == want()
    got = {(r["conversation_id"], r["position"]): r["content"] for r in C.rebuilt(messages, talks(spark)).collect()}
    assert [got["fine", i] for i in range(5)] == ["Be kind.", "a", "b", "c", "d"]
    assert C.reply_pairs(messages).filter("id = 'fine4'").count() == 1


def test_random_conversations_by_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    all_rows = []
    for c in range(60):
        t, turns = 0, []
        for _ in range(rnd.randrange(1, 9)):
            t += rnd.choice([0, 3, 50, 70])
            turns.append((rnd.choice(["user", "assistant", "assistant", "user", "system"]), rnd.choice("ab"), t))
        all_rows += rows(f"k{c}_", turns)
    rank = {"system": 0, "user": 1, "assistant": 2}
    d = spark.createDataFrame(all_rows, DDL)
    said = {r["id"]: r["h"] for r in d.select("id", F.xxhash64("content").alias("h")).collect()}
    broken = set()
    for c in {r[1] for r in all_rows}:
        own = sorted((r for r in all_rows if r[1] == c), key=lambda r: (r[4], rank[r[2]], said[r[0]], r[0]))
        kept = [r for i, r in enumerate(own) if not (i and own[i - 1][2:4] == r[2:4] and (r[4] - own[i - 1][4]).total_seconds() <= 10)]
        roles = [r[2] for r in kept if r[2] != "system"]
        if not roles or len(roles) % 2 or any(x != ("user", "assistant")[i % 2] for i, x in enumerate(roles)):
            broken.add(c)
    none = spark.createDataFrame([], "id string")
    for hot in (100_000, 2):
        monkeypatch.setattr(C, "HOT", hot)
        assert {r[0] for r in C.broken_conversations(d, none).collect()} == broken


def test_links(messages):
    got = {r["id"]: r["parent"] for r in C.reply_links(messages).filter("conversation_id = 'fine'").collect()}
    assert got == {"fine1": None, "fine2": "fine1", "fine3": "fine2", "fine4": "fine3"}


def test_chats_on_empty_tables(spark):
    none = spark.createDataFrame([], DDL)
    fees = spark.createDataFrame([], "pair_id long, question string, answer string, updated_at timestamp_ntz")
    assert C.broken_conversations(none, none.select("id")).count() == 0
    assert C.rebuilt(none, none.select("id")).count() == C.reply_links(none).count() == P.defective_pairs(fees, none).count() == pii.found_kinds(none).count() == 0


@pytest.mark.parametrize(("text", "lang"), [("What is the fee for this course?", "en"), ("Wann endet die Bewerbungsfrist für das Wohnheim?", "de"), ("El plazo termina el 3 de mayo para los nuevos", "es"), ("Les étudiants déposent leur dossier avant le 3", "fr"), ("फीस कितनी है?", "hi"), ("Fees 3000 hai, aap ise de sakte hain", "hi"), ("学费是多少？", "zh"), ("₹3,000", None), ("No.", None)])
def test_languages(text, lang):
    assert P.language(text)[0] == lang


def test_pairs(spark):
    topics = {"fee": ["What is the annual fee for {}?", "How much does {} cost per year"], "bus": ["When does the bus leave {}?", "Does the bus go to {}?"], "form": ["Is the {} form still open?", "When is the last date to apply for {}?"], "room": ["How much is a shared room in {}?", "Does {} have single rooms?"], "aid": ["Is there any scholarship for {}?", "How do I get a waiver in {}?"]}
    answers = {"fee": "You will pay ₹{n},000 per year.", "bus": "Buses leave the gate at {n} pm.", "form": "The form stays open until {n} May, and lists are put up at the hall.", "room": "Rooms start at ₹{n},500, with laundry and network access included.", "aid": "Students with at least {n}% marks receive a waiver."}
    rnd = random.Random(2)
    good, bad = [], []
    names = ["Solar Optics", "Rural Design", "Marine Ceramics", "Civic Robotics"]
    for i in range(400):
        t = rnd.choice(list(topics))
        q = rnd.choice(topics[t]).format(rnd.choice(names))
        good.append((q, answers[t].format(n=rnd.randrange(10, 60)), None))
        if i % 8 == 0:
            bad.append((q, rnd.choice(["I'm sorry, but I can't help with that.", "My guidelines prevent me from answering."]), "refusal"))
    q = "What is the annual fee for Solar Optics?"
    bad += [(q, None, "empty"), (q, " \n", "empty"), (q, "N/A", "empty"), (q, "-", "empty"), (q, q, "copied_question"), (q, f"You asked: {q}", "copied_question"), (q, "La caution est rendue à la fin du semestre pour les étudiants.", "wrong_language"),
            (q, "You will pay ₹30,000 per year. The form stays open until 3 May, and lists are put", "truncated"), (q, "Rooms start at ₹3,500, with laundry and", "truncated")]
    good += [("Reply in French please. " + q, "La caution est rendue à la fin du semestre pour les étudiants.", None), (q, "₹30,000", None), (q, "Rooms start at ₹3,500, with laundry and network access included", None), (None, "You will pay ₹30,000 per year.", None), (q, q + " You will pay ₹30,000 per year.", None)]
    all_ = good + bad
    fees = spark.createDataFrame([(i, q, a, T0) for i, (q, a, _) in enumerate(all_)] + [(0, q, None, T0 - dt.timedelta(days=1)), (None, q, None, T0)], "pair_id long, question string, answer string, updated_at timestamp_ntz")
    got = {int(r["pair_id"]): r["defect"] for r in P.defective_pairs(fees, spark.createDataFrame([], DDL)).collect()}
    assert {i: all_[i][2] for i in range(len(all_)) if all_[i][2]} == got


def test_chat_pairs(spark, messages):
    none = spark.createDataFrame([], "pair_id long, question string, answer string, updated_at timestamp_ntz")
    assert {tuple(r) for r in P.defective_pairs(none, messages).collect()} <= {("chat", r["id"], d) for r in messages.collect() for d in ("truncated", "empty", "refusal", "copied_question", "wrong_language")}
    assert {r["id"] for r in C.reply_pairs(messages).collect()} >= {"fine2", "fine4", "equal_times0"}


@pytest.fixture(scope="module")
def found(spark):
    texts = {
        "mail": "Write to me at anna.kov@mail.example please", "dots": "My mail is anna.kov [at] mail [dot] example", "phone": "Call me on +91 55512 34567.", "id": "passport no. Z 0712345", "addr": "I live at 14, Willow Road, Coppervale 034567.",
        "name": "My name is Bereth Quormere.", "none": "The receipt no. is 3948939195. Does Willow Hall have single rooms?", "null": None, "empty": "", "blank": "  ", "long": "What is the fee? " * 20000 + "Call me on +91 55512 34567.",
    }
    d = spark.createDataFrame([(k, v, 1, "x", 0) for k, v in texts.items()] + [("mail", texts["mail"], 2, "y", 1)], "id string, content string, start int, kind string, labels int")
    return d, {(r["id"], r["kind"]) for r in pii.found_kinds(d).collect()}, {r["id"]: r["content"] for r in pii.redacted(d).collect()}


def test_personal_information(found):
    assert found[1] == {("mail", "email"), ("dots", "email"), ("phone", "phone"), ("id", "id_number"), ("addr", "address"), ("name", "name"), ("long", "phone")}


def test_placeholders_keep_the_rest(found):
    red = found[2]
    assert red["phone"] == "Call me on [PHONE]." and red["name"] == "My name is [NAME]." and red["null"] is None and red["empty"] == ""
    assert red["none"].startswith("The receipt no. is 3948939195.") and red["long"].endswith("Call me on [PHONE].")


def test_held_out_frames():
    """On frames that training doesn't see, with fillings of their own."""
    model = pii._trained(frozenset())
    held = [pii.tagged(t, s) for t, s in pii.labelled_table(500, seed=77, held_out=True)]
    got = model.decode([w for w, _ in held])
    right = sum(int((g == y).sum()) for g, (_, y) in zip(got, held))
    assert right / sum(len(y) for _, y in held) > 0.93
    for seen, kept in zip(pii._frames(False), pii._frames(True)):
        assert not set(seen) & set(kept) and kept


@pytest.mark.parametrize(("text", "kind"), [("the road will close on 16, they say", "address"), ("Foxford House", "name"), ("B", "name"), ("详情请咨询管理课程", "name")])
def test_forms_reject(text, kind):
    assert not pii.plausible(kind, text, "")


def test_interleaved_threads_form_trees(spark):
    t = lambda k: dt.datetime(2025, 3, 1, 10, 0, k)
    said = [("u", "hostel mess timings for vegetarian breakfast"), ("u", "refund deadline after semester withdrawal"), ("a", "vegetarian breakfast timings in the hostel mess: seven"),
            ("a", "withdrawal before the deadline gives the refund of the semester"), ("u", "breakfast timings on holidays, hostel mess"), ("a", "holidays: hostel mess breakfast at eight")]
    two = [(f"m{k}", "two", x, r, t(k)) for k, (r, x) in enumerate(said)]
    one = [(f"n{k}", "one", x, r, t(k)) for k, (r, x) in enumerate([("user", "hello there"), ("assistant", "good morning"), ("user", "and the fee"), ("assistant", "ten thousand")])]
    d = spark.createDataFrame([(i, c, x, {"u": "user", "a": "ai"}.get(r, r), s) for i, c, x, r, s in two + one], "id string, conversation_id string, content string, role string, created_at timestamp_ntz")
    parents = {r["id"]: r["parent"] for r in C.reply_links(d).collect()}
    assert (parents["m0"], parents["m1"], parents["m2"], parents["m3"], parents["m5"]) == (None, None, "m0", "m1", "m4")
    trees = {(r["conversation_id"], r["root"]): (r["turns"], r["depth"], r["leaves"]) for r in C.reply_trees(d).collect()}
    assert trees["one", "n0"] == (4, 4, 1) and trees["two", "m1"][0] == 2 and trees["two", "m0"][0] == 4 and len(trees) == 3
    ids = spark.createDataFrame([("one",), ("two",)], "id string")
    assert [r[0] for r in C.broken_conversations(d, ids).collect()] == ["two"] and C.reply_trees(d.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "refuses"), [("I can't help with form 16, sorry.", True), ("The library is large. Still, I am unable to answer that.", True), ("It opens at ten. " * 40 + "I cannot discuss this topic.", True), ("Refunds are not given after 12 May.", False)])
def test_declining_anywhere(text, refuses):
    assert P.declines(text) == refuses


def test_refusals_in_other_words_by_their_cluster(spark):
    same = "Regrettably rules that bind me forbid that"
    prompts = [f"what is the {w} of the {v}" for w in ("fee", "date", "price", "place", "form") for v in ("hostel", "library", "bus")]
    rows = [(k, q, f"{same}, so I cannot answer {q[:9]}." if k % 2 else f"{same} entirely, dear reader.") for k, q in enumerate(prompts)]
    rows += [(100 + k, q, f"{q.split()[-1].title()} matters are settled by office number {k} on the ground floor.") for k, q in enumerate(prompts)]
    fees = spark.createDataFrame([(k, "s", q, a, dt.datetime(2025, 1, 1)) for k, q, a in rows], "pair_id long, section string, question string, answer string, updated_at timestamp_ntz")
    none = spark.createDataFrame([], "id string, conversation_id string, content string, role string, created_at timestamp_ntz")
    got = {(r["pair_id"], r["defect"]) for r in P.defective_pairs(fees, none).collect()}
    assert {x for x in got if x[1] == "refusal"} == {(str(k), "refusal") for k in range(len(prompts))}
    assert P.is_copy("Is it open?", "- " * 60 + "Is it open?") and P.is_empty(" " * 60 + "N/A") and not P.is_copy("Is it open?", "It is open until nine. " * 20)


def test_declining_is_looked_for_where_it_can_be(monkeypatch):
    def in_each_sentence(answer):
        text = P._LEAD.sub("", answer)
        return any(P._declining(" ".join(P.mask_words(s))) or bool(P._REFUSE_LATIN.search(s)) for s in P.sentences(text.replace("’", "'")))

    rnd = random.Random(12)
    parts = "I can't cannot Not not, no comment comment, pass on off limits declıne refuſe outside help answer this question. Sorry sorry, Leider! no puedo nicht sagen désolé Rs. 5 \n ? fees are due".split(" ")
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14))) for _ in range(3000)]
    assert [P.declines(t) for t in texts] == [in_each_sentence(t) for t in texts] and 0 < sum(map(P.declines, texts)) < 3000
    # An answer without a word of declining costs neither sentences nor masks.
    monkeypatch.setattr(P, "sentences", lambda text: 1 / 0)
    assert not P.declines("The fee is Rs. 500. It is due on 3 May at the office of the registrar.")
