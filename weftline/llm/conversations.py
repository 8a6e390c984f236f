"""Rebuilding conversations from message rows.

Repeated deliveries are merged and the rows of a conversation are put in order. Every turn gets its likeliest parent among the
turns before it, scored by time, mention, speaker and lexical overlap; a turn that nothing before it is likely to have asked for
is a root. The links form trees. A conversation whose turns are one chain of links, from a user to an assistant and so on, is
whole; where the links branch, or leave several roots, the exact rule of alternating turns follows. Ordering works on a
conversation at a time, and on minutes of it where a conversation has more than HOT rows, with the borders joined afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import guarded_broadcast, materialize

HOT = 100_000
REPEAT_SECONDS = 10
#: What a score has for another speaker, at most for words, and less for each place back. Time never favours the older turn,
#: so further back than HORIZON no turn can win against the one directly before.
SPEAKER, OVERLAP, PLACE = 2.0, 1.2, 0.05
#: A link needs this score: another speaker, or a recent turn with words in common.
LINKED = 1.5
HORIZON = 1 + round((SPEAKER + OVERLAP) / PLACE)
#: Turns are looked through in blocks of so many, each with the HORIZON turns before it.
BLOCK = 2000


def role_of(role: Column) -> Column:
    """u, a, s for the roles that name a speaker, x for all others and null."""
    r = F.lower(F.regexp_replace(F.coalesce(role, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(r.isin("user", "human"), "u").when(r.isin("assistant", "ai", "bot", "model"), "a").when(r == "system", "s").otherwise("x")


def _word_set(content: Column) -> Column:
    """The hashes of a text's words of four letters or more, for lexical overlap."""
    words = F.filter(F.split(F.lower(F.coalesce(content, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 3)
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


class Turns:
    """Rows of messages, one per delivered id, and whether any conversation is hot."""

    def __init__(self, rows: DataFrame, hot: bool) -> None:
        self.rows, self.hot = rows, hot
        #: Parts matter only where a conversation is hot.
        self.keys = ("c", "part") if hot else ("c",)

    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*_ORDER)

    def over(self, rows: DataFrame) -> Turns:
        return Turns(rows, self.hot)


_ORDER = ("t", "rank", "said", "id")


def turns(messages: DataFrame, *, with_content: bool = False, for_links: bool = False) -> Turns:
    """One row per delivered id with a conversation: id, c (conversation), part, t, role, rank, said (content hash), filled.

    ``part`` is 0, and the minute in conversations of more than HOT rows. Of differing rows of one id the earliest counts.
    """
    bits = [_word_set(F.col("content")).alias("words"), F.coalesce(F.col("content").rlike(r"(^|\s)@\w"), F.lit(False)).alias("mention")] if for_links else []
    rows = messages.filter("conversation_id IS NOT NULL").select(
        "id", F.col("conversation_id").alias("c"), F.col("created_at").cast("timestamp_ntz").alias("t"), role_of(F.col("role")).alias("role"),
        F.xxhash64(F.coalesce("content", F.lit("\0"))).alias("said"), F.coalesce(F.col("content").rlike(r"[\p{L}\p{N}]"), F.lit(False)).alias("filled"),
        *bits, *([F.col("content")] if with_content else []))
    key = F.struct(F.col("t").isNull().alias("none"), "t", "c", "role", "said")
    rest = [c for c in rows.columns if c != "id"]
    one = rows.groupBy("id").agg(F.min_by(F.struct(*rest), key).alias("r")).select("id", "r.*")
    hot = materialize(messages.groupBy(F.col("conversation_id").alias("c")).count().filter((F.col("count") > HOT) & F.col("c").isNotNull()).select("c", F.lit(True).alias("hot")), "hot-conversations")
    any_hot = not hot.isEmpty()
    rank = F.when(F.col("role") == "s", 0).when(F.col("role") == "u", 1).when(F.col("role") == "a", 2).otherwise(3)
    if any_hot:
        minute = F.coalesce(F.unix_micros(F.col("t").cast("timestamp")) / 60_000_000, F.lit(-1.0)).cast("long") + 1
        one = one.join(guarded_broadcast(hot), "c", "left").withColumn("part", F.when(F.col("hot"), minute).otherwise(F.lit(0).cast("long"))).drop("hot")
    else:
        one = one.withColumn("part", F.lit(0).cast("long"))
    return Turns(one.withColumn("rank", rank), any_hot)


def with_previous(turns: Turns, value: Column, name: str, back: int = 1) -> Turns:
    """Adds ``value`` of the row ``back`` places before in the conversation; across parts of hot conversations only for one place."""
    rows = turns.rows
    out = rows.withColumn(name, F.lag(value, back).over(turns.window()))
    if back > 1 or not turns.hot:
        return turns.over(out)
    # Borders: the last row of the part before. Only hot conversations have parts above 0.
    ends = rows.filter("part > 0").groupBy("c", "part").agg(F.max_by(value, F.struct(*_ORDER)).alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy("c").orderBy("part"))).filter("_end IS NOT NULL")
    out = out.join(guarded_broadcast(materialize(ends, "part-ends")), ["c", "part"], "left")
    return turns.over(out.withColumn(name, F.when(F.col(name).isNull(), F.col("_end")).otherwise(F.col(name))).drop("_end"))


def merged(messages: DataFrame, *, with_content: bool = False, for_links: bool = False) -> Turns:
    """``turns`` without the rows that repeat role and content of the row before within REPEAT_SECONDS."""
    rows = with_previous(turns(messages, with_content=with_content, for_links=for_links), F.struct("role", "said", "t"), "before")
    seconds = (F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.col("before.t").cast("timestamp"))) / 1e6
    again = (F.col("before.role") == F.col("role")) & (F.col("before.said") == F.col("said")) & (seconds <= REPEAT_SECONDS)
    return rows.over(rows.rows.filter(~F.coalesce(again, F.lit(False))).drop("before"))


def _score(p: Column) -> Column:
    """How likely a turn before is the parent: speaker, time, lexical overlap, mention."""
    seconds = (F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(p["t"].cast("timestamp"))) / 1e6
    both = F.size(F.array_intersect(F.col("words"), p["words"]))
    common = both / F.greatest(F.size("words") + F.size(p["words"]) - both, F.lit(1))
    return F.when(p["role"] != F.col("role"), SPEAKER).otherwise(0.0) + F.exp(-F.greatest(seconds, F.lit(0.0)) / 600) + common + F.when(F.col("mention"), (OVERLAP - 1) * common).otherwise(0.0)


def _linked(rows: Turns) -> DataFrame:
    """(c, id, role, t, n, before, best) of the turns of users and assistants: number, role of the turn before, likeliest parent.

    A turn's candidates are all turns before it of its conversation that can win: the HORIZON turns before. Turns are
    numbered, and a block of a conversation takes the last turns of the block before along.
    """
    rows = rows.over(rows.rows.filter("role IN ('u', 'a') AND t IS NOT NULL"))
    numbered = rows.rows.withColumn("n", F.row_number().over(rows.window()))
    if rows.hot:
        before = rows.rows.filter("part > 0").groupBy("c", "part").count().withColumn("_before", F.sum("count").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
        numbered = numbered.join(guarded_broadcast(materialize(before, "part-sizes")), ["c", "part"], "left").withColumn("n", F.col("n") + F.coalesce("_before", F.lit(0)))
    block = F.floor((F.col("n") - 1) / BLOCK)
    last = F.floor((F.col("n") - 1 + HORIZON) / BLOCK)
    spread = numbered.select("c", "id", "role", "t", "words", "mention", "n", block.alias("own"), F.explode(F.sequence(block, last)).alias("block"))
    near = Window.partitionBy("c", "block").orderBy("n").rowsBetween(-HORIZON, -1)
    seen = spread.withColumn("earlier", F.collect_list(F.struct("id", "role", "t", "words", "n")).over(near)).filter("block = own")
    # Nearer candidates win ties.
    scored = F.transform("earlier", lambda p: F.struct((_score(p) - PLACE * (F.col("n") - p["n"])).alias("score"), p["n"].alias("near"), p["id"].alias("parent"), p["role"].alias("role")))
    best = F.array_max(scored)
    return seen.select("c", "id", "role", "t", "n", F.try_element_at("earlier", F.lit(-1))["role"].alias("before"), F.when(best["score"] >= LINKED, best).alias("best"))


def reply_links(messages: DataFrame) -> DataFrame:
    """(conversation_id, id, role, created_at, parent, score) of every turn of a user or assistant; roots have no parent.

    Rows without a time or of another role have no link. An empty table gives no rows.
    """
    linked = _linked(merged(messages, for_links=True))
    return linked.select(F.col("c").alias("conversation_id"), "id", "role", F.col("t").alias("created_at"), F.col("best.parent").alias("parent"), F.round("best.score", 6).alias("score"))


def reply_trees(messages: DataFrame) -> DataFrame:
    """(conversation_id, root, turns, depth, leaves) of every tree of links.

    Every turn takes its parent's ancestor for its own, which doubles the way each time, until all have come to their roots.
    """
    links = materialize(reply_links(messages).select("conversation_id", "id", "parent"), "reply-links")
    at = links.select("conversation_id", "id", F.coalesce("parent", "id").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    while True:
        far = at.select("conversation_id", F.col("id").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        step = materialize(at.join(far, ["conversation_id", "root"]).select("conversation_id", "id", F.col("up").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "reply-roots")
        at = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    parents = links.filter("parent IS NOT NULL").select("conversation_id", F.col("parent").alias("id"), F.lit(1).alias("asked")).distinct()
    trees = at.join(parents, ["conversation_id", "id"], "left").groupBy("conversation_id", "root")
    return trees.agg(F.count("*").alias("turns"), (F.max("depth") + 1).alias("depth"), F.count_if(F.col("asked").isNull()).alias("leaves"))


def _judged(messages: DataFrame) -> DataFrame:
    """(c, whole) of every conversation with rows, by its links; by exact order where they are no single chain."""
    all_ = merged(messages, for_links=True)
    rows = all_.over(materialize(all_.rows, "merged-turns"))
    bad = rows.rows.groupBy("c").agg(F.max(F.col("t").isNull() | (F.col("role") == "x") | ~F.col("filled")).alias("bad"))
    turns_ = _linked(rows)
    linked = F.col("best").isNotNull()
    # In a chain every turn but the first has a parent, no two the same one: in order, each is the child of the one before.
    trees = turns_.groupBy("c").agg(
        F.count("*").alias("turns"), F.count_if(~linked).alias("roots"), F.count_if(linked & (F.col("best.near") == F.col("n") - 1) & (F.col("best.role") != F.col("role"))).alias("chained"),
        F.bool_and(F.col("role") != F.coalesce("before", F.lit("a"))).alias("alternate"), F.min_by("role", "n").alias("first"), F.max_by("role", "n").alias("last"))
    chain = (F.col("roots") == 1) & (F.col("chained") == F.col("turns") - 1)
    whole = (F.col("first") == "u") & (F.col("last") == "a") & (chain | F.col("alternate"))
    return bad.join(trees, "c", "left").select("c", (~F.col("bad") & F.coalesce(whole, F.lit(False))).alias("whole"))


def broken_conversations(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation_id) of every conversation of either table that is to be dropped.

    Conversations without rows are broken. A null id is none. Empty tables give no rows.
    """
    ids = conversations.select(F.col("id").alias("c")).union(messages.select(F.col("conversation_id").alias("c"))).filter("c IS NOT NULL").distinct()
    whole = _judged(messages).filter("whole").select("c")
    return ids.join(whole, "c", "left_anti").select(F.col("c").alias("conversation_id"))


def rebuilt(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation_id, position, role, id, content) of the turns of whole conversations, in order."""
    whole = _judged(messages).filter("whole").select("c")
    kept = merged(messages, with_content=True)
    rows, w = kept.rows.join(whole, "c", "left_semi"), kept.window()
    before = rows.filter("part > 0").groupBy("c", "part").count().withColumn("_before", F.sum("count").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    rows = rows.withColumn("n", F.row_number().over(w)).join(guarded_broadcast(materialize(before, "part-sizes")), ["c", "part"], "left")
    speaker = F.when(F.col("role") == "u", "user").when(F.col("role") == "a", "assistant").otherwise("system")
    return rows.select(F.col("c").alias("conversation_id"), (F.col("n") + F.coalesce("_before", F.lit(0)) - 1).cast("long").alias("position"), speaker.alias("role"), "id", "content")


def reply_pairs(messages: DataFrame) -> DataFrame:
    """(id, question, answer) of assistant rows directly after a user row, in conversations whose rows all have a time."""
    rows = merged(messages, with_content=True)
    timeless = materialize(messages.filter("created_at IS NULL AND conversation_id IS NOT NULL").select(F.col("conversation_id").alias("c")).distinct(), "timeless")
    rows = rows.over(rows.rows.join(guarded_broadcast(timeless), "c", "left_anti"))
    rows = with_previous(rows, F.struct("role", "content"), "before").rows
    return rows.filter("role = 'a' AND before.role = 'u'").select("id", F.col("before.content").alias("question"), F.col("content").alias("answer"))
