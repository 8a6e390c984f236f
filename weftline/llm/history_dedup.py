"""New batches against everything accepted before: exact hashes, hashes of short paragraphs, word-for-word agreement.

``History`` keeps three tables, bucketed by hash: the exact hash of every body judged, the paragraph hashes of the accepted
bodies, and their words. A batch meets only the rows of its own buckets; the history is never read as a whole. What a batch
adds becomes visible all at once, by one marker.

Paragraphs are short and overlap, so that scattered changes leave some whole: the runs of LONG_RUN words, of short bodies also
those of SHORT_RUN. A body keeps those of least hash (a bottom-k sketch). It is compared with the earliest holders of its
paragraphs, and with all earlier bodies that hold at least MET of the RAREST of its sketch that others hold too; the longest
common subsequence of words decides.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import guarded_broadcast, materialize, shared_dir, site_of
from weftline.llm.main_body import Cutter, load_cutter, split_lines, style_tree, with_low

LEAST_CHARS, SAME = 200, 0.8
LONG_RUN, SHORT_RUN, SHORT_BODY = 6, 3, 200
#: Sizes of the sketches of long and of short runs; how many of its rarest shared runs a body looks for, and how many must meet.
LONG_SKETCH, SHORT_SKETCH, RAREST, MET = 32, 16, 8, 2
#: How many of the first so many paragraphs of a sketch must have the same earliest holder for a comparison with that.
LEADING, LED = 16, 2
#: Into how many loads of whole days p4_found divides a table, and the buckets of its history.
LOADS, BUCKETS = 2, 12
#: What stands between words: ASCII by a table of bytes, the rest by a pattern.
_BETWEEN = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
_BETWEEN_WIDE = re.compile(r"[^\w\x00-\x7f]")
_ASCII = bytes(range(128))


class Words(dict):
    """64-bit hashes of words, the runs of letters and digits of a text in lower case; remembered by their UTF-8."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        text = text.lower()
        spaced = text.encode().translate(_BETWEEN)
        if not text.isascii():
            for sign in set(spaced.translate(None, _ASCII).decode()):
                if _BETWEEN_WIDE.match(sign):
                    spaced = spaced.replace(sign.encode(), b" ")
        words = spaced.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _run_hashes(h: np.ndarray, length: int, n: int) -> np.ndarray:
    """The hashes of all runs of ``n`` words, in order; ``length`` is what they stand for."""
    with np.errstate(over="ignore"):
        g = h[: len(h) - n + 1] + np.uint64(length)
        for k in range(1, n):
            g = (g ^ (g >> np.uint64(31))) * _MIX + h[k : len(h) - n + 1 + k]
        g = (g ^ (g >> np.uint64(29))) * _MIX
        g ^= g >> np.uint64(32)
    return g


def _least(g: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` least of some hashes, each once."""
    g = np.sort(g)
    other = np.empty(len(g), bool)
    other[0] = True
    np.not_equal(g[1:], g[:-1], out=other[1:])
    return g[other][:most].view(np.int64)


def runs(h: np.ndarray, length: int, most: int) -> np.ndarray:
    """The ``most`` least hashes of the runs of ``length`` words; of a shorter body the hash of all its words."""
    return _least(_run_hashes(h, length, min(length, len(h))), most)


def sketch(h: np.ndarray) -> np.ndarray:
    """A body's paragraph hashes."""
    return sketches([h])[0]


#: So many bodies' runs are hashed at once, as one row of words.
AT_ONCE = 256


def sketches(bodies: list[np.ndarray]) -> list[np.ndarray]:
    """The paragraph hashes of each body; runs across their borders are left out."""
    out = []
    for k in range(0, len(bodies), AT_ONCE):
        some = bodies[k : k + AT_ONCE]
        row = np.concatenate(some)
        long, short = (_run_hashes(row, n, min(n, len(row))) for n in (LONG_RUN, SHORT_RUN))
        at = 0
        for h in some:
            end = at + len(h)
            own = _least(long[at : end - LONG_RUN + 1], LONG_SKETCH) if len(h) >= LONG_RUN else runs(h, LONG_RUN, LONG_SKETCH)
            if len(h) < SHORT_BODY:
                own = np.concatenate((own, _least(short[at : end - SHORT_RUN + 1], SHORT_SKETCH) if len(h) >= SHORT_RUN else runs(h, SHORT_RUN, SHORT_SKETCH)))
            out.append(own)
            at = end
    return out


def body_of(content: str, cutter: Cutter, low: set[int]) -> str:
    gone = set(cutter.outside(content, low))
    return "\n".join(s for i, x in enumerate(split_lines(content)) if i not in gone and (s := x.strip()))


def signatures(data: DataFrame, low: DataFrame, cutter) -> DataFrame:
    """(id, t, h, exact, runs, words, row) of every judged body: hashes of the id, the whole body, its paragraphs and its words.

    ``row`` tells rows of one id and time apart, once the table is written. Bodies under LEAST_CHARS characters, null and blank content have none.
    """
    pages = data.select("id", site_of(F.col("url")).alias("site"), "content", F.col("scraped_at").cast("timestamp_ntz").alias("t"), F.xxhash64("id").alias("h"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, words = cutter.value, Words()
        for batch in batches:
            keep, exact, spelled = [], [], []
            sets: dict[str, set[int]] = {}
            lows = batch.column(5)
            for k, (site, content) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if not content or len(content) < LEAST_CHARS:
                    continue
                if site not in sets:
                    sets[site] = set(lows[k].as_py() or ())
                body = body_of(content, work, sets[site])
                if len(body) < LEAST_CHARS:
                    continue
                h = words.of(body)
                if not len(h):
                    continue
                keep.append(k)
                exact.append(xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63))
                spelled.append(h)
            rows = batch.select([0, 3, 4]).take(pa.array(keep, pa.int32()))
            marks, short = sketches(spelled), [(h & np.uint64(0x7FFFFFFF)).astype(np.int32) for h in spelled]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(exact, pa.int64()), pa.array(marks, pa.list_(pa.int64())), pa.array(short, pa.list_(pa.int32()))], names=["id", "t", "h", "exact", "runs", "words"])

    return with_low(pages, low).select("id", "site", "content", "t", "h", "low").mapInArrow(sign, "id string, t timestamp_ntz, h long, exact long, runs array<long>, words array<int>").withColumn("row", F.monotonically_increasing_id())


def common_in_sequence(a: list, b: list) -> int:
    """Length of the longest common subsequence: a bit for each place of ``a``, one addition for each word of ``b``."""
    places: dict = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << k)
    full = (1 << len(a)) - 1
    free = full
    for w in b:
        met = free & places.get(w, 0)
        if met:
            free = ((free + met) | (free - met)) & full
    return len(a) - free.bit_count()


#: Words are told apart by their last 12 bits first.
_REST = 4095


def agreement(a: np.ndarray, b: np.ndarray, least: float = SAME) -> float:
    """Share of words that two sequences have in common in the same order, of both together; 0 if surely under ``least``."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    if 2 * min(len(a), len(b)) < least * total:
        return 0.0
    # At least as many as they have in common, as words of the same last bits count as one.
    if 2 * int(np.minimum(np.bincount(a & _REST, minlength=_REST + 1), np.bincount(b & _REST, minlength=_REST + 1)).sum()) < least * total:
        return 0.0
    a, b = a.tolist(), b.tolist()
    if 2 * sum((Counter(a) & Counter(b)).values()) < least * total:
        return 0.0
    return 2 * common_in_sequence(a, b) / total


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(3), batch.column(4)
        ok = [agreement(a[k].values.to_numpy(), b[k].values.to_numpy()) >= SAME for k in range(batch.num_rows)]
        yield batch.select([0, 1, 2]).filter(pa.array(ok, pa.bool_()))


def decide(edges: DataFrame) -> DataFrame:
    """(h) of the records that aren't accepted. ``edges``: h, to_h, where to_h is an earlier record of the same content.

    A record is accepted if none of its earlier ones was. Each round settles every record that has an earlier one without open
    edges, and takes what is settled out; so it takes as many rounds as the longest chain of accepted and refused records.
    """
    open_, cases = edges, None
    while True:
        waits = open_.select(F.col("h").alias("to_h"), F.lit(True).alias("waits")).distinct()
        now = materialize(open_.join(waits, "to_h", "left").filter("waits IS NULL").select("h").distinct(), "dedup-cases")
        cases = now if cases is None else cases.unionByName(now)
        open_ = materialize(open_.join(now, "h", "left_anti").join(now.withColumnRenamed("h", "to_h"), "to_h", "left_anti").select("h", "to_h"), "dedup-open")
        if open_.isEmpty():
            return cases.distinct()


def _words(signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, words) of the rows of ``wanted`` (row); the words stay where they are if what is wanted fits a broadcast."""
    wanted = guarded_broadcast(materialize(wanted.select("row"), "words-wanted"))
    return signed.select("row", "h", "words").join(wanted, "row", "left_semi").select("h", "words")


def _with_leaders(holders: DataFrame) -> DataFrame:
    """(h, to_h, new) of new records and the earliest holders of their leading paragraphs that lead at least LED of them."""
    # One exchange by paragraph serves the leaders and the join with them.
    rows = holders.filter("leading").select("run", "h", "t", "new").repartition("run")
    leader = rows.groupBy("run").agg(F.min(F.struct("new", "t", "h")).alias("r"), F.count("*").alias("n")).filter("n > 1").select("run", F.col("r.new").alias("to_new"), F.col("r.t").alias("to_t"), F.col("r.h").alias("to_h"))
    # One row a paragraph on the side that is hashed, so no key of it is hot.
    met = rows.filter("new").join(leader.hint("shuffle_hash"), "run").filter("to_h <> h AND (to_t < t OR NOT to_new)")
    return met.groupBy("h", "to_h").agg(F.count("*").alias("met"), F.bool_and("to_new").alias("new")).filter(F.col("met") >= LED).select("h", "to_h", "new")


def _with_rarest(holders: DataFrame, asking: DataFrame | None = None) -> DataFrame:
    """(h, to_h, new) of new records, or of those ``asking``, and all earlier holders of at least MET of their rarest shared paragraphs."""
    rows = holders.select("run", "h", "t", "new").repartition("run")
    shared = rows.groupBy("run").agg(F.count("*").alias("n")).filter("n > 1")
    mine = rows.filter("new").select("run", "h", "t")
    if asking is not None:
        mine = mine.join(asking, "h", "left_semi")
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("n", "run"))), 1, RAREST)
    sought = mine.join(shared.hint("shuffle_hash"), "run").groupBy("h", "t").agg(rarest.alias("r")).select("h", "t", F.explode("r.run").alias("run"))
    met = sought.join(rows.select("run", F.col("h").alias("to_h"), F.col("t").alias("to_t"), F.col("new").alias("to_new")), "run").filter("to_h <> h AND (to_t < t OR NOT to_new)")
    return met.groupBy("h", "to_h").agg(F.count("*").alias("met"), F.bool_and("to_new").alias("new")).filter(F.col("met") >= MET).select("h", "to_h", "new")


class History:
    """Hashes of everything judged and accepted, in tables bucketed by hash: a batch meets only its own buckets.

    Every row carries its load; a load counts once its marker is written, so that one which ended halfway adds nothing and can be
    given again. A folder that isn't there is an empty history; any other failure to read is one.
    """

    _TABLES = {"exact": ("exact long, h long, load string", "exact"), "runs": ("run long, h long, t timestamp_ntz, leading boolean, load string", "run"), "bodies": ("h long, words array<int>, load string", "h")}

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        # The catalog's names for the tables under this path.
        self.name = "weftline_history_" + format(xxhash.xxh3_64_intdigest(self.path), "x")
        for t, (ddl, key) in self._TABLES.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{t} ({ddl}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.path}/{t}'")

    def _folder(self):
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/loads")
        return done, done.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def loads(self) -> list[str]:
        """The loads that count."""
        done, fs = self._folder()
        return sorted(f.getPath().getName() for f in fs.listStatus(done)) if fs.exists(done) else []

    def held(self, table: str) -> DataFrame:
        """The rows of the loads that count."""
        return self.spark.table(f"{self.name}_{table}").filter(F.col("load").isin(self.loads()))

    def _append(self, table: str, rows: DataFrame, load: str) -> None:
        ddl, key = self._TABLES[table]
        rows.withColumn("load", F.lit(load)).select(*[c.split()[0] for c in ddl.split(", ")]).repartition(self.buckets, key).write.insertInto(f"{self.name}_{table}")

    def drop(self) -> None:
        """Takes the tables out of the catalog; their files stay."""
        for t in self._TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{t}")

    def _agreeing(self, pairs: DataFrame, own: DataFrame, signed: DataFrame) -> DataFrame:
        """Those of ``pairs`` (h, to_h, new) that agree word for word, with the words of the batch and of the history."""
        pairs = materialize(pairs, "batch-pairs")
        wanted = materialize(pairs.select("h", F.lit(True).alias("new")).union(pairs.select("to_h", "new")).distinct(), "batch-wanted")
        theirs = _words(signed, own.join(wanted.filter("new").select("h"), "h", "left_semi"))
        if self.loads():
            theirs = theirs.unionByName(self.held("bodies").select("h", "words").join(wanted.filter("NOT new").select("h"), "h", "left_semi"))
        theirs = materialize(theirs, "batch-words")
        both = pairs.join(theirs, "h").join(theirs.select(F.col("h").alias("to_h"), F.col("words").alias("to_words")), "to_h")
        return both.select("h", "to_h", "new", "words", "to_words").mapInArrow(_agree, "h long, to_h long, new boolean").distinct()

    def _refused(self, edges: DataFrame) -> DataFrame:
        """(h) of the records that are like an accepted one; all records of the history are accepted."""
        known = edges.filter("NOT new").select("h").distinct()
        among = edges.filter("new").select("h", "to_h").join(known, "h", "left_anti").join(known.withColumnRenamed("h", "to_h"), "to_h", "left_anti")
        return materialize(known.unionByName(decide(materialize(among, "batch-open"))), "batch-near")

    def accept(self, signed: DataFrame) -> DataFrame:
        """(id) of the records of a batch of ``signatures`` that aren't accepted; what is new of the others is appended.

        Rows of one id are one record. A record with an accepted one of an earlier time and the same content, in the history or in
        the batch, isn't accepted; everything in the history counts as earlier. Null times are neither judged nor kept. Give it a
        written table.
        """
        load = uuid.uuid4().hex
        signed = signed.filter("t IS NOT NULL")
        key = F.struct("t", "h", "row")
        # Full copies: of a body judged before, or of the first of its kind in the batch.
        first = signed.groupBy("exact").agg(F.min(key).alias("first"))
        before = self.held("exact").select("exact", F.col("h").alias("before"))
        first = materialize(first.join(before, "exact", "left"), "batch-exact")
        marked = signed.select("id", "h", "t", "exact").join(first, "exact")
        copies = marked.filter(F.when(F.col("before").isNotNull(), F.col("before") != F.col("h")).otherwise((F.col("first.h") != F.col("h")) & (F.col("first.t") < F.col("t")))).select("id")
        heads = first.filter("before IS NULL").select("exact", "first.*")
        # One row of each record; a delivery repeated at the same time is a second one.
        own = materialize(heads.groupBy("h").agg(F.min(F.struct("t", "row")).alias("r")).select("h", "r.*"), "batch-first")
        # Shared paragraphs: those of the batch, and the accepted ones in the same buckets.
        mine = signed.select("h", "t", "runs", "row").join(guarded_broadcast(own.select("row")), "row", "left_semi")
        mine = materialize(mine.select("h", "t", F.posexplode("runs").alias("place", "run")).select("run", "h", "t", (F.col("place") < LEADING).alias("leading")), "batch-runs")
        holders = mine.withColumn("new", F.lit(True))
        if self.loads():
            held = self.held("runs").select("run", "h", "t", "leading").join(mine.select("run"), "run", "left_semi")
            holders = holders.unionByName(materialize(held, "held-runs").withColumn("new", F.lit(False)))
        # First the earliest holders of its paragraphs, of which a body has few and a group of copies one; then, without the
        # records these settle, all earlier holders of its rarest ones.
        edges = materialize(self._agreeing(_with_leaders(holders), own, signed), "batch-leaders")
        led = edges.select("h").distinct()
        edges = materialize(edges.unionByName(self._agreeing(_with_rarest(holders.join(led, "h", "left_anti")), own, signed)), "batch-edges")
        near = self._refused(edges)
        while True:
            # Who is accepted though like a refused record looks again, among accepted ones alone.
            doubtful = materialize(edges.join(near, "h", "left_anti").join(near.withColumnRenamed("h", "to_h"), "to_h", "left_semi").select("h").distinct(), "batch-doubtful")
            if doubtful.isEmpty():
                break
            again = _with_rarest(holders.join(near, "h", "left_anti"), doubtful).join(edges.select("h", "to_h"), ["h", "to_h"], "left_anti")
            found = materialize(self._agreeing(again, own, signed), "batch-again")
            if found.isEmpty():
                break
            edges = materialize(edges.unionByName(found), "batch-edges")
            near = self._refused(edges)
        self._append("exact", heads.select("exact", "h"), load)
        self._append("runs", mine.join(near, "h", "left_anti"), load)
        self._append("bodies", _words(signed, own.join(near, "h", "left_anti")), load)
        done, fs = self._folder()
        fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(done, load)).close()
        # Copies of a record that isn't accepted aren't either: a near one's exact copies are copies of their first.
        return copies.unionByName(signed.select("id", "h").join(near, "h", "left_semi").select("id")).distinct()


def repeated_records(data: DataFrame, *, loads: int = LOADS) -> DataFrame:
    """(id) of every record with the same content as an accepted record of an earlier scraped_at.

    The table goes through a new ``History`` in ``loads`` loads of whole days, each against what was accepted before and within
    itself; more loads give the same result. Rows of one id are one record. Null times are never cases and never count as
    earlier; records of equal time don't exclude each other. An empty table gives no rows.
    """
    spark = data.sparkSession
    day = F.datediff(F.col("t").cast("date"), F.lit("1970-01-01").cast("date"))
    lo, hi = data.select(F.col("scraped_at").cast("timestamp_ntz").alias("t")).agg(F.min(day), F.max(day)).first()
    if lo is None:
        return data.select(F.col("id").cast("string").alias("id")).limit(0)
    pages = data.select(site_of(F.col("url")).alias("site"), "content")
    low, shared = style_tree(pages)
    cutter = spark.sparkContext.broadcast(load_cutter(shared))
    size = max(1, -(-(hi - lo + 1) // loads))
    # A folder for each load, which reads its own rows alone, several times.
    part = F.floor((day - F.lit(lo)) / F.lit(size)).cast("int")
    signed = materialize(signatures(data, low, cutter).withColumn("part", part), "signatures", "part")
    history = History(spark, f"{shared_dir(spark)}/weftline/history-{uuid.uuid4().hex}", BUCKETS)
    cases = None
    for k in range(-(-(hi - lo + 1) // size)):
        refused = materialize(history.accept(signed.filter(F.col("part") == k).drop("part")), "load-cases")
        cases = refused if cases is None else cases.unionByName(refused)
    history.drop()
    return cases.distinct()
