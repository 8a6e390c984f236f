"""Streaming forms: lockout by custom state, first-write-wins, buffers, windows with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_lockouts(events: DataFrame, *, limit: int = 5) -> DataFrame:
    """(k, locked_at) once per key, when its ``limit``-th failure since the last success arrives.

    ``events``: k string, t timestamp, i bigint, failed boolean. Rows of a micro-batch are ordered by (t, i); a row that
    arrives after later ones counts when it comes.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        locked = None
        rows = pd.concat(list(pdfs)).sort_values(["t", "i"])
        if count < limit:
            for t, failed in zip(rows["t"], rows["failed"]):
                count = count + 1 if failed else 0
                if count >= limit:
                    locked = t
                    break
        state.update((int(count),))
        if locked is not None:
            yield pd.DataFrame({"k": [key[0]], "locked_at": [locked]})

    return events.groupBy("k").applyInPandasWithState(step, "k string, locked_at timestamp", "n long", "append", GroupStateTimeout.NoTimeout)


def stream_history(turns: DataFrame, *, keep: int = 50) -> DataFrame:
    """(c, kept, last) per conversation and batch: how many of the last ``keep`` rows are held, and the newest content."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        new = None
        for pdf in pdfs:  # never more than one Arrow batch and the rows kept
            new = pd.concat([x for x in (new, pdf) if x is not None]).sort_values(["t", "id"]).tail(keep)
        held = (held + [x or "" for x in new["content"]])[-keep:]
        state.update((held,))
        yield pd.DataFrame({"c": [key[0]], "kept": [len(held)], "last": [held[-1]]})

    return turns.groupBy("c").applyInPandasWithState(step, "c string, kept bigint, last string", "rows array<string>", "update", GroupStateTimeout.NoTimeout)


def stream_first(rows: DataFrame, key: str, ts: str, lateness: str = "10 minutes") -> DataFrame:
    """First write wins within the watermark: later rows of a key are dropped."""
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, ts: str, by: str, size: str = "1 day", lateness: str | None = None) -> DataFrame:
    """(window_start, by, n, total) per tumbling window; with a watermark if ``lateness`` is given."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp"))
    e = e.withWatermark("_t", lateness) if lateness else e
    return e.groupBy(F.window("_t", size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), by, "n", F.round("total", 4).alias("total"))


def session_counts(events: DataFrame, ts: str, by: str, gap: str = "30 minutes") -> DataFrame:
    """(by, started, n) per session: runs of events no further apart than the gap."""
    return events.withColumn("_t", F.col(ts).cast("timestamp")).groupBy(F.session_window("_t", gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("started"), "n")


def run_once(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Drives a stream over all that is there and returns its result, which is written below ``path`` with the checkpoint.

    Each micro-batch replaces its own folder, so a batch that is run again counts once; in complete mode all share one folder.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={0 if mode == 'complete' else number}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    out = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/out")
    if not out.getFileSystem(spark._jsc.hadoopConfiguration()).exists(out):  # no batch came
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/out").drop("batch")
