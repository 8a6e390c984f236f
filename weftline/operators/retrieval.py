"""Exact nearest neighbours, scores, context packing, pluggable embeddings."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import or_default, strip

DIMENSIONS, TOP_K, BUDGET = 384, 5, 2000
#: The grid of queries and vectors has cells of about so many of each.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 65_536
#: The words around a context, and in place of one.
CONTEXT_HEAD = "Relevant information from the knowledge base:"
CONTEXT_TAIL = "Please use this information to answer the user's question."
NOTHING_FOUND = "No relevant information found"
log = logging.getLogger(__name__)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def score(distance: Column) -> Column:
    return 1 / (1 + distance)


def top_k(vectors: DataFrame, query: list[float] | Column, k: int | None = None, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest vectors of one query: a projection and TakeOrderedAndProject. k of none or 0 is TOP_K; ties go by key."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("distance", squared_distance(F.col(vector), q)).withColumn("score", score(F.col("distance"))).orderBy("distance", key).limit(k or TOP_K)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int | None = None, *, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query") -> DataFrame:
    """(query_key, key, distance, rank) of the k nearest vectors of every query.

    Both sides are divided into blocks by the hash of their keys, at most about QUERY_BLOCK queries and VECTOR_BLOCK vectors each. Every
    cell of the grid is one task with two numpy matrices; it gives the k best of its vectors to each of its queries, and a query's
    cells are merged by rank. Nothing passes through the driver but the two counts. The distances are exact; null vectors have none.
    """
    n = k or TOP_K
    held = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    asked = queries.select(F.col(query_key).cast("long").alias("q"), F.col(query_vector).alias("v")).filter("v IS NOT NULL")
    rows, columns = (max(1, -(-df.count() // size)) for df, size in ((asked, QUERY_BLOCK), (held, VECTOR_BLOCK)))
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.withColumn("row", block("q", rows)).withColumn("column", every(columns)).groupBy("row", "column")
    right = held.withColumn("column", block("k", columns)).withColumn("row", every(rows)).groupBy("row", "column")

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "k": [], "d": []})
        ids, keys = a["q"].to_numpy(np.int64), b["k"].to_numpy(np.int64)
        m, v = (np.stack(x["v"].to_numpy()).astype(np.float64) for x in (a, b))
        frames = []
        for at in range(len(ids)):
            d = ((v - m[at]) ** 2).sum(1)
            # Ties go by key: all that are as near as the n-th stay in.
            near = np.flatnonzero(d <= np.partition(d, min(n, len(d)) - 1)[min(n, len(d)) - 1])
            order = near[np.lexsort((keys[near], d[near]))[:n]]
            frames.append(pd.DataFrame({"q": ids[at], "k": keys[order], "d": d[order]}))
        return pd.concat(frames)

    out = left.cogroup(right).applyInPandas(nearest, "q long, k long, d double")
    best = out.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "k"))).filter(F.col("rank") <= n)
    return best.select(F.col("q").alias(query_key), F.col("k").alias(key), F.col("d").alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def pack(ranked: DataFrame, *, group: str | None, order: list[str], title: str, content: str, budget: int = BUDGET) -> DataFrame:
    """The longest prefix of each ranking whose wrapped contents fit the budget; blank contents are passed over.

    Lengths aren't negative, so the running sum stops for good where it first exceeds the budget.
    """
    rows = ranked.withColumn("_c", strip(F.coalesce(F.col(content), F.lit("")))).filter("_c <> ''")
    rows = rows.withColumn("piece", F.concat(F.lit("[Source: "), or_default(F.col(title), "Unknown"), F.lit("]\n"), F.col("_c"))).drop("_c")
    w = Window.partitionBy(*([group] if group else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.length("piece")).over(w).cast("bigint")).filter(F.col("used") <= budget)


def context_text(packed: DataFrame, group: str, order: str, separator: str = "\n\n---\n\n") -> DataFrame:
    """(group, context): the packed pieces in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("piece"))))
    return packed.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["piece"]), separator).alias("context"))


def wrapped_context(context: Column) -> Column:
    """A packed context with the words around it; the text that nothing was found where there is none."""
    text = F.nullif(context, F.lit(""))
    return F.coalesce(F.concat(F.lit(CONTEXT_HEAD + "\n\n"), text, F.lit("\n\n" + CONTEXT_TAIL)), F.lit(NOTHING_FOUND))


def hashed_embedding(text: str | None, dimensions: int = DIMENSIONS) -> list[float]:
    """Deterministic bag of hashed words, of length one; the offline stand-in for an embedding model."""
    import hashlib

    v = np.zeros(dimensions, np.float32)
    for w in (text or "").lower().split():
        h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
        v[h % dimensions] += 1.0 if h // dimensions % 2 else -1.0
    n = float(np.linalg.norm(v))
    return (v / n if n else v).tolist()


def index_batches(chunks: DataFrame, path: str, *, order: str = "vector_id", text: str = "chunk_text", batch: int = 100_000, encode: Callable[[list[str]], list[list[float]]] | None = None, progress: Callable[[int, int], None] | None = None) -> int:
    """Embeds numbered chunks and appends them to the index at a path, so many a batch; returns how many batches were stored.

    A batch that fails or is empty is passed over and the others are kept; ``progress`` is told (done, all) after each.
    """
    last = chunks.agg(F.max(order)).first()[0]
    all_, stored = 0 if last is None else last // batch + 1, 0
    for k in range(all_):
        try:
            rows = embed(chunks.filter(F.col(order).between(k * batch, (k + 1) * batch - 1)), text, encode=encode).filter("embed_error IS NULL")
            rows.drop("embed_error").write.mode("append").parquet(path)
            stored += 1
        except Exception as e:  # noqa: BLE001
            log.warning("batch %d of %d was passed over: %s", k + 1, all_, e)
        if progress:
            progress(k + 1, all_)
    return stored


def embed(data: DataFrame, text: str, *, encode: Callable[[list[str]], list[list[float]]] | None = None, out: str = "embedding") -> DataFrame:
    """Adds an embedding by batches. ``encode`` takes a list of texts; a batch that fails gives null and its error, not a failed job."""
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("v", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            try:
                texts = [t or "" for t in s]
                yield pd.DataFrame({"v": encode(texts) if encode else [hashed_embedding(t) for t in texts], "error": None})
            except Exception as e:  # noqa: BLE001 - one bad batch must not end the job
                yield pd.DataFrame({"v": [None] * len(s), "error": str(e)})

    return data.withColumn("_e", run(F.col(text))).withColumn(out, F.col("_e.v")).withColumn("embed_error", F.col("_e.error")).drop("_e")
