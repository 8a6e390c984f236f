"""Documents to chunks: fixed stride by expressions, separator-aware by an Arrow function."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import or_default, strip
from weftline.sources.staging import materialize

SIZE, OVERLAP, LEAST = 512, 50, 50
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def chunk_fixed(data: DataFrame, key: str, text: str, *, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(key, chunk_index, chunk_id, chunk_text): windows of ``size`` characters every ``size - overlap``.

    Chunks with fewer than ``least`` characters without outer whitespace are dropped after numbering, so that indexes keep
    their gaps. Null and empty texts have no chunks.
    """
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("_t") - overlap) / step).cast("int") - 1)
    rows = data.select(F.col(key), F.col(text).alias("_t")).filter("_t IS NOT NULL AND _t <> ''")
    rows = rows.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("_t", i * step + 1, F.lit(size)))).alias("chunk_index", "chunk_text"))
    return rows.filter(F.length(strip(F.col("chunk_text"))) >= least).select(
        key, F.col("chunk_index").cast("bigint").alias("chunk_index"), F.concat_ws("_chunk_", F.col(key).cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_text")


def split_recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that occurs, joined up to ``size`` with up to ``overlap`` repeated."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :] if sep in separators else ()
    parts = list(text) if sep == "" else text.split(sep)
    out: list[str] = []
    held: list[str] = []
    length = 0

    def emit() -> None:
        t = sep.join(held).strip()
        if t:
            out.append(t)

    for p in parts:
        if len(p) > size:
            if held:
                emit()
                held, length = [], 0
            out += split_recursive(p, size, overlap, rest or ("",))
            continue
        add = len(p) + (len(sep) if held else 0)
        if length + add > size:
            emit()
            while held and (length > overlap or length + add > size):
                length -= len(held[0]) + (len(sep) if len(held) > 1 else 0)
                held = held[1:]
            add = len(p) + (len(sep) if held else 0)
        held.append(p)
        length += add
    if held:
        emit()
    return out


def chunk_by_separator(data: DataFrame, key: str, text: str, *, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """As ``chunk_fixed``, but cut at paragraphs, lines, sentences or words where there are any."""
    kind = data.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, index, texts = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, c in enumerate(split_recursive(t, size, overlap) if t else []):
                    if len(c.strip()) >= least:
                        keys.append(k)
                        index.append(i)
                        texts.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(index, pa.int64()), pa.array(texts, pa.string())], names=["k", "chunk_index", "chunk_text"])

    rows = data.select(F.col(key), F.col(text)).mapInArrow(run, f"k {kind}, chunk_index bigint, chunk_text string")
    return rows.select(F.col("k").alias(key), "chunk_index", F.concat_ws("_chunk_", F.col("k").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_text")


def batches_of(data: DataFrame, order: str, workers: int = 4) -> DataFrame:
    """Adds ``batch_id``: runs of max(1, n // workers) rows in the order of a unique key.

    """
    numbered = dense_ids(data, [order], "_i", total="_all")
    size = F.greatest(F.lit(1), F.floor(F.col("_all") / workers))
    return numbered.withColumn("batch_id", F.floor(F.col("_i") / size).cast("bigint")).drop("_i", "_all")


def dense_ids(data: DataFrame, order: list[str], name: str, total: str | None = None) -> DataFrame:
    """Adds a running number from 0 in the order of unique columns, and the number of rows as ``total``.

    The rows are range partitioned and written once with the number of their partition; row counts per partition then give
    where each starts, so that no single task sorts all rows and nothing depends on how a partitioning is computed twice.
    """
    ranged = materialize(data.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    # One row a partition.
    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    numbered = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order))).join(F.broadcast(offsets), "_p")
    out = numbered.withColumn(name, (F.col("_before") + F.col("_r") - 1).cast("bigint"))
    return (out.withColumn(total, F.col("_total")) if total else out).drop("_p", "_r", "_before", "_total")


def chunk_records(documents: DataFrame, *, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks with their provenance: source, title, content_type, chunk_index, doc_id, scraped_at and a dense vector_id from 0.

    ``documents``: doc_id, text, source, title, content_type, scraped_at. Missing sources are Unknown, titles Untitled, types general.
    """
    pieces = chunk_fixed(documents, "doc_id", "text", size=size, overlap=overlap)
    facts = documents.select(
        "doc_id", or_default(F.col("source"), "Unknown").alias("source"), or_default(F.col("title"), "Untitled").alias("title"), or_default(F.col("content_type"), "general").alias("content_type"),
        F.coalesce(F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("scraped_at"))
    return dense_ids(pieces.join(facts, "doc_id"), ["doc_id", "chunk_index"], "vector_id")
