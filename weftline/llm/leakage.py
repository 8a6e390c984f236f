"""Evaluation texts leaking into training text: spaced seeds.

Texts become sequences of normalised words. A seed is a fixed mask over neighbouring words; where the mask is open a word may
have been changed. Hashes of all masked windows of the test items are joined with those of the corpus. Around the hits,
item and document are laid side by side and the longest stretch that agrees but for an odd changed word is measured.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import BROADCAST_BYTES, guarded_broadcast, materialize

#: Masks over neighbouring words: six words that must agree, in a row or around one or two that needn't.
MASKS = ("111111", "1110111", "11011011", "10110111")
#: An item of fewer words has at most one window of these masks: its mask is all of it.
SHORT = 7
LEAST_WORDS, WORDS_PER_CHANGE = 20, 9
#: Up to this number of item windows, corpus windows are first looked up in a broadcast table; beyond it all are joined.
LOOKUP_ROWS = 2_000_000

_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([nrtfv])|\\([\"'/\\])|%([0-9A-Fa-f]{2})")
_APOSTROPHE = re.compile(r"(?<=\w)['’ʼ`´](?=\w)")
_GAP = re.compile(r"[^\W_]+")


def _unescape(m: re.Match) -> str:
    if m.group(1) or m.group(2) or m.group(5):
        return chr(int(m.group(1) or m.group(2) or m.group(5), 16))
    return " " if m.group(3) else m.group(4)


def plain(text: str) -> str:
    """Text without character escapes, compatibility forms, invisible characters, soft hyphens and apostrophes within words; case folded."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "\\" in text or "%" in text:
        text = _ESCAPE.sub(_unescape, text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = re.sub(r"[­​-‏⁠﻿]", "", text)
    return _APOSTROPHE.sub("", text).casefold()


class Words(dict):
    """Hashes of normalised words, remembered."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        if len(self) > 300_000:
            self.clear()
        words = _GAP.findall(plain(text))
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Lookup:
    """Which seeds are known: a bitmap answers for nearly all of those that aren't, a sorted table for the rest."""

    BITS = 24

    def __init__(self, seeds: np.ndarray) -> None:
        self.table = np.unique(seeds)
        self.marked = np.zeros(1 << self.BITS, bool)
        self.marked[self._place(self.table)] = True

    def _place(self, seeds: np.ndarray) -> np.ndarray:
        return seeds.view(np.uint64) >> np.uint64(64 - self.BITS)

    def hits(self, seeds: np.ndarray) -> np.ndarray:
        """Places of the known ones."""
        near = np.flatnonzero(self.marked[self._place(seeds)])
        if not len(near):
            return near
        at = np.searchsorted(self.table, seeds[near])
        return near[self.table[np.minimum(at, len(self.table) - 1)] == seeds[near]]


def seeds(h: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the masked window at each place of a sequence."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(number * 2 + 1) * np.uint64(0x9E3779B97F4A7C15), np.uint64)
        for k, c in enumerate(mask):
            if c == "1":
                out = (out ^ h[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
                out ^= out >> np.uint64(32)
        return out.view(np.int64)


def whole_mask(length: int) -> tuple[int, str]:
    """Number and mask of a whole item of so many words."""
    return len(MASKS) + length, "1" * length


def overlap(item: np.ndarray, words: np.ndarray, document: np.ndarray, shift: int) -> int:
    """Words of the item in its longest stretch that agrees with the document moved by ``shift``, but for odd changes.

    ``words`` gives for each part of the item the number of the written word it belongs to. A stretch begins and ends
    with agreement, never has two changed parts in a row and at most one in WORDS_PER_CHANGE.
    """
    lo, hi = max(0, -shift), min(len(item), len(document) - shift)
    if hi - lo <= 0:
        return 0
    same = item[lo:hi] == document[lo + shift : hi + shift]
    best, start, changes = 0, None, []
    n = hi - lo
    for i in range(n):
        if same[i]:
            if start is None:
                start, changes = i, []
            while start is not None and len(changes) * WORDS_PER_CHANGE > i - start + 1:
                start = changes.pop(0) + 1
                while start <= i and not same[start]:
                    start += 1
            best = max(best, int(words[lo + i] - words[lo + start]) + 1)
        elif start is not None:
            if i and not same[i - 1]:
                start = None
            else:
                changes.append(i)
    return best


def longest(item: np.ndarray, words: np.ndarray, document: np.ndarray, shifts: np.ndarray) -> int:
    """The best ``overlap`` over all shifts, something less if none is long enough to count; those with the most agreeing words first, until no other can be better."""
    same = [int((item[max(0, -s) : len(document) - s] == document[max(0, s) : max(0, s) + len(item[max(0, -s) : len(document) - s])]).sum()) for s in map(int, shifts)]
    best, bare = 0, int(words[-1]) + 1 - len(np.unique(words))
    least = min(LEAST_WORDS, int(words[-1] - words[0]) + 1)
    for k in np.argsort(same)[::-1]:
        # A stretch has at most one changed part in WORDS_PER_CHANGE, and perhaps the written words without a part.
        if same[k] * WORDS_PER_CHANGE < (max(best + 1, least) - bare) * (WORDS_PER_CHANGE - 1):
            break
        best = max(best, overlap(item, words, document, int(shifts[k])))
    return best


_ITEM_WORD = re.compile(r"\S+")


def item_parts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of an item's parts and, of each, the number of the written word it belongs to."""
    work, hashes, numbers = Words(), [], []
    for n, m in enumerate(_ITEM_WORD.findall(text or "")):
        h = work.of(m)
        hashes.append(h)
        numbers += [n] * len(h)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.array(numbers, np.int32)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, words) of documents that hold a whole item or LEAST_WORDS of its words in sequence.

    Null and empty texts hold nothing and are held by nothing; an item with fewer than LEAST_WORDS words must be there as
    a whole. Rows repeated in either table give one row.
    """
    spark = documents.sparkSession

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w = zip(*(item_parts(t) for t in batch.column(1).to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.view(np.int64) for x in h], pa.list_(pa.int64())), pa.array(w, pa.list_(pa.int32()))], names=["item_id", "parts", "numbers"])

    cut = materialize(items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().mapInArrow(cut_items, "item_id long, parts array<long>, numbers array<int>"), "items")

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, parts in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = parts.values.to_numpy().view(np.uint64)
                for number, mask in enumerate(MASKS) if len(h) >= SHORT else [whole_mask(len(h))]:
                    s = seeds(h, mask, number)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i), pa.int64()), pa.array(s), pa.array(np.arange(len(s), dtype=np.int32))], names=["item_id", "seed", "item_at"])

    windows = materialize(cut.select("item_id", "parts").mapInArrow(item_windows, "item_id long, seed long, item_at int"), "item-windows")
    known = None
    if windows.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
        known = spark.sparkContext.broadcast(Lookup(windows.select("seed").toArrow().column(0).to_numpy()))
    # Fewer than SHORT lengths at most.
    short = sorted(r[0] for r in cut.select(F.size("parts").alias("n")).filter((F.col("n") > 0) & (F.col("n") < SHORT)).distinct().collect())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Words()
        table = known.value if known is not None else None
        for batch in batches:
            docs, at, seed, parts = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = work.of(text)
                found_at, found = [], []
                for number, mask in [*enumerate(MASKS), *map(whole_mask, short)]:
                    s = seeds(h, mask, number)
                    if not len(s):
                        continue
                    hit = np.arange(len(s)) if table is None else table.hits(s)
                    if number >= len(MASKS) and len(hit):  # a short item stands in a text or doesn't: its first place is enough
                        hit = hit[np.unique(s[hit], return_index=True)[1]]
                    found_at.append(hit.astype(np.int32))
                    found.append(s[hit])
                if sum(map(len, found)):
                    docs.append(i)
                    at.append(np.concatenate(found_at))
                    seed.append(np.concatenate(found))
                    parts.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(seed, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int64()))], names=["doc_id", "at", "seed", "parts"])

    hits = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, "doc_id long, at array<int>, seed array<long>, parts array<long>"), "leak-hits")
    each = hits.select("doc_id", F.explode(F.arrays_zip("at", "seed")).alias("x")).select("doc_id", F.col("x.at").alias("at"), F.col("x.seed").alias("seed"))
    lines = each.join(guarded_broadcast(windows, 4 * BROADCAST_BYTES), "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
    lines = lines.groupBy("doc_id", "item_id", "shift").agg(F.count("*").alias("n"))
    # An agreement of LEAST_WORDS with odd changes holds several windows on one line or on two neighbouring ones; one window alone is a shared turn of phrase.
    brief = guarded_broadcast(cut.filter(F.size("parts") < SHORT).select("item_id", F.lit(True).alias("brief"))) if short else None
    lines = lines.join(brief, "item_id", "left").filter("n > 1 OR brief") if short else lines.filter("n > 1")
    lines = lines.groupBy("doc_id", "item_id").agg(F.collect_list("shift").alias("shifts"))
    both = lines.join(hits.select("doc_id", F.col("parts").alias("document")).dropDuplicates(["doc_id"]), "doc_id").join(guarded_broadcast(cut), "item_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, whole = [], []
            for k in range(batch.num_rows):
                document, item, numbers = (batch.column(c)[k].values.to_numpy() for c in (3, 4, 5))
                best.append(longest(item, numbers, document, batch.column(2)[k].values.to_numpy()))
                whole.append(int(numbers[-1] - numbers[0]) + 1 if len(numbers) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.int32()), pa.array(whole, pa.int32())], names=["doc_id", "item_id", "words", "all_words"])

    measured = both.select("doc_id", "item_id", "shifts", "document", "parts", "numbers").mapInArrow(measure, "doc_id long, item_id long, words int, all_words int")
    return measured.filter(F.col("words") >= F.least(F.lit(LEAST_WORDS), F.col("all_words"))).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def found_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of ``leaks``."""
    return leaks(documents, items).select("doc_id", "item_id")
