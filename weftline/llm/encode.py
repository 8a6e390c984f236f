"""Encoding of a corpus with a public byte-level BPE vocabulary, exactly and in linear time.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the vocabulary finds, for every place of a piece, the
longest token that starts there. Encoding takes longest matches and backtracks to shorter ones where two neighbours
couldn't both come out of the merges; whether they can is remembered per pair of tokens. The result equals that of
applying the merges in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES, PAIRS = 400_000, 1_000_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k.json of the installed public tokenizers."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by the public rule: printable Latin-1 stands for itself, the rest is numbered from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoder:
    """Exact encoder for one vocabulary file (``model.vocab`` and ``model.merges`` of a byte-level BPE)."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        stand = _byte_letters()
        spell = lambda t: "".join(chr(stand[c]) for c in t)
        special = [t for t in model["vocab"] if any(c not in stand for c in t) or (t.startswith("<|") and t.endswith("|>"))]
        self.text = {i: spell(t) for t, i in model["vocab"].items() if t not in special}
        self.ids = {t: i for i, t in self.text.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Rank by order of merging; bytes come before all merges.
        self.rank: dict[int, int] = {i: -1 - i for i, t in self.text.items() if len(t) == 1}
        self.split: dict[int, tuple[int, int]] = {i: (i, i) for i in self.rank}
        self.joined: dict[tuple[int, int], int] = {}
        for n, (a, b) in enumerate(merges):
            a, b = self.ids[spell(a)], self.ids[spell(b)]
            c = self.ids.get(self.text[a] + self.text[b])
            if c is not None and (a, b) not in self.joined:
                self.joined[a, b] = c
                if c not in self.rank:
                    self.rank[c], self.split[c] = n, (a, b)
        self.find = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.find.add_word(t, (len(t), i))
        self.find.make_automaton()
        #: The longest token that is a proper prefix of a token.
        self.shorter: dict[int, int] = {}
        for i, t in self.text.items():
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in self.ids:
                    self.shorter[i] = self.ids[t[:n]]
                    break
        self.pattern = regex.compile(PATTERN)
        self.pieces: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave the border between two neighbours alone."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = known = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # The border is undone backwards: the later of the two last merges is taken apart, and at each
        # stage no merge across the border may come before the merge taken apart last.
        rank, split = self.rank, self.split
        limit = len(rank) + 1
        while True:
            c = self.joined.get((a, b))
            if c is not None and rank[c] < limit:
                return False
            ra, rb = rank[a], rank[b]
            whole_a, whole_b = ra < 0, rb < 0
            if whole_a and whole_b:
                return True
            if ra > rb:  # a's last merge came after b's: before it, its right part stood at the border
                limit, a = ra, split[a][1]
            else:  # at equal ranks the left one merges first, so a merge across may not even tie with b's
                limit, b = rb + 1, split[b][0]

    def piece(self, piece: str) -> list[int]:
        s = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        own = self.ids.get(s)
        if own is not None:
            return [own]
        n = len(s)
        longest: list[tuple[int, int]] = [(0, 0)] * n
        for end, match in self.find.iter(s):
            start = end - match[0] + 1
            if match[0] > longest[start][0]:
                longest[start] = match
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at = 0
        token = longest[0][1]
        while True:
            last = out[-1] if out else None
            while True:
                end = at + len(self.text[token])
                if open_[end] and (last is None or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    if at == n:
                        return out
                    token = longest[at][1]
                    break
                less = self.shorter.get(token)
                if less is not None:
                    token = less
                    continue
                open_[at] = 0  # nothing that starts here goes on to the end
                token = out.pop()
                at -= len(self.text[token])
                less = self.shorter.get(token)
                while less is None:
                    open_[at] = 0
                    token = out.pop()
                    at -= len(self.text[token])
                    less = self.shorter.get(token)
                token = less
                break

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty and a null text."""
        if not text:
            return []
        held, out = self.pieces, []
        if len(held) > PIECES:
            held.clear()
        for p in self.pattern.findall(text):
            ids = held.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 64:
                    held[p] = ids
            out += ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_texts(data: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens. Null and empty texts give an empty list.

    ``vocabulary`` is the path of the vocabulary file on the executors. Strings that name special tokens are plain text.
    """
    path = vocabulary or default_vocabulary()
    rows = data.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weftline.llm.encode import encoder as of

        work = of(path)
        for batch in batches:
            # In slices, so that the ids of a batch of long texts don't stand in memory all at once.
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = pa.array([work.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
