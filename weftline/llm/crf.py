"""A linear-chain conditional random field in numpy: hashed features of tokens and their neighbours, batch Viterbi."""

from __future__ import annotations

import numpy as np
import xxhash

OFFSETS = (-2, -1, 0, 1, 2)


class Chain:
    """Weights of features by offset and label, and of label transitions."""

    def __init__(self, labels: list[str], features, bits: int = 17, seed: int = 1) -> None:
        self.labels, self.features, self.size = labels, features, 1 << bits
        self.w = np.zeros((self.size, len(labels)), np.float32)
        self.move = np.zeros((len(labels), len(labels)), np.float32)
        self.begin = np.zeros(len(labels), np.float32)
        self.seed = seed
        self._rows: dict[str, int] = {}
        self._table = np.zeros((0, len(OFFSETS), len(labels)), np.float32)

    def __getstate__(self):
        return {**self.__dict__, "_rows": {}, "_table": self._table[:0]}

    def ids_of(self, token: str) -> np.ndarray:
        """Feature numbers of a token at each offset: (offsets, features)."""
        f = self.features(token)
        return np.array([[xxhash.xxh3_64_intdigest(f"{o}|{x}") % self.size for x in f] for o in OFFSETS], np.int64)

    def fit(self, examples: list[tuple[list[str], list[int]]], epochs: int = 6, rate: float = 0.3, batch: int = 64, keep: float = 1e-4) -> Chain:
        """Maximum likelihood by adaptive gradients over padded batches."""
        rng = np.random.default_rng(self.seed)
        memo: dict[str, np.ndarray] = {}
        k = len(self.labels)
        # Adaptive steps: sums of squared gradients.
        gw, gm, gb = np.full((self.size, k), 1e-6, np.float32), np.full((k, k), 1e-6), np.full(k, 1e-6)
        order = np.argsort([len(t) for t, _ in examples], kind="stable")
        batches = [order[i : i + batch] for i in range(0, len(order), batch)]
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                rows = [examples[i] for i in batches[b] if examples[i][0]]
                if not rows:
                    continue
                n, t = len(rows), max(len(x) for x, _ in rows)
                width = 0
                parts = []
                for words, _ in rows:
                    got = []
                    for x in words:
                        if x not in memo:
                            memo[x] = self.ids_of(x)
                        got.append(memo[x])
                    parts.append(got)
                    width = max(width, max(g.shape[1] for g in got))
                ids = np.full((n, t, len(OFFSETS), width), -1, np.int64)
                gold = np.zeros((n, t), np.int64)
                mask = np.zeros((n, t), bool)
                for r, (words, y) in enumerate(rows):
                    mask[r, : len(words)] = True
                    gold[r, : len(words)] = y
                    for i in range(len(words)):
                        for o, off in enumerate(OFFSETS):
                            j = i + off
                            if 0 <= j < len(words):
                                g = parts[r][j][o]
                                ids[r, i, o, : len(g)] = g
                flat = ids.reshape(n, t, -1)
                held = flat >= 0
                e = (self.w[np.where(held, flat, 0)] * held[..., None]).sum(2)
                p, pair, first = self._marginals(e, mask, gold)
                grad = p * mask[..., None]
                where = np.nonzero(held)
                touched, inverse = np.unique(flat[where], return_inverse=True)
                rows_of = grad[where[0], where[1]].astype(np.float32)
                g = np.stack([np.bincount(inverse, rows_of[:, c], len(touched)) for c in range(k)], 1).astype(np.float32) + keep * self.w[touched]
                gw[touched] += g**2
                self.w[touched] -= rate * g / np.sqrt(gw[touched])
                gm += pair**2
                gb += first**2
                self.move -= (rate * pair / np.sqrt(gm)).astype(np.float32)
                self.begin -= (rate * first / np.sqrt(gb)).astype(np.float32)
        return self

    def _marginals(self, e: np.ndarray, mask: np.ndarray, gold: np.ndarray):
        """Expected minus observed counts of labels, transitions and beginnings."""
        n, t, k = e.shape
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0] + self.begin
        for i in range(1, t):
            m = a[:, i - 1, :, None] + self.move
            top = m.max(1)
            a[:, i] = np.where(mask[:, i, None], np.log(np.exp(m - top[:, None]).sum(1)) + top + e[:, i], a[:, i - 1])
        top = a[:, -1].max(1)
        z = np.log(np.exp(a[:, -1] - top[:, None]).sum(1)) + top
        for i in range(t - 2, -1, -1):
            m = self.move[None] + (e[:, i + 1] + b[:, i + 1])[:, None, :]
            top = m.max(2)
            b[:, i] = np.where(mask[:, i + 1, None], np.log(np.exp(m - top[..., None]).sum(2)) + top, 0.0)
        p = np.exp(np.minimum(a + b - z[:, None, None], 0)) * mask[..., None]
        pair = np.zeros((k, k))
        for i in range(1, t):
            on = mask[:, i]
            if on.any():
                m = a[on, i - 1, :, None] + self.move + (e[on, i] + b[on, i])[:, None, :] - z[on, None, None]
                pair += np.exp(np.minimum(m, 0)).sum(0)
                np.add.at(pair, (gold[on, i - 1], gold[on, i]), -1.0)
        first = p[:, 0].sum(0)
        np.add.at(first, gold[:, 0], -1.0)
        r, c = np.nonzero(mask)
        p[r, c, gold[r, c]] -= 1.0
        return p, pair, first

    def _row(self, token: str) -> int:
        row = self._rows.get(token)
        if row is None:
            row = len(self._rows)
            if row >= len(self._table):
                grown = np.zeros((max(1024, 2 * row), len(OFFSETS), len(self.labels)), np.float32)
                grown[: len(self._table)] = self._table
                self._table = grown
            self._table[row] = self.w[self.ids_of(token)].sum(1)
            self._rows[token] = row
        return row

    def decode(self, texts: list[list[str]], batch: int = 512) -> list[np.ndarray]:
        """Likeliest labels of each text. The order of the texts stays."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        if len(self._rows) > 200_000:
            self._rows.clear()
        rows = [np.array([self._row(x) for x in t], np.int64) for t in texts]
        order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: len(texts[i]))
        k = len(self.labels)
        at = 0
        while at < len(order):
            # Padded batches of bounded area, so that very long texts stand alone.
            take = order[at : at + max(1, min(batch, 400_000 // max(1, len(texts[order[min(at + batch, len(order)) - 1]]))))]
            at += len(take)
            n, t = len(take), len(texts[take[-1]])
            e = np.zeros((n, t, k), np.float32)
            for r, i in enumerate(take):
                own = rows[i]
                m = len(own)
                x = self._table[own]
                for o, off in enumerate(OFFSETS):
                    lo, hi = max(0, -off), min(m, m - off)
                    if hi > lo:
                        e[r, lo:hi] += x[lo + off : hi + off, o]
            back = np.zeros((n, t, k), np.int8)
            score = e[:, 0] + self.begin
            size = np.array([len(texts[i]) for i in take])
            final = score.copy()
            for i in range(1, t):
                m = score[:, :, None] + self.move
                back[:, i] = m.argmax(1)
                score = np.take_along_axis(m, back[:, i][:, None, :].astype(np.int64), 1)[:, 0] + e[:, i]
                on = size > i
                final[on] = score[on]
            label = final.argmax(1)
            path = np.zeros((n, t), np.int64)
            for i in range(t - 1, -1, -1):
                on = size > i
                path[on, i] = label[on]
                label = np.where(on & (i > 0), back[np.arange(n), i, label], label)
            for r, i in enumerate(take):
                out[i] = path[r, : size[r]]
        return out
