"""Abusive, hateful or sexual content: non-negative positive-unlabelled learning over passages.

Texts are cut into passages and words are freed of disguise (spaced letters, look-alike signs, stretched letters, invisible
characters). A linear model over words, word pairs and letter groups is trained from passages of documents that reviewers
confirmed and from unlabelled passages, by the non-negative risk for the share of bad passages. That share is estimated from
the data: a first model, fitted crosswise, gives its rates of true and false alarms on the reviewed documents and its rate of
alarms on the unlabelled ones. A document's score is that of its worst passage; the threshold has the best F1 at that share.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize

#: Bounds of the training sample, in documents: confirmed, cleared and unlabelled ones, those of least hash of doc_id.
MOST_CONFIRMED, MOST_CLEARED, UNLABELLED = 3000, 6000, 6000
#: Words on this share of the training passages count as a whole, without their letter groups.
COMMON = 0.002
#: PRIOR is the share of bad documents that is assumed before it is estimated, and where too few were reviewed.
BITS, PRIOR, EPOCHS = 18, 0.03, 12
#: Weight of the bad class in the risk.
BALANCE = 0.5
#: Within longer passages, the worst stretches of so many words count as well.
STRETCHES = (4, 8)
#: A passage may be what reviewers meant if confirmed texts hold it so many times as often as others.
MEANT = 3
BAD = ("abusive", "hateful", "sexual")
NOTHING = -9.0

_INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u2060-\u2064\ufeff\u0300-\u036f]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-*_]{1,2}){2,}[^\W\d_](?![^\W_])")
#: What a text must hold for spaced letters across blanks to be worth a look.
_SINGLE = re.compile(r"[\s>(][^\W\d_][ .\-*_]{1,2}[^\W\d_][ .\-*_]")
_LOOK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"})
_LOOKALIKE = re.compile(r"(?<![^\W_])[^\W_]*?(?:[a-z][0-9@$!|€]|[0-9@$|€][a-z])[^\s,.;:?()\"]*")
_NO_LOOKALIKE = re.compile(r"[a-z]{2,3}\d{3}|\d[\d.,:]*[a-z%]{0,2}")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_CYRILLIC = str.maketrans("аеорсухіјѕԁһ", "aeopcyxijsdh")
_WORD = re.compile(r"[^\W\d_]*\*+[^\W\d_*]*|[^\W\d_]+(?:['’][^\W\d_]+)*|#|\n")
_END, _END_ANYWHERE = tuple(".!?।。！？…"), re.compile(r"(?<=[।。！？])")
_NO_SPACES = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff\u0e00-\u0e7f]")
_NUMBER = re.compile(r"(?:rs\.?|inr|₹)?\d[\d,.:/\-]*")


def _joined(m: re.Match) -> str:
    return re.sub(r"[ .\-*_]", "", m.group())


def _plain_signs(m: re.Match) -> str:
    word = m.group()
    return word if _NO_LOOKALIKE.fullmatch(word) else word.translate(_LOOK)


def undisguised(text: str) -> str:
    """Lower case text without invisible signs, spaced-out words, look-alike signs within words and stretched letters."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = _SPACED.sub(_joined, text).lower()
    if not text.isascii():
        text = " ".join(w.translate(_CYRILLIC) if re.search("[a-z]", w) else w for w in text.split(" "))
    return _STRETCH.sub(r"\1", _LOOKALIKE.sub(_plain_signs, text))


def pieces(raw: str) -> list[str]:
    """The words of a piece of text without blanks, undisguised; numbers become one sign, a line feed ends a passage."""
    words = _WORD.findall(_NUMBER.sub(" # ", undisguised(_END_ANYWHERE.sub("\n", raw))))
    if not raw.isascii():  # scripts without spaces: every sign is a word
        words = [c for w in words for c in (w if _NO_SPACES.match(w) else (w,))]
    if raw.endswith(_END):
        words.append("\n")
    return words


class Vocabulary(dict):
    """Words and their numbers; number 0 ends a passage. ``texts`` gives whole texts as numbers.

    What a piece of text between two blanks holds is remembered, so that each is undisguised once.
    """

    def __init__(self) -> None:
        super().__init__({"\n": 0})
        self.hashes = [0]
        self._pieces: dict[str, list[int]] = {}

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n

    def text(self, text: str | None) -> list[int]:
        """Numbers of the words of a whole text. Passages are sentences and lines; letters spaced out don't end one."""
        out: list[int] = []
        held = self._pieces
        if text:
            if _SINGLE.search("\n" + text):
                text = _SPACED.sub(_joined, text)
            for line in text.split("\n"):
                for raw in line.split():
                    own = held.get(raw)
                    if own is None:
                        held[raw] = own = [self[w] for w in pieces(raw)]
                    out += own
                out.append(0)
            return out
        return [0]

    def forget_pieces(self) -> None:
        self._pieces.clear()


def _groups(word: str) -> list[str]:
    """Letter groups of a word: of three to five, from its rim inwards; a masked word also by what is left of it."""
    out = ["w" + word]
    if "*" in word:
        return [*out, "m" + word[0] + word[-1], "m" + re.sub(r"\*+", "*", word), "masked"]
    if len(word) > 3:
        rim = f"<{word}>"
        for n in (3, 4, 5):
            out += [f"c{rim[i : i + n]}" for i in range(len(rim) - n + 1)]
    elif not word.isascii():
        out += [f"c{word[i : i + 2]}" for i in range(max(1, len(word) - 1))]
    return out


def _feature(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) & ((1 << BITS) - 1)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def pair_features(h: np.ndarray) -> np.ndarray:
    """Feature numbers of neighbouring words, out of the hashes of a sequence."""
    with np.errstate(over="ignore"):
        x = (h[:-1] * np.uint64(31) + h[1:]) * _MIX
        return ((x ^ (x >> np.uint64(29))) >> np.uint64(64 - BITS)).astype(np.int32)


def features_of(words: list[str], common: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where each word's features start, and the features one after the other. The end of a passage has none."""
    each = [[] if w == "\n" else [_feature(f) for f in (("w" + w,) if w in common else _groups(w))] for w in words]
    return np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64), np.array([f for x in each for f in x], np.int32)


def _word_scores(w: np.ndarray, starts: np.ndarray, features: np.ndarray) -> np.ndarray:
    """A word's weight: the sum over its features by the root of their number."""
    sums = np.concatenate(([0.0], np.cumsum(w[features], dtype=np.float64)))
    return (sums[starts[1:]] - sums[starts[:-1]]) / np.sqrt(np.maximum(1, np.diff(starts)))


def _passage_scores(rows: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score of each passage over its whole and its stretches, and the places where passages end.

    ``rows``: word numbers, 0 ends a passage; ``s``: weight of each place, with that of its pair with the word before.
    """
    ends = np.flatnonzero(rows == 0)
    begins = np.concatenate(([0], ends[:-1] + 1))
    c = np.concatenate(([0.0], np.cumsum(s)))
    n = ends - begins
    best = np.where(n > 0, (c[ends] - c[begins]) / np.sqrt(np.maximum(4, n)), -np.inf)
    for k in STRETCHES:
        long = np.flatnonzero(n > k)
        if len(long):
            run = c[k:] - c[:-k]
            # From a passage's first word up to its last stretch; what lies between two such is left out by every other slice.
            cuts = np.stack((begins[long], ends[long] - k + 1), 1).ravel()
            if cuts[-1] >= len(run):
                run = np.append(run, -np.inf)
            best[long] = np.maximum(best[long], np.maximum.reduceat(run, cuts)[::2] / np.sqrt(k))
    return best, ends


class Model:
    """A linear model; scores the worst passage of a text."""

    def __init__(self, w: np.ndarray, bias: float, threshold: float, common: frozenset[str] = frozenset(), prior: float = PRIOR) -> None:
        self.w, self.bias, self.threshold, self.common, self.prior = w, bias, threshold, common, prior
        self._forget()

    def _forget(self) -> None:
        self._words = Vocabulary()
        self._scores, self._hashes = np.zeros(0), np.zeros(0, np.uint64)

    def __getstate__(self):
        return {"w": self.w, "bias": self.bias, "threshold": self.threshold, "common": self.common, "prior": self.prior}

    def __setstate__(self, state):
        self.__init__(**state)

    def texts(self, texts: list[str | None], at_once: int = 1_000_000) -> np.ndarray:
        """Score of each text, of its worst passage. Texts are taken together up to ``at_once`` characters."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size > at_once:
                out.append(self._part(part))
                part, size = [], 0
        if part:
            out.append(self._part(part))
        return np.concatenate(out) if out else np.zeros(0)

    def _part(self, texts: list[str | None]) -> np.ndarray:
        if len(self._words) > 300_000:
            self._forget()
        words = self._words
        if len(words._pieces) > 600_000:
            words.forget_pieces()
        each = [words.text(t) for t in texts]
        sizes = [len(x) for x in each]
        rows = np.fromiter(itertools.chain.from_iterable(each), np.int64, sum(sizes))
        have = len(self._hashes)
        if len(words) > have:
            new = _word_scores(self.w, *features_of(list(itertools.islice(words, have, None)), self.common))
            self._scores = np.concatenate((self._scores, new))
            self._hashes = np.concatenate((self._hashes, np.array(words.hashes[have:], np.uint64)))
        s = self._scores[rows]
        if len(rows) > 1:
            s[1:] += np.where((rows[1:] != 0) & (rows[:-1] != 0), self.w[pair_features(self._hashes[rows])], 0.0)
        best, ends = _passage_scores(rows, s)
        first = np.searchsorted(ends, np.concatenate(([0], np.cumsum(sizes)[:-1])))
        score = np.maximum.reduceat(best, first) + self.bias
        return np.where(np.isfinite(score), np.maximum(score, NOTHING), NOTHING)

    def text(self, text: str | None) -> float:
        return float(self.texts([text])[0])


class Passages:
    """Passages of texts as word numbers, and which text each belongs to; equal passages of a text count once."""

    def __init__(self, texts: list[list[int]]) -> None:
        rows, sizes, owner, self.keys = [], [], [], []
        for k, text in enumerate(texts):
            seen, own = set(), []
            for w in text:
                if w:
                    own.append(w)
                elif own:
                    key = hash(tuple(own))
                    if key not in seen:
                        seen.add(key)
                        self.keys.append(key)
                        rows += own
                        sizes.append(len(own))
                        owner.append(k)
                    own = []
        self.rows, self.sizes, self.owner = np.array(rows, np.int32), np.array(sizes, np.int64), np.array(owner, np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.scale = 1 / np.sqrt(np.maximum(4, self.sizes))
        self.pairs = np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.sizes)

    def spell(self, hashes: np.ndarray) -> None:
        """Feature number of each word with the one before it; the first word of a passage has none (-1)."""
        if len(self.rows):
            self.pairs = np.concatenate(([-1], pair_features(hashes[self.rows]))).astype(np.int32)
            self.pairs[self.starts[:-1]] = -1

    def places(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of the chosen passages, and the number of the passage, among the chosen, of each."""
        sizes = self.sizes[chosen]
        at = np.repeat(self.starts[chosen] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        return at, np.repeat(np.arange(len(chosen)), sizes)


class _Net:
    """Weights, their gradients and adaptive steps over a vocabulary."""

    def __init__(self, spelled: tuple[np.ndarray, np.ndarray]) -> None:
        self.starts, self.features = spelled
        self.root = 1 / np.sqrt(np.maximum(1, np.diff(self.starts)))
        self.of = np.repeat(np.arange(len(self.root)), np.diff(self.starts))
        self.w, self.bias = np.zeros(1 << BITS, np.float32), -1.0
        self.g2, self.gb = np.full(1 << BITS, 1e-5, np.float32), 1e-5

    def scores(self, p: Passages, chosen: np.ndarray, words: np.ndarray) -> np.ndarray:
        at, of = p.places(chosen)
        pairs = p.pairs[at]
        s = words[p.rows[at]] + np.where(pairs >= 0, self.w[pairs], 0.0)
        return np.bincount(of, s, len(chosen)) * p.scale[chosen] + self.bias

    def step(self, parts: list[tuple[Passages, np.ndarray, np.ndarray]], rate: float, keep: float) -> None:
        """Moves against the gradient; ``parts``: passages, those chosen, and the slope of each."""
        by_word, pair_ids, pair_g, total = np.zeros(len(self.root)), [], [], 0.0
        for p, chosen, slope in parts:
            at, of = p.places(chosen)
            each = (slope * p.scale[chosen])[of]
            by_word += np.bincount(p.rows[at], each, len(self.root))
            pairs = p.pairs[at]
            pair_ids.append(pairs[pairs >= 0])
            pair_g.append(each[pairs >= 0])
            total += slope.sum()
        g = np.bincount(np.concatenate((self.features, *pair_ids)), np.concatenate(((by_word * self.root)[self.of], *pair_g)), 1 << BITS).astype(np.float32)
        on = np.flatnonzero(g)
        g = g[on] + keep * self.w[on]
        self.g2[on] += g**2
        self.w[on] -= rate * g / np.sqrt(self.g2[on])
        self.gb += total * total
        self.bias -= rate * total / np.sqrt(self.gb)


def nn_pu(positive: Passages, chosen: np.ndarray, unlabelled: Passages, inside: np.ndarray, prior: float, spelled, *, epochs: int = EPOCHS, rate: float = 0.15, seed: int = 3, keep: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with the logistic loss l, its classes balanced.

    risk = BALANCE * E_p[l(+)] + (1 - BALANCE) / (1 - prior) * max(0, E_u[l(-)] - prior * E_p[l(-)]) over the ``chosen``
    positive and the unlabelled passages ``inside``; with BALANCE = prior it would be the plain one. Bad passages are so few
    that the plain risk is least where nothing is bad. A batch whose second part is negative moves by that part alone, the
    other way.
    """
    rest = (1 - BALANCE) / (1 - prior)
    rng = np.random.default_rng(seed)
    net = _Net(spelled)
    if not len(chosen) or not len(inside):
        return net.w, net.bias
    steps = max(1, len(inside) // 2000)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(inside), steps):
            pick = rng.choice(chosen, min(len(chosen), 500), replace=len(chosen) > 500)
            own = _word_scores(net.w, net.starts, net.features)
            zp, zu = (net.scores(p, c, own) for p, c in ((positive, pick), (unlabelled, batch)))
            sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            # Slopes: l(+) has s - 1, l(-) has s.
            gp, gn, gu = BALANCE * (sp - 1) / len(pick), rest * prior * sp / len(pick), rest * su / len(batch)
            if np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0:
                net.step([(positive, pick, gp - gn), (unlabelled, batch, gu)], rate, keep)
            else:
                net.step([(positive, pick, gn), (unlabelled, batch, -gu)], rate, keep)
    return net.w, net.bias


def _rounds(bad: Passages, inside_bad: np.ndarray, score: np.ndarray, good: Passages, inside_good: np.ndarray, prior: float, spelled, rounds: int = 3) -> tuple[np.ndarray, float, float]:
    """Learns which passages of the confirmed texts are meant and, from them, the weights.

    The prior of passages is that of documents times the meant passages of a bad one by the passages of any one. Gives that of
    the last round too.
    """
    w, bias, share = np.zeros(1 << BITS, np.float32), -1.0, prior
    each = len(inside_good) / max(1, len(np.unique(good.owner[inside_good])))
    texts = max(1, len(np.unique(bad.owner[inside_bad])))
    for turn in range(rounds):
        best = np.full(int(bad.owner.max()) + 1, -np.inf)
        np.maximum.at(best, bad.owner[inside_bad], score[inside_bad])
        # One passage of a text is enough; further ones count if the model holds them for bad.
        meant = inside_bad[(score[inside_bad] >= best[bad.owner[inside_bad]]) | ((turn > 0) & (score[inside_bad] > 0))]
        share = min(0.5, prior * len(meant) / texts / max(1.0, each))
        w, bias = nn_pu(bad, meant, good, inside_good, share, spelled, seed=3 + turn)
        score = _all_scores(bad, w, bias, spelled)
    return w, bias, share


def _all_scores(p: Passages, w: np.ndarray, bias: float, spelled) -> np.ndarray:
    net = _Net(spelled)
    net.w, net.bias = w, bias
    return net.scores(p, np.arange(len(p)), _word_scores(w, net.starts, net.features))


def best_threshold(bad: np.ndarray, clear: np.ndarray, prior: float) -> float:
    """The score with the best F1 where a share ``prior`` of all texts is bad: both sides weigh by that, not by their numbers."""
    s = np.concatenate((bad, clear))
    weight = np.concatenate((np.full(len(bad), prior / len(bad)), np.full(len(clear), (1 - prior) / len(clear))))
    order = np.argsort(-s, kind="stable")
    hit, all_ = np.cumsum(np.where(order < len(bad), weight[order], 0.0)), np.cumsum(weight[order])
    s = s[order]
    f1 = np.where(np.append(s[:-1] > s[1:], True), 2 * hit / (all_ + prior), 0.0)
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] - 1e-6)


def estimated_prior(bad: np.ndarray, clear: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of bad texts among unlabelled ones, by their rate of alarms less the false ones, by true less false ones.

    Measured at the scores between a tenth and a half of the bad texts, where false alarms are few; the median counts.
    """
    out = []
    for q in np.linspace(0.1, 0.5, 9):
        t = np.quantile(bad, q)
        hit, false, all_ = ((x > t).mean() for x in (bad, clear, unlabelled))
        if hit > false:
            out.append((all_ - false) / (hit - false))
    return float(np.clip(np.median(out), 0.001, 0.5)) if out else PRIOR


def train(confirmed: list[str], cleared: list[str], unlabelled: list[str], prior: float | None = None) -> Model:
    """A model from whole texts. Which passage of a confirmed text is the bad one is learned in rounds.

    The first round goes by how rare a passage's words are in the other texts; later ones by the model so far. The share of bad
    texts is estimated if none is given. With fewer than ten confirmed or cleared texts it is PRIOR and the threshold is 0.
    """
    words = Vocabulary()
    bad, good = (Passages([words.text(t) for t in x]) for x in (confirmed, [*cleared, *unlabelled]))
    if not len(bad) or not len(good):
        return Model(np.zeros(1 << BITS, np.float32), -1.0, 0.0)
    # In how many of the other passages each word stands.
    each = np.unique(np.repeat(np.arange(len(good)), good.sizes) * len(words) + good.rows)
    seen = np.bincount(each % len(words), minlength=len(words))
    del each
    names = list(words)
    common = frozenset(names[k] for k in np.flatnonzero(seen >= max(5, COMMON * len(good))))
    spelled = features_of(names, common)
    hashes = np.array(words.hashes, np.uint64)
    bad.spell(hashes)
    good.spell(hashes)
    rare = np.log((len(good) + 1) / (seen + 0.5))
    rare[[0, words.get("#", 0)]] = 0
    first = np.add.reduceat(rare[bad.rows], bad.starts[:-1]) / np.maximum(3, bad.sizes)
    # A passage that good texts hold about as often as confirmed ones isn't what the reviewers meant.
    held: dict[str, int] = {}
    for k in good.keys:
        held[k] = held.get(k, 0) + 1
    own: dict[str, int] = {}
    for k in bad.keys:
        own[k] = own.get(k, 0) + 1
    texts = len(cleared) + len(unlabelled)
    meant = np.array([own[k] * texts > MEANT * held.get(k, 0) * len(confirmed) for k in bad.keys])
    some = np.zeros(len(confirmed), bool)
    some[bad.owner[meant]] = True
    inside = np.flatnonzero(meant | ~some[bad.owner])
    everything = np.arange(len(good))
    few = len(confirmed) < 10 or len(cleared) < 10
    share, threshold = PRIOR if prior is None else prior, 0.0
    if not few:
        scores: list[list[np.ndarray]] = [[], [], []]
        for fold in (0, 1):
            rest = everything[(good.owner >= len(cleared)) | (good.owner % 2 != fold)]
            w, bias, _ = _rounds(bad, inside[bad.owner[inside] % 2 != fold], first, good, rest, share, spelled, rounds=2)
            model = Model(w, bias, 0.0, common)
            for out, given in zip(scores, (confirmed, cleared, unlabelled)):
                out.append(model.texts(given[fold::2]))
        sides = [np.concatenate(x) for x in scores]
        if prior is None and len(unlabelled):
            share = estimated_prior(*sides)
        threshold = best_threshold(sides[0], sides[1], share)
    w, bias, _ = _rounds(bad, inside, first, good, everything, share, spelled)
    return Model(w, bias, threshold, common, share)


def verdicts(labels: DataFrame) -> DataFrame:
    """(doc_id, bad) of documents with clear verdicts: the majority of a document's, without null and undecided ones."""
    kind = F.lower(F.trim("category"))
    known = labels.select("doc_id", F.when(kind.isin(*BAD), 1).when(kind == "none", 0).alias("v")).filter("v IS NOT NULL AND doc_id IS NOT NULL")
    return known.groupBy("doc_id").agg(F.avg("v").alias("m")).filter("m <> 0.5").select("doc_id", (F.col("m") > 0.5).alias("bad"))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of these tables; the driver holds at most the bounded training sample.

    The sample is chosen by hash among the ids alone; only the texts of those chosen are read.
    """
    ids = documents.filter("text IS NOT NULL").select("doc_id").distinct().join(verdicts(labels), "doc_id", "left")
    order = F.xxhash64(F.lit(5), "doc_id")
    side = F.when(F.col("bad"), 0).when(~F.col("bad"), 1).otherwise(2)
    chosen = None
    for k, most in enumerate((MOST_CONFIRMED, MOST_CLEARED, UNLABELLED)):
        part = ids.withColumn("side", side).filter(F.col("side") == k).orderBy(order, "doc_id").limit(most).select("doc_id", "side")
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = materialize(chosen, "review-sample")
    # At most MOST_CONFIRMED + MOST_CLEARED + UNLABELLED ids, whatever the tables hold.
    rows = documents.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "side").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["side"], str(r["doc_id"])))
    return train(*([r["text"] for r in rows if r["side"] == k] for k in range(3)))


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, bad) of every document; null, empty and blank texts score NOTHING and are not bad."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = model.value
        for batch in batches:
            s = work.texts(batch.column(2).to_pylist())
            bad = (s > work.threshold) & (s > NOTHING)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array(bad, pa.bool_())], names=["doc_id", "source", "score", "bad"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(run, "doc_id long, source string, score double, bad boolean")


def found_bad(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents with a bad passage."""
    return scored(documents, labels).filter("bad").select("doc_id").distinct()


def source_rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, documents, bad, rate) over all documents of each source."""
    s = scored(documents, labels).groupBy("source").agg(F.count("*").alias("documents"), F.count_if("bad").alias("bad"))
    return s.withColumn("rate", F.round(F.col("bad") / F.col("documents"), 6))
