"""Broken prompt and response pairs, each with the type of its defect.

Openings of responses are clustered by MinHash, every member verified against its cluster's representative. An opening
that recurs across unrelated prompts answers none of them: if many responses of its cluster decline, all of them are refusals,
whatever their own words. Copies are found by
letters, languages by script and function words, and broken-off ends by how often the whole corpus ends a sentence
where the response does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import guarded_broadcast, materialize
from weftline.llm.conversations import reply_pairs

OPENING_WORDS, BANDS, ROWS_OF_BAND, SIMILAR = 8, 8, 2, 0.6

_LETTER = re.compile(r"[\W_]+")
_INVISIBLE = re.compile(r"[​-‏⁠﻿­]")
#: Words that stand for no answer.
_NO_ANSWER = frozenset("na none null nil noanswer tba tbd tbc nan undefined empty blank notanswered unanswered pending notavailable notapplicable xx xxx noresponse todo void keineantwort sinrespuesta sansréponse".split())
_LEAD = re.compile(
    r"^\s*(?:sure|thanks for asking|thank you for asking|sorry for the delay|happy to help|good question|great question|of course|certainly|hello|hi|hey|dear \w+|answer|ans|a|q|question|you asked|your question|re|reply)\s*[.!:,\-–]+\s*", re.I)
_COPY_LEAD = re.compile(r"^\s*(?:answer|ans|a|q|question|you asked|you have asked|you want to know|you wrote|your question(?: was| is)?|re|reply|user|the question is|asked|so)\s*[:,\-–>]*\s*", re.I)
_ACT = r"(?:answer|answered|reply|respond|help|assist|comment|discuss|share|provide|disclose|talk about|speak|advise|engage|support|fulfil|complete|process|handle|offer|give|address|tell|say|information|request|question|guidelines?|permission|policy|topic|matter)"
_NEG = r"(?:can(?:no|')?t|cannot|can not|could not|couldn't|unable|not able|won't be able|will not|won't|not allowed|not permitted|not appropriate|inappropriate|not in a position|no comment|decline|declining|refuse|prevent\w*|outside|beyond|pass on|do not have permission|don't have permission|not authori[sz]ed|must not|may not|rather not|not something|restricted from|forbidden|not free|not going to|off limits)"
_SELF = r"(?:\bi\b|\bi'm\b|\bmy\b|\bme\b|\bthis assistant\b|\bassistant\b|\bas an? \w+|\bsorry\b|\bapolog\w+|\bunfortunately\b|\bregret\w*|\bthis one\b|\bmyself\b|\bafraid\b)"
_REFUSE = (re.compile(r"\b" + _NEG + r"\b", re.I), re.compile(r"\b" + _ACT + r"\b", re.I), re.compile(_SELF, re.I))
#: One of these stands, within a word, in whatever the first pattern matches.
_STEMS = ("not", "can't", "cant", "n't", "unable", "inappropriate", "comment", "declin", "refuse", "prevent", "outside", "beyond", "pass", "restricted", "forbidden", "limits")
_REFUSE_LATIN = re.compile(r"no puedo|lo siento|no me es posible|je ne (?:peux|suis)|je regrette|désolé|nicht (?:beantworten|helfen|sagen)|leider|tut mir leid|darf ich nicht|maaf kij|nahin? (?:bata|de) sakt", re.I)
#: The same phrases as far as ASCII spells them.
_REFUSE_PLAIN = ("no puedo", "lo siento", "no me es posible", "je ne peux", "je ne suis", "je regrette", "nicht beantworten", "nicht helfen", "nicht sagen", "leider", "tut mir leid", "darf ich nicht", "maaf kij",
                 "nahi bata sakt", "nahin bata sakt", "nahi de sakt", "nahin de sakt")
_REFUSE_OTHER = re.compile(
    r"नहीं दे सकता|नहीं कर सकता|क्षमा करें|माफ़? ?कीजि|抱歉|无法回答|不能回答|无法提供|對不起|对不起", re.I)
_HOLE = re.compile(r"<[a-z]{2,8}>|\{\w+\}|\[\w+\]")

#: Function words by language; Romanised Hindi counts as Hindi.
_FUNCTION = {
    "en": "the is are of and to in for you it what how can be by with at on this that please will may a an do does when which there any not have from your we if must i or until before after much yes please but so they he she was were would should could has had its our their".split(),
    "fr": "le la les des du une est et pour dans vous il que qui avec sur au aux sont ont cette ce par plus puis quel quelle quels je mon être été avant après faut se nous à d l en un".split(),
    "de": "der die das und ist für sind ein eine im zum zur den dem des mit bei bis wie von auf wird ich nicht sich es am zu hoch wann gibt kann mindestens erforderlich bietet".split(),
    "es": "el los las del una es y para con por que se al en este esta más su sus son hasta antes hay cuál cuánto cuándo cómo la de un lo no salvo puedo".split(),
    "hi": "hai hain ka ki ke ko mein se aur kya kab kitni kitna kaise nahi nahin liye aap hum yeh ise ji par tak lekin sakte sakti baad karein hota hoti milti milta zaroori chahiye haan jaankari wahan".split(),
}
_FUNCTION_OF: dict[str, list[str]] = {}
for _lang, _words in _FUNCTION.items():
    for _w in dict.fromkeys(_words):
        _FUNCTION_OF.setdefault(_w, []).append(_lang)
#: Letters that speak for a language.
_MARKS = {"fr": "éèêàçùœ", "de": "äöüß", "es": "ñ¿¡íóáú"}
_SCRIPTS = (("hi", re.compile(r"[ऀ-ॿ]")), ("zh", re.compile(r"[一-鿿]")), ("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힯]")), ("ru", re.compile(r"[Ѐ-ӿ]")),
            ("ar", re.compile(r"[؀-ۿ]")), ("bn", re.compile(r"[ঀ-৿]")), ("ta", re.compile(r"[஀-௿]")), ("te", re.compile(r"[ఀ-౿]")), ("gu", re.compile(r"[઀-૿]")))
_ASKED = {
    "fr": r"french|français|französisch|francés|फ़?्रेंच|法语|法文", "de": r"german|deutsch|allemand|alemán|जर्मन|德语|德文", "es": r"spanish|español|espagnol|spanisch|स्पेनिश|西班牙语|西班牙文",
    "hi": r"hindi|हिंदी|हिन्दी|印地语", "zh": r"chinese|mandarin|中文|汉语|chinois|chinesisch|chino|चीनी", "en": r"english|anglais|englisch|inglés|अंग्रेज़?ी|英语|英文",
}
_ASKED_OF = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)" if k != "zh" else v, re.I) for k, v in _ASKED.items()}
_TOKEN = re.compile(r"[^\W\d_]+")
#: ASCII text in lower case with blanks for all but letters; and what letters() takes out of it.
_WORDS = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalpha() else 32 for i in range(256))
_LOWER, _NO_LETTER = bytes(range(128)).lower() + bytes(range(128, 256)), bytes(i for i in range(128) if not chr(i).isalnum())
_ANY_SCRIPT = re.compile("|".join(p.pattern for _, p in _SCRIPTS))


def language(text: str) -> tuple[str | None, float]:
    """Likeliest language and the evidence for it; None where a text says too little."""
    plain = text.isascii()
    if not plain and _ANY_SCRIPT.search(text):
        latin = len(re.findall(r"[a-z]", text))
        for lang, pattern in _SCRIPTS:
            n = len(pattern.findall(text))
            if n >= 2 and n * (4 if lang in ("zh", "ja", "ko") else 1) >= latin * 0.5:
                return lang, float(n)
    score: dict[str, float] = {}
    low = text.lower()
    words = text.encode().translate(_WORDS).decode().split() if plain else _TOKEN.findall(low)
    for of in filter(None, map(_FUNCTION_OF.get, words)):
        for lang in of:
            score[lang] = score.get(lang, 0.0) + 1.0 / len(of)
    if not plain:
        for lang, marks in _MARKS.items():
            n = sum(low.count(c) for c in marks)
            if n:
                score[lang] = score.get(lang, 0.0) + min(n, 4) * 0.5
    if not score:
        return None, 0.0
    best = max(score, key=score.get)
    rest = max((v for k, v in score.items() if k != best), default=0.0)
    return (best, score[best]) if score[best] >= 1.5 and score[best] >= 1.6 * rest else (None, score[best])


def letters(text: str) -> str:
    if text.isascii():
        return text.encode().translate(_LOWER, _NO_LETTER).decode()
    return _LETTER.sub("", text.lower())


def is_empty(answer: str | None) -> bool:
    """Null, blank, or only a sign or word that stands for no answer."""
    if answer is None:
        return True
    answer = answer.strip()
    if len(answer) > 40:
        return not any(map(str.isalnum, answer))
    own = letters(_INVISIBLE.sub("", answer))
    return not own or own in _NO_ANSWER


def is_copy(question: str | None, answer: str) -> bool:
    """The answer gives back the question, or a sentence of it, and nothing else."""
    if not question:
        return False
    q = letters(question)
    # The letters of an answer that goes far beyond the question are more than those of the question twice, and of a lead.
    if len(answer) > 2 * len(question) + 60 and len(letters(answer)) > 2 * len(q) + 60:
        return False
    for text in dict.fromkeys((answer, _COPY_LEAD.sub("", answer))):
        a = letters(text)
        if a and q and (a == q or (len(a) >= 12 and a in q and len(a) * 2 >= len(q)) or a == q + q):
            return True
    if answer.rstrip().endswith(("?", "？")):
        a = letters(_COPY_LEAD.sub("", answer))
        return len(a) >= 12 and a in q
    return False


class _Memo(dict):
    """Remembers what a function gives; forgets all when it is full."""

    def __init__(self, of, most: int = 200_000) -> None:
        self.of, self.most = of, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.of(key)
        return value


def _declining(sentence: str) -> bool:
    return all(p.search(sentence) for p in _REFUSE)


#: By masked sentence: names and numbers don't decline.
_DECLINING = _Memo(_declining)


def declines(answer: str) -> bool:
    """Words of declining: a negation, an act of answering and the answerer, within one sentence of the whole answer."""
    text = _LEAD.sub("", answer)
    if not text.isascii() and _ANY_SCRIPT.search(text) and _REFUSE_OTHER.search(text):
        return True
    text = text.replace("’", "'")
    low = text.lower()
    # These phrases hold no sign that ends a sentence, so they needn't be looked for in each by itself.
    if any(map(low.__contains__, _REFUSE_PLAIN)) if text.isascii() else _REFUSE_LATIN.search(text):
        return True
    # Patterns take the long s and the dotless i for ASCII letters.
    if not any(map(low.__contains__, _STEMS)) and "ſ" not in low and "ı" not in low:
        return False
    return any(_DECLINING[" ".join(mask_words(s))] for s in sentences(text))


def _masked(word: str) -> str:
    core = word.strip("()[]\"'“”‘’,;:")
    if not core:
        return ""
    if any(c.isdigit() for c in core) or core[0] in "₹$€£" or core in ("Rs.", "INR", "Rs"):
        return "#"
    if core[0].isupper() and len(core) > 1 and not core.isupper():
        return "@"
    return core.lower()


#: A word without its variable part: names, numbers and amounts are the same.
_MASKED = _Memo(_masked)


def mask_words(text: str, most: int | None = None) -> list[str]:
    """The masked words of a text, or the first ``most`` of them."""
    words = text.split()
    if not words:
        return []
    first = words[0].lower().strip(",;:()\"")
    out = [first] if first else []
    last = first
    for m in map(_MASKED.__getitem__, words[1:]):
        if m and (m != last or m not in "#@"):
            if len(out) == most:
                break
            out.append(m)
            last = m
    return out


_SENTENCE = re.compile(r"(?<=[.!?।])\s+|(?<=[。！？])|\n+")
_END = re.compile(r"[.!?।。！？][\"'”’)\]]*$")
#: Abbreviations whose full stop ends no sentence.
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:Rs|No|Dr|Mr|Ms|Mrs|Prof|St|[A-Z]|(?:[A-Z][A-Za-z]{0,3}\.)+[A-Z]?[A-Za-z]{0,3})\.$")


def sentences(text: str) -> list[str]:
    out: list[str] = []
    for p in _SENTENCE.split(text.strip()):
        if not p or p.isspace():
            continue
        if out and out[-1][-1] == "." and _ABBREVIATION.search(out[-1][-12:]):
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def opening(answer: str) -> list[str]:
    return mask_words(_LEAD.sub("", answer), OPENING_WORDS)


def prompt_key(question: str | None) -> int:
    """Key of what a prompt asks: the masked words of its last question, else of its longest sentence."""
    parts = sentences(question or "")
    asking = [s for s in parts if s.rstrip().endswith(("?", "？"))] or sorted(parts, key=len)
    return xxhash.xxh3_64_intdigest(" ".join(mask_words(asking[-1]))) - (1 << 63) if asking else 0


_SEEDS = np.random.default_rng(7).integers(1, 2**63, (2, BANDS * ROWS_OF_BAND), np.uint64) | np.uint64(1)


def band_keys(words: list[str]) -> np.ndarray:
    """Keys of the MinHash bands over single words and neighbours of an opening."""
    grams = {*words, *(a + " " + b for a, b in zip(words, words[1:]))} or {""}
    h = np.array([xxhash.xxh3_64_intdigest(g) for g in grams], np.uint64)
    with np.errstate(over="ignore"):
        mins = ((h[:, None] * _SEEDS[0] + _SEEDS[1]) >> np.uint64(1)).min(axis=0).reshape(BANDS, ROWS_OF_BAND)
    return np.array([xxhash.xxh3_64_intdigest(bytes([k]) + b.tobytes()) for k, b in enumerate(mins)], np.uint64).view(np.int64)


def similar(a: list[str], b: list[str]) -> float:
    x = {*a, *(p + " " + q for p, q in zip(a, a[1:]))}
    y = {*b, *(p + " " + q for p, q in zip(b, b[1:]))}
    return len(x & y) / max(1, len(x | y))


def _tails(words: list[str]) -> Iterator[tuple[int, int, int]]:
    """(length, key, ends here) of the word groups of a whole sentence."""
    n = len(words)
    for i in range(n):
        end = int(i == n - 1)
        for k in (1, 2, 3):
            if i - k + 1 >= 0:
                yield k, tail_key(words[i - k + 1 : i + 1]), end


def tail_key(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)


#: Words no sentence ends with.
_OPEN_WORDS = frozenset(
    "the a an of and or to for by with at in on from is are was be been has have will may can must should that which who whose than as its their your our this these into about between during over under per up not "
    "le la les des du une un et de à au aux en pour par dans avec sur est sont que qui l' d' se der die das den dem des und ist sind im zum zur für mit bei bis von auf ein eine einen el los las del y con por al es una su hasta un "
    "का की के को में से और पर है। द्वारा".split())


def unfinished(answer: str) -> list[str] | None:
    """Masked words of the last sentence if the answer doesn't end one, else None."""
    text = (answer if answer.isascii() else _INVISIBLE.sub("", answer)).rstrip()
    if text[-1:] in ".!?।。！？\"'”’)]" and _END.search(text) and not re.search(r"(?:\bRs|\bB|\bM|\bPh|\bNo|\bDr|\bProf|\.\.)\.$", text):
        return None
    last = sentences(text)
    return mask_words(last[-1]) if last else None


_PAIR = "pair_source string, pair_id string, defect string, opening array<string>, prompt long, cue boolean, hole boolean, tail array<string>, whole boolean"


def _assess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(9)]
        for source, i, q, a in zip(*(batch.column(c).to_pylist() for c in range(4))):
            defect, tail, whole, cue, hole = None, None, False, False, False
            if is_empty(a):
                defect = "empty"
            elif is_copy(q, a):
                defect = "copied_question"
            else:
                cue, hole = declines(a), ("<" in a or "{" in a or "[" in a) and bool(_HOLE.search(a))
                # An answer may start by repeating its question, in the question's language.
                own = a[len(q) :] if q and a.startswith(q) else a
                lang, _ = language(own)
                asked, _ = language(q or "")
                if lang and asked and lang != asked and not (lang in _ASKED_OF and _ASKED_OF[lang].search(q)):
                    defect = "wrong_language"
                tail = unfinished(a)
                whole = tail is not None and len(sentences(_LEAD.sub("", a))) <= 1 and len(tail) <= 7
            for c, v in zip(out, (source, i, defect, opening(a) if a and defect is None else None, prompt_key(q), cue, hole, tail[-3:] if tail else None, whole)):
                c.append(v)
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[f.split()[0] for f in _PAIR.split(", ")])


def _whole_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masked whole sentences and how often they stand; added up before the shuffle."""
    counts: dict[str, int] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["s", "n"])
        counts.clear()
        return out

    for batch in batches:
        for a in batch.column(0).to_pylist():
            for s in sentences(a or ""):
                if s[-1] in ".!?।。！？\"'”’)]" and _END.search(s):
                    words = mask_words(s)
                    if words:
                        words[-1] = words[-1].rstrip(".!?।。！？")
                        key = " ".join(words)
                        counts[key] = counts.get(key, 0) + 1
        if len(counts) > 100_000:
            yield flush()
    if counts:
        yield flush()


def _sentence_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often word groups stand in whole sentences, and at their ends. Input: masked sentence, count."""
    counts: dict[int, list[int]] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1] for v in counts.values()], pa.int64())], names=["key", "n", "ends"])
        counts.clear()
        return out

    for batch in batches:
        for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for _, key, end in _tails(s.split(" ")):
                held = counts.setdefault(key, [0, 0])
                held[0] += n
                held[1] += n * end
        if len(counts) > 200_000:
            yield flush()
    if counts:
        yield flush()


def opening_clusters(assessed: DataFrame) -> DataFrame:
    """(opening, cluster, prompts, n, cued, holed): clusters of verified MinHash, and how unrelated their prompts are.

    ``prompts`` is the effective number of different prompts (the exponential of their entropy). Every opening is held
    against the smallest opening of each of its bands; it joins the smallest one it is truly similar to.
    """
    distinct = materialize(
        assessed.filter("opening IS NOT NULL").groupBy("opening", "prompt").agg(F.count("*").alias("n"), F.sum(F.col("cue").cast("long")).alias("cued"), F.sum(F.col("hole").cast("long")).alias("holed")), "openings")
    ones = distinct.select("opening").distinct()

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([band_keys(w) for w in words], pa.list_(pa.int64()))], names=["opening", "bands"])

    banded = ones.mapInArrow(bands, "opening array<string>, bands array<long>").select("opening", F.explode("bands").alias("band"))
    # Two heads of each band: the first and the last opening.
    heads = banded.groupBy("band").agg(F.array_distinct(F.array(F.min("opening"), F.max("opening"))).alias("heads")).select("band", F.explode("heads").alias("head"))
    candidates = banded.join(heads, "band").select("opening", "head").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(a, b) >= SIMILAR for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(ok, pa.bool_()))

    member = candidates.mapInArrow(verify, "opening array<string>, head array<string>").groupBy("opening").agg(F.min("head").alias("cluster"))
    # An opening like no head is a cluster of its own.
    member = materialize(ones.join(member, "opening", "left").select("opening", F.coalesce("cluster", "opening").alias("cluster")), "opening-members")
    rows = distinct.join(member, "opening")
    prompts = rows.groupBy("cluster", "prompt").agg(F.sum("n").alias("n"), F.sum("cued").alias("cued"), F.sum("holed").alias("holed"))
    sums = prompts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("cued").alias("cued"), F.sum("holed").alias("holed"), F.exp(F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("prompts"))
    return member.join(sums, "cluster")


#: An opening is unrelated to its prompts if they are effectively so many, or nearly as many as its rows.
PROMPTS, SPREAD = 4.0, 0.5


def _defects(pairs: DataFrame) -> DataFrame:
    """``pairs``: pair_source, pair_id, question, answer."""
    assessed = materialize(pairs.select("pair_source", "pair_id", "question", "answer").mapInArrow(_assess, _PAIR), "pairs-assessed")
    clusters = materialize(opening_clusters(assessed), "opening-clusters")
    unrelated = (F.col("prompts") >= PROMPTS) | (F.col("prompts") >= F.col("n") * SPREAD)
    refusing = clusters.filter(unrelated & ((F.col("cued") > F.col("n") * 0.3) | (F.col("holed") > F.col("n") * 0.3))).select("opening", F.lit(True).alias("refusing"))
    whole = pairs.select("answer").mapInArrow(_whole_sentences, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))
    ends = whole.mapInArrow(_sentence_ends, "key long, n long, ends long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    tails = assessed.filter("tail IS NOT NULL AND defect IS NULL").select("pair_source", "pair_id", "tail", "whole")
    spelled = tails.select("pair_source", "pair_id", "tail", "whole", F.explode(F.sequence(F.lit(1), F.size("tail"))).alias("k"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [tail_key(t[-k:]) for t, k in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())]
            open_ = [t[-1].rstrip(",;:-–—(") in _OPEN_WORDS or t[-1] != t[-1].rstrip(",;:-–—(") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 1, 3, 4)), pa.array(key, pa.int64()), pa.array(open_, pa.bool_())], names=["pair_source", "pair_id", "whole", "k", "key", "open"])

    keyed = spelled.mapInArrow(keys, "pair_source string, pair_id string, whole boolean, k int, key long, open boolean")
    known = keyed.join(ends, "key", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("ends", F.coalesce("ends", F.lit(0)))
    # The longest group that the corpus knows well tells how often a sentence ends there.
    rate = F.max(F.when((F.col("n") >= 4) | (F.col("k") == 1), F.struct("k", ((F.col("ends") + 0.0) / F.greatest(F.col("n"), F.lit(1))).alias("rate"), "n")))
    judged = known.groupBy("pair_source", "pair_id").agg(rate.alias("r"), F.max("open").alias("open"), F.max("whole").alias("whole"))
    cut = judged.filter(F.col("open") | (~F.col("whole") & (F.col("r.rate") < 0.1))).select("pair_source", "pair_id", F.lit(True).alias("cut"))
    refused = assessed.filter("opening IS NOT NULL").join(guarded_broadcast(refusing), "opening").select("pair_source", "pair_id", F.lit(True).alias("refused")).distinct()
    out = assessed.select("pair_source", "pair_id", "defect").join(refused, ["pair_source", "pair_id"], "left").join(cut, ["pair_source", "pair_id"], "left")
    kind = F.coalesce("defect", F.when(F.col("refused"), "refusal"), F.when(F.col("cut"), "truncated"))
    return out.select("pair_source", "pair_id", kind.alias("defect")).filter("defect IS NOT NULL")


def defective_pairs(fees: DataFrame, messages: DataFrame) -> DataFrame:
    """(pair_source, pair_id, defect) of the defective pairs of both tables; a pair stored again is judged by its latest row.

    A null or empty answer is ``empty``; a null question can't be copied and has no language. One defect a pair at most:
    empty, then copied_question, wrong_language, refusal, truncated.
    """
    faq = fees.filter("pair_id IS NOT NULL").groupBy("pair_id").agg(F.max_by(F.struct("question", "answer"), F.struct("updated_at", "answer")).alias("r"))
    faq = faq.select(F.lit("faq").alias("pair_source"), F.col("pair_id").cast("string").alias("pair_id"), "r.question", "r.answer")
    chat = reply_pairs(messages).select(F.lit("chat").alias("pair_source"), F.col("id").alias("pair_id"), "question", "answer")
    return _defects(materialize(faq.unionByName(chat), "pairs")).distinct()
