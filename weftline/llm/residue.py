"""Template residue, filler, error messages and demands for scripts.

A page's main body (see ``main_body``) carries little information if hardly a sentence of it says anything but that something
is filler, failed, or needs scripts. Such a body is a case if it has nothing to do with the page's address and title, or stands
on several hosts: a page on the very subject shares its terms with both, and has no twin elsewhere. Unfilled placeholders in
title or content are cases whatever surrounds them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import guarded_broadcast, materialize, site_of
from weftline.llm.main_body import key_of, letters, load_cutter, split_lines, style_tree, with_low

#: A body of more words, if they aren't Latin, has content of its own; one of hardly any is judged with the lines cut around it.
FEW_WORDS, HARDLY = 90, 15
#: A body of little information has at most so many sentences without a cue, or as many with one as without.
LEFT, CUED = 3, 0.5
#: It is a case from this share of foreign terms on (the terms of slug and title that it lacks, of those it could have), or with twins on so many hosts.
FOREIGN, HOSTS = 0.5, 2

_PLACEHOLDER = re.compile(
    r"\{\{\s*[\w.\-| ]*\s*\}\}|\{%.*?%\}|\$\{[\w.]*\}|\{\$[\w.]+\}|<%.*?%>|<<[\w .\-]+>>|\[\[[\w .\-]*\]\]|%%\w+%%|##\w+##|\b__[A-Za-z]\w*__\b|"
    r"\[(?:todo|tbd|insert|your|add|title|name|date|enter|placeholder|fill)\b[^\]\n]*\]|\{\d+\}|\[object Object\]|&lt;\s*placeholder\s*&gt;|<placeholder>|\{[A-Za-z_]\w*\}|"
    r"%\([a-z_]+\)[sd]|#\{[\w.]+\}|@@\w+@@", re.I)
_MISSING = re.compile(
    r"(?:(?:\b(?:fee|apply|contact|dear|welcome|left|page|date|by|on|for|to|before|of|is|hello|hi)\b:?\s+)(?:NaN|undefined|null|None|nil)\b(?!\s+(?:of|and|but|or)\b))|"
    r"\bNaN\b|\bundefined\b|(?<![\w'])null(?![\w'])(?!\s+(?:hypothes|and void|value))")
#: What a text must hold for its pattern to be worth a look.
_PATTERNS = ((("{", "[", "<", "%%", "##", "__", "@@", "&lt;", "%("), _PLACEHOLDER), (("NaN", "undefined", "null", "None", "nil"), _MISSING))
_SPOKEN = re.compile(r"template exercise|such as\s*$|double braces|placeholders?\s+(?:like|such)|\bcalled\b|\bsyntax\b|\bfor example\b|\be\.g\.|written as|\bthe string\b|\bthe word\b", re.I)

_FILLER = re.compile(
    r"lorem|ipsum|dolor|consectetur|adipisc|eiusmod|incididunt|aliqua|veniam|ullamco|cillum|excepteur|proident|asdf|qwerty|(?:\btest\b\s*){2,}|x{4,}|dummy|placeholder|body copy|"
    r"coming soon|text goes here|content goes here|under construction|headline here|type (?:the|some|a|your|here)|paste (?:the|a|some|your)|put (?:the|a|your|some)|add (?:your|some|a|the)|"
    r"click to edit|write some|sample (?:text|paragraph)|your own words|heading \d|subheading|do not publish|layout testing|to be supplied|\bhere\.?$|untitled|watch this space|to be (?:added|announced|written)", re.I)
_ERROR = re.compile(
    r"\b[45]\d\d\b|error|not found|no longer exist|could not|cannot|unable to|failed|refused|denied|forbidden|permission|timed? ?out|took too long|bad gateway|gateway|unavailable|not available|"
    r"maintenance|too many requests|session has expired|sign in again|no response|did not respond|traceback|exception|warning:|fatal|stack|line \d+|upstream|try again|retry|went wrong|"
    r"overloaded|blocked|\bexpired\b|\bmissing\b|\binvalid\b|\bdown\b|oops|^\s*\[\d+\]", re.I)
_SCRIPT = re.compile(
    r"java ?script|\bjs\b|\bscripts?\b|scripting|noscript|browser|captcha|human|robot|cookies? (?:and|must)|loading\.{2,}|checking your|verify|ad ?blocker|enable|reload", re.I)
_WORD = re.compile(r"[^\W\d_]{3,}")
#: The usual words of Latin filler text.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip "
    "commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim est laborum".split())
_SLUG = re.compile(r"^[a-z][a-z0-9+.\-]*://[^/]*/(.*?)(?:[?#].*)?$", re.I)


def placeholder_in(text: str | None) -> bool:
    """Whether a text holds an unfilled placeholder, or what a template prints for a missing value, other than as a subject."""
    if not text:
        return False
    for marks, pattern in _PATTERNS:
        if not any(x in text for x in marks):
            continue
        for m in pattern.finditer(text):
            if not _SPOKEN.search(text, max(0, m.start() - 90), m.start()):
                return True
    return False


def title_residue(title: str | None) -> bool:
    """Titles that are, or end in, a placeholder or a printed missing value."""
    if not title:
        return False
    return bool(placeholder_in(title) or re.fullmatch(r"(?:(?:page|welcome)\s*:?\s*)?(?:undefined|null|nan|none|nil)(?:\s*-\s*\w+)?", title.strip(), re.I))


def cue_of(body: list[str]) -> str:
    """Which sort of empty page the lines of a small body speak for: filler, error, script or none."""
    text = "\n".join(body)
    words = _WORD.findall(text.lower())
    for kind, pattern in (("filler", _FILLER), ("script", _SCRIPT), ("error", _ERROR)):
        if pattern.search(text):
            return kind
    return "filler" if words and len(set(words)) * 3 <= len(words) else "none"


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def cued(body: list[str]) -> tuple[int, int]:
    """How many sentences of a body have a cue of any sort, and how many there are."""
    parts = [p for x in body for p in _SENTENCE.split(x) if _WORD.search(p)]
    return sum(any(c.search(p) for c in (_FILLER, _ERROR, _SCRIPT)) for p in parts), len(parts)


_FIELDS = "id string, site string, residue boolean, few boolean, cue string, mismatch double, body long"


def page_evidence(data: DataFrame) -> DataFrame:
    """One row of evidence per page: placeholder found, small body, its cue, mismatch with slug and title, hash of the body."""
    pages = data.select("id", site_of(F.col("url")).alias("site"), "content", "url", "title")
    low, shared = style_tree(pages.select("site", "content"))
    cutter = data.sparkSession.sparkContext.broadcast(load_cutter(shared))

    def look_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = cutter.value
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            sets: dict[str, set[int]] = {}
            lows = batch.column(5)
            for k, (i, site, content, url, title) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                residue = title_residue(title) or placeholder_in(content)
                if not residue and not (content and content.strip()):
                    continue
                if site not in sets:
                    sets[site] = set(lows[k].as_py() or ())
                few, cue, mismatch, key = False, "none", 0.0, None
                if content and not residue:
                    lines = split_lines(content)
                    gone = set(work.outside(content, sets[site]))
                    body = [x for n, x in enumerate(lines) if n not in gone and x.strip()]
                    words = [w for x in body for w in _WORD.findall(x.lower())]
                    latin = sum(w in _LATIN for w in words) > 0.5 * len(words)
                    few = len(words) < FEW_WORDS or latin
                    if latin and words:
                        cue = "filler"
                    elif few:
                        cue = cue_of(body)
                        if cue == "none" and len(words) < HARDLY:
                            body = [x for x in lines if x.strip() and key_of(letters(x)) not in sets[site]]
                            words = [w for x in body for w in _WORD.findall(x.lower())]
                            cue = cue_of(body)
                        if cue != "none":
                            with_cue, all_ = cued(body)
                            if all_ - with_cue > LEFT and with_cue < CUED * all_:
                                few, cue = False, "none"
                    if few:
                        m = _SLUG.match(url or "")
                        about = set(_WORD.findall(((m.group(1) if m else "") + " " + (title or "")).lower()))
                        mismatch = 1.0 - len(about & set(words)) / max(1, min(len(about), len(set(words)))) if about else 1.0
                        key = key_of("".join(map(letters, body)))
                for c, v in zip(out, (i, site, residue, few, cue, mismatch, key)):
                    c.append(v)
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[f.split()[0] for f in _FIELDS.split(", ")])

    return with_low(pages, low).select("id", "site", "content", "url", "title", "low").mapInArrow(look_at, _FIELDS).filter("residue OR few")


def residue_pages(data: DataFrame) -> DataFrame:
    """(id, reason) of pages with template residue or with nothing but filler, an error message or a demand for scripts.

    Null and blank content is no case unless the title holds a placeholder. Repeated rows of an id give one row.
    """
    seen = materialize(page_evidence(data), "page-evidence")
    small = seen.filter("few AND NOT residue")
    # Host evidence: a body that stands on several hosts says nothing of its own page.
    twins = small.groupBy("body").agg(F.count_distinct("site").alias("hosts"))
    judged = small.join(guarded_broadcast(materialize(twins, "residue-twins")), "body", "left")
    empty = (F.col("cue") != "none") & ((F.col("mismatch") >= FOREIGN) | (F.col("hosts") >= HOSTS))
    bad = judged.filter(empty).select("id", F.col("cue").alias("reason"))
    return seen.filter("residue").select("id", F.lit("placeholder").alias("reason")).unionByName(bad).groupBy("id").agg(F.min("reason").alias("reason"))


def found_pages(data: DataFrame) -> DataFrame:
    """(id) of ``residue_pages``."""
    return residue_pages(data).select("id")
