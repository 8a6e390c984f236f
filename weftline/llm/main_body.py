"""Main body of pages: a style tree per site, importance of its nodes by entropy, low-importance branches removed.

Pages hold lines instead of markup, so the tree is built over lines. A *content node* is a line by its letters
under its site; a *presentation node* is the way a line looks (its words with names and numbers masked) and what
follows it. All pages of a site are merged into the tree. A content node on ``n`` of ``m`` pages has the importance
``1 - log(n)/log(m)``: one minus the normalised entropy of its spread over the pages. A presentation node's
importance is the chance that body text stands directly before or after it: high for headings and plain lists, low for
menu and sidebar entries. A sidebar is a branch: a node of low importance and the teasers below it.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fits_broadcast, guarded_broadcast, materialize, site_of

#: A content node is furniture below this importance, if it also stands on this share of the pages and on so many.
IMPORTANCE, SHARE, LEAST = 0.5, 0.01, 3
#: Presentation nodes count from this share of all lines of their class on; that bounds their number by 1/SUPPORT.
SUPPORT = 1e-4
BODY_NEXT, BODY_PREV = 0.6, 0.12
#: A presentation node stands for a sidebar entry by itself below these, if it was seen so often.
ALONE_NEXT, ALONE_PREV, ALONE_LEAST = 0.4, 0.08, 40
#: A line that recurs within sites is furniture of any site from this share of all pages on.
ANYWHERE = 0.003
#: Pages of one site go to so many tasks where the furniture of all sites is too much for a broadcast.
SALTS = 32


_ASCII, _ASCII_OTHER = bytes(range(128)), bytes(i for i in range(128) if not chr(i).isalpha())
_OTHER_IN_LINES = _ASCII_OTHER.replace(b"\n", b"")
_LOWER = bytes(range(128)).lower() + bytes(range(128, 256))
_OTHER = re.compile(r"[\W\d_]")
_ITEM = re.compile(r"\s*(?:[-*•‣▪–·»>]|\(?\d{1,3}[.)]|\(?[a-z]\))\s+\S")
_CRUMB = re.compile(r"\s*[-•*]?\s*home\s*(?:[>›»/|:→\\]|::)\s*\S", re.I)
_DIGIT, _DIGITS = re.compile(r"\d"), re.compile(r"\d+")
#: What a list entry, and a breadcrumb, can begin with, besides numbers and letters in brackets.
_ITEM_SIGNS, _CRUMB_SIGNS = frozenset("-*•‣▪–·»>("), frozenset("hH-•*")
_EDGE = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "»«›‹-–•*|"


def letter_bytes(text: str, other: bytes = _ASCII_OTHER) -> bytes:
    """The letters of a text, lower case, in UTF-8; of the ASCII signs only ``other`` are left out."""
    if text.isascii():
        return text.encode().translate(_LOWER, other)
    out = text.lower().encode("utf-8", "ignore").translate(None, other)
    # A text has few signs beyond ASCII, and fewer that are no letters.
    for sign in set(out.translate(None, _ASCII).decode()):
        if _OTHER.match(sign):
            out = out.replace(sign.encode(), b"")
    return out


def letters(line: str) -> str:
    """The letters of a line, lower case."""
    return letter_bytes(line).decode()


def line_letters(text: str) -> list[bytes]:
    """The letters of every line of a text, found in the text as a whole."""
    return letter_bytes(text, _OTHER_IN_LINES).split(b"\n")


def key_of(text: str | bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def look(line: str) -> str:
    """z blank, b list entry, t table row, p prose, l long line without an end mark, h short one."""
    s = line.strip()
    if not s:
        return "z"
    if (s[0] in _ITEM_SIGNS or s[0].isdecimal() or s[1:2] == ")") and _ITEM.match(line):
        return "b"
    if s.count(" | ") >= 2 and any(map(str.isdigit, s)):
        return "t"
    n = s.count(" ") + 1
    if n > 3 and s[-1] in ".!?।。" and not s.endswith(".."):
        return "p"
    return "l" if n > 16 else "h"


def skeletons(line: str) -> tuple[int, int]:
    """Keys of a line's presentation: names and numbers masked; with its first word, and without."""
    words = line.strip(_EDGE).split()
    if not words:
        return key_of("1"), key_of("2")
    rest: list[str] = []
    for w in words[1:]:
        if not w.islower() and (w[0].isupper() or _DIGIT.search(w)):
            if not rest or rest[-1] != "#":
                rest.append("#")
        else:
            rest.append(w)
    tail = " ".join(rest)
    first = words[0].lower()
    return key_of("1" + (first if first.isalpha() else _DIGITS.sub("0", first)) + " " + tail), key_of("2" + tail)


#: Lines up to this length come again and again and are remembered.
SHORT_LINE = 80


class Lines(dict):
    """What is looked at in a line besides its letters: its look, whether it is a breadcrumb."""

    def __missing__(self, line: str) -> tuple[str, bool]:
        known = (look(line), line.lstrip()[:1] in _CRUMB_SIGNS and _CRUMB.match(line) is not None)
        if len(line) <= SHORT_LINE:
            if len(self) >= 200_000:
                self.clear()
            self[line] = known
        return known


def split_lines(text: str) -> list[str]:
    return text.split("\n")


def _tree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the nodes of the pages at hand, added up before they are shuffled."""
    pages: Counter[str] = Counter()
    content: defaultdict[str, Counter[int]] = defaultdict(Counter)
    # How often a short line was seen, and with body text after and before it; and the same of the nodes.
    headings: dict[str, list[int]] = {}
    shown: dict[int, list[int]] = {}
    known = Lines()

    def settle() -> None:
        for line, seen in headings.items():
            for node in skeletons(line):
                held = shown.get(node)
                if held is None:
                    shown[node] = seen.copy()
                else:
                    for i in range(3):
                        held[i] += seen[i]
        headings.clear()

    def flush() -> pa.RecordBatch:
        settle()
        sites, kinds, nodes, counts = list(pages), [0] * len(pages), [0] * len(pages), list(pages.values())
        for site, own in content.items():
            sites += [site] * len(own)
            nodes += own
            counts += own.values()
        kinds += [1] * (len(sites) - len(kinds))
        plain = [0] * len(sites)
        out = pa.RecordBatch.from_arrays(
            [pa.array(sites + [""] * len(shown), pa.string()), pa.array(kinds + [2] * len(shown), pa.int8()), pa.array(nodes + list(shown), pa.int64()),
             pa.array(counts + [v[0] for v in shown.values()], pa.int64()), *(pa.array(plain + [v[i] for v in shown.values()], pa.int64()) for i in (1, 2))],
            names=["site", "kind", "node", "n", "body_next", "body_prev"],
        )
        for held in (pages, content, shown):
            held.clear()
        return out

    for batch in batches:
        for site, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pages[site] += 1
            if not text:
                continue
            content[site].update({key_of(own) for own in set(line_letters(text)) if own})
            lines = [x for x in split_lines(text) if x.strip()]
            looks = [known[x][0] for x in lines] + ["h"]
            full = [k in "pbtl" for k in looks]
            for i, x in enumerate(lines):
                if looks[i] == "h":
                    held = headings.get(x)
                    if held is None:
                        headings[x] = [1, int(full[i + 1]), int(full[i - 1])]
                    else:
                        held[0] += 1
                        held[1] += full[i + 1]
                        held[2] += full[i - 1]
            if len(headings) >= 200_000:
                settle()
        if len(shown) + sum(map(len, content.values())) > 200_000:
            yield flush()
    if pages:
        yield flush()


_TREE = "site string, kind byte, node long, n long, body_next long, body_prev long"


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, low: its furniture nodes) and (kind, node, n, body_next, body_prev) of the nodes that hold for all sites.

    ``pages``: site, content. Both results are written to the shared folder. A site has at most lines-per-page / SHARE
    furniture nodes; there are at most lines-per-page / ANYWHERE nodes that are furniture anywhere and 2 / SUPPORT
    presentation nodes, at any size.
    """
    nodes = pages.select(F.coalesce("site", F.lit("")).alias("site"), "content").mapInArrow(_tree_batches, _TREE)
    sums = [F.sum(c).alias(c) for c in ("n", "body_next", "body_prev")]
    nodes = materialize(nodes.groupBy("site", "kind", "node").agg(*sums).filter((F.col("kind") != 1) | (F.col("n") >= LEAST)), "style-tree")
    sizes = nodes.filter("kind = 0").select("site", F.col("n").alias("m"))
    content = nodes.filter("kind = 1")
    importance = F.lit(1.0) - F.log(F.col("n")) / F.log(F.greatest(F.col("m"), F.lit(2)))
    low = (
        content.join(guarded_broadcast(sizes), "site")
        .filter((importance < IMPORTANCE) & (F.col("n") >= F.col("m") * SHARE))
        .groupBy("site").agg(F.collect_list("node").alias("low"))
    )
    total = nodes.agg(F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"), F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("shown"))
    shared = (
        content.groupBy("kind", "node").agg(*sums)
        .unionByName(nodes.filter("kind = 2").select("kind", "node", "n", "body_next", "body_prev"))
        .crossJoin(F.broadcast(total))
        .filter(F.col("n") >= F.when(F.col("kind") == 1, F.greatest(F.lit(12.0), F.col("pages") * ANYWHERE)).otherwise(F.greatest(F.lit(4.0), F.col("shown") * SUPPORT)))
        .select("kind", "node", "n", "body_next", "body_prev")
    )
    return materialize(low, "style-low"), materialize(shared, "style-shared")


class Cutter:
    """Decides, page by page, which lines stand outside the main body."""

    def __init__(self, anywhere: set[int], shown: dict[int, tuple[int, int, int]]) -> None:
        self.anywhere, self.shown = anywhere, shown
        self._memo: dict[str, tuple[float, float, bool]] = {}
        self._lines = Lines()

    def body_near(self, line: str) -> tuple[float, float, bool]:
        """How often body text follows and precedes the line's presentation node, smoothed by its wider node; whether it was seen often."""
        known = self._memo.get(line)
        if known is None:
            one, two = skeletons(line)
            n2, a2, b2 = self.shown.get(two, (0, 0, 0))
            n1, a1, b1 = self.shown.get(one, (0, 0, 0))
            known = (a1 + 4 * (a2 + 1.0) / (n2 + 2.0)) / (n1 + 4), (b1 + 4 * (b2 + 0.2) / (n2 + 2.0)) / (n1 + 4), n1 >= ALONE_LEAST
            if len(self._memo) > 100_000:
                self._memo.clear()
            self._memo[line] = known
        return known

    def outside(self, content: str, low: set[int]) -> list[int]:
        """Numbers of the non-blank lines of a page outside its main body."""
        out: list[int] = []
        general: list[int] = []
        furniture = body = False
        known = self._lines
        for i, (line, own) in enumerate(zip(split_lines(content), line_letters(content))):
            kind, crumb = known[line]
            if kind == "z":
                continue
            key = key_of(own) if own else None
            if crumb or key in low:
                out.append(i)
                furniture = kind == "h"
                continue
            if key in self.anywhere and (kind != "h" or self.body_near(line)[0] < BODY_NEXT):
                out.append(i)
                general.append(i)
                furniture = kind == "h"
                continue
            if kind == "h" or (kind == "l" and furniture and line.count(" ") < 30):
                after, before, often = self.body_near(line)
                if (furniture and after < BODY_NEXT and before < BODY_PREV) or (after < ALONE_NEXT and before < ALONE_PREV and often):
                    out.append(i)
                    furniture = True
                    continue
            furniture = False
            body = body or kind in "pbt"
        if general and not body:  # the message of an error page, which recurs on many sites, is that page's body
            return [i for i in out if i not in general]
        return out


def load_cutter(shared: DataFrame) -> Cutter:
    """The nodes that hold for all sites, whose number is bounded by the shares they need."""
    rows = shared.collect()
    return Cutter({r["node"] for r in rows if r["kind"] == 1}, {r["node"]: (r["n"], r["body_next"], r["body_prev"]) for r in rows if r["kind"] == 2})


def with_low(pages: DataFrame, low: DataFrame) -> DataFrame:
    """Pages with their site's furniture nodes as an array ``low``; a hot site's pages are split by a salt if they are shuffled."""
    pages = pages.withColumn("site", F.coalesce("site", F.lit("")))
    if fits_broadcast(low):
        return pages.join(F.broadcast(low), "site", "left")
    salted = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("_salt", F.pmod(F.xxhash64("content"), F.lit(SALTS)).cast("int")).join(salted, ["site", "_salt"], "left").drop("_salt")


def outside_lines(data: DataFrame) -> DataFrame:
    """(id, line_no) of every non-blank line outside the main body of its page.

    Null, empty and blank content give no rows, a null url is a site of its own, repeated rows of an id give each
    line once, other columns are ignored.
    """
    pages = data.withColumn("site", site_of(F.col("url"))).select("id", "site", "content")
    low, shared = style_tree(pages)
    cutter = data.sparkSession.sparkContext.broadcast(load_cutter(shared))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = cutter.value
        for batch in batches:
            ids, numbers = [], []
            low_sets: dict[str, set[int]] = {}
            cols = [batch.column(k).to_pylist() for k in (0, 1, 2)]
            lows = batch.column(3)
            for k, (i, site, content) in enumerate(zip(*cols)):
                if not content:
                    continue
                if site not in low_sets:
                    low_sets[site] = set(lows[k].as_py() or ())
                out = work.outside(content, low_sets[site])
                ids += [i] * len(out)
                numbers += out
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int32())], names=["id", "line_no"])

    return with_low(pages, low).select("id", "site", "content", "low").mapInArrow(cut, "id string, line_no int")
