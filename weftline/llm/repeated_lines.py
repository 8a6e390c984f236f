"""Lines repeated across one site's documents.

Each line is reduced to its letters. Its frequency within the site is held against its frequency on the other sites, but for
those where it is dense itself, by a log-likelihood ratio. Of all lines that a site has on several pages, those in significant
excess (Benjamini-Hochberg over all of them) and on the least share of the site's pages are taken out of every page by an
anti-join, and the page is put together again by line number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import guarded_broadcast, letters_of, materialize, page_lines, site_of

LEAST_PAGES, LEAST_SHARE, FDR = 5, 0.1, 0.01


def _xlogx(x: Column, y: Column) -> Column:
    """x * log(x / y), 0 where x is 0."""
    return F.when(x > 0, x * F.log(x / y)).otherwise(0.0)


def log_likelihood(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """G2 of k1 hits in n1 pages against k2 in n2; 0 where the first rate isn't the higher one."""
    k1, n1, k2, n2 = (x.cast("double") for x in (k1, n1, k2, n2))
    p = (k1 + k2) / (n1 + n2)
    g = _xlogx(k1, n1 * p) + _xlogx(n1 - k1, n1 * (1 - p)) + _xlogx(k2, n2 * p) + _xlogx(n2 - k2, n2 * (1 - p))
    return F.when((n2 <= 0) | (k1 * n2 > k2 * n1), F.greatest(2 * g, F.lit(0.0))).otherwise(0.0)


def _chi2_tail_bin(step: float) -> Column:
    """Upper tail of chi-square with one degree of freedom at a bin's lower edge (a bound good to a few percent)."""
    x = F.col("bin") * step
    z = F.sqrt(x)
    # erfc(z / sqrt 2) by Abramowitz and Stegun 7.1.26
    t = 1.0 / (1.0 + 0.3275911 * z / 2**0.5)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x / 2)


def excess_lines(data: DataFrame, *, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, fdr: float = FDR) -> DataFrame:
    """(site, line, pages, site_pages, dense, background, others, g2, significant) of the lines on ``least_pages`` pages of their site.

    ``others``: pages of the sites where the line isn't dense, ``background`` those of them with the line. Where they are fewer
    than the site's own, as for a line dense on nearly all sites, the rate of lines in general stands in: all (page, line) pairs
    by the distinct lines and all pages. ``significant`` lines are also ``dense``, on ``least_share`` of the site's pages.

    ``line`` is a 64-bit hash of the letters. Pages are distinct ids. Lines without letters and pages without site
    are not judged; null and blank pages count among the site's pages. An empty table gives no rows.
    """
    pages = data.select(F.xxhash64("id").alias("page"), site_of(F.col("url")).alias("site"), "content").filter("site IS NOT NULL")
    sizes = pages.groupBy("site").agg(F.count_distinct("page").alias("site_pages"))
    lines = (
        pages.filter("content IS NOT NULL")
        .select("site", "page", F.explode(F.array_distinct(F.filter(F.transform(page_lines(F.col("content")), letters_of), lambda x: x != ""))).alias("text"))
        .select(F.xxhash64("site").alias("s"), "page", F.xxhash64("text").alias("line"))
    )
    # One row per page and line after this, so that a page delivered twice counts once; then one per site and line.
    counts = lines.groupBy("s", "line").agg(F.count_distinct("page").alias("pages"))
    # Pairs below the least number of pages matter as background only, added up by line.
    counts = materialize(counts.groupBy(F.when(F.col("pages") >= least_pages, F.col("s")).alias("s"), "line").agg(F.sum("pages").alias("pages")), "line-counts")
    small = guarded_broadcast(materialize(sizes.withColumn("s", F.xxhash64("site")), "site-sizes"))
    frequent = materialize(counts.filter("s IS NOT NULL").join(small, "s").withColumn("dense", F.col("pages") >= F.col("site_pages") * least_share), "frequent-lines")
    # By line: its pages on sites where it isn't dense, and the pages of the sites where it is.
    by_line = frequent.groupBy("line").agg(F.sum(F.when(~F.col("dense"), F.col("pages")).otherwise(0)).alias("sparse"), F.sum(F.when(F.col("dense"), F.col("site_pages")).otherwise(0)).alias("dense_pages"))
    rare = counts.filter("s IS NULL").select("line", F.col("pages").alias("rare")).join(by_line.select("line"), "line", "left_semi")
    by_line = by_line.join(rare, "line", "left").select("line", "dense_pages", (F.col("sparse") + F.coalesce("rare", F.lit(0))).alias("sparse"))
    all_pages = sizes.agg(F.sum("site_pages").alias("all_pages"))
    general = counts.agg((F.sum("pages") / F.count_distinct("line")).alias("of_a_line"))
    lines_of_site = frequent.join(by_line, "line").crossJoin(F.broadcast(all_pages)).crossJoin(F.broadcast(general))
    # A pair that isn't dense isn't its own background.
    own = F.when(F.col("dense"), 0).otherwise(F.col("pages"))
    others = F.col("all_pages") - F.col("dense_pages") - F.when(F.col("dense"), 0).otherwise(F.col("site_pages"))
    enough = others >= F.col("site_pages")
    tested = materialize(
        lines_of_site.withColumn("others", F.when(enough, others).otherwise(F.col("all_pages")))
        .withColumn("background", F.when(enough, F.col("sparse") - own).otherwise(F.col("of_a_line")))
        .withColumn("g2", log_likelihood(F.col("pages"), F.col("site_pages"), F.least("background", "others"), F.col("others")))
        .select("site", "line", "pages", "site_pages", "dense", "background", "others", "g2"), "line-tests")
    step = 0.25
    bins = tested.groupBy(F.least(F.floor(F.col("g2") / step), F.lit(400)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    hypotheses = tested.agg(F.count("*").alias("m"))
    above = bins.alias("a").join(bins.alias("b"), F.col("b.bin") >= F.col("a.bin")).groupBy(F.col("a.bin").alias("bin")).agg(F.sum("b.n").alias("rank"))
    bound = above.crossJoin(hypotheses).filter(_chi2_tail_bin(step) * F.col("m") <= F.col("rank") * fdr).agg(F.min(F.col("bin") * step).alias("bound"))
    return tested.crossJoin(F.broadcast(bound)).withColumn("significant", F.col("dense") & F.coalesce(F.col("g2") >= F.col("bound"), F.lit(False))).drop("bound")


def _numbered(data: DataFrame) -> DataFrame:
    """(id, site, line_no, text, line) of every line of every page with a site."""
    return data.select("id", site_of(F.col("url")).alias("site"), F.posexplode(page_lines(F.coalesce("content", F.lit("")))).alias("line_no", "text"))


def repeated_lines(data: DataFrame) -> DataFrame:
    """(id, line_no) of the significant excess lines; rows of one id give each line once."""
    found = excess_lines(data).filter("significant").select("site", "line")
    lines = _numbered(data).filter("site IS NOT NULL").select("id", "site", "line_no", F.xxhash64(letters_of(F.col("text"))).alias("line"))
    hits = lines.join(guarded_broadcast(materialize(found, "excess-lines")), ["site", "line"], "left_semi")
    return hits.select("id", "line_no").distinct()


def remove_repeated(data: DataFrame) -> DataFrame:
    """(id, content) with the excess lines taken out; null content stays null, one row per id."""
    found = materialize(excess_lines(data).filter("significant").select("site", "line"), "excess-lines")
    pages = data.select("id", "url", "content").groupBy("id").agg(F.min_by("url", "content").alias("url"), F.min("content").alias("content"))
    lines = _numbered(pages).withColumn("line", F.xxhash64(letters_of(F.col("text"))))
    kept = lines.join(guarded_broadcast(found), ["site", "line"], "left_anti")
    body = kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("body"))
    return pages.select("id", F.col("content").isNull().alias("none")).join(body, "id", "left").select("id", F.when(~F.col("none"), F.coalesce("body", F.lit(""))).alias("content"))
