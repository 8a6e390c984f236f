"""Pages by address, as a Spark data source: each task fetches its share; failures are rows, not failed jobs.

    spark.dataSource.register(PageSource)
    spark.read.format("pages").option("urls", "\\n".join(urls)).load()
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Which sections of a site hold which type of content.
SECTIONS = (("/admissions/", "admission"), ("/courses/", "courses"), ("/about/", "about"), ("/facilities/", "facilities"), ("/academics/", "courses"), ("/programs/", "courses"), ("/engineering/", "courses"), ("/management/", "courses"))
#: The two pages that are no sections, by the end of their path.
SPECIAL = (("fee-structure", "fee_structure"), ("faculty", "faculty"))


def section_types(spark) -> DataFrame:
    """(path, kind): the static assignment of types to paths; ten rows."""
    return spark.createDataFrame([*SECTIONS, *SPECIAL], "path string, kind string")


def fetched(pages: DataFrame, least: int = 100) -> DataFrame:
    """The pages that came with status 200 and at least ``least`` characters; failures are left out, not raised."""
    return pages.filter((F.col("status") == 200) & (F.length("html") >= least))


class PageSource(DataSource):
    """Options: urls (one a line), timeout (seconds, 30), partitions (4)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, status int, html string, error string"

    def reader(self, schema):
        return _Reader(self.options)


class _Share(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.urls = [u.strip() for u in options.get("urls", "").splitlines() if u.strip()]
        self.timeout = float(options.get("timeout", "30"))
        self.n = max(1, int(options.get("partitions", "4")))

    def partitions(self):
        return [_Share(self.urls[i :: self.n]) for i in range(min(self.n, max(1, len(self.urls))))]

    def read(self, partition):
        from urllib.request import Request, urlopen

        for url in partition.urls:
            try:
                with urlopen(Request(url, headers={"User-Agent": "weftline"}), timeout=self.timeout) as r:
                    yield url, int(getattr(r, "status", None) or 200), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), None
            except Exception as e:  # noqa: BLE001
                yield url, int(getattr(e, "code", 0) or 0), None, str(e)
