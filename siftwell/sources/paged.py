"""Paged sources: a service or a folder that gives its rows page by page, read in parallel and resumably.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("url", "http://host/rows").load()

A service answers ``GET url?offset=..&limit=..`` with ``{"total": n, "rows": [...]}``.
Of a folder every file of JSON lines is a page, in the order of names.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftwell.plans.providers import ProviderError, with_retry

#: Rows of a service's page, pages of a task, and pages that a download commits together.
LIMIT, PAGES_A_TASK, PAGES_A_ROUND = 1000, 1, 64
SCHEMA = "page int, place int, value string"


@dataclass
class Pages(InputPartition):
    numbers: list[int]


def _get(url: str, timeout: float) -> dict:
    """One answer; what the service refuses for now is tried again."""

    def ask():
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as error:
            after = error.headers.get("Retry-After", "")
            raise ProviderError(f"{url}: {error.code}", error.code, float(after) if after.isdigit() else None) from error
        except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
            raise ProviderError(f"{url}: {error}") from error
        except ValueError as error:
            raise ProviderError(f"{url}: no JSON", 400) from error

    return with_retry(ask)


class PagedReader(DataSourceReader):
    """``only``: the numbers of the pages to read, comma-joined; all if it is left out."""

    def __init__(self, options: dict[str, str]):
        self.url, self.folder = options.get("url"), options.get("folder")
        if (self.url is None) == (self.folder is None):
            raise ValueError("a paged source has an url or a folder")
        self.limit, self.timeout = int(options.get("limit", LIMIT)), float(options.get("timeout", 30))
        self.together = int(options.get("pagesatask", PAGES_A_TASK))
        only = options.get("only")
        self.only = None if only is None else [int(x) for x in only.split(",") if x]

    def _address(self, page: int) -> str:
        joint = "&" if urllib.parse.urlparse(self.url).query else "?"
        return f"{self.url}{joint}{urllib.parse.urlencode({'offset': page * self.limit, 'limit': self.limit})}"

    def _files(self) -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if n.endswith(".jsonl") and not n.startswith((".", "_")))

    def count(self) -> int:
        """The number of pages now."""
        if self.folder is not None:
            return len(self._files())
        joint = "&" if urllib.parse.urlparse(self.url).query else "?"
        total = int(_get(f"{self.url}{joint}offset=0&limit=1", self.timeout)["total"])
        return -(-total // self.limit)

    def partitions(self) -> list[Pages]:
        numbers = self.only if self.only is not None else list(range(self.count()))
        return [Pages(numbers[k : k + self.together]) for k in range(0, len(numbers), self.together)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in partition.numbers:
            if self.folder is not None:
                with open(os.path.join(self.folder, self._files()[page]), encoding="utf-8") as lines:
                    for place, line in enumerate(x for x in lines if x.strip()):
                        yield page, place, line.rstrip("\n")
            else:
                for place, row in enumerate(_get(self._address(page), self.timeout)["rows"]):
                    yield page, place, json.dumps(row, sort_keys=True, ensure_ascii=False)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader({k.lower(): v for k, v in self.options.items()})


def read_pages(spark: SparkSession, **options: str) -> DataFrame:
    """All rows of a paged source: page, place in it, and the row as JSON."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").options(**options).load()


def download(spark: SparkSession, path: str, together: int = PAGES_A_ROUND, told: Callable[[int, int], None] | None = None, **options: str) -> DataFrame:
    """A paged source's rows kept under ``path``, and read from there.

    Pages come in rounds; a round is kept as a whole or not at all, and one that
    is there is not asked for again: a download that broke off goes on where it
    stopped.  ``told(pages kept, pages)`` after every round.
    """
    from siftwell.sources.files import exists

    pages = PagedReader({k.lower(): v for k, v in options.items()}).count()
    for first in range(0, pages, together):
        place = f"{path}/round={first}-{together}"
        numbers = range(first, min(pages, first + together))
        if not exists(spark, f"{place}/_SUCCESS"):
            read_pages(spark, **options, only=",".join(map(str, numbers))).write.mode("overwrite").parquet(place)
        if told is not None:
            told(numbers[-1] + 1, pages)
    if not pages:
        return spark.createDataFrame([], SCHEMA)
    kept = [f"{path}/round={first}-{together}" for first in range(0, pages, together)]
    return spark.read.schema(SCHEMA).parquet(*kept)


def rows_of(pages: DataFrame, schema: str) -> DataFrame:
    """The rows of pages as columns, in the order of the source: ``ord`` and the fields."""
    order = (F.col("page").cast("long") * (1 << 32) + F.col("place")).alias("ord")
    return pages.select(order, F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("ord", "r.*")
