"""A paged feed as it was landed, as a data source: ``spark.read.format("landed_feed").load(folder)``.

A page is a file ``<query>-<page>.json`` of the folder.  Reading gives a row for each page: ``query_ord, page, body,
error``; a page that isn't JSON (a service's error page, a cut-off answer) has no body and says what is wrong, so it
ends no read.  Conditions on ``query_ord`` and ``page`` are pushed down: pages they rule out aren't opened.  The driver
lists names alone; pages are opened in tasks, PAGES a partition, through whatever file system their address names.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterable, Iterator, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Pages in a partition, if the option ``pages`` says nothing.
PAGES = 64
SCHEMA = "query_ord int, page int, body string, error string"
_NAME = re.compile(r"^(\d+)-(\d+)\.json$")
_TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Pages(InputPartition):
    def __init__(self, names: list[tuple[int, int, str]]):
        self.names = names


def page(raw: bytes) -> tuple[str | None, str | None]:
    """(body, what is wrong) of a landed page."""
    try:
        text = raw.decode("utf-8-sig")
        json.loads(text)
    except UnicodeDecodeError:
        return None, "not UTF-8"
    except ValueError:
        head = text.lstrip()[:1]
        return None, "empty" if not head else "a page of markup" if head == "<" else "not JSON"
    return text, None


class FeedReader(DataSourceReader):
    def __init__(self, folder: str, pages: int):
        self.folder, self.pages, self.tests = folder, pages, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("query_ord",), ("page",)) and f.value is not None:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        where, root = _place(self.folder)
        names = []
        for info in where.get_file_info(fs.FileSelector(root)):
            if m := _NAME.match(posixpath.basename(info.path)):
                at = {"query_ord": int(m[1]), "page": int(m[2])}
                if all(_TESTS[kind](at[c], v) for c, kind, v in self.tests):
                    names.append((at["query_ord"], at["page"], m[0]))
        names.sort()
        return [Pages(names[k : k + self.pages]) for k in range(0, len(names), self.pages)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        where, root = _place(self.folder)
        for query_ord, number, name in partition.names:
            with where.open_input_stream(posixpath.join(root, name)) as f:
                yield query_ord, number, *page(f.readall())


class LandedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options["path"], int(self.options.get("pages", PAGES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedFeed)


def feed(spark: SparkSession, folder: str, pages: int = PAGES) -> tuple[DataFrame, DataFrame]:
    """(items of the good pages, ``query_ord, page, error`` of the bad ones)."""
    from changelens.sources.feeds import law_items

    register(spark)
    raw = spark.read.format("landed_feed").option("pages", pages).load(folder)
    good = raw.where("error IS NULL")
    # items keep the order of queries, then pages, then places in a page
    items = law_items(good.withColumn("query_ord", good["query_ord"].cast("long") * (1 << 31) + good["page"]))
    return items, raw.where("error IS NOT NULL").select("query_ord", "page", "error")
