"""The search feed: pages of hits over a range of dates, recorded as they come and replayed without the network.

``call`` answers from the recording where there is one, else asks, records, and answers; offline it never asks. The feed is
a data source of Spark: a page is a partition, the range of dates is pushed down to the request, and every page is
recorded by the task that reads it. Recordings are one JSON file per request in a folder all executors share.

Defined results: paging ends at the number of hits that the first page tells, at an empty page, or offline at a page that
isn't recorded; a first page that isn't recorded is an error offline; a broken recording counts as missing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from lexloom.runtime import filesystem, put_file

#: Hits of a page: fixed value.
PAGE = 20
FIELDS = ("title", "subtitle", "reportType", "reportId", "sittingDate", "maxResult", "memberName", "mpNames")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS) + ", sitting_date string"
#: What asks for a page: (first day, last day, index of the first hit) to a list of hits.
Fetch = Callable[[str, str, int], list[dict]]


class FixtureMissing(LookupError):
    """Nothing is recorded for a request, and the network is not to be used."""


def replay(folder: str, name: str) -> object | None:
    """What is recorded under a name; None if nothing is."""
    files, root = filesystem(folder)
    try:
        with files.open_input_file(f"{root}/{name}.json") as f:
            return json.loads(f.read().decode("utf-8"))
    except (FileNotFoundError, ValueError):
        return None


def record(folder: str, name: str, answer: object) -> None:
    """Records an answer; a task that runs twice leaves the same file."""
    files, root = filesystem(folder)
    put_file(files, f"{root}/{name}.json", json.dumps(answer, ensure_ascii=False).encode("utf-8"))


def call(folder: str, name: str, ask: Callable[[], object] | None) -> object:
    """The recorded answer, else a new one, which is recorded. Without ``ask``: offline."""
    held = replay(folder, name)
    if held is None:
        if ask is None:
            raise FixtureMissing(f"{folder}/{name}")
        held = ask()
        record(folder, name, held)
    return held


def iso_day(day: str | None) -> str | None:
    """yyyy-mm-dd of d-m-yyyy; None for anything else."""
    parts = (day or "").split("-")
    return f"{parts[2]}-{int(parts[1]):02d}-{int(parts[0]):02d}" if len(parts) == 3 and all(p.isdigit() for p in parts) and len(parts[2]) == 4 else None


def page_name(first: str, last: str, start: int) -> str:
    return f"{first}_{last}" + (f"_{start}" if start else "")


class PageRange(InputPartition):
    def __init__(self, start: int) -> None:
        super().__init__(start)
        self.start = start


class SearchReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch | None) -> None:
        self.folder, self.first, self.last = options["path"], options.get("first", "1900-01-01"), options.get("last", "2999-12-31")
        self.fetch = fetch
        # a recording is of its whole range, so the range that is pushed down narrows what is asked for only where something is asked
        self.low, self.high = self.first, self.last

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("sitting_date",) and isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual)):
                if not isinstance(f, LessThanOrEqual):
                    self.low = max(self.low, f.value)
                if not isinstance(f, GreaterThanOrEqual):
                    self.high = min(self.high, f.value)
            else:
                yield f
        if self.fetch is not None:
            self.first, self.last = self.low, self.high

    def _page(self, start: int) -> list[dict]:
        ask = (lambda: self.fetch(self.first, self.last, start)) if self.fetch is not None else None
        return call(self.folder, page_name(self.first, self.last, start), ask)

    def partitions(self) -> list[PageRange]:
        if self.low > self.high:
            return []
        page = self._page(0)
        hits = int(page[0]["maxResult"]) if page else 0
        return [PageRange(start) for start in range(0, hits, PAGE)]

    def read(self, partition: PageRange | None) -> Iterator[tuple]:
        if partition is None:  # a feed without pages
            return
        try:
            page = self._page(partition.start)
        except FixtureMissing:
            if not partition.start:
                raise
            return
        for hit in page:
            day = iso_day(hit.get("sittingDate"))
            if day is None or self.low <= day <= self.high:
                yield (*(None if hit.get(f) is None else str(hit[f]) for f in FIELDS), day)


class SearchFeed(DataSource):
    """Options: path (recordings), first and last (days of the request). A subclass with ``fetch`` asks for what isn't recorded."""

    fetch: Fetch | None = None

    @classmethod
    def name(cls) -> str:
        return "search_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> SearchReader:
        return SearchReader(dict(self.options), type(self).fetch)


def search(spark: SparkSession, folder: str, first: str, last: str, fetch: Fetch | None = None) -> DataFrame:
    """The hits of a range of days; without ``fetch`` from recordings only."""
    # a class of its own is sent to the tasks with what it asks
    spark.dataSource.register(type("OwnFeed", (SearchFeed,), {"fetch": staticmethod(fetch) if fetch else None}))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("search_feed").option("first", first).option("last", last).load(folder)


def recorded_days(spark: SparkSession, folder: str) -> DataFrame:
    """(day): days with a recorded report (named by it), the newest first; only names are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return files.select(F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})\.json$", 1).alias("day")).where("day <> ''").distinct().orderBy(F.desc("day"))
