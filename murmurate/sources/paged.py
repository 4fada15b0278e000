"""A cursor-paged service as a Spark source, a partition a window of time.

The service is any function ``fetch(window, cursor) -> (rows, next cursor)`` that can be pickled; tests use recorded
pages. Windows are planned so that each holds about a target number of rows; a walk that comes up short is repeated.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DAY = 86_400
TARGET = 40_000
SHORTFALL, LEAST_SHORT, WALKS = 0.95, 20, 3
_SERVICES: dict[str, Callable] = {}


@dataclass
class Window:
    start: int
    end: int
    expected: int


def plan(count: Callable[[int, int], int], start: int, end: int, target: int = TARGET) -> list[Window]:
    """Windows of [start, end] that halve until each holds at most the target or a day; empty ones go."""
    n = count(start, end)
    if not n:
        return []
    if n <= target or end - start <= DAY:
        return [Window(start, end, n)]
    middle = start + (end - start) // 2
    return plan(count, start, middle, target) + plan(count, middle + 1, end, target)


def short(rows: int, expected: int) -> bool:
    return rows < SHORTFALL * expected and expected - rows > LEAST_SHORT


def walk(fetch: Callable, window: Window, key: str, created: str = "timestamp_created", keep_until: int | None = None) -> Iterator[dict]:
    """Every row of a window once, walked again while it comes up short; rows newer than the crawl are passed over."""
    seen: dict = {}
    for _ in range(WALKS):
        cursor, past = "*", set()
        while True:
            rows, cursor = fetch((window.start, window.end), cursor)
            for r in rows:
                if keep_until is not None and r.get(created, 0) > keep_until:
                    past.add(r[key])
                else:
                    seen.setdefault(r[key], r)
            if not rows or cursor is None:
                break
        if not short(len(seen) + len(past), window.expected):
            break
    yield from seen.values()


@dataclass
class WindowPartition(InputPartition):
    start: int
    end: int
    expected: int


class PagedSource(DataSource):
    """Options: ``service`` (module:function of fetch), ``windows`` (JSON of windows), ``key``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, value string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.service, self.key = options["service"], options.get("key", "recommendationid")
        self.windows = [Window(**w) for w in json.loads(options["windows"])]

    def partitions(self):
        return [WindowPartition(w.start, w.end, w.expected) for w in self.windows]

    def read(self, partition):
        import importlib

        module, name = self.service.split(":")
        fetch = getattr(importlib.import_module(module), name)
        for row in walk(fetch, Window(partition.start, partition.end, partition.expected), self.key):
            yield (str(row[self.key]), json.dumps(row))


def read(spark: SparkSession, service: str, windows: list[Window], key: str = "recommendationid"):
    """Rows of a service as (id, JSON text)."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").options(service=service, key=key, windows=json.dumps([w.__dict__ for w in windows])).load()


def next_wait(refusals: int, waited: float, told: float | None, patience: float = 1800.0) -> float | None:
    """Seconds to wait after a refusal: what was told, else doubling up to five minutes; None when patience is out."""
    wait = told if told is not None else min(300.0, 2.0 ** refusals)
    return wait if waited + wait <= patience else None
