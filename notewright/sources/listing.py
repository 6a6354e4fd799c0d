"""Listings of notes from a source that is asked for windows of items, as a Spark data source.

The source counts its items and gives them window by window; a window is a partition, so executors ask for them side by side.
A filter on the last date goes to the source.  A request that takes too long is repeated with a longer limit.
"""

from __future__ import annotations

import queue
import threading
from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, InputPartition

SCHEMA = "title string, creation_date string, modification_date string, last_date string, place long"
#: Items of a window, and seconds that a request for one may take: at first, and when it is repeated.
WINDOW, LIMITS = 50, (300.0, 450.0, 600.0)


class Source(Protocol):
    """What is asked; it is sent to the executors.  since: only items with a creation or modification after it."""

    def count(self, since: str | None) -> int: ...

    def window(self, start: int, stop: int, since: str | None) -> list[tuple[str, str, str]]: ...


class TooLong(RuntimeError):
    """A request took longer than all its limits."""


def within(limit: float, request: Any) -> Any:
    """The answer of a request, or queue.Empty behind the limit; the request itself goes on in a thread of its own."""
    answer: queue.Queue = queue.Queue()

    def ask() -> None:
        try:
            answer.put((request(), None))
        except BaseException as e:  # noqa: BLE001  raised where the answer is awaited
            answer.put((None, e))

    threading.Thread(target=ask, daemon=True).start()
    out, error = answer.get(timeout=limit)
    if error is not None:
        raise error
    return out


def patiently(limits: tuple[float, ...], request: Any) -> Any:
    """The answer of a request that is repeated under each limit in turn while it takes too long; other errors are raised at once."""
    for limit in limits:
        try:
            return within(limit, request)
        except queue.Empty:
            continue
    raise TooLong(f"no answer within {', '.join(f'{x:g}' for x in limits)} seconds")


class Window(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        super().__init__((start, stop))


class ListingReader(DataSourceReader):
    def __init__(self, source: Source, most: int | None, window: int, limits: tuple[float, ...]) -> None:
        self.source, self.most, self.size, self.limits, self.since = source, most, window, limits, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """last_date > T is the source's own; all else is left to Spark."""
        for f in filters:
            if isinstance(f, GreaterThan) and f.attribute == ("last_date",) and isinstance(f.value, str):
                self.since = f.value if self.since is None else max(self.since, f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        n = patiently(self.limits, lambda: self.source.count(self.since))
        n = n if self.most is None else min(n, self.most)
        return [Window(i, min(i + self.size, n)) for i in range(0, n, self.size)] or [Window(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, stop = partition.value
        if stop > start:
            items = patiently(self.limits, lambda: self.source.window(start, stop, self.since))
            for i, (title, created, modified) in enumerate(items):
                yield title, created, modified, max(x for x in (created, modified, "") if x is not None), start + i


def read_listing(spark: SparkSession, source: Source, name: str = "note_listing", most: int | None = None, window: int = WINDOW, limits: tuple[float, ...] = LIMITS) -> DataFrame:
    """The items of a source in its order, with last_date (the later of both dates; ISO texts) and place.

    most: the first so many only, as the source numbers them; with a filter, of what it leaves.  The data source is
    registered under name, and the session lets filters through to Python sources from then on.
    """

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: Any) -> DataSourceReader:
            return ListingReader(source, most, window, limits)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listing)
    return spark.read.format(name).load()


class ListedFiles:
    """A source over Parquet files with title, creation_date and modification_date, in the order of these; read once in each process."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _items(self, since: str | None) -> list[tuple[str, str, str]]:
        import pyarrow.dataset as ds

        rows = ds.dataset(self.path.removeprefix("file://"), format="parquet", exclude_invalid_files=True).to_table(columns=["title", "creation_date", "modification_date"]).to_pylist()
        items = [(r["title"], r["creation_date"], r["modification_date"]) for r in rows]
        items = [x for x in items if since is None or max(y for y in (*x[1:], "") if y is not None) > since]
        return sorted(items, key=lambda x: tuple((y is None, y or "") for y in x))

    def count(self, since: str | None) -> int:
        return len(self._items(since))

    def window(self, start: int, stop: int, since: str | None) -> list[tuple[str, str, str]]:
        return self._items(since)[start:stop]
