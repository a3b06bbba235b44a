"""A streaming DataSource over landed listings of closed pull requests.

A folder holds the crawls of one repository's listing, in the order of their
names. A crawl is a folder of pages, in the order of their names too, each a
file of JSON objects by line; it counts once ``_SUCCESS`` is in it, which comes after that of
all crawls named before it, and does not change from then on. As the listing is, a crawl runs from the newest record
down, by ``updated_at`` and then ``number``.

The stream hands out each (``updated_at``, ``number``) once, from the first one at
``since`` on. Its offset is the newest pair so far, with the crawl it was
found in. Of a crawl, what lies between the newest pair of the crawls before and
its own newest is new: pages are looked at from the newest on, and none behind the first
one that begins at or below the old offset is opened. A record that is edited
between two crawls comes again, with its later ``updated_at``. If the listing moves while it is crawled,
a page may begin with records of the one before, which are left out.

Offsets only tell pairs and names, and crawls don't change, so a batch that is run again after a
failure has the same rows. Nulls are as landed; an empty page or crawl has no rows. A line that
is no JSON object with both parts of the key, or a page that is not in order,
ends the stream with its place, as what it would hide could not be told. The folder has to be a mount that
all executors see.

    register(spark); spark.readStream.format("pull_listing").option("since", "2026-01-01T00:00:00Z").load("/path")
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: ``record`` is the whole object as it was landed.
SCHEMA = "number long, updated_at string, merged_at string, merge_commit_sha string, title string, record string"
#: The file that says that a crawl is whole.
DONE = "_SUCCESS"
#: Pages of a partition.
PAGES = 64

Pair = tuple[str, int]


def _records(page: str) -> Iterator[tuple[Pair, dict, str]]:
    """(pair, object, line) of a page's records, which have to descend."""
    last = None
    with open(page, encoding="utf-8") as f:
        for i, line in enumerate(f, 1):
            if not line.strip():
                continue
            try:
                value = json.loads(line)
                pair = str(value["updated_at"]), int(value["number"])
            except (ValueError, TypeError, KeyError) as e:
                raise ValueError(f"{page}, line {i}: no record of a listing") from e
            if last is not None and pair >= last:
                raise ValueError(f"{page}, line {i}: not in the order of the listing")
            last = pair
            yield pair, value, line.rstrip("\r\n")


def _newest(page: str) -> Pair | None:
    """The pair a page begins with; no more of it is read."""
    return next((pair for pair, _, _ in _records(page)), None)


class _Pages(InputPartition):
    """Consecutive pages of a crawl and the one before them; wanted are pairs above ``low`` up to ``high``."""

    def __init__(self, before: str | None, pages: list[str], low: Pair, high: Pair):
        self.before, self.pages, self.low, self.high = before, pages, low, high


class ListingReader(DataSourceStreamReader):
    def __init__(self, root: str, since: str):
        self.root = root.removeprefix("file://")
        self.since = since
        self.last = self.initialOffset()

    def initialOffset(self) -> dict:
        # No record has a number below 0, so those at ``since`` itself come after this.
        return {"crawl": "", "updated": self.since, "number": -1}

    def _crawls(self, after: str) -> list[str]:
        if not os.path.isdir(self.root):
            return []
        return sorted(c for c in os.listdir(self.root) if c > after and os.path.exists(os.path.join(self.root, c, DONE)))

    def _pages(self, crawl: str) -> list[str]:
        folder = os.path.join(self.root, crawl)
        return [os.path.join(folder, n) for n in sorted(os.listdir(folder)) if not n.startswith(("_", "."))]

    def _top(self, crawl: str) -> Pair | None:
        """The newest pair of a crawl; later pages don't have a newer one."""
        return next((top for p in self._pages(crawl) if (top := _newest(p)) is not None), None)

    def latestOffset(self) -> dict:
        pair = self.last["updated"], self.last["number"]
        for crawl in self._crawls(self.last["crawl"]):
            pair = max(pair, self._top(crawl) or pair)
            self.last = {"crawl": crawl, "updated": pair[0], "number": pair[1]}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, out = (start["updated"], start["number"]), []
        for crawl in self._crawls(start["crawl"]):
            if crawl > end["crawl"]:
                break
            wanted, high = [], low
            for page in self._pages(crawl):
                top = _newest(page)
                if top is None:
                    continue
                if top <= low:
                    break
                wanted.append(page)
                high = max(high, top)
            for i in range(0, len(wanted), PAGES):
                out.append(_Pages(wanted[i - 1] if i else None, wanted[i : i + PAGES], low, high))
            low = high
        return out

    def read(self, partition: _Pages) -> Iterator[tuple]:
        seen = None
        if partition.before:
            for seen, _, _ in _records(partition.before):
                pass
        for page in partition.pages:
            for pair, value, line in _records(page):
                if pair <= partition.low:
                    break
                if pair <= partition.high and (seen is None or pair < seen):
                    seen = pair
                    yield pair[1], pair[0], value.get("merged_at"), value.get("merge_commit_sha"), value.get("title"), line

    def commit(self, end: dict) -> None:
        """Nothing to clear: crawls belong to who lands them."""


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pull_listing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"], self.options.get("since", ""))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Listing)
