"""A data source over saved pages of repository searches, and the pause between requests.

Each saved page, a JSON object with ``items``, is one partition; a folder may
hold the pages of any number of searches, in folders of their own or not.  It
must be a folder that all machines can open as a path.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas

#: Fixed value of the search interface: hits of a page.
PAGE_SIZE = 100
#: Fixed value: seconds added to the time at which a limit is lifted.
MARGIN = 7.5


def pause(limited_until: float, now: float) -> float:
    """Seconds to wait until a rate limit is lifted."""
    return max(0.0, limited_until - now) + MARGIN


def pause_column(limited_until: Column, now: Column) -> Column:
    """``pause`` for a log of requests."""
    return F.greatest(F.lit(0.0), (limited_until - now).cast("double")) + MARGIN


def _items(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return json.load(f).get("items", [])


class _Page(InputPartition):
    def __init__(self, path: str, most: int | None):
        self.path, self.most = path, most


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.limit = options["path"].removeprefix("file:"), options.get("limit")

    def _pages(self) -> Iterator[str]:
        """All pages below the folder, in the order of their paths; marks and checksums are none."""
        for base, folders, names in os.walk(self.path):
            folders.sort()
            yield from (os.path.join(base, n) for n in sorted(names) if n[:1] not in "._")

    def partitions(self) -> list[_Page]:
        if self.limit is None:
            return [_Page(p, None) for p in self._pages()]
        # only with a limit must pages be counted, and no more of them than it takes
        left, out = int(self.limit), []
        for p in self._pages():
            if left <= 0:
                break
            out.append(_Page(p, left))
            left -= len(_items(p))
        return out

    def read(self, partition: _Page | None) -> Iterator[tuple]:
        # without any partition Spark reads once without one
        if partition is None:
            return
        for item in _items(partition.path)[: partition.most]:
            license_ = item.get("license")
            row = [item.get(f.name) for f in schemas.REPO]
            row[schemas.REPO.names.index("license")] = None if license_ is None else tuple(license_.get(n) for n in schemas.LICENSE.names)
            yield tuple(row)


class RepositoryPages(DataSource):
    """``spark.dataSource.register(RepositoryPages)``, then ``spark.read.format("repository_pages").load(folder)``.

    The option ``limit`` ends the union of pages after exactly so many hits; without it there is no end but the last page's.
    """

    @classmethod
    def name(cls) -> str:
        return "repository_pages"

    def schema(self):
        return schemas.REPO

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
