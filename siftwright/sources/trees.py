"""A data source over folders of checked-out repositories, hidden files included.

The binary file source passes over names that begin with a point or an
underscore, lists all files in the driver and makes a task for some thirty of
them.  This one walks all of a tree: the folders below the root are dealt out to
a number of partitions, each walked by its own task, so that no machine lists
all files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length bigint, content binary"


#: Partitions at most, unless the reader is told how many.
PARTS = 256


class _Folders(InputPartition):
    def __init__(self, paths: list[str], deep: bool):
        self.paths, self.deep = paths, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.root = options["path"].removeprefix("file:")
        self.most = int(options.get("most_bytes", 1 << 31))
        self.passed = {n for n in options.get("passed_over", ".git").split(",") if n}
        self.parts = max(1, int(options.get("parts", PARTS)))
        self.names = names

    def partitions(self) -> list[_Folders]:
        folders = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and e.name not in self.passed)
        return [_Folders([self.root], False), *[_Folders(folders[k :: self.parts], True) for k in range(min(self.parts, len(folders)))]]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        for base, folders, files in chain.from_iterable(map(os.walk, partition.paths)):
            folders[:] = sorted(n for n in folders if n not in self.passed) if partition.deep else []
            for name in sorted(files):
                path = os.path.join(base, name)
                if os.path.islink(path) or not os.path.isfile(path):
                    continue
                length = os.path.getsize(path)
                # a file that is too large is not opened, nor any whose content is not asked for
                if length >= self.most:
                    continue
                content = None
                if "content" in self.names:
                    with open(path, "rb") as f:
                        content = f.read()
                yield tuple({"path": path, "length": length, "content": content}[n] for n in self.names)


class RepositoryTrees(DataSource):
    """``spark.dataSource.register(RepositoryTrees)``, then ``spark.read.format("repository_trees").load(root)``.

    Options: ``most_bytes`` leaves out files of so many bytes and more before they
    are opened; ``passed_over`` names folders that are not walked, separated by
    commas; ``parts`` is the most tasks that walk.  A schema without ``content`` lists files without opening them.  The
    root must be a folder that all machines can open as a path; links are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "repository_trees"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, schema.names)
