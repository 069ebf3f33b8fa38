"""A Spark data source that walks folders over many tasks, errors as rows.

    spark.dataSource.register(FolderWalk)
    spark.read.format("folder_walk").option("roots", "/a,/b").option("partitions", 64).load()

The driver opens the upper folders until there are several times as many branches as
partitions, and deals the branches out; what it has seen in the folders it opened goes
along as paths.  So a single root is walked by many tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from heliograph.schemas import EXTENSIONS

SCHEMA = "root string, path string, size_bytes long, mtime_ns long, error string"


def _listed(root: str, folder: str) -> tuple[list[tuple], list[str]]:
    """(rows, folders) right below a folder, by name; hidden entries and links are passed over, errors are rows."""
    rows, below = [], []
    try:
        with os.scandir(folder) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError as e:
        return [(root, folder, None, None, str(e))], []
    for e in entries:
        if e.name.startswith(".") or e.is_symlink():
            continue
        try:
            if e.is_dir(follow_symlinks=False):
                below.append(e.path)
            elif e.is_file(follow_symlinks=False) and e.name.rpartition(".")[2].lower() in EXTENSIONS and "." in e.name:
                st = e.stat(follow_symlinks=False)
                rows.append((root, e.path, st.st_size, st.st_mtime_ns, None))
        except OSError as error:
            rows.append((root, e.path, None, None, str(error)))
    return rows, below


def walk(root: str, start: str | None = None) -> Iterator[tuple]:
    """(root, path, size, mtime, error) of supported files below ``start`` or else the root, depth first by name.

    A folder is entered once however it is reached, and what cannot be read is a row with
    an error, never an exception.
    """
    waiting, entered = [start or root], set()
    while waiting:
        folder = waiting.pop()
        try:
            own = os.stat(folder)
        except OSError as e:
            yield root, folder, None, None, str(e)
            continue
        if (own.st_dev, own.st_ino) in entered:
            continue
        entered.add((own.st_dev, own.st_ino))
        rows, below = _listed(root, folder)
        yield from rows
        waiting += reversed(below)


@dataclass
class Branches(InputPartition):
    """Folders to walk whole, and opened folders of which only the files are listed."""

    whole: list[tuple[str, str]]
    opened: list[tuple[str, str]]


class _Reader(DataSourceReader):
    #: Branches to a partition, so that large ones even out; and how many folders the driver opens at most for each.
    EACH = 8

    def __init__(self, roots: list[str], partitions: int):
        self.roots, self.count = roots, max(1, partitions)

    def partitions(self):
        waiting, opened = [(r, r) for r in self.roots], []
        while waiting and len(waiting) < self.count * self.EACH and len(opened) < self.count * self.EACH:
            root, folder = waiting.pop(0)  # breadth first: upper folders have the largest branches
            below = _listed(root, folder)[1]
            opened.append((root, folder))
            waiting += [(root, b) for b in below]
        dealt = [Branches([], []) for _ in range(self.count)]
        for k, one in enumerate(waiting):
            dealt[k % self.count].whole.append(one)
        for k, one in enumerate(opened):
            dealt[-1 - k % self.count].opened.append(one)
        return [d for d in dealt if d.whole or d.opened] or dealt[:1]

    def read(self, partition):
        for root, folder in partition.opened:
            yield from _listed(root, folder)[0]
        for root, folder in partition.whole:
            yield from walk(root, folder)


class FolderWalk(DataSource):
    @classmethod
    def name(cls):
        return "folder_walk"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader([r for r in self.options.get("roots", "").split(",") if r], int(self.options.get("partitions", 32)))
