"""A data source writer for content-addressed files: each is put in place whole, once, or not at all.

    spark.dataSource.register(CacheSink)
    rows.write.format("content_cache").option("folder", "/cache").mode("append").save()

Rows are (key, content); a file's place is {folder}/{key[:2]}/{key}{suffix}.  A task writes
each file aside and renames it, so readers never see a part of one, equal keys meet in one
file, and a task that fails or runs twice leaves nothing behind but whole files.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    new: int
    known: int


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def write(self, rows):
        new = known = 0
        mine = os.path.join(self.folder, f".{uuid.uuid4().hex}")
        try:
            for key, content in rows:
                if not key or content is None or os.sep in key:
                    raise ValueError(f"no file can have the key {key!r}")
                target = os.path.join(self.folder, key[:2], key + self.suffix)
                if os.path.exists(target):
                    known += 1
                    continue
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(mine, "wb") as out:
                    out.write(content)
                os.replace(mine, target)
                new += 1
        finally:
            if os.path.exists(mine):
                os.remove(mine)
        return Written(new, known)

    def commit(self, messages):
        pass  # every file is in place already

    def abort(self, messages):
        pass  # what tasks have put in place is whole and as good for the next attempt


class CacheSink(DataSource):
    @classmethod
    def name(cls):
        return "content_cache"

    def schema(self):
        return "key string, content binary"

    def writer(self, schema, overwrite):
        return _Writer(self.options["folder"], self.options.get("suffix", ""))
