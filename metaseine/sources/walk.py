"""A folder walk as a data source: ``spark.read.format("media_files")``, a row for each file, a partition for each folder or so.

Unlike the binary file source it sees empty files, dead links and names that start with an underscore. Options: path, recursive,
ext (comma-separated, replaces the default suffixes), hidden, exclude (globs of folder names, comma-separated), since, until
(epoch seconds). Lists may also be given as JSON. Suffix, hidden and folder tests come before a file is looked at. Filters on ``ext`` are pushed down.
"""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.columns import IMAGE_SUFFIXES, VIDEO_SUFFIXES

SCHEMA = "path string, dir string, name string, ext string, length long, mtime_ns long, is_link boolean, link_target string, dead boolean"
#: Folders that the driver lists at most before it leaves the rest to the partitions.
SPREAD = 256


@dataclass
class Folder(InputPartition):
    path: str
    recursive: bool

    def __init__(self, path: str, recursive: bool):
        self.path, self.recursive = path, recursive
        super().__init__((path, recursive))


class MediaFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


def listed(option: str) -> list[str]:
    """The members of an option, which may have commas where it is JSON."""
    if option.startswith('["'):
        return json.loads(option)
    return [x.strip() for x in option.split(",") if x.strip()]


class MediaReader(DataSourceReader):
    def __init__(self, options):
        flag = lambda k, d: str(options.get(k, d)).lower() == "true"
        self.root = os.path.abspath(options["path"])
        self.recursive, self.hidden = flag("recursive", "true"), flag("hidden", "false")
        given = [e.lstrip(".").lower() for e in listed(options.get("ext", ""))]
        self.ext = set(given or (*IMAGE_SUFFIXES, *VIDEO_SUFFIXES))
        self.exclude = [g.lower() for g in listed(options.get("exclude", ""))]
        self.since, self.until = (float(options[k]) if k in options else None for k in ("since", "until"))

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ext",):
                self.ext &= {f.value}
            elif isinstance(f, In) and f.attribute == ("ext",):
                self.ext &= set(f.value)
            yield f  # the engine tests it again

    def _inner(self, folder: str) -> list[str]:
        """The sub-folders to go into."""
        try:
            with os.scandir(folder) as entries:
                names = [e.name for e in entries if e.is_dir(follow_symlinks=False)]
        except OSError:
            return []
        names = [n for n in names if self.hidden or not n.startswith(".")]
        return [os.path.join(folder, n) for n in sorted(names) if not any(fnmatch.fnmatchcase(n.lower(), g) for g in self.exclude)]

    def partitions(self) -> list[InputPartition]:
        if not self.recursive:
            return [Folder(self.root, False)]
        found, front = [], [self.root]
        while front and len(front) + len(found) < SPREAD:
            found += [Folder(d, False) for d in front]
            front = [s for d in front for s in self._inner(d)]
        return found + [Folder(d, True) for d in front]

    def read(self, partition: Folder) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            folder = todo.pop()
            yield from self._files(folder)
            if partition.recursive:
                todo += self._inner(folder)

    def _files(self, folder: str) -> Iterator[tuple]:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            ext = os.path.splitext(e.name)[1].lower().lstrip(".")
            if ext not in self.ext or (e.name.startswith(".") and not self.hidden) or e.is_dir():
                continue
            link = e.is_symlink()
            try:
                stat = e.stat(follow_symlinks=False) if link else e.stat()
            except OSError:
                continue
            if self.since is not None or self.until is not None:
                try:
                    when = e.stat().st_mtime
                except OSError:
                    continue
                if (self.since is not None and when < self.since) or (self.until is not None and when >= self.until):
                    continue
            target = os.path.realpath(e.path) if link else None
            yield e.path, folder, e.name, ext, stat.st_size, stat.st_mtime_ns, link, target, link and not os.path.exists(target)


def files(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters
    reader = spark.read.format("media_files").option("path", path)
    for k, v in options.items():
        if v not in (None, "", (), []):
            reader = reader.option(k, json.dumps(v) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load()
