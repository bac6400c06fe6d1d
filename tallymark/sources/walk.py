"""A Spark data source that lists directory trees, dot-files included, and never reads what a filter rules out."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "root string, dir string, fname string, size bigint, mtime bigint"


class Subtree(InputPartition):
    def __init__(self, root: str, path: str, deep: bool):
        self.root, self.path, self.deep = root, path, deep


# --------------------------------------------------------------------------- what is never read


class Prefixes:
    """Which directories are wanted: those that begin with one of ``under`` (all, if there is none) and with none of ``outside``."""

    def __init__(self, under: list[str], outside: list[str]):
        self.under, self.outside = tuple(under), tuple(outside)

    def passes(self, path: str) -> bool:
        return (not self.under or path.startswith(self.under)) and not (self.outside and path.startswith(self.outside))

    def could(self, path: str) -> bool:
        """Whether the directory itself or one below it may be wanted."""
        if self.outside and path.startswith(self.outside):
            return False
        return not self.under or path.startswith(self.under) or any(p.startswith(path.rstrip("/") + "/") for p in self.under)


#: Parts of a pattern whose match may depend on what follows, or that Java and Python read differently.
_UNSURE = re.compile(r"\$|\\[zZbBGQEhHRXpPN]|\(\?[=!<]|&&|\[\[")


def prefix_patterns(patterns: list[str]) -> list[re.Pattern]:
    """The patterns that, once they are found in a directory's path, are found in every path below it.

    The others (and those that Python can't read) only ever drop single files.
    """
    out = []
    for p in patterns:
        if not _UNSURE.search(p):
            try:
                out.append(re.compile(p, re.ASCII))
            except re.error:
                continue
    return out


# --------------------------------------------------------------------------- the reader


class WalkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options.get("paths", options.get("path", "")).split(os.pathsep) if r]
        self.marker = options.get("skip_marker", ".mdSkipDir")
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.subtrees = int(options.get("subtrees", "64"))
        self.patterns = json.loads(options.get("ignore", "[]"))
        self.prefixes = Prefixes(json.loads(options.get("under", "[]")), json.loads(options.get("outside", "[]")))
        self.name = options.get("fname")

    def _wanted(self) -> Callable[[str], bool]:
        """Whether a directory is to be read at all."""
        ignored = prefix_patterns(self.patterns)

        def wanted(path: str) -> bool:
            if not self.hidden and os.path.basename(path).startswith("."):
                return False
            if not self.prefixes.could(path) or any(p.search(f"{path}/") for p in ignored):
                return False
            return not os.path.exists(os.path.join(path, self.marker))

        return wanted

    def partitions(self) -> list[Subtree]:
        """Directories from the roots down, each by itself, until there are ``subtrees`` others to read whole: a deep tree is cut where it branches."""
        wanted = self._wanted()
        waiting = [(r, r) for r in self.roots if not os.path.exists(os.path.join(r, self.marker)) and self.prefixes.could(r)]
        out = []
        while waiting and len(waiting) < self.subtrees and len(out) < self.subtrees:
            root, at = waiting.pop(0)
            out.append(Subtree(root, at, False))
            try:
                with os.scandir(at) as entries:
                    waiting += [(root, e.path) for e in sorted(entries, key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and wanted(e.path)]
            except OSError:  # it went meanwhile, or can't be read
                continue
        return out + [Subtree(root, at, True) for root, at in waiting]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        wanted, waiting = self._wanted(), [partition.path]
        while waiting:
            at = waiting.pop()
            passes = self.prefixes.passes(at)
            try:
                with os.scandir(at) as found:
                    entries = sorted(found, key=lambda e: e.name)
            except OSError:  # it went meanwhile, or can't be read
                continue
            below = []
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    if partition.deep and wanted(e.path):
                        below.append(e.path)
                elif passes and self.name in (None, e.name):
                    try:
                        s = e.stat(follow_symlinks=False)
                    except OSError:
                        continue
                    yield partition.root, at, e.name, s.st_size, int(s.st_mtime)
            waiting += reversed(below)


class WalkSource(DataSource):
    """Options: paths (separated as in PATH), skip_marker, hidden, subtrees (how many to read at a time, about), and JSON lists: ignore (patterns), under and outside (prefixes of dir); fname, of a single name.

    Directories with the marker are never read, nor is anything below; the same
    goes for directories in whose path an ignore pattern is found whatever may
    follow, and for those that the prefixes rule out.  Patterns that depend on
    what follows only concern files, which
    :func:`tallymark.operators.filters.drop_ignored` drops.

    What is pruned is said by options, not taken from filters: Spark 4.1 keeps
    one reader for all queries over one DataFrame of a Python source, so what one
    query pushes into it would rule out rows of another.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WalkReader:
        return WalkReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WalkSource)


def listed(spark: SparkSession, roots: list[str], ignore: list[str] | tuple[str, ...] = (), under: list[str] | tuple[str, ...] = (), outside: list[str] | tuple[str, ...] = (), **options: str) -> DataFrame:
    """The files below ``roots`` whose dir begins with one of ``under`` and none of ``outside``, without those that a pattern of ``ignore`` drops; subtrees that are ruled out are not even read."""
    from ..operators import filters

    register(spark)
    lists = {k: json.dumps(list(v)) for k, v in (("ignore", ignore), ("under", under), ("outside", outside))}
    found = spark.read.format("tree").option("paths", os.pathsep.join(map(os.path.abspath, roots))).options(**lists, **options).load()
    return filters.drop_ignored(found.withColumn("path", _path()), list(ignore)).drop("path") if ignore else found


def _path():
    from pyspark.sql import functions as F

    return F.concat_ws("/", "dir", "fname")


def read_contents(files, names: tuple[str, str] = ("dir", "fname")):
    """(path, content) of listed files, read where the tasks run; one that can't be read is null."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for d, f in zip(batch[names[0]], batch[names[1]]):
                path = os.path.join(d, f)
                try:
                    with open(path, "rb") as file:
                        out.append((path, file.read()))
                except OSError:
                    out.append((path, None))
            yield pd.DataFrame(out, columns=["path", "content"])

    return files.select(*names).mapInPandas(run, "path string, content binary")


def checksums(files, names: tuple[str, str] = ("dir", "fname")):
    """(path, new_checksum) of listed files, read part by part where the tasks run; one that can't be read is left out."""
    from ..plans.execute import checksum

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for d, f in zip(batch[names[0]], batch[names[1]]):
                path = os.path.join(d, f)
                try:
                    out.append((path, checksum(path)))
                except OSError:
                    continue
            yield pd.DataFrame(out, columns=["path", "new_checksum"])

    return files.select(*names).mapInPandas(run, "path string, new_checksum string")
