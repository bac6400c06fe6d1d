"""Journals of any size, read by many tasks.

A journal file is cut into byte ranges, wherever the cuts fall.  A range owns the
elements that begin in it: its reader finds the first by itself and reads on past
the range's end to finish the last.  An entry's alias and directory stand before
it, perhaps many ranges before; so a first pass looks, from each range's end, only
for the last root and the last directory that begin there, and a running value
over the ranges (a row each) tells every range what it starts under.
"""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as tree
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .documents import ENTRY, entries

#: Bytes of a range, and bytes that are read at a time to finish an element.
SPLIT, MORE = 32 << 20, 1 << 16
_START = re.compile(rb"<(mdj|dr|fr)(?=[\s/>])")
#: A start tag; an attribute's value may hold any character but its quote and <.
TAG = re.compile(rb"""<[a-z]+(?:\s+[^\s=<>/"']+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*\s*(/?)>""")
_END = re.compile(rb"</fr\s*>")


def journal_files(paths: list[str]) -> list[str]:
    """The files that ``paths`` name, or that lie right below them; names that begin with a dot or an underscore are left out."""
    out = []
    for path in (p[7:] if p.startswith("file://") else p for p in paths):
        out += [os.path.join(path, f) for f in sorted(os.listdir(path)) if f[:1] not in "._"] if os.path.isdir(path) else [path]
    return out


def ranges(spark: SparkSession, sizes: list[tuple[str, int]], split: int = SPLIT) -> DataFrame:
    """(file, start, stop) of files (with their sizes) cut into ranges of ``split`` bytes."""
    listed = spark.createDataFrame(sizes, "file string, size long").filter("size > 0")
    starts = listed.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    return starts.select("file", "start", F.least(F.col("start") + split, "size").alias("stop"))


def dealt(spark: SparkSession, paths: list[str], split: int) -> tuple[DataFrame, int]:
    """The ranges of the files that ``paths`` name, dealt to tasks, and the number of these."""
    sizes = [(f, os.path.getsize(f)) for f in journal_files(paths)]
    tasks = max(1, min(sum(-(-size // split) for _, size in sizes), 4 * spark.sparkContext.defaultParallelism))
    return ranges(spark, sizes, split).repartition(tasks), tasks


class Bytes:
    """The bytes of a file from ``start`` on, as many as have been asked for."""

    def __init__(self, file, start: int, stop: int):
        self.file, self.size = file, os.fstat(file.fileno()).st_size
        self.base, self.data = start, b""
        self.fill(stop + 8 - start)  # enough to tell the name of an element that begins at the range's last byte

    def fill(self, n: int) -> bool:
        """Reads on until there are ``n`` bytes; whether there are more than before."""
        missing = min(n, self.size - self.base) - len(self.data)
        if missing <= 0:
            return False
        self.file.seek(self.base + len(self.data))
        self.data += self.file.read(missing)
        return True

    def match(self, pattern: re.Pattern, at: int, anchored: bool) -> re.Match:
        """The match at ``at`` (or after it), for which more is read if need be."""
        more = MORE
        while True:
            m = pattern.match(self.data, at) if anchored else pattern.search(self.data, at)
            if m:
                return m
            if not self.fill(len(self.data) + more):
                raise ValueError(f"{self.file.name}: cut off or malformed at byte {self.base + at}")
            more *= 2


def attribute(tag: bytes, name: str) -> str:
    whole = tag if tag.endswith(b"/>") else tag[:-1] + b"/>"
    return tree.fromstring(whole).get(name) or ""


def heads(start: int, stop: int, file) -> tuple[str | None, str | None]:
    """(alias of the last root, path of the last directory) that begin in a range; null where none does."""
    w = Bytes(file, start, stop)
    out = []
    for name, field in ((b"<mdj", "alias"), (b"<dr", "dir")):
        at = min(stop - start, len(w.data))
        while (at := w.data.rfind(name, 0, at + len(name) - 1)) >= 0:
            if _START.match(w.data, at):
                break
        out.append(attribute(w.match(TAG, at, True).group(), field) if at >= 0 else None)
    return out[0], out[1]


def elements(start: int, stop: int, file, alias: str | None, at_dir: str | None) -> Iterator[tuple[str | None, str | None, str]]:
    """(alias, dir, XML) of the entries that begin in a range, which itself begins under ``alias`` and ``at_dir``."""
    w, at = Bytes(file, start, stop), 0
    while (m := _START.search(w.data, at)) and m.start() < stop - start:
        tag = w.match(TAG, m.start(), True)
        at = tag.end()
        if m.group(1) == b"mdj":
            alias, at_dir = attribute(tag.group(), "alias"), None
        elif m.group(1) == b"dr":
            at_dir = attribute(tag.group(), "dir")
        else:
            if not tag.group(1):
                at = w.match(_END, at, False).end()
            yield alias, at_dir, w.data[m.start() : at].decode()


def read_journals(spark: SparkSession, paths: list[str], split: int = SPLIT) -> DataFrame:
    """Files of journals (alias, dir, fname, checksum, size, mtime, tags, backup_dest), as :func:`tallymark.sources.documents.read_journal` gives them, whatever ``split`` is.

    Paths are files or folders that driver and executors share.  A blank alias
    is an error, and so is a file that ends within an element.  Comments and
    character data that hold markup are not provided for.
    """
    cut, tasks = dealt(spark, paths, split)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name, start, stop in batch[["file", "start", "stop"]].itertuples(index=False):
                with open(name, "rb") as file:
                    found.append(heads(start, stop, file))
            yield batch.assign(last_alias=[a for a, _ in found], last_dir=[d for _, d in found])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start, stop, alias, at_dir in batch[["file", "start", "stop", "alias", "dir"]].itertuples(index=False):
                with open(name, "rb") as file:
                    out = []
                    for row in elements(start, stop, file, alias, at_dir):
                        out.append(row)
                        if len(out) == 10_000:
                            yield pd.DataFrame(out, columns=["alias", "dir", "xml"])
                            out = []
                    yield pd.DataFrame(out, columns=["alias", "dir", "xml"])

    seen = cut.mapInPandas(look, "file string, start long, stop long, last_alias string, last_dir string")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    under = seen.select("file", "start", "stop", F.last("last_alias", True).over(before).alias("alias"), F.last("last_dir", True).over(before).alias("dir"))
    rows = under.repartition(tasks).mapInPandas(read, "alias string, dir string, xml string")
    alias = F.when(F.trim(F.coalesce("alias", F.lit(""))) == "", F.raise_error(F.lit("a journal entry without an alias"))).otherwise(F.col("alias"))
    return entries(rows.select(alias.alias("alias"), "dir", F.from_xml("xml", ENTRY, {"rowTag": "fr"}).alias("fr")), "alias", "dir")
