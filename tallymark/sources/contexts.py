"""Restore contexts of any size: nested directories below source paths, read by many tasks and written by many.

Files are cut into byte ranges as journals are.  Where a range begins in the tree
follows from the ranges before it: each says how many directories it closes that
it didn't open, and which it opens and leaves open, and such sayings compose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import escape
from .journals import SPLIT, TAG, Bytes, attribute, dealt

FILE = "_name string, _size bigint, _mtime double, _md5 string, bd array<string>"
_MARK = re.compile(rb"<(rc|dr|file)(?=[\s/>])|</(dr)(?=[\s>])")
_END = re.compile(rb"</file\s*>")

#: What a range does to the place in the tree: the source path it changes to (null: it stays), directories it closes first, and those it leaves open.
Step = tuple[str | None, int, list[str]]


def walked(start: int, stop: int, file, source: str | None = None, at: list[str] | None = None) -> Iterator[tuple[str | None, str, str] | Step]:
    """(source path, directory, XML) of each file that begins in a range, which begins at ``source`` and ``at``; then the range's step."""
    w, place, closed, opened, changed = Bytes(file, start, stop), 0, 0, [], None
    base = list(at or [])
    while (m := _MARK.search(w.data, place)) and m.start() < stop - start:
        if m.group(2):
            place = m.end()
            if opened:
                opened.pop()
            else:
                closed += 1
                base = base[:-1]
            continue
        tag = w.match(TAG, m.start(), True)
        place, whole = tag.end(), bool(tag.group(1))
        if m.group(1) == b"rc":
            source = changed = attribute(tag.group(), "src_path")
            base, opened, closed = [], [], 0
        elif m.group(1) == b"dr":
            if not whole:
                opened.append(attribute(tag.group(), "name"))
        else:
            if not whole:
                place = w.match(_END, place, False).end()
            yield source, "/".join([*base, *opened]), w.data[m.start() : place].decode()
    yield changed, closed, opened


def after(source: str | None, at: list[str], step: Step) -> tuple[str | None, list[str]]:
    """Where a range's step leads to."""
    changed, closed, opened = step
    if changed is not None:
        return changed, list(opened)
    return source, [*at[: len(at) - closed if closed < len(at) else 0], *opened]


def read_contexts(spark: SparkSession, paths: list[str], split: int = SPLIT) -> DataFrame:
    """(src_path, dir, name, size, mtime, md5, backup_dest) of restore contexts, files right under a source path included (dir is empty), whatever ``split`` is.

    Paths are files or folders that driver and executors share; a file that ends
    within an element is an error.
    """
    cut, tasks = dealt(spark, paths, split)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            steps = []
            for name, start, stop in batch[["file", "start", "stop"]].itertuples(index=False):
                with open(name, "rb") as file:
                    for step in walked(start, stop, file):
                        pass
                    steps.append(step)
            yield batch.assign(changed=[s[0] for s in steps], closed=[s[1] for s in steps], opened=[s[2] for s in steps])

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by file and start; what is held is one place."""
        own, source, at = None, None, []
        for batch in batches:
            out = []
            for name, start, stop, changed, closed, opened in batch[["file", "start", "stop", "changed", "closed", "opened"]].itertuples(index=False):
                if name != own:
                    own, source, at = name, None, []
                out.append((name, start, stop, source, list(at)))
                source, at = after(source, at, (changed, closed, list(opened)))
            yield pd.DataFrame(out, columns=["file", "start", "stop", "source", "at"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["src_path", "dir", "xml"]
        for batch in batches:
            for name, start, stop, source, at in batch[["file", "start", "stop", "source", "at"]].itertuples(index=False):
                with open(name, "rb") as file:
                    out, last = [], None
                    for row in walked(start, stop, file, source, list(at)):
                        if last is not None:
                            out.append(last)
                        last = row  # the very last is the step
                        if len(out) == 10_000:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                    yield pd.DataFrame(out, columns=names)

    steps = cut.mapInPandas(look, "file string, start long, stop long, changed string, closed int, opened array<string>")
    placed = steps.repartition("file").sortWithinPartitions("file", "start").mapInPandas(compose, "file string, start long, stop long, source string, at array<string>")
    rows = placed.repartition(tasks).mapInPandas(read, "src_path string, dir string, xml string")
    f = rows.withColumn("f", F.from_xml("xml", FILE, {"rowTag": "file"}))
    none = F.array().cast("array<string>")
    return f.select("src_path", "dir", F.col("f._name").alias("name"), F.coalesce("f._size", F.lit(0)).alias("size"), F.coalesce("f._mtime", F.lit(0.0)).alias("mtime"), F.coalesce("f._md5", F.lit("")).alias("md5"), F.coalesce("f.bd", none).alias("backup_dest"))


def write_contexts(rows: DataFrame) -> DataFrame:
    """(src_path, dir, xml): parts of a restore context, each with the directories above its own, so that many tasks write it; files in the order of names."""
    value = lambda name, c: F.concat(F.lit(f' {name}="'), escape(c.cast("string")), F.lit('"'))
    mtime = F.when(F.col("mtime") == F.floor("mtime"), F.floor("mtime").cast("string")).otherwise(F.col("mtime").cast("string"))
    dests = F.array_join(F.transform(F.array_sort(F.coalesce("backup_dest", F.array().cast("array<string>"))), lambda v: F.concat(F.lit("<bd>"), escape(v), F.lit("</bd>"))), "")
    one = F.concat(F.lit("<file"), value("name", F.col("name")), value("size", F.col("size")), value("mtime", mtime), value("md5", F.coalesce("md5", F.lit(""))), F.lit(">"), dests, F.lit("</file>"))
    files = rows.select("src_path", F.coalesce("dir", F.lit("")).alias("dir"), F.struct("name", one.alias("x")).alias("e"))
    docs = files.groupBy("src_path", "dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]), "").alias("body"))
    levels = F.filter(F.split("dir", "/"), lambda p: p != "")
    opened = F.array_join(F.transform(levels, lambda p: F.concat(F.lit('<dr name="'), escape(p), F.lit('">'))), "")
    closed = F.repeat(F.lit("</dr>"), F.size(levels))
    return docs.select("src_path", "dir", F.concat(F.lit('<rc src_path="'), escape(F.col("src_path")), F.lit('">'), opened, "body", closed, F.lit("</rc>")).alias("xml"))
