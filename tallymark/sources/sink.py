"""Directory documents on disk: a Spark data sink that writes and deletes them, and the way from a catalog to it.

A task stages each of its documents beside the one it replaces and swaps them in
once all of its rows are staged; a swap is a rename, so whoever reads a directory
finds a whole document, the old one or the new one.  A task that fails takes its
staged files away; one that runs again, or runs twice, swaps in the same text.
What a lost executor leaves behind has a name that no reader looks at, and goes
when that directory is written next.
"""

from __future__ import annotations

import contextlib
import glob
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import documents, walk

#: The file that holds a directory's entries; seconds after which a staged file is a lost one.
NAME, LOST = ".directory.xml", 3600


@dataclass
class Written(WriterCommitMessage):
    """What one task did; no paths, so the driver holds a few numbers for each task."""

    written: int
    deleted: int
    gone: int  # documents whose directory is no longer there


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.name, self.tally = options.get("name", NAME), options.get("tally")

    def _sweep(self, directory: str) -> None:
        for part in glob.glob(f"{glob.escape(os.path.join(directory, self.name))}.*.part"):
            with contextlib.suppress(OSError):
                if time.time() - os.path.getmtime(part) > LOST:
                    os.unlink(part)

    def write(self, iterator: Iterator) -> Written:
        staged, stale, gone = [], [], 0
        try:
            for row in iterator:
                path = os.path.join(row["dir"], self.name)
                if row["action"] == "delete":
                    stale.append(path)
                    continue
                if row["action"] != "write":
                    raise ValueError(f"{row['action']} is neither write nor delete")
                if not os.path.isdir(row["dir"]):
                    gone += 1
                    continue
                part = f"{path}.{uuid.uuid4().hex}.part"
                staged.append((part, path))
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write(row["xml"])
                    f.flush()
                    os.fsync(f.fileno())
        except BaseException:
            for part, _ in staged:
                with contextlib.suppress(OSError):
                    os.unlink(part)
            raise
        for part, path in staged:
            os.replace(part, path)
            self._sweep(os.path.dirname(path))
        for path in stale:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(path)
        return Written(len(staged), len(stale), gone)

    def commit(self, messages: list[Written | None]) -> None:
        """All tasks are done: says how much, where the option ``tally`` names a file."""
        if self.tally:
            done = [m for m in messages if m is not None]
            with open(f"{self.tally}.part", "w") as f:
                f.write(f"{sum(m.written for m in done)} written, {sum(m.deleted for m in done)} deleted, {sum(m.gone for m in done)} gone")
            os.replace(f"{self.tally}.part", self.tally)

    def abort(self, messages: list[Written | None]) -> None:
        """A task failed for good: it has taken its own staged files away, and what others swapped in is whole; the next run finds the rest stale still."""


class DocumentSink(DataSource):
    """Rows of dir, action (write or delete) and xml; options: name, of the document in each directory, and tally."""

    @classmethod
    def name(cls) -> str:
        return "directory_documents"

    def schema(self) -> str:
        return "dir string, action string, xml string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options))


def on_disk(spark: SparkSession, roots: list[str], name: str = NAME, **options: str) -> DataFrame:
    """(dir, xml): the documents below ``roots``; one that can't be read counts as empty."""
    found = walk.listed(spark, roots, fname=name, **options)
    text = walk.read_contents(found).select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("xml"))
    return text


def persist(files: DataFrame, roots: list[str], name: str = NAME, tally: str | None = None, **options: str) -> None:
    """Brings the documents below ``roots`` in line with ``files``: only those that differ are written, those of directories without files are deleted.

    Directories that the walk skips (see the tree source) keep their documents
    as long as ``files`` says nothing of them.
    """
    spark = files.sparkSession
    spark.dataSource.register(DocumentSink)
    todo = documents.stale_documents(on_disk(spark, roots, name, **options), documents.write_directories(files.drop("alias")))
    writer = todo.select("dir", "action", "xml").write.format("directory_documents").option("name", name)
    (writer.option("tally", tally) if tally else writer).mode("append").save()
