"""Carries out plan tables, one row at a time; by default it only says what it would do.

Tasks may run twice, so every step can: a copy goes to a temporary name, is
verified and renamed; what is already there with the right content is done.
Nothing is ever overwritten with other content.
"""

from __future__ import annotations

import base64
import errno
import hashlib
import os
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


#: Told how many bytes have passed since the last time.
Told = Callable[[int], None]
#: Copies source to target: done, or why not.
Copier = Callable[[str, str], str]


def checksum(path: str, size: int = 1 << 20, told: Told | None = None) -> str:
    """MD5 as unpadded base64; ``told`` hears of every part that has been read."""
    digest = hashlib.md5()
    with open(path, "rb") as f:
        while part := f.read(size):
            digest.update(part)
            if told:
                told(len(part))
    return base64.b64encode(digest.digest()).decode().rstrip("=")


def copy_bytes(source: str, target: str, size: int = 1 << 20, told: Told | None = None) -> None:
    """Content and times, part by part."""
    with open(source, "rb") as f, open(target, "wb") as g:
        while part := f.read(size):
            g.write(part)
            if told:
                told(len(part))
    shutil.copystat(source, target)


def copy_file(source: str, target: str, link: bool = True, told: Told | None = None) -> str:
    """done, or why not: no_space where the volume is full.  A hard link where that works, else a verified copy."""
    if os.path.exists(target):
        return "done" if os.path.samefile(source, target) or checksum(source) == checksum(target) else "exists"
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    if link:
        try:
            os.link(source, target)
            return "done"
        except OSError:
            pass
    part = f"{target}.{os.getpid()}.part"
    try:
        copy_bytes(source, part, told=told)
        if checksum(part) != checksum(source):
            return "corrupt"
        os.rename(part, target)
        return "done"
    except OSError as e:
        return "no_space" if e.errno == errno.ENOSPC else f"failed: {e.strerror}"
    finally:
        if os.path.exists(part):
            os.unlink(part)


def carry_out(action: str, source: str, target: str | None, copier: Copier = copy_file) -> str:
    if action == "copy":
        return copier(source, target) if os.path.exists(source) else "missing"
    if action == "move":
        if not os.path.exists(source):
            return "done" if os.path.exists(target) else "missing"
        if os.path.exists(target):
            return "exists"
        os.rename(source, target)
        return "done"
    if action == "delete":
        if os.path.exists(source):
            os.unlink(source)
        return "done"
    return "unknown"


def execute(plan: DataFrame, dry_run: bool = True, partitions: int = 2, copier: Copier = copy_file) -> DataFrame:
    """The plan with a column result; as many rows at a time as there are partitions.  ``copier`` copies in place of :func:`copy_file`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(result=[carry_out(a, s, t, copier) for a, s, t in batch[["action", "source", "target"]].itertuples(index=False)])

    if dry_run:
        from pyspark.sql import functions as F

        return plan.withColumn("result", F.lit("planned"))
    from pyspark.sql.types import StringType, StructField, StructType

    return plan.repartition(partitions).mapInPandas(run, StructType([*plan.schema.fields, StructField("result", StringType())]))
