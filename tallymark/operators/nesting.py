"""Flat files as nested trees, and back.

A tree is folded from its deepest level up: each level is one aggregation of
directories' parts, which are their own files and the directories right below
them, already folded.  What a directory has together may be more than a document
should hold; then its parts are dealt to several documents by their hash, and its
parent gets no more than its name and totals.  So no row grows with the tree, and
the number of steps is that of its levels.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .durable import shared_dir

ENTRY = "fname string, checksum string, size bigint, mtime bigint, tags array<string>, backup_dest array<string>"
#: About how many characters a document has at most.
LIMIT = 1 << 20


def depth(dir_: Column) -> Column:
    """1 for /a, 2 for /a/b."""
    return F.size(F.filter(F.split(dir_, "/"), lambda p: p != ""))


def _stored(df: DataFrame, place: str) -> DataFrame:
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def nest(files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(dir, piece, height, document): the trees of files as JSON documents of about ``limit`` characters at most.

    A node is {name, n, b, files, dirs}: its files and bytes, those below
    counted, its own files, and the directories right below it.  One that has
    ``pieces`` instead of files and dirs stands in so many documents of its own;
    these say under ``dir`` where they belong.  ``height``: levels in a document.
    Files are those of an absolute ``dir``; columns of an entry that are null, or
    that ``files`` lacks, are left out.
    """
    place = f"{shared_dir(files.sparkSession)}/tree-{uuid.uuid4().hex}"
    have = [c.split()[0] for c in ENTRY.split(", ") if c.split()[0] in files.columns]
    size = F.coalesce("size", F.lit(0)).cast("long")
    entries = files.select("dir", F.lit(0).alias("kind"), F.col("fname").alias("key"), F.to_json(F.struct(*have)).alias("text"), F.lit(1).cast("long").alias("n"), size.alias("b"), F.lit(0).alias("height"))
    entries = _stored(entries.withColumn("depth", depth(F.col("dir"))), f"{place}/files")
    top, out, folded = entries.agg(F.max("depth")).first()[0] or 0, None, None
    for level in range(top, 0, -1):
        parts = entries.filter(F.col("depth") == level).drop("depth")
        if folded is not None:
            parts = parts.unionByName(folded)
        sums = parts.groupBy("dir").agg(F.sum(F.length("text") + 1).alias("chars"), F.sum("n").alias("dn"), F.sum("b").alias("db"))
        sums = sums.withColumn("pieces", F.ceil(F.col("chars") / limit).cast("int")).drop("chars")
        dealt = parts.join(sums, "dir").withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("kind", "key"), F.col("pieces"))).otherwise(0).cast("int"))
        listed = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "text")))), lambda x: x["text"]), ",")
        nodes = dealt.groupBy("dir", "piece", "pieces", "dn", "db").agg(listed(0).alias("f"), listed(1).alias("d"), (F.max("height") + 1).alias("height"))
        head = F.to_json(F.struct(paths.base(F.col("dir")).alias("name"), F.col("dn").alias("n"), F.col("db").alias("b")))
        open_ = F.substring(head, F.lit(1), F.length(head) - 1)
        text = F.concat(open_, F.lit(',"files":['), "f", F.lit('],"dirs":['), "d", F.lit("]}"))
        nodes = _stored(nodes.select("dir", "piece", "pieces", "dn", "db", "height", text.alias("text"), F.concat(open_, F.lit(',"pieces":'), F.col("pieces").cast("string"), F.lit("}")).alias("stub")), f"{place}/level={level}")
        ends = F.lit(level == 1) | (F.col("pieces") > 1)
        documents = nodes.filter(ends).select("dir", "piece", "height", F.col("text").alias("document"))
        out = documents if out is None else out.unionByName(documents)
        up = lambda rows, text, height: rows.select(paths.parent(F.col("dir")).alias("dir"), F.lit(1).alias("kind"), paths.base(F.col("dir")).alias("key"), F.col(text).alias("text"), F.col("dn").alias("n"), F.col("db").alias("b"), height.alias("height"))
        whole, split = nodes.filter("pieces = 1"), nodes.filter("pieces > 1").select("dir", "stub", "dn", "db").distinct()
        folded = up(whole, "text", F.col("height")).unionByName(up(split, "stub", F.lit(1)))
    return files.sparkSession.createDataFrame([], "dir string, piece int, height int, document string") if out is None else out


def flatten(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files: dir and the columns of an entry; directories: dir, n_files, bytes, n_dirs) of nested documents.

    n_files and bytes count what is below too, n_dirs what is right below.  One
    step down for each level of the highest document.
    """
    steps = documents.agg(F.max("height")).first()[0] or 0
    at = documents.select("dir", "piece", F.parse_json("document").alias("v"))
    files, nodes = [], []
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    for _ in range(steps):
        files.append(at.select("dir", F.explode(get("$.files", f"array<struct<{', '.join(ENTRY.split(', ')).replace(' ', ': ').replace(',:', ',')}>>")).alias("f")).select("dir", "f.*"))
        nodes.append(at.select("dir", "piece", get("$.n", "long").alias("n_files"), get("$.b", "long").alias("bytes"), F.coalesce(F.size(get("$.dirs", "array<variant>")), F.lit(0)).alias("d"), get("$.pieces", "int").alias("pieces")))
        below = at.select("dir", F.explode(get("$.dirs", "array<variant>")).alias("v"))
        at = below.select(F.concat("dir", F.lit("/"), get("$.name", "string")).alias("dir"), F.lit(0).alias("piece"), "v")
    if not steps:
        empty = documents.sparkSession.createDataFrame
        return empty([], f"dir string, {ENTRY}"), empty([], "dir string, n_files long, bytes long, n_dirs long")
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    # A directory of several documents is met as each of them and as a stub: all know its totals.
    totals = union(nodes).groupBy("dir").agg(F.max("n_files").alias("n_files"), F.max("bytes").alias("bytes"), F.sum("d").alias("n_dirs"))
    return union(files), totals
