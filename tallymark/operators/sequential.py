"""Logic in which each row depends on the outcome of the one before."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, paths
from . import scan
from .durable import checkpointed

#: Ranks whose sizes are added up at a time.
RANGE = 1 << 16


def _has(directory: str, name: str) -> bool:
    return directory.rstrip("/").endswith(f"/{name}") or f"/{name}/" in directory


def score(dir0: str, name0: str, dir1: str, name1: str) -> int:
    """As :func:`tallymark.functions.names.pair_score`, for plain text."""
    n = lambda s: len(s.encode())
    return 2 * (n(dir0) > n(dir1)) - 2 * _has(dir0, "to") - (n(name0) > n(name1)) + 2 * _has(dir0, "favs")


def _together(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one partition, by a shuffle of their own.

    Dealt by the keys themselves after a join by the same, Spark leaves this
    shuffle out; and a join that it makes a broadcast one while it runs then
    reads rows where they lie, so that groups fall apart.
    """
    return rows.repartition(F.xxhash64(*keys))


def keep_best(files: DataFrame) -> DataFrame:
    """One row for each duplicated (checksum, size): the file that stays.

    The scores compare pairs, so the order matters: it is that of the paths.
    Rows stream past in that order and one file is held for each group, so
    groups of any size take the same memory.
    """
    schema = "checksum string, size long, path string, n_files long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, best, n, out = None, None, 0, []
        for batch in batches:
            for c, s, d, f, p in batch[["checksum", "size", "dir", "fname", "path"]].itertuples(index=False):
                if (c, s) != key:
                    if n > 1:
                        out.append((*key, best[2], n))
                    key, best, n = (c, s), (d, f, p), 1
                    continue
                n += 1
                if score(d, f, *best[:2]) > score(*best[:2], d, f):
                    best = (d, f, p)
            yield pd.DataFrame(out, columns=["checksum", "size", "path", "n_files"])
            out = []
        if n > 1:
            yield pd.DataFrame([(*key, best[2], n)], columns=["checksum", "size", "path", "n_files"])

    many = files.groupBy("checksum", "size").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    rows = files.join(many, ["checksum", "size"], "left_semi").select("checksum", "size", "dir", "fname", "path")
    return _together(rows, "checksum", "size").sortWithinPartitions("checksum", "size", "path").mapInPandas(run, schema)


def rename_plan(files: DataFrame, rules: Sequence[str]) -> DataFrame:
    """dir, fname and new_name of every file that would be renamed.

    Names that can be in each other's way are equal but for bracketed numbers at
    the end of their stems: such a group is (dir, stem without numbers,
    extension).  A wanted name that nobody else wants, and that no file has, is
    taken as it is.  The groups that are left stream by, sorted, file by file in
    the order of names; only the names of the group at hand are held.  A file
    whose own name is wanted by another keeps it until it is renamed itself.
    """
    name = F.col("fname")
    stem = names.squeeze(names.strip_extensions(names.rename_by_rules(names.strip_number(names.strip_extensions(name)), rules)))
    key = lambda c: F.regexp_replace(c, "([(][0-9]+[)])+$", "")
    known = files.select("dir", "fname", names.last_extension(name).alias("ext"), stem.alias("stem")).filter("ext <> ''")
    known = known.withColumn("wants", F.concat("stem", "ext") != name)
    wanted = known.filter("wants").withColumn("key", key(F.col("stem")))
    taken = known.select("dir", key(F.regexp_replace("fname", "[.][^.]*$", "")).alias("key"), "ext", "fname")
    rivals = wanted.groupBy("dir", "key", "ext").agg(F.count(F.lit(1)).alias("n"))
    there = taken.join(wanted.select("dir", F.concat("stem", "ext").alias("fname")).distinct(), ["dir", "fname"], "left_semi").select("dir", "key", "ext", F.lit(True).alias("hit")).distinct()
    groups = rivals.join(there, ["dir", "key", "ext"], "left").select("dir", "key", "ext", (F.col("n") > 1).alias("several"), F.coalesce("hit", F.lit(False)).alias("hit"))
    alone = groups.filter("NOT several AND NOT hit")
    contested = groups.filter("several OR hit").select("dir", "key", "ext")
    plain = wanted.join(alone, ["dir", "key", "ext"], "left_semi").select("dir", "fname", F.concat("stem", "ext").alias("new_name"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, there = None, set()
        for batch in batches:
            out = []
            for d, k, ext, kind, own, stem in batch[["dir", "key", "ext", "kind", "fname", "stem"]].itertuples(index=False):
                if (d, k, ext) != at:
                    at, there = (d, k, ext), set()
                if not kind:
                    there.add(own)
                    continue
                new, n = stem + ext, 0
                while new in there and new != own:
                    new, n = f"{stem}({n}){ext}", n + 1
                if new != own:
                    there.discard(own)
                    there.add(new)
                    out.append((d, own, new))
            yield pd.DataFrame(out, columns=["dir", "fname", "new_name"])

    rows = taken.withColumn("kind", F.lit(0)).withColumn("stem", F.lit("")).unionByName(wanted.select("dir", "key", "ext", "fname", F.lit(1).alias("kind"), "stem"))
    rows = rows.join(contested, ["dir", "key", "ext"], "left_semi")
    rows = _together(rows, "dir", "key", "ext").sortWithinPartitions("dir", "key", "ext", "kind", "fname")
    return plain.union(rows.mapInPandas(run, "dir string, fname string, new_name string"))


def _tried(sized: DataFrame, last: int | None) -> DataFrame:
    """(rank, size) with _used (sum up to and with each row), _nth (its number) and _rise: larger than the row before, the first one than ``last``.

    By sums and last sizes of ranges of ranks: no window holds more than a range.
    """
    w = sized.withColumn("_r", F.floor(F.col("rank") / RANGE))
    ranges = w.groupBy("_r").agg(F.sum("size").alias("_s"), F.count(F.lit(1)).alias("_n"), F.max_by("size", "rank").alias("_e"))
    order = Window.orderBy("_r")  # a row for each range
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    ranges = ranges.select("_r", zero(F.sum("_s").over(earlier)).alias("_before"), zero(F.sum("_n").over(earlier)).alias("_count"), F.lag("_e").over(order).alias("_end"))
    inside = Window.partitionBy("_r").orderBy("rank")
    j = w.join(ranges, "_r").withColumn("_p", F.coalesce(F.lag("size").over(inside), "_end", F.lit(last).cast("long")))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return j.select("rank", "size", (F.col("_before") + F.sum("size").over(upto)).alias("_used"), (F.col("_count") + F.row_number().over(inside)).alias("_nth"), (F.col("size") > F.col("_p")).alias("_rise"))


def fill_volume(plan: DataFrame, capacity: int) -> DataFrame:
    """What copying in the order of ``rank`` does with a volume of ``capacity`` bytes: rank and action copy, no_space or skip.

    Up to the first file that doesn't fit, everything is copied.  From there on
    files over half its size are skipped (over half of each further one), and a
    file larger than the last one tried ends the run.  So the run falls into
    stretches that end with a file that doesn't fit, and where each ends follows
    from sums and from comparisons with the row before.  Each halves the size
    that is tried, so there are no more of them than sizes have bits.  Below 1 KiB
    nothing is halved, but sizes never rise, so of each size as many are copied,
    the first ones, as fit when its turn comes.
    """
    sized = checkpointed(plan.select(F.col("rank").cast("long").alias("rank"), F.coalesce("size", F.lit(0)).cast("long").alias("size")))
    rank, size = F.col("rank"), F.col("size")
    left, target, last, after = capacity, 0, None, None  # last is null until a file didn't fit: sizes may rise before
    stretches: list[tuple[int, int, str]] = []  # (last rank, size that is tried, what becomes of that rank)
    small = None
    while True:
        rest = sized if after is None else sized.filter(rank > after)
        rows = _tried(rest.filter(size <= target) if target else rest, last)
        if last is not None and not target:
            small = (after, last)
            break
        rise = F.min(F.when(F.col("_rise"), rank)) if last is not None else F.lit(None).cast("long")
        full = F.min(F.when(F.col("_used") > left, F.struct("rank", "size", "_used")))
        found = rows.agg(rise.alias("rise"), full.alias("full")).first()
        if found["full"] is None and found["rise"] is None:
            break
        if found["full"] is None or found["rise"] is not None and found["rise"] <= found["full"]["rank"]:
            stretches.append((found["rise"] - 1, target, ""))
            after = None
            break
        after, last, used = found["full"]
        stretches.append((after, target, "no_space"))
        left, target = left - (used - last), last // 2 if last > 1024 else 0
    ended = stretches and not stretches[-1][2]
    action = F.when(F.lit(bool(ended)), "skip").when(F.lit(target) > 0, F.when(size <= target, "copy").otherwise("skip")).otherwise("copy")
    for end, tried, what in reversed(stretches):  # as many as sizes have bits, and one
        here = F.when(rank == end, what) if what else F.when(F.lit(False), "")
        here = here.when(size > tried, "skip") if tried else here
        action = F.when(rank <= end, here.otherwise("copy")).otherwise(action)
    if small is None:
        return sized.select("rank", action.alias("action"))
    # Sizes of at most 1 KiB, up to the first that rises: how many of each size there are says how many fit.
    rows = checkpointed(rows)
    rise = rows.filter("_rise").agg(F.min("rank")).first()[0]
    falling = rows if rise is None else rows.filter(rank < rise)
    before, fits = 0, []
    for r in sorted(falling.groupBy("size").count().collect(), reverse=True):  # 1025 sizes at most
        n = r["count"] if not r["size"] else min(r["count"], left // r["size"])
        left -= n * r["size"]
        fits.append((r["size"], before + n))
        before += r["count"]
    known = sized.sparkSession.createDataFrame(fits, "size long, fit long")
    tail = falling.join(F.broadcast(known), "size").select("rank", F.when(F.col("_nth") <= F.col("fit"), "copy").otherwise("no_space").alias("action"))
    head = sized.filter(rank <= small[0]).select("rank", action.alias("action"))
    none = sized.filter(rank >= rise).select("rank", F.lit("skip").alias("action")) if rise is not None else None
    return head.unionByName(tail) if none is None else head.unionByName(tail).unionByName(none)


def closed_paths(visits: DataFrame, by: str | None = "session") -> DataFrame:
    """For each visit by ``seq``: the path before it, if the visit leaves its scope.  Without ``by`` all visits are one session, of any length."""
    if by:
        v = visits.withColumn("_b", F.lag("path").over(Window.partitionBy(by).orderBy("seq")))
    else:
        v = scan.before(visits, [F.col("seq").asc()], F.col("path"), "_b")
    left = F.col("_b").isNotNull() & (F.col("_b") != "") & (F.col("path") != F.col("_b")) & ~paths.is_under(F.col("path"), F.col("_b"))
    return v.withColumn("closed", F.when(left, F.col("_b"))).drop("_b")


def is_name_taken(name: str) -> re.Match | None:
    """A name that ends in a bracketed number before its extension."""
    return re.search(r"\((\d+)\)(\.[^.]*)?$", name)
