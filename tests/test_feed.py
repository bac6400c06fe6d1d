"""The change feed over real trees and over states of a catalog, and pruning in the tree source."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallymark.operators import filters
from tallymark.sources import walk
from tallymark.streaming import events, feed


def put(root, name, text, mtime=1000):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (mtime, mtime))


def test_every_change_comes_once(spark, tmp_path):
    tree, place = tmp_path / "tree", f"file://{tmp_path}/feed"
    for k in range(30):
        put(tree, f"d{k % 3}/f{k}", "x" * k)

    def run():
        got = events.drain(feed.changes(feed.scans(spark, [str(tree)], buckets=8), 8), "append", place)
        rows = [(r.change, os.path.relpath(f"{r.dir}/{r.fname}", tree), r.size, r.mtime) for r in got.collect()]
        assert len({r.scan for r in got.collect()}) <= 1
        return sorted(rows)

    assert run() == sorted(("created", f"d{k % 3}/f{k}", k, 1000) for k in range(30))
    assert run() == []
    put(tree, "d0/f0", "longer")
    put(tree, "d1/f1", "x", 2000)
    put(tree, "new/deep/f", "n")
    (tree / "d2/f2").unlink()
    assert run() == [("changed", "d0/f0", 6, 1000), ("changed", "d1/f1", 1, 2000), ("created", "new/deep/f", 1, 1000), ("deleted", "d2/f2", 2, 1000)]
    for k in range(30):  # buckets that are left without any file tell so too
        (tree / f"d{k % 3}/f{k}").unlink(missing_ok=True)
    assert [c for c, *_ in run()] == ["deleted"] * 29
    assert run() == []
    tree.rename(tmp_path / "elsewhere")  # a tree that is not there is an error, not a tree of which all was deleted
    with pytest.raises(Exception, match="tree"):
        run()


def test_several_scans_in_one_batch(spark, tmp_path):
    schema = "dir string, fname string, size long, mtime long"
    states = [[("/a", "x", 1, 1), ("/a", "y", 1, 1)], [("/a", "x", 2, 1), ("/b", "z", None, None), ("/b", "z", 3, None)], [], [("/a", "x", 2, 1)]]
    for n, rows in enumerate(states, 1):
        feed.as_scan(spark.createDataFrame(rows, schema), n, 4).write.mode("append").parquet(f"{tmp_path}/scans")
    got = events.drain(feed.changes(spark.readStream.schema(feed.SCHEMA).parquet(f"{tmp_path}/scans"), 4), "append")
    assert sorted((r.scan, r.change, r.dir + r.fname, r.size) for r in got.collect()) == [
        (1, "created", "/ax", 1), (1, "created", "/ay", 1), (2, "changed", "/ax", 2), (2, "created", "/bz", 3), (2, "deleted", "/ay", 1), (3, "deleted", "/ax", 2), (3, "deleted", "/bz", 3), (4, "created", "/ax", 2),
    ]


# ---------------------------------------------------------------- pruning


@pytest.fixture
def tree(tmp_path):
    for name in ("a", "keep/b", "keep/deep/c", "keep/tmp/d", "cache/x/e", "cache/y/z/f", "cached/g", "end.tmp/h", "marked/i", "marked/.mdSkipDir", "keepsake/j"):
        put(tmp_path, name, name)
    return tmp_path


def read(tree, **options):
    """(files, directories that were opened) of the source on its own."""
    reader = walk.WalkReader({"paths": str(tree), "subtrees": "3", **{k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}})
    opened, scandir = [], os.scandir

    def counted(path):
        opened.append(os.path.relpath(path, tree))
        return scandir(path)

    os.scandir = counted
    try:
        files = sorted(os.path.relpath(f"{d}/{f}", tree) for p in reader.partitions() for _, d, f, _, _ in reader.read(p))
    finally:
        os.scandir = scandir
    return files, set(opened)


def test_prefixes_prune_subtrees(tree):
    everything, opened = read(tree)
    assert len(everything) == 9 and len(opened) == 11
    files, opened = read(tree, outside=[f"{tree}/cache"])
    assert files == [f for f in everything if not f.startswith("cache")] and not [d for d in opened if d.startswith("cache")]
    files, opened = read(tree, under=[f"{tree}/keep/"])
    assert files == ["keep/deep/c", "keep/tmp/d"] and opened == {".", "keep", "keep/deep", "keep/tmp"}
    files, opened = read(tree, under=[f"{tree}/cache/y/z", f"{tree}/keepsake"])
    assert files == ["cache/y/z/f", "keepsake/j"] and opened == {".", "cache", "cache/y", "cache/y/z", "keepsake"}
    files, opened = read(tree, under=[f"{tree}/keep"], outside=[f"{tree}/keep/t", f"{tree}/keeps"], fname="c")
    assert files == ["keep/deep/c"] and opened == {".", "keep", "keep/deep"}


def test_patterns_prune_subtrees(tree):
    files, opened = read(tree, ignore=["/cache/", "(broken", "[.]tmp$"])
    assert files == ["a", "cached/g", "end.tmp/h", "keep/b", "keep/deep/c", "keep/tmp/d", "keepsake/j"] and "cache" not in opened and "end.tmp" in opened
    assert [p.pattern for p in walk.prefix_patterns(["a$", "b(?=c)", "d\\b", "[", "plain", "x\\Z", "a.*b"])] == ["plain", "a.*b"]


def test_pruned_listing_is_the_filtered_one(spark, tree):
    everything = walk.listed(spark, [str(tree)])
    path = F.concat_ws("/", "dir", "fname")
    for ignore in (["/cache/"], ["/cache/", "d$"], ["tmp"], ["(broken", "^nothing"]):
        want = filters.drop_ignored(everything.withColumn("path", path), ignore).select("path").collect()
        assert sorted(walk.listed(spark, [str(tree)], ignore).select(path.alias("path")).collect()) == sorted(want)
    for under, outside in (([f"{tree}/keep"], []), ([], [f"{tree}/cache/"]), ([f"{tree}/keep", str(tree)], [f"{tree}/keep/deep"])):
        wanted = F.lit(not under)
        for p in under:
            wanted = wanted | F.col("dir").startswith(p)
        for p in outside:
            wanted = wanted & ~F.col("dir").startswith(p)
        got = sorted(walk.listed(spark, [str(tree)], under=under, outside=outside).collect())
        assert got == sorted(everything.filter(wanted).collect()) and got
