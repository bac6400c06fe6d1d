"""Trees as documents and back."""

import json

import pytest
from pyspark.sql import functions as F

from tallymark.operators import nesting

FILE = "dir string, fname string, checksum string, size long, mtime long, tags array<string>, backup_dest array<string>"


def deep(spark):
    rows = []
    for k in range(120):
        dir_ = "/r" + "".join(f"/{c}" for c in f"{k % 4:02b}{k % 7}{k % 3}{k % 2}x\"é{k % 5}")
        rows.append((dir_, f'f {k} "&', f"c{k}", k, None if k % 3 else k, ["t"] if k % 2 else [], ["V", "W"][: k % 3]))
    rows += [("/r", "top", None, 5, 1, [], []), ("/other", "y", "c", 1, 1, [], [])] + [("/r/wide", f"w{k}", "c", 1, 1, [], []) for k in range(200)]
    return spark.createDataFrame(rows, FILE)


def directories(rows):
    out = {}
    for dir_, size in rows:
        parts = dir_.split("/")[1:]
        for n in range(1, len(parts) + 1):
            at = "/" + "/".join(parts[:n])
            out.setdefault(at, [0, 0])
            out[at][0] += 1
            out[at][1] += size
    below = lambda d: sum(x.rpartition("/")[0] == d for x in out)
    return sorted((d, n, b, below(d)) for d, (n, b) in out.items())


@pytest.mark.parametrize("limit", [1 << 20, 3000, 400, 60])
def test_trees_come_back(spark, limit):
    files = deep(spark)
    documents = nesting.nest(files, limit).cache()
    back, dirs = nesting.flatten(documents)
    assert sorted(map(str, back.select(*files.columns).collect())) == sorted(map(str, files.collect()))
    assert sorted(tuple(r) for r in dirs.select("dir", "n_files", "bytes", "n_dirs").collect()) == directories([(r.dir, r.size) for r in files.collect()])
    longest = max(len(r.document) for r in documents.collect())
    if limit == 1 << 20:
        assert documents.count() == 2  # a tree in one piece
        tree = json.loads(documents.filter("dir = '/r'").first().document)
        assert tree["name"] == "r" and tree["n"] == 321 and [f["fname"] for f in tree["files"]] == ["top"] and [d["name"] for d in tree["dirs"]] == ["0", "1", "wide"]
    else:
        assert documents.count() > 2 and longest < 3 * limit + 600


def test_no_tree(spark):
    files, dirs = nesting.flatten(nesting.nest(deep(spark).limit(0)))
    assert files.count() == dirs.count() == 0


def test_depth(spark):
    rows = spark.createDataFrame([("/a",), ("/a/b/",), ("/",)], "d string").select(nesting.depth(F.col("d")).alias("n")).collect()
    assert [r.n for r in rows] == [1, 2, 0]
