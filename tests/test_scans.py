"""Scans over one series, volumes that fill up, and visitors."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymark.operators import scan, sequential, tuning, visit


def series(spark, n, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(k, rng.randint(1, 4), None if rng.random() < 0.1 else float(rng.randint(1, 50))) for k in range(n)], "seq long, tokens int, throughput double").repartition(7)


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_scans_are_the_windows(spark, n):
    rows, order = series(spark, n), Window.orderBy("seq")
    got = scan.before(rows, [F.col("seq").asc()], F.col("throughput"), "p")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.withColumn("p", F.lag("throughput").over(order)).collect()))
    got = scan.largest_so_far(rows, [F.col("seq").asc()], F.struct("throughput", "tokens"), "m")
    want = rows.withColumn("m", F.max(F.struct("throughput", "tokens")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    one = rows.withColumn("t", F.lit(1))
    for f in (tuning.changes, tuning.best_so_far):
        assert sorted(map(str, f(rows).collect())) == sorted(map(str, f(one, ["t"]).drop("t").collect()))


def test_windows_hold_a_range_or_a_row_for_each(spark):
    plan = scan.before(series(spark, 500), [F.col("seq").asc()], F.col("throughput"), "p")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [lag") == 2 and "hashpartitioning(_part" in plan


def test_paths_of_one_session(spark):
    rng = random.Random(2)
    rows = [(k, "one", rng.choice(["/a", "/a/b", "/a/b/c", "/ab", "", "/x"])) for k in range(300)]
    visits = spark.createDataFrame(rows, "seq long, session string, path string").repartition(5)
    assert sorted(map(str, sequential.closed_paths(visits, None).collect())) == sorted(map(str, sequential.closed_paths(visits).collect()))


def filled(sizes, capacity):
    """The rules, one file after the other."""
    left, target, last, filling, over, out = capacity, 0, 0, False, False, []
    for size in sizes:
        if over or target and size > target:
            out.append("skip")
        elif filling and size > last:
            over = True
            out.append("skip")
        else:
            last = size
            if size <= left:
                left -= size
                out.append("copy")
            else:
                filling, target = True, size // 2 if size > 1024 else 0
                out.append("no_space")
    return out


@pytest.mark.parametrize("seed", range(12))
def test_filling_is_one_file_after_the_other(spark, monkeypatch, seed):
    monkeypatch.setattr(sequential, "RANGE", 7)
    rng = random.Random(seed)
    top = rng.choice([5, 300, 2000, 100_000])
    sizes = [rng.choice([0, rng.randint(0, top), int(top * rng.random() ** 6)]) for _ in range(rng.randint(0, 120))]
    if seed % 3:
        sizes.sort(reverse=True)
    if seed % 3 == 2:
        sizes = sizes[: len(sizes) // 2] + sizes[: len(sizes) // 2]
    capacity = int(sum(sizes) * rng.choice([0, 0.1, 0.5, 0.9, 0.99, 1]))
    plan = spark.createDataFrame([(k, s) for k, s in enumerate(sizes, 1)], "rank long, size long").repartition(3)
    got = {r["rank"]: r["action"] for r in sequential.fill_volume(plan, capacity).collect()}
    assert [got[k] for k in range(1, len(sizes) + 1)] == filled(sizes, capacity)


FILE = "dir string, fname string, size long, tags array<string>"


def test_visitors(spark):
    rows = [("/a", "x", 1, []), ("/a", "y", 2, ["t"]), ("/b", "z", 3, []), ("/c", "w", 4, []), (None, "n", 5, None), ("/d", "v", 6, [])]

    def visitor(row):
        return {1: {"tags": ["new"]}, 2: visit.IGNORE, 3: visit.DELETE, 4: {"size": 4}, 5: None, 6: {"size": 7, "tags": []}}[row["size"]]

    got = visit.mutate(spark.createDataFrame(rows, FILE), visitor)
    assert sorted((str(r.dir), r.fname, r.size, r.tags, r.action) for r in got.collect()) == [
        ("/a", "x", 1, ["new"], "changed"), ("/a", "y", 2, ["t"], "keep"), ("/b", "z", 3, [], "delete"), ("/c", "w", 4, [], "keep"), ("/d", "v", 7, [], "changed"), ("None", "n", 5, None, "keep"),
    ]
    assert sorted(tuple(r) for r in visit.stale(got).collect()) == [("/a", False), ("/b", True), ("/d", False)]
    assert visit.mutate(spark.createDataFrame([], FILE), visitor).count() == 0


def test_visitors_see_names_in_order(spark):
    rows = [("/a", f"f{k:03}", k, []) for k in range(200)]

    class Number:
        def __init__(self):
            self.n = 0

        def __call__(self, row):
            self.n += 1
            return {"size": self.n}

    got = visit.mutate(spark.createDataFrame(rows, FILE).repartition(5), Number()).collect()
    assert [r.size for r in sorted(got, key=lambda r: r.fname)] == list(range(1, 201))


@pytest.mark.parametrize("told", [{"nothing": 1}, 7])
def test_visitors_that_err(spark, told):
    with pytest.raises(Exception, match="no such fields|a visitor returns"):
        visit.mutate(spark.createDataFrame([("/a", "x", 1, [])], FILE), lambda row: told).collect()
