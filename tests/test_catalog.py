"""Operators against tables of expectations."""

import pytest
from pyspark.sql import functions as F

from tallymark.functions import checksums, names, paths, units
from tallymark.operators import content, coverage, discovery, filters, restore, roots, sequential, state, tuning
from tallymark.plans import execute, tables

FILE = "path string, dir string, fname string, checksum string, size long, backup_dest array<string>"


def files(spark, rows):
    """(path, checksum, size, volumes)"""
    return spark.createDataFrame([(p, p.rpartition("/")[0] or "/", p.rpartition("/")[2], c, s, list(v)) for p, c, s, v in rows], FILE)


def ordered(df, column="path"):
    return [r[column] for r in df.collect()]


def vols(n):
    return [f"V{i}" for i in range(n)]


@pytest.mark.parametrize(
    "rows, expected",
    [
        (
            [("z_two_small", 500, 2), ("z_one_tiny", 100, 1), ("a_three_large", 5000, 3), ("a_one_large", 5000, 1), ("a_one_tiny", 100, 1), ("m_two_large", 5000, 2)],
            ["a_one_large", "a_one_tiny", "z_one_tiny", "m_two_large", "z_two_small", "a_three_large"],
        ),
        ([("zebra", 1000, 1), ("apple", 1000, 1), ("monkey", 1000, 1)], ["apple", "monkey", "zebra"]),
        ([("x", 100, 1), ("y", 5000, 0), ("z", 1000, 2)], ["y", "x", "z"]),
        ([("C:\\a", 1, 0), ("\\\\host\\a", 1, 0), ("/a", 1, 0)], ["/a", "C:\\a", "\\\\host\\a"]),
    ],
)
def test_priority_order(spark, rows, expected):
    df = spark.createDataFrame([(p, s, vols(n)) for p, s, n in rows], "path string, size long, backup_dest array<string>")
    assert ordered(content.prioritise(df)) == expected
    ranked = {r.path: r.rank for r in content.ranked(df.repartition(3)).collect()}
    assert ranked == {p: i for i, p in enumerate(expected, 1)}


def test_label_is_left_out(spark):
    df = spark.createDataFrame([("a", 1, ["labby"]), ("b", 2, []), ("c", 9, ["x"]), ("d", 9, ["labby", "x"])], "path string, size long, backup_dest array<string>")
    assert ordered(content.prioritise(df, label="labby")) == ["b", "c"]


def test_source_merge_keeps_the_path_with_fewer_volumes(spark):
    df = files(spark, [("/file1", "k", 7, ["dest1"]), ("/file2", "k", 7, ["dest2", "dest3"])])
    r = content.merge_sources(df).collect()
    assert [(x.path, x.backup_dest) for x in r] == [("/file1", ["dest1", "dest2", "dest3"])]
    df = files(spark, [("/1", "k", 7, ["a", "b"]), ("/2", "k", 7, ["c"]), ("/3", "k", 7, ["a", "b", "c"])])
    assert content.merge_sources(df).first().path == "/2"
    df = files(spark, [("/1", "k", 7, []), ("/2", "k", 7, [])])
    assert content.merge_sources(df).first().path == "/1"


def test_compare_is_a_partition_of_both_sides(spark):
    s = files(spark, [("/a", "1", 1, []), ("/b", "2", 1, []), ("/missing.txt", "4", 1, [])])
    d = files(spark, [("/x", "2", 1, []), ("/y", "3", 1, []), ("/y2", "3", 1, [])])
    got = {(r.checksum, r.status) for r in content.compare(content.merge_sources(s), content.merge_destination(d)).collect()}
    assert got == {("1", "to_copy"), ("2", "both"), ("3", "orphan"), ("4", "to_copy")}
    assert ordered(content.absent(content.merge_destination(d), s)) == ["/y"]
    assert sorted(ordered(content.absent(d, s))) == ["/y", "/y2"]
    # what has been copied is not planned again
    assert content.absent(s, d.unionByName(content.absent(s, d))).count() == 0


def test_coverage_keeps_empty_buckets(spark):
    df = files(spark, [("/a", "1", 10, []), ("/b", "2", 5, ["x"])])
    assert sorted(map(tuple, coverage.bytes_by_coverage(df).collect())) == [(0, 1, 10), (1, 1, 5), (2, 0, 0)]
    assert sorted(map(tuple, coverage.bytes_by_coverage(df.limit(0)).collect())) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]


def test_volume_filters(spark):
    df = files(spark, [("/1", "1", 1, ["A"]), ("/2", "2", 1, ["A"]), ("/3", "3", 1, ["B"]), ("/4", "4", 1, ["A", "B"])])
    assert filters.on_volume(df, "A").count() == 3 and filters.on_volume(df, "B").count() == 2
    assert filters.not_on_volume(df, "A").count() == 1 and filters.not_on_volume(df, "B").count() == 2
    assert filters.coverage_cap(df, 1).count() == 3 and filters.coverage_cap(df, 1, strict=True).count() == 0
    assert filters.coverage_cap(df, 0, strict=True).count() == 4


def test_path_filters(spark):
    df = files(spark, [("/a/.git/x", "1", 1, []), ("/a/b/y", "2", 1, []), ("/a/./z", "3", 1, []), ("/skip/deep/w", "4", 1, []), ("/skipped/v", "5", 1, [])])
    assert sorted(ordered(filters.drop_hidden(df))) == ["/a/./z", "/a/b/y", "/skip/deep/w", "/skipped/v"]
    markers = spark.createDataFrame([("/skip",)], "dir string")
    assert sorted(ordered(filters.drop_skipped(df, markers)))[-1] == "/skipped/v" and filters.drop_skipped(df, markers).count() == 4
    assert filters.drop_ignored(df, ["(bad", "/a/"]).count() == 2
    with pytest.raises(Exception):
        filters.drop_ignored(df, ["(bad"], strict=True)


def test_discover_is_idempotent(spark):
    s = files(spark, [("/0", "1234", 1, []), ("/1", "5678", 1, []), ("/2", "9abc", 1, [])])
    d = files(spark, [("/d", "5678", 1, []), ("/e", "5678", 1, [])])
    once = discovery.discover(s, d, "V")
    assert {r.path: (r.backup_dest, r.updated) for r in once.collect()} == {"/0": ([], False), "/1": (["V"], True), "/2": ([], False)}
    assert discovery.discover(once.drop("updated"), d, "V").filter("updated").count() == 0
    assert tuple(discovery.statistics(s, d, "V").first()) == (1, 1)


TARGET = "checksum string, size long, task_id string, alias string, target_path string, backup_dest array<string>, state string"


def test_restore_planning(spark):
    rows = [(f"c{i}", 1, f"t{i}", "a", f"/r/{i}", v, "pending") for i, v in enumerate([["VOL1"], ["VOL1"], ["VOL1"], ["VOL1", "VOL2"], ["VOL2"], ["VOL2"], ["VOL3"]])]
    t = spark.createDataFrame(rows, TARGET)
    per = lambda df: {r.volume: r.n_pending for r in restore.pending_by_volume(df).collect()}
    assert per(t) == {"VOL1": 4, "VOL2": 3, "VOL3": 1}
    done = lambda *ids: spark.createDataFrame([(i,) for i in ids], "task_id string")
    t = restore.move_to_copied(t, done("t0"))
    assert per(t)["VOL1"] == 3
    assert "VOL3" not in per(restore.move_to_copied(t, done("t6", "t6")))
    disk = files(spark, [("/m", "c1", 1, []), ("/u", "zz", 1, []), ("/other_size", "c2", 9, [])])
    assert tuple(restore.scan_statistics(disk, t).first()) == (1, 2, 1)
    assert [(r.source, r.target_path) for r in restore.copy_plan(disk, t).collect()] == [("/m", "/r/1")]


def test_shared_content_is_one_node(spark):
    t = spark.createDataFrame([("c", 1, "t1", "a", "/r/1", ["A"], "pending"), ("c", 1, "t2", "a", "/r/2", ["B"], "pending")], TARGET)
    assert [(r.n_targets, r.backup_dest) for r in restore.nodes(t).collect()] == [(2, ["A", "B"])]
    assert [(r.n_contents, r.n_targets) for r in restore.contents(t).collect()] == [(1, 2)]


def test_ingest_paths_and_clashes(spark):
    j = spark.createDataFrame([("a", "/x/summer", "photo.jpg", "m", 5, ["V"]), ("a", "/y/summer", "photo.jpg", "n", 5, []), ("b", "/z", "f", "o", 1, [])], "alias string, dir string, fname string, checksum string, size long, backup_dest array<string>")
    dests = spark.createDataFrame([("a", "/restore")], "alias string, path string")
    none = spark.createDataFrame([], "alias string, path string")
    got = restore.ingest(j, dests, none)
    assert {(r.task_id, r.state) for r in got.collect()} == {("m:5:/restore/summer/photo.jpg", "pending"), ("n:5:/restore/summer/photo.jpg", "pending"), (None, "failed")}
    assert restore.target_clashes(got).count() == 1
    assert restore.target_clashes(restore.ingest(j, dests, none, whole_path=True)).count() == 0


def test_first_listed_root_wins(spark):
    df = spark.createDataFrame([("/a/b/c",), ("/ab/c",), ("/z",)], "path string")
    rs = spark.createDataFrame([("/a/b", 2), ("/a/", 1), ("/x", 0)], "root string, seq int")
    assert {r.path: r.root for r in roots.source_root(df, rs).collect()} == {"/a/b/c": "/a/", "/ab/c": None, "/z": None}
    assert {r.path: r.root for r in roots.source_root(df, rs, nearest=True).collect()}["/a/b/c"] == "/a/b"


@pytest.mark.parametrize(
    "name, expected",
    [
        ("test_calc.flv", "test.flv"), ("test_calc.flv.flv", "test.flv"), ("test_calc.mp4.flv", "test.flv"), ("test_calc", None), ("test_bob_c.mpg", "testc.mpg"), ("test_calc_bob.jpg", "test.jpg"),
        ("Party.mp4.mp4", "Party.mp4"), ("This is a - weird filename.wmv.mp4", "This is a - weird filename.mp4"), ("fred.jpg.doc", None),
    ],
)
def test_rename(spark, name, expected):
    df = spark.createDataFrame([("/d", name)], "dir string, fname string")
    assert [r.new_name for r in sequential.rename_plan(df, ["(.*)_calc", "(.*)_bob_(.*)", "(broken"]).collect()] == ([expected] if expected else [])


def test_rename_clashes_are_numbered(spark):
    df = spark.createDataFrame([("/d", n) for n in ("a.jpg", "a.jpg.jpg", "a_calc.jpg", "a(0).jpg")], "dir string, fname string")
    got = {r.fname: r.new_name for r in sequential.rename_plan(df, ["(.*)_calc"]).collect()}
    assert got["a.jpg.jpg"] == "a(1).jpg" and len(set(got.values())) == len(got) and "a.jpg" not in got.values()
    assert names.apply_rules("aa", names.valid_rules(["(a+)"])) == "aa"


def test_keep_best_of_duplicates(spark):
    rows = [("/to/a.jpg", "k", 1, []), ("/favs/b.jpg", "k", 1, []), ("/x/c.jpg", "k", 1, []), ("/only", "z", 1, [])]
    assert ordered(sequential.keep_best(files(spark, rows).repartition(3))) == ["/favs/b.jpg"]


def test_overlay_and_prune(spark):
    old = spark.createDataFrame([("/d", n, "c", 1, t, ["V"]) for n, t in (("same", 1), ("older", 1), ("gone", 1))], "dir string, fname string, checksum string, size long, mtime long, backup_dest array<string>")
    stat = spark.createDataFrame([("/d", "same", 1, 1), ("/d", "older", 1, 2), ("/d", "fresh", 3, 3)], "dir string, fname string, size long, mtime long")
    got = {r.fname: (r.action, r.checksum, r.backup_dest) for r in state.overlay(old, stat).collect()}
    assert got == {"same": ("keep", "c", ["V"]), "older": ("changed", "", []), "gone": ("delete", "c", ["V"]), "fresh": ("new", "", [])}
    assert sorted(ordered(state.prune(old, stat), "fname")) == ["older", "same"]


def test_sweep_spares_other_aliases(spark):
    df = spark.createDataFrame([("a", "/1"), ("a", "/2"), ("b", "/3")], "alias string, path string")
    assert sorted(ordered(state.sweep(df, df.filter("path = '/1'")))) == ["/1", "/3"]


def test_each_deleted_file_is_moved_once(spark):
    gone = files(spark, [("/a/x", "1", 5, []), ("/b/x", "1", 5, [])])
    new = files(spark, [("/c/x", "1", 5, []), ("/d/x", "1", 6, [])])
    assert [(r.old_path, r.new_path) for r in state.moved(gone, new).collect()] == [("/a/x", "/c/x")]


def test_capacity(spark):
    plan = spark.createDataFrame([(1, 60), (2, 5000), (3, 4000), (4, 2000), (5, 30), (6, 40)], "rank long, size long")
    assert [r.action for r in sequential.fill_volume(plan, 100).orderBy("rank").collect()] == ["copy", "no_space", "skip", "no_space", "copy", "skip"]


def test_closed_paths(spark):
    visits = ["/bob", "/bob/fred", "/bob/fred/bob", "/bob/fred", "/bob/fred/steve", "/bob/fred/susan", "/bob/fred"]
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate(visits)], "session string, seq int, path string")
    closed = [r.closed is not None for r in sequential.closed_paths(df).orderBy("seq").collect()]
    assert [sum(closed[:i]) for i in range(1, 8)] == [0, 0, 0, 1, 1, 2, 3]


@pytest.mark.parametrize(
    "history, current, last, best, best_tokens, expected",
    [
        ([(2, 100.0)], 2, 1, 100.0, 2, ("increase", 3)), ([(2, 100.0), (3, 102.0)], 3, 2, 102.0, 3, ("increase", 4)), ([(4, 100.0), (5, 98.0)], 5, 4, 100.0, 4, ("freeze", 4)),
        ([(3, 100.0), (3, 100.0)], 3, 3, 100.0, 3, ("hold", 3)), ([(7, 100.0), (8, 120.0)], 8, 7, 120.0, 8, ("hold", 8)),
    ],
)
def test_tuner_steps(history, current, last, best, best_tokens, expected):
    assert tuning.step(history, current, last, best, best_tokens, 8, False) == expected
    assert tuning.step(history, current, last, best, best_tokens, 8, True) == ("hold", current)


def test_tuner_column_agrees_with_step(spark):
    df = spark.createDataFrame([(2.0, 3, 2, 3, 102.0, 3, 102.0), (-2.0, 5, 4, 5, 100.0, 4, 98.0), (0.005, 3, 3, 3, 100.0, 3, 100.0)], "change double, tokens int, last int, current int, best double, best_tokens int, throughput double")
    d = tuning.decision(F.col("change"), F.col("tokens"), F.col("last"), F.col("current"), F.col("best"), F.col("best_tokens"), F.col("throughput"), 8)
    assert [tuple(r.d) for r in df.select(d.alias("d")).collect()] == [("increase", 4), ("freeze", 4), ("hold", 3)]


def test_scalars(spark):
    df = spark.createDataFrame([(0,)], "x int")
    one = lambda c: df.select(c.alias("c")).first().c
    assert one(checksums.md5_base64(F.lit("hello"))) == "XUFAKrxLKna5cZ2REBfFkg"
    assert one(checksums.canonical(F.lit("XUFAKrxLKna5cZ2REBfFkg"))) == one(checksums.canonical(F.lit("5D41402ABC4B2A76B9719D911017C592"))) == "5d41402abc4b2a76b9719d911017c592"
    assert one(checksums.canonical(F.lit("nonsense"))) is None
    assert [one(units.human_bytes(F.lit(n))) for n in (0, 1023, 1024, 1536, 5 * 1024**3)] == ["0.00 B", "1023.00 B", "1.00 KiB", "1.50 KiB", "5.00 GiB"]
    assert one(units.kib_clamped(F.lit(2**50))) == 2147483647
    assert one(paths.relative(F.lit("/a/b/c"), F.lit("/a/"))) == "b/c" and one(paths.relative(F.lit("/ab/c"), F.lit("/a"))) is None
    assert one(paths.ancestors(F.lit("/a/b/c"))) == ["/a", "/a/b"]
    assert one(names.squeeze(F.lit("a..b  c. "))) == "a.b c."


def test_plans_carry_out_once_and_again(spark, tmp_path):
    (tmp_path / "a").write_text("one")
    (tmp_path / "b").write_text("two")
    plan = spark.createDataFrame([("copy", f"{tmp_path}/a", f"{tmp_path}/new/a", None, None, ""), ("copy", f"{tmp_path}/a", f"{tmp_path}/b", None, None, ""), ("delete", f"{tmp_path}/c", None, None, None, "")], "action string, source string, target string, checksum string, size long, reason string")
    assert {r.result for r in execute.execute(plan).collect()} == {"planned"} and not (tmp_path / "new").exists()
    for _ in range(2):
        assert [r.result for r in execute.execute(plan, dry_run=False).orderBy("target").collect()] == ["done", "exists", "done"]
    assert (tmp_path / "new/a").read_text() == "one" and (tmp_path / "b").read_text() == "two"


def test_deletions(spark):
    df = files(spark, [("/a", "k", 1, []), ("/b", "k", 1, []), ("/empty", "e", 0, [])])
    kept = content.duplicates(df).select("checksum", "size", F.col("first_path").alias("path"))
    assert {(r.source, r.reason) for r in tables.deletions(df, kept).collect()} == {("/b", "duplicate"), ("/empty", "empty")}


def test_renames_never_meet(spark):
    """A number that stays in a wanted name, and two wanted names that differ by a number only."""

    def plan(*names_):
        df = spark.createDataFrame([("/d", n) for n in names_], "dir string, fname string")
        return {r.fname: r.new_name for r in sequential.rename_plan(df, ["(.*)_calc"]).collect()}

    got = plan("x.jpg", "x(0).jpg", "x(0)_calc.jpg")
    assert got["x(0)_calc.jpg"] not in ("x.jpg", "x(0).jpg") and len({*got.values()}) == len(got)
    got = plan("x.jpg", "x_calc.jpg", "x(0)_calc.jpg")
    assert len({*got.values()}) == 2 and "x.jpg" not in got.values()
    many = [f"same{k % 3}{'_calc' * (1 + k)}.mpg" for k in range(30)] + ["same1.mpg", "same1(4).mpg"]
    got = plan(*many)
    left = [got.get(n, n) for n in many]
    assert len(set(left)) == len(many) and got["same0_calc.mpg"] == "same0.mpg"


def test_ignore_patterns_are_those_that_run(spark):
    df = files(spark, [("/a/b", "1", 1, []), ("/c", "2", 1, []), ("/D", "3", 1, [])])
    assert ordered(filters.drop_ignored(df, ["(?P<n>b)", "(?i)/d$"])) == ["/a/b", "/c"]
    with pytest.raises(Exception):
        filters.drop_ignored(df, ["(?P<n>b)"], strict=True)


def test_capacity_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sequential, "RANGE", 3)
    sizes = [9, 8, 7, 7, 6, 5, 5, 4, 3, 2, 1, 1]
    plan = spark.createDataFrame(list(enumerate(sizes, 1)), "rank long, size long").repartition(4)
    assert {r.action for r in sequential.fill_volume(plan, 100).collect()} == {"copy"}
    got = {r["rank"]: r.action for r in sequential.fill_volume(plan, 30).collect()}
    assert [got[k] for k in range(1, 13)] == ["copy", "copy", "copy", "no_space", "copy", *["no_space"] * 7]
    assert sequential.fill_volume(plan.limit(0), 3).count() == 0


def test_for_backup_is_largest_first(spark):
    df = files(spark, [("/1", "1", 30, []), ("/0", "2", 300, []), ("/2", "3", 3, []), ("/3", "4", 30, []), ("/4", "5", 9, ["V"])])
    assert ordered(filters.for_backup(df, "V")) == ["/0", "/1", "/3", "/2"]


@pytest.mark.parametrize("stream", ["keep_best", "rename_plan"])
def test_streamed_groups_have_a_shuffle_of_their_own(spark, stream):
    """Else Spark lets the join by the same keys deal the rows, and may turn it, while it runs, into a broadcast join that leaves them where they lie."""
    df = files(spark, [(f"/d{k % 20}/a_calc{k}.jpg", f"c{k % 40}", 1, []) for k in range(400)])
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        got = sequential.keep_best(df) if stream == "keep_best" else sequential.rename_plan(df, ["(.*)_calc"])
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(threshold)
    above = plan[plan.index("MapInPandas") :]
    assert "REPARTITION_BY_COL" in above[: above.index("Join")]
    assert got.count() == (40 if stream == "keep_best" else 400)
