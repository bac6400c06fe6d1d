"""Plans in rounds: order, progress and the tuner; and the commands that use them."""

import os

import pytest

from tallymark import __main__ as commands
from tallymark.operators import tuning
from tallymark.plans import execute, rounds

PLAN = "action string, source string, target string, checksum string, size long, reason string, rank long"


def a_plan(spark, tmp_path, sizes):
    (tmp_path / "from").mkdir()
    rows = []
    for k, size in enumerate(sizes, 1):
        (tmp_path / f"from/{k}").write_bytes(b"x" * size)
        rows.append(("copy", f"{tmp_path}/from/{k}", f"{tmp_path}/to/{k}", "", size, "", k))
    return spark.createDataFrame(rows, PLAN).repartition(3)


def test_rounds_keep_the_order_and_obey_the_tuner(spark, tmp_path):
    sizes = [100, 900, 500, 500, 1000, 0, 1000, 1000, 1000, 1000, 1000, 1000]
    plan, heard = a_plan(spark, tmp_path, sizes), []
    times = iter(x for pair in ((0, 10), (0, 5), (0, 5), (0, 6), (0, 9), (0, 9), (0, 9), (0, 9), (0, 9)) for x in pair)
    tuner = tuning.Tuner(1, 4)
    run = rounds.carry_out(plan, f"file://{tmp_path}/run", size=1000, tuner=tuner, listener=heard.append, every=0.05, clock=lambda: next(times))
    out = rounds.outcomes(spark, run, plan.schema)
    assert sorted((r.rank, r.result) for r in out.collect()) == [(k, "done") for k in range(1, len(sizes) + 1)]
    assert [p.stat().st_size for p in sorted((tmp_path / "to").iterdir(), key=lambda p: int(p.name))] == sizes
    # 100 bytes a second with one task, 200 with two, 200 with three (no more than the best), then fewer: frozen at the best.
    assert [(tasks, action) for tasks, _, _, _, action in run.rounds][:4] == [(1, "increase"), (2, "increase"), (3, "hold"), (3, "freeze")]
    assert {tasks for tasks, *_ in run.rounds[4:]} == {2} and [r[1] for r in run.rounds][:2] == [2, 2]
    assert (heard[-1].done_files, heard[-1].done_bytes) == (heard[-1].files, heard[-1].bytes) == (len(sizes), sum(sizes)) and len(heard) >= 2
    done = [t.done_bytes for t in heard]
    assert done == sorted(done) and "100%" in str(heard[-1])
    # Run again, everything is there: the same outcomes.
    again = rounds.carry_out(plan, f"file://{tmp_path}/again", size=1000)
    assert rounds.outcomes(spark, again, plan.schema).filter("result = 'done'").count() == len(sizes) and {r[0] for r in again.rounds} == {2}


def test_a_task_that_runs_again_counts_once():
    latest = rounds._Latest()
    total = latest.zero({})
    for part, told in (((0, 0), (2, 20)), ((0, 1), (1, 5)), ((0, 0), (2, 20)), ((1, 0), (1, 1))):
        total = latest.addInPlace(total, {part: told})
    assert total == {(0, 0): (2, 20), (0, 1): (1, 5), (1, 0): (1, 1)}


def test_rounds_of_nothing(spark, tmp_path):
    plan = spark.createDataFrame([], PLAN)
    run = rounds.carry_out(plan, f"file://{tmp_path}/run")
    assert run.rounds == [] and rounds.outcomes(spark, run, plan.schema).count() == 0


# Throughputs before and now with the tokens that had them, the tokens at present, the most there may be, the best, whether frozen; and the decision.
ORIGINAL = [
    (100.0, 102.0, 3, 8, 3, "increase", 4),
    (100.0, 102.0, 8, 8, 7, "hold", 8),
    (100.0, 98.0, 5, 8, 4, "freeze", 4),
    (100.0, 100.5, 3, 8, 3, "hold", 3),
    (100.0, 99.5, 3, 8, 3, "hold", 3),
    (100.0, 99.0, 5, 8, 4, "hold", 5),
    (100.0, 98.99, 5, 8, 4, "freeze", 4),
    (100.0, 101.0, 3, 8, 3, "hold", 3),
    (100.0, 101.01, 3, 8, 3, "increase", 4),
    (None, 100.0, 2, 8, 2, "increase", 3),
    (None, 100.0, 8, 8, 4, "hold", 8),
]


def test_decisions_of_a_step(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ORIGINAL, "before double, now double, current int, most int, best int, action string, tokens int")
    change = (F.col("now") - F.col("before")) / F.col("before") * 100
    for r in rows.select("*", *[tuning.simple_decision(change, F.col("current"), F.col("best"), m).alias(f"d{m}") for m in (8,)]).collect():
        assert (r.d8.action, r.d8.tokens) == (r.action, r.tokens), r


def test_a_recorded_series():
    """More tokens help until the fourth; the fifth costs, and the number freezes at the best."""
    tuner = tuning.Tuner(1, 8)
    for throughput, action, tokens in ((100, "increase", 2), (150, "increase", 3), (180, "increase", 4), (190, "increase", 5), (170, "freeze", 4), (500, "hold", 4)):
        assert (tuner.hear(throughput * 10, 10), tuner.tokens) == (action, tokens)
    assert tuner.hear(0, 10) == "hold" and tuner.hear(5, 0) == "hold" and len(tuner.decisions) == 6


@pytest.fixture
def run(spark, tmp_path):
    def run(*args):
        return commands.main(["--catalog", f"{tmp_path}/catalog", "--config", f"{tmp_path}/config.xml", *args], spark)

    return run


def put(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def held(volume):
    return sorted(os.path.relpath(p, volume / "home") for p in (volume / "home").rglob("*") if p.is_file())


def test_a_small_volume_gets_the_beginning_of_the_order(run, spark, tmp_path, capsys):
    from tallymark.sources import store

    put(tmp_path / "tree", {"big": "b" * 5000, "mid/one": "m" * 3000, "mid/two": "n" * 2900, "small": "s" * 10, "mid/copy of two": "n" * 2900})
    for v in ("v1", "v2"):
        (tmp_path / v).mkdir()
    assert run("source", "home", f"{tmp_path}/tree") == 0 and run("check") == 0
    assert run("backup", f"{tmp_path}/v1", "--capacity", "9000", "--go") == 3
    assert held(tmp_path / "v1") == ["big", "mid/one", "small"]  # after the first that doesn't fit, small ones go on
    out = capsys.readouterr()
    assert "no_space" in out.out and "3 copied, 1 not" in out.out and "8010 of 8010 bytes, 100%" in out.err
    files = store.Catalog(spark, f"{tmp_path}/catalog").read("files").collect()
    label = next(r.alias for r in files if r.alias != "home")
    assert sorted((os.path.basename(r.path), r.backup_dest) for r in files if r.alias == label) == [("big", [label]), ("one", [label]), ("small", [label])]
    assert sorted(os.path.basename(r.path) for r in files if r.alias == "home" and r.backup_dest == [label]) == ["big", "one", "small"]
    outcomes = {os.path.basename(r.source): r.result for r in store.Catalog(spark, f"{tmp_path}/catalog").read("outcomes").collect()}
    assert outcomes["big"] == outcomes["one"] == "done" and set(outcomes.values()) == {"done", "no_space"}
    # What has no copy yet comes first on the next volume.
    assert run("backup", f"{tmp_path}/v2", "--capacity", "3000", "--adaptive", "--go") == 3
    assert held(tmp_path / "v2") == ["mid/copy of two", "small"]
    assert run("report") == 0 and [x.split("\t")[:2] for x in capsys.readouterr().out.splitlines()[-2:]] == [["1", "4"], ["2", "1"]]


def test_moves_renames_and_documents(run, spark, tmp_path, capsys):
    from tallymark.sources import documents, sink

    put(tmp_path / "tree", {"a/one.txt": "1" * 11, "b/two.jpg": "2" * 22, "b/three(2).jpg": "3" * 33})
    (tmp_path / "v").mkdir()
    assert run("source", "home", f"{tmp_path}/tree") == 0 and run("check") == 0 and run("backup", f"{tmp_path}/v", "--go") == 0
    (tmp_path / "tree/c").mkdir()
    (tmp_path / "tree/a/one.txt").rename(tmp_path / "tree/c/one.txt")
    capsys.readouterr()
    assert run("check", "--moves", "--write") == 0 and capsys.readouterr().out == "3 keep\n"
    assert run("missing") == 0 and "/" not in capsys.readouterr().out  # the moved file is on the volume still
    read = {r.fname: (os.path.basename(r.dir), len(r.backup_dest)) for r in documents.read_directories(sink.on_disk(spark, [f"{tmp_path}/tree"])).collect()}
    assert read == {"one.txt": ("c", 1), "two.jpg": ("b", 1), "three(2).jpg": ("b", 1)}
    assert run("check", "--rename") == 0 and (tmp_path / "tree/b/three.jpg").exists()
    capsys.readouterr()
    assert run("discover", f"{tmp_path}/v", "--dry") == 0 and capsys.readouterr().out == "3\t1\n"
    assert run("discover", f"{tmp_path}/v") == 0 and run("discover", f"{tmp_path}/v", "--dry") == 0 and capsys.readouterr().out.splitlines()[-1] == "3\t0"
    (tmp_path / "tree/b/two.jpg").unlink()
    assert run("check") == 0 and run("prune", f"{tmp_path}/v") == 0 and (tmp_path / "v/home/b/two.jpg").exists()
    assert run("prune", f"{tmp_path}/v", "--go") == 0 and not (tmp_path / "v/home/b/two.jpg").exists() and (tmp_path / "v/home/a/one.txt").exists()


def test_small_commands(run, tmp_path, capsys):
    put(tmp_path / "tree", {"keep/a": "1", "cache/b": "2"})
    assert run("source", "home", f"{tmp_path}/tree") == 0 and run("source") == 0 and capsys.readouterr().out == f"home\t{tmp_path}/tree\n"
    assert run("ignore", "/cache/") == 0 and run("ignore", "/cache/") == 1 and run("ignore", "(broken") == 2
    assert run("ignore_test", "/x/cache/y") == 0 and run("ignore_test", "/x/y") == 1
    capsys.readouterr()
    assert run("check") == 0 and capsys.readouterr().out == "1 new\n"
    assert run("dump", f"{tmp_path}/tree/keep/a", "--kind", "raw") == 0 and '"Size":1' in capsys.readouterr().out and run("dump", "nothing") == 1
    (tmp_path / "v").mkdir()
    assert run("label", f"{tmp_path}/v", "--show") == 1 and run("label", f"{tmp_path}/v") == 0
    first = capsys.readouterr().out.split()[-1]
    assert run("label", f"{tmp_path}/v", "--recreate") == 0 and capsys.readouterr().out.strip() != first
    assert execute.checksum(f"{tmp_path}/tree/keep/a")
