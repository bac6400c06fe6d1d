"""Documents, directory trees, configuration and streams."""

import os

import pytest
from pyspark.sql import functions as F

from tallymark import __main__ as commands
from tallymark.functions import codecs, names
from tallymark.operators import progress, restore, state
from tallymark.plans import execute
from tallymark.sources import config, contexts, documents, journals, sink, store, walk


def test_directory_document_round_trip(spark):
    schema = "dir string, fname string, checksum string, size long, mtime long, tags array<string>, backup_dest array<string>"
    rows = [("/d", 'it\'s "q" & <x>.txt', "c", 5, 7, ["t1", "t2"], ["V1"]), ("/d", "b", "", 0, 0, [], []), ("/e", "é", "k", 1, 2, [], ["V1", "V2"])]
    df = spark.createDataFrame(rows, schema)
    docs = documents.write_directories(df)
    assert "mtime" not in docs.filter("dir = '/d'").first().xml.split("<fr")[1]
    back = documents.read_directories(docs)
    assert sorted((r.dir, r.fname, r.checksum, r.size, r.mtime, r.tags, r.backup_dest) for r in back.collect()) == sorted(rows)


def test_corrupt_and_foreign_documents(spark):
    texts = [("/a", "<dr><fr fname='x' checksum="), ("/b", "<dr><fr fname='x' size='3' odd='1'/></dr>"), ("/c", "")]
    got = documents.read_directories(spark.createDataFrame(texts, "dir string, xml string")).collect()
    assert [(r.dir, r.fname, r.size, r.backup_dest) for r in got] == [("/b", "x", 3, [])]


def test_journal_of_many_roots(spark):
    text = '<mdj alias="a"><dr dir="summer"><fr fname="p" checksum="m" size="5" bd="V1"/></dr></mdj>\n<mdj alias="b"><dr dir="x"><fr fname="q" checksum="n" size="1"><bd>V2</bd></fr></dr></mdj>'
    got = documents.read_journal(spark.createDataFrame([(text,)], "value string"))
    assert sorted((r.alias, r.dir, r.fname, r.backup_dest) for r in got.collect()) == [("a", "summer", "p", ["V1"]), ("b", "x", "q", ["V2"])]
    escaped = documents.write_journal(got.replace("a", 'x"&<', "alias"))
    assert {r.alias for r in documents.read_journal(escaped, "xml").collect()} == {'x"&<', "b"}
    assert documents.journal_file_dest(got).count() == 2


def test_only_stale_documents_are_written(spark):
    old = spark.createDataFrame([("/a", "1"), ("/b", "1"), ("/c", "1")], "dir string, xml string")
    new = spark.createDataFrame([("/a", "1"), ("/b", "2"), ("/d", "1")], "dir string, xml string")
    assert sorted((r.dir, r.action) for r in documents.stale_documents(old, new).collect()) == [("/b", "write"), ("/c", "delete"), ("/d", "write")]


CONTEXT = "src_path string, dir string, name string, size long, mtime double, md5 string, backup_dest array<string>"


def test_restore_contexts_at_every_split(spark, tmp_path):
    xml = """<?xml version="1.0"?><root>
  <rc src_path="/s"><file name="top" size="1" mtime="2" md5="m"/>
    <dr name="a"><dr name="b > c"><file name="f" size="3" mtime="1.5" md5="n"><bd>V</bd><bd>W</bd></file></dr>
      <dr name="empty"/><dr name="é"><dr name="x"></dr><file name="g&amp;" size="4" mtime="1" md5=""/></dr><file name="h" size="5" mtime="1" md5="q"></file></dr>
    <file name="last" size="6" mtime="1" md5="z"/></rc>
  <rc src_path="/t &lt;"><dr name="a"><file name="f" size="7" mtime="1" md5="n"/></dr></rc></root>"""
    want = [("/s", "", "last", 6, 1.0, "z", []), ("/s", "", "top", 1, 2.0, "m", []), ("/s", "a", "h", 5, 1.0, "q", []), ("/s", "a/b > c", "f", 3, 1.5, "n", ["V", "W"]), ("/s", "a/é", "g&", 4, 1.0, "", []), ("/t <", "a", "f", 7, 1.0, "n", [])]
    (tmp_path / "c.xml").write_text(xml)
    for split in (1 << 20, 100, 37):
        assert sorted(tuple(r) for r in contexts.read_contexts(spark, [f"{tmp_path}/c.xml"], split).collect()) == want
    size = (tmp_path / "c.xml").stat().st_size
    with open(tmp_path / "c.xml", "rb") as f:
        *whole, end = contexts.walked(0, size, f)
        for cut in range(1, size):
            *first, step = contexts.walked(0, cut, f)
            *second, rest = contexts.walked(cut, size, f, *contexts.after(None, [], step))
            assert first + second == whole and contexts.after(*contexts.after(None, [], step), rest) == contexts.after(None, [], end)


def test_restore_contexts_come_back(spark, tmp_path):
    rows = [("/s", "", "top", 1, 2.0, "m", []), ("/s", "a/b", "f", 3, 1.5, "n", ["V", "W"]), ("/s", "a", "k", 3, 1.0, "n", ["W"]), ("/t", "a", 'é&<"', 0, 7.0, "", [])]
    contexts.write_contexts(spark.createDataFrame(rows, CONTEXT)).select("xml").write.text(f"{tmp_path}/c")
    assert sorted(tuple(r) for r in contexts.read_contexts(spark, [f"{tmp_path}/c"], 50).collect()) == sorted(rows)
    (tmp_path / "none").mkdir()
    assert contexts.read_contexts(spark, [f"{tmp_path}/none"]).count() == 0


def test_documents_are_validated_and_edited(spark):
    texts = [("/a", "<dr><fr fname='x' size='3'/></dr>"), ("/b", "<dr><fr fname='x' checksum="), ("/c", "<dr><fr size='3'/></dr>"), ("/d", "<other/>"), ("/e", "<dr></dr>"), ("/f", "")]
    got = {r.dir: r.valid for r in documents.is_valid(spark.createDataFrame(texts, "dir string, xml string")).collect()}
    assert got == {"/a": True, "/b": False, "/c": False, "/d": False, "/e": True, "/f": False}
    files = spark.createDataFrame([("/a", "x", 1), ("/a", "y", 2)], "dir string, fname string, size long")
    new = spark.createDataFrame([("/a", "y", 5), ("/a", "y", 4), ("/b", "z", 6)], "dir string, fname string, size long")
    assert sorted(tuple(r) for r in documents.set_entries(files, new).collect()) == [("/a", "x", 1), ("/a", "y", 5), ("/b", "z", 6)]
    assert [tuple(r) for r in documents.get_entries(files, new).collect()] == [("/a", "y", 2)]


def test_walk(spark, tmp_path):
    for name in ("a", ".dot", "sub/b", "sub/deep/c", ".hidden/x", "skip/y", "skip/.mdSkipDir"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    walk.register(spark)
    df = spark.read.format("tree").option("paths", str(tmp_path)).load()
    assert sorted(r.fname for r in df.collect()) == [".dot", "a", "b", "c"]
    assert sorted(bytes(r.content).decode() for r in walk.read_contents(df).collect()) == [".dot", "a", "sub/b", "sub/deep/c"]


def test_config_round_trip(spark, tmp_path):
    c = config.Config(["(.*)_x"], ["L1"], {}, {"a": "/r"}, [".*[.]tmp"])
    assert c.add_source("a", "/s") and not c.add_source("a", "/t") and not c.add_source("b", "/s")
    assert config.Config.parse(c.to_xml()) == c
    assert c.tables(spark)["sources"].collect()[0].path == "/s"
    assert config.Config.load("none.xml", (str(tmp_path),)) == config.Config()
    assert c.source_paths([]) == ["/s"] and c.source_paths(["/q"]) == ["/q"]
    (tmp_path / ".mdbackup.xml").write_text("<v><label>LAB</label></v>")
    (tmp_path / "x").mkdir()
    assert config.volume_label(str(tmp_path / "x")) == "LAB" and len(config.new_label({"L"})) == 8


def test_deep_trees_are_cut(tmp_path):
    at = tmp_path
    for k in range(5):
        at = at / f"d{k}"
        for name in ("x", "y", "z"):
            (at / name).mkdir(parents=True)
            (at / name / f"{name}{k}").write_text("1")
    for subtrees in (1, 3, 8, 100):
        reader = walk.WalkReader({"paths": str(tmp_path), "subtrees": str(subtrees)})
        parts = reader.partitions()
        found = [(d, f) for p in parts for _, d, f, _, _ in reader.read(p)]
        assert len(found) == len(set(found)) == 15
        assert len(parts) >= min(subtrees, 8)


def test_contexts_are_added_once(spark):
    files = spark.createDataFrame([("/s", "x", 1, 1, "m", ["V"])], "src_path string, filename string, size long, mtime long, md5 string, backup_dest array<string>")
    more = spark.createDataFrame([("/t", "a/b", "f", 3, 1, "n", ["W"]), ("/t", "", "top", 3, 1, "n", [])], "src_path string, dir string, name string, size long, mtime long, md5 string, backup_dest array<string>")
    both = restore.add_context(files, more)
    assert sorted(r.filename for r in both.collect()) == ["a/b/f", "top", "x"]
    with pytest.raises(ValueError):
        restore.add_context(both, more)


def test_payloads(spark):
    rows = [(5, "/é/x", ["V1", "V2"]), (0, "", []), (2**40, "/" + "long" * 100, [])]
    df = spark.createDataFrame(rows, "size long, path string, dests array<string>").select("*", codecs.encode_payload(F.col("size"), F.col("path"), F.col("dests")).alias("data"))
    for r in df.withColumns({"p": codecs.decode_payload(F.col("data")), "more": codecs.decode_payload(F.concat("data", F.lit(b"rest"))), "less": codecs.decode_payload(F.expr("substring(data, 1, length(data) - 1)"))}).collect():
        assert int.from_bytes(r.data[:4], "little") == len(r.data) - 4
        assert tuple(r.p) == tuple(r.more) == (r.size, r.path, r.dests) and r.less is None
    assert spark.range(1).select(codecs.decode_payload(F.lit(b"ab")).alias("p")).first().p is None


def test_catalog_outlives_a_session(spark, tmp_path):
    c = store.Catalog(spark, f"file://{tmp_path}/catalog")
    assert c.read("files").count() == 0 and c.versions("files") == []
    row = [("a", "/d", "f", "/d/f", "c", 1, 1, [], ["V"])]
    for n in range(1, 5):
        assert c.write("files", spark.createDataFrame(row * n, store.TABLES["files"])) == n
    assert c.versions("files") == [3, 4] and c.read("files").count() == 4 and c.read("files", 3).count() == 3
    (tmp_path / "catalog/files/v5/b=0").mkdir(parents=True)  # a run that failed
    assert store.Catalog(spark, f"{tmp_path}/catalog").read("files").count() == 4
    c.write("files", c.read("files").limit(1))
    assert c.read("files").count() == 1
    c.clear_files()
    assert c.read("files").count() == 0


def test_progress(spark):
    files = spark.createDataFrame([("a", 10), ("b", 30), ("c", 0)], "path string, size long")
    seen, done = progress.observed(files)
    assert seen.filter("size > 0").count() == 2 and done.done == (3, 40) and done.share == 1.0
    part, done = progress.observed(files.filter("size < 20"), progress.amount(files))
    part.collect()
    assert done.share == 0.25


def test_copies_tell_of_their_bytes(tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 3_000_000)
    heard = []
    assert execute.checksum(f"{tmp_path}/a", told=heard.append) == execute.checksum(f"{tmp_path}/a", size=777)
    assert sum(heard) == 3_000_000 and len(heard) == 3
    heard.clear()
    assert execute.copy_file(f"{tmp_path}/a", f"{tmp_path}/new/b", link=False, told=heard.append) == "done" and sum(heard) == 3_000_000
    assert execute.carry_out("copy", f"{tmp_path}/a", "there", copier=lambda s, t: f"{os.path.basename(s)} to {t}") == "a to there"


def test_config_edits(tmp_path):
    c = config.Config(sources={"a": "/s"})
    c.set_restore("a")
    c.set_restore("b", "/r/x/..")
    assert c.restore == {"a": "/s", "b": "/r"} and c.remove_restore("b") and not c.remove_restore("b")
    with pytest.raises(KeyError):
        c.set_restore("z")
    path = config.Config.find("c.xml", (f"{tmp_path}/none", str(tmp_path)))
    c.save(path)
    assert config.Config.load("c.xml", (str(tmp_path),)) == c and path == f"{tmp_path}/c.xml"


def test_labels_are_made_again(tmp_path):
    c = config.Config(volumes=["OLD"])
    first = config.ensure_volume_label(str(tmp_path), c)
    assert config.ensure_volume_label(str(tmp_path), c) == first == config.volume_label(str(tmp_path)) and c.volumes == ["OLD", first]
    (tmp_path / ".mdbackup.xml").write_text("<broken")
    assert config.ensure_volume_label(str(tmp_path), c) not in ("OLD", first)


def test_rules_file(spark):
    lines = spark.createDataFrame([("# a comment",), ("",), (" (.*)_calc ",), ("(broken",), ("// no",), ("plain",), ("(.*)_bob_(.*)",)], "value string")
    assert names.load_rules(lines) == ["(.*)_calc", "(.*)_bob_(.*)"]


def test_check_run(spark):
    old = spark.createDataFrame([("/d", n, c, 1, 1, ["V"]) for n, c in (("same", "s"), ("rot", "r"), ("lack", ""), ("gone", "g"))], "dir string, fname string, checksum string, size long, mtime long, backup_dest array<string>")
    stat = spark.createDataFrame([("/d", n, 1, 1) for n in ("same", "rot", "lack", "new")], "dir string, fname string, size long, mtime long")
    now = spark.createDataFrame([("/d/same", "s"), ("/d/rot", "R"), ("/d/lack", "l"), ("/d/new", "n")], "path string, new_checksum string")
    run = lambda **o: {r.fname: (r.action, r.checksum, r.backup_dest) for r in state.check(old, stat, now, **o).collect()}
    gone = ("delete", "g", ["V"])
    assert run() == {"same": ("keep", "s", ["V"]), "rot": ("keep", "r", ["V"]), "lack": ("keep", "l", ["V"]), "new": ("new", "n", []), "gone": gone}
    assert run(only_validate=True)["rot"] == ("mismatch", "r", ["V"])
    assert run(recompute=True)["rot"] == ("mismatch", "R", [])
    assert run(scrub_labels=True)["same"] == ("keep", "s", [])


def test_commands(spark, tmp_path, capsys):
    for name in ("one", "two", "sub/three", "sub/copy of three"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(name.removeprefix("sub/copy of ") if "copy" in name else name.removeprefix("sub/"))
    (tmp_path / "vol").mkdir()
    run = lambda *a: commands.main(["--catalog", f"{tmp_path}/catalog", "--config", f"{tmp_path}/config.xml", *a], spark)
    assert run("source", "home", f"{tmp_path}/tree") == 0 and run("source", "home", f"{tmp_path}/tree") == 1
    assert run("check") == 0 and "4 new" in capsys.readouterr().out
    assert run("backup", f"{tmp_path}/vol") == 0 and not (tmp_path / "vol/home").exists()
    assert run("backup", f"{tmp_path}/vol", "--go") == 0 and "3 copied" in capsys.readouterr().out
    assert sorted(p.name for p in (tmp_path / "vol/home").rglob("*") if p.is_file())[-2:] == ["three", "two"] or (tmp_path / "vol/home/sub").exists()
    assert run("report") == 0 and capsys.readouterr().out.splitlines()[1].split("\t")[:2] == ["1", "4"]
    assert run("check", "--validate") == 0 and "4 keep" in capsys.readouterr().out
    (tmp_path / "tree/one").write_text("eno")
    os.utime(tmp_path / "tree/one", (1, 1))
    assert run("check") == 0 and "1 changed, 3 keep" in capsys.readouterr().out
    assert run("journal", f"{tmp_path}/journal") == 0
    assert run("restore_to", "home", f"{tmp_path}/back") == 0
    assert run("restore", f"{tmp_path}/vol", "--journal", f"{tmp_path}/journal", "--go") == 0
    capsys.readouterr()
    assert (tmp_path / "back/sub/three").read_text() == "three" and not (tmp_path / "back/tree/one").exists()


ROW = "alias string, dir string, fname string, path string, checksum string, size long, mtime long, tags array<string>, backup_dest array<string>"


def stored(spark, names, size=1):
    return spark.createDataFrame([("a", "/d", n, f"/d/{n}", "c", size, 1, [], ["V"]) for n in names], ROW)


def test_a_change_rewrites_what_it_touches(spark, tmp_path):
    c = store.Catalog(spark, f"file://{tmp_path}/catalog", buckets=16)
    names = [f"f{k}" for k in range(200)]
    c.write("files", stored(spark, names))
    number, touched = c.change("files", put=stored(spark, ["f3", "f7", "new"], 5), drop=stored(spark, ["f9", "absent"]))
    assert number == 2 and len(touched) <= 5
    written = {p.name for p in (tmp_path / "catalog/files/v2").iterdir() if p.is_dir()}
    assert written <= {f"b={b}" for b in touched}
    sizes = {r.fname: r.size for r in c.read("files").collect()}
    assert sizes == {n: 5 if n in ("f3", "f7") else 1 for n in names if n != "f9"} | {"new": 5}
    assert c.read("files", 1).count() == 200
    assert c.change("files", put=stored(spark, [])) == (2, [])
    # A version is dropped once nothing needs its folder.
    for n in range(3, 6):
        assert c.change("files", put=stored(spark, ["f3"], n))[0] == n
    assert c.versions("files") == [4, 5] and {r.size for r in c.read("files").filter("fname = 'f3'").collect()} == {5}
    assert {p.name for p in (tmp_path / "catalog/files").iterdir() if p.name[0] == "v"} >= {"v1", "v4", "v5"} and not (tmp_path / "catalog/files/v3").exists()
    assert c.read("files").count() == 200


def test_a_failed_change_leaves_the_old_rows(spark, tmp_path):
    c = store.Catalog(spark, f"file://{tmp_path}/catalog", buckets=4)
    c.write("files", stored(spark, ["a", "b"]))
    broken = stored(spark, ["a"], 9).withColumn("size", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        c.change("files", put=broken)
    assert c.versions("files") == [1] and {r.size for r in c.read("files").collect()} == {1}
    assert c.change("files", put=stored(spark, ["a"], 9))[0] == 2 and sorted(r.size for r in c.read("files").collect()) == [1, 9]


def test_journals_are_read_alike_at_every_split(spark, tmp_path):
    entry = lambda i: f"""<fr fname="{'é' * (i % 4)}f > {i}" checksum='c{i}' size="{i}" mtime="7">{'<bd>V1</bd><tag>x</tag>' if i % 3 else ''}</fr>""" if i % 5 else f'<fr fname="e{i}" checksum="" size="{i}" bd="V2,V3"/>'
    roots, i = [], 0
    for r in range(12):
        dirs = ""
        for d in range(r % 4):
            dirs += f'<dr dir="/d{r}/{d} &amp; &lt;fr">' + "".join(entry(i + k) for k in range(d * 3)) + "</dr>\n"
            i += 10
        roots.append(f'<mdj alias="a{r} &quot;&gt;">{dirs}</mdj>')
    (tmp_path / "j").mkdir()
    (tmp_path / "j/one.xml").write_text('<?xml version="1.0"?>\n' + "\n".join(roots[:7]))
    (tmp_path / "j/two.xml").write_text("\n".join(roots[7:]))
    (tmp_path / "j/_SUCCESS").write_text("")
    (tmp_path / "j/empty.xml").write_text("")
    want = sorted(map(str, documents.read_journal(spark.read.text([f"{tmp_path}/j/one.xml", f"{tmp_path}/j/two.xml"], wholetext=True)).collect()))
    assert len(want) > 20
    for split in (1 << 20, 1000, 333, 61):
        assert sorted(map(str, journals.read_journals(spark, [f"file://{tmp_path}/j"], split).collect())) == want
    # Every cut, by the readers themselves.
    path = tmp_path / "j/one.xml"
    size = path.stat().st_size
    with open(path, "rb") as f:
        whole = list(journals.elements(0, size, f, None, None))
        for cut in range(1, size):
            first = journals.heads(0, cut, f)
            assert list(journals.elements(0, cut, f, None, None)) + list(journals.elements(cut, size, f, *first)) == whole


def test_broken_journals_are_an_error(spark, tmp_path):
    (tmp_path / "cut").write_text('<mdj alias="a"><dr dir="d"><fr fname="x" size="1"><bd>V</bd>')
    (tmp_path / "blank").write_text('<mdj alias=" "><dr dir="d"><fr fname="x" size="1"/></dr></mdj>')
    with pytest.raises(Exception, match="cut off"):
        journals.read_journals(spark, [f"{tmp_path}/cut"]).collect()
    with pytest.raises(Exception, match="without an alias"):
        journals.read_journals(spark, [f"{tmp_path}/blank"]).collect()
    (tmp_path / "none").mkdir()
    assert journals.read_journals(spark, [f"{tmp_path}/none"]).count() == 0


DOCUMENT = "dir string, fname string, checksum string, size long, mtime long, tags array<string>, backup_dest array<string>"


def test_only_stale_documents_are_touched_on_disk(spark, tmp_path):
    for d in ("a", "b", "c/deep"):
        (tmp_path / "t" / d).mkdir(parents=True)
    file = lambda d, n, s=1: (f"{tmp_path}/t/{d}", n, "k", s, 1, [], ["V"])
    put = lambda rows: sink.persist(spark.createDataFrame(rows, DOCUMENT), [f"{tmp_path}/t"], tally=f"{tmp_path}/tally")
    rows = [file("a", "x"), file("a", "y"), file("b", "z"), file("c/deep", "w")]
    put(rows)
    assert (tmp_path / "tally").read_text() == "3 written, 0 deleted, 0 gone"
    read = documents.read_directories(sink.on_disk(spark, [f"{tmp_path}/t"])).select("dir", "fname", "size")
    assert sorted(tuple(r) for r in read.collect()) == sorted((r[0], r[1], r[3]) for r in rows)
    kept = (tmp_path / "t/a" / sink.NAME).stat().st_mtime_ns
    put([file("a", "x"), file("a", "y"), file("c/deep", "w", 2), file("gone", "v")])
    assert (tmp_path / "tally").read_text() == "1 written, 1 deleted, 1 gone"
    assert (tmp_path / "t/a" / sink.NAME).stat().st_mtime_ns == kept and not (tmp_path / "t/b" / sink.NAME).exists()
    assert sorted(r.size for r in documents.read_directories(sink.on_disk(spark, [f"{tmp_path}/t"])).collect()) == [1, 1, 2]
    assert not list((tmp_path / "t").rglob("*.part"))


def test_a_failed_task_leaves_whole_documents(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / sink.NAME).write_text("old")
    writer = sink.DocumentWriter({})
    row = lambda d, action="write", xml="new": {"dir": f"{tmp_path}/{d}", "action": action, "xml": xml}

    def rows():
        yield row("a")
        yield row("b")
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(rows())
    assert (tmp_path / "a" / sink.NAME).read_text() == "old" and [p.name for p in tmp_path.rglob("*") if p.is_file()] == [sink.NAME]
    lost = tmp_path / "a" / f"{sink.NAME}.{'0' * 32}.part"
    lost.write_text("half")
    os.utime(lost, (1, 1))
    for _ in range(2):  # a task may run twice
        assert writer.write(iter([row("a"), row("b", "delete")])).written == 1
    assert (tmp_path / "a" / sink.NAME).read_text() == "new" and not lost.exists() and not (tmp_path / "b" / sink.NAME).exists()
