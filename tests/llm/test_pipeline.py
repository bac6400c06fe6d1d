"""The stages one after the other, each against what it must and must not do."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tallymark.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "docs")
        stage(spark, docs, SF).write.parquet(path)
        out.append((name, docs, docs := spark.read.parquet(path)))
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "jaccard_join", "suffix_dedup", "decontamination", "mixing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() > 0
        assert after.join(before, "doc_id", "left_anti").count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_group_stays(stages):
    """Against all pairs by brute force."""
    _, before, after = stages[1]
    rows = sorted((r.doc_id, r.text) for r in before.select("doc_id", "text").collect())
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    where = {}
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where.get(x, ())}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
        for x in s:
            where.setdefault(x, []).append(i)
    want = [i for k, (i, _) in enumerate(rows) if root[k] == k]
    assert len(want) < len(rows) and sorted(r.doc_id for r in after.select("doc_id").collect()) == want


def test_what_repeats_is_cut(stages):
    """Against 50-byte windows by brute force."""
    _, before, after = stages[2]
    first, got = {}, {r.doc_id: (r.text, r.n_chars) for r in after.collect()}
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    cut = 0
    for r in rows:
        b, gone = r.text.encode(), bytearray(len(r.text.encode()))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], r.doc_id) < r.doc_id:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g).decode(errors="ignore")
        cut += any(gone)
        if any(gone) and not kept.encode().split():
            assert r.doc_id not in got
        else:
            assert got[r.doc_id] == (kept, len(kept) if any(gone) else r.n_chars)
    assert cut > 0


def test_no_benchmark_passage_is_left(stages, spark):
    _, before, after = stages[3]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("text").alias("item"))
    holds = before.join(F.broadcast(items), F.col("text").contains(F.col("item"))).select("doc_id").distinct()
    assert after.join(holds, "doc_id").count() == 0
    gone = before.join(after, "doc_id", "left_anti").join(holds, "doc_id", "left_anti").count()
    assert gone <= max(2, holds.count() // 10)  # paraphrases; no clean document goes


def test_what_the_classifier_rejects_goes(stages, spark):
    """Exactly the documents of at least the score; and those are the ones that are marked, nearly."""
    _, before, after = stages[0]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(before, model).collect()}
    left = {r.doc_id for r in after.collect()}
    assert left == {d for d, x in scores.items() if x < corpus_pipeline.TOXIC} and len(left) < len(scores)
    marked = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None and r.doc_id in scores}
    right = sum((d not in left) == bool(t) for d, t in marked.items())
    assert right >= 0.8 * len(marked)


def test_the_pipeline_is_its_stages(stages, spark):
    """What the stages leave, each run by itself on what the one before left, is what the whole leaves."""
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[-1][2].columns and sorted(map(str, got.collect())) == sorted(map(str, stages[-1][2].collect()))


def test_mix_takes_words(stages):
    _, before, after = stages[4]
    assert after.columns == [*before.columns, "taken"] and after.filter("taken <= 0").count() == 0
    assert after.join(before, ["doc_id", "text"], "left_anti").count() == 0


def test_queries_are_registered():
    known = __spark_entry__.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in known) == 1 for n in range(1, 14)) and "pipeline" in known


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = lambda columns, data: sorted(repr([None if r[columns.index(k)] is None else round(r[columns.index(k)], 6) if isinstance(r[columns.index(k)], float) else r[columns.index(k)] for k in order]) for r in data)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


ODD = [(0, None, "s"), (1, "", None), (2, "  \n", "s"), (3, "one", "s"), (3, "one", "s"), (None, "no id at all but some words", None), (None, None, None), (4, "wörd " * 300_000, "t"), (5, "tab\tand\x0bmore " * 20, "t"), (6, "tab\tand\x0bmore " * 20, "t")]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, tmp_path, name, stage):
    """Nulls, blanks, repeated rows, a text of megabytes, an empty table and columns that clash with all that the operators add."""
    clash = "class_id n_links is_first kept kept_text n_bytes n_removed n_spans kept_sha256 leaks score taken uid key body found".split()
    for table, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([(10**6, None, 0)] if table == "labels" else [(1, "an item that nobody has in any of the texts"), (None, None)], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ODD], "doc_id long, text string, source string, n_chars long").withColumns({c: F.lit(c) for c in clash if not (name == "mixing" and c == "taken")})
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns + (["taken"] if name == "mixing" else [])
    rows = got.collect()
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in rows)
    if name in ("toxicity", "decontamination"):
        assert ids == [-1, -1, 0, 1, 2, 3, 3, 4, 5, 6]
    elif name == "jaccard_join":
        assert ids == [-1, -1, 0, 1, 2, 3, 4, 5]
    elif name == "suffix_dedup":
        assert ids == [-1, -1, 0, 1, 2, 3, 3, 4, 5]
    else:
        assert set(ids) <= {-1, 3, 4, 5, 6} and all(0 < r.taken <= 2 * len((r.text or "").split()) for r in rows)
    assert all(r[c] == c for r in rows for c in clash if not (name == "mixing" and c == "taken"))
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_texts_are_stored_once(spark, monkeypatch):
    """Beside its columns, the copy of the documents that the repeats are cut from has numbers and digests only."""
    from tallymark.llm import suffix_dedup

    seen, write = {}, suffix_dedup.materialise
    monkeypatch.setattr(suffix_dedup, "materialise", lambda df, tag: seen.setdefault(tag, write(df, tag)))
    docs = spark.createDataFrame([(1, "a" * 60), (2, "a" * 60), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.kept_text, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {1: ("a" * 60, 0), 2: ("", 60), 3: ("", 0)}
    assert [f.name for f in seen["texts"].schema if f.dataType.simpleString() == "string"] == ["text"]


def test_a_run_leaves_its_last_stage_only(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, SF)
    new = set(os.listdir(folder)) - before
    assert got.count() > 0 and [n.rpartition("-")[0] for n in new] == ["stage-mixing"]
