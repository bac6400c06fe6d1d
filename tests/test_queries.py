"""Every catalog query against its SQL, on the smallest tables."""

import base64
import math
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallymark import catalog_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog_queries.ORACLE_SQL))
def test_query_matches_sql(spark, sql, name):
    got = catalog_queries.QUERIES[name](spark, SF)
    want = sql.sql(catalog_queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog_queries.QUERIES) - set(catalog_queries.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog_queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("missing", ["tiktoken", "public_tokenizers", "tallymark.llm", "corpus_pipeline"])
def test_catalog_does_without(missing):
    """The other queries are there when a library that only the corpus operators need, or they themselves, are missing."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(__spark_entry__.__file__)), capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, sql = out.stdout.split()
    assert int(n) >= len(catalog_queries.QUERIES) and int(sql) >= len(catalog_queries.ORACLE_SQL)


def test_dump_is_one_line(spark):
    """Base64 of 57 bytes or more, which Spark breaks into lines, and of none."""
    from tallymark.functions import codecs

    df = spark.createDataFrame([(n, "x" * n) for n in (0, 1, 57, 58, 200)], "n int, s string")
    got = {r.n: r.d for r in df.select("n", codecs.dump(F.encode("s", "UTF-8"), "base64").alias("d")).collect()}
    assert got == {n: base64.b64encode(b"x" * n).decode() for n in (0, 1, 57, 58, 200)}
