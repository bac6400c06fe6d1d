"""A file catalog derived from the driver's tables, by the same rules in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOLUMES = ("VOL_01", "VOL_02", "VOL_03")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _named(self, docs: DataFrame) -> DataFrame:
        at = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"))
        fname = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt"))
        return docs.select(
            "doc_id", F.col("source").alias("alias"), at.alias("dir"), fname.alias("fname"), F.concat(at, F.lit("/"), fname).alias("path"), F.md5("text").alias("checksum"), F.col("n_chars").alias("size"),
            (F.lit(1_700_000_000) + F.col("doc_id")).cast("long").alias("mtime"), F.array().cast("array<string>").alias("tags"), F.slice(F.array(*map(F.lit, VOLUMES)), 1, (F.col("doc_id") % 4).cast("int")).alias("backup_dest"),
        )

    @property
    def files(self) -> DataFrame:
        return self._named(self.table("documents"))

    @property
    def src(self) -> DataFrame:
        return self.files

    @property
    def dst(self) -> DataFrame:
        """Every file; two of three lie elsewhere, with an older content."""
        same = F.col("doc_id") % 3 == 0
        there = lambda c: F.when(same, F.col(c)).otherwise(F.concat(F.lit("/vol"), c))
        older = {"dir": there("dir"), "path": there("path"), "size": F.col("size") + F.when(same, 0).otherwise(1), "checksum": F.when(same, F.col("checksum")).otherwise(F.md5(F.concat(F.lit("old:"), "checksum")))}
        return self.files.withColumns(older)

    @property
    def stat(self) -> DataFrame:
        """Every file; some are larger than the catalog says, and one of ten has another name."""
        name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("new_"), "fname")).otherwise(F.col("fname"))
        own = self.files.select("dir", name.alias("fname"), (F.col("size") + (F.col("doc_id") % 7 == 0).cast("long")).alias("size"), "mtime")
        pages = self.table("pages").select(F.lit("/pages").alias("dir"), F.concat(F.lit("page_"), F.col("page_id"), F.lit(".html")).alias("fname"), F.length("html").cast("long").alias("size"), (F.lit(1_700_000_000) + F.col("page_id")).cast("long").alias("mtime"))
        return own.union(pages)

    @property
    def sources(self) -> DataFrame:
        return self.table("documents").select("source").distinct().filter("source NOT IN ('src1', 'src2')").select(F.col("source").alias("alias"), F.concat(F.lit("/"), F.col("source")).alias("path"))

    @property
    def restore_dests(self) -> DataFrame:
        return self.table("documents").select("source").distinct().filter("source NOT IN ('src0', 'src2', 'src3')").select(F.col("source").alias("alias"), F.concat(F.lit("/restore/"), F.col("source")).alias("path"))

    @property
    def targets(self) -> DataFrame:
        target = F.concat(F.lit("/restore/"), F.col("alias"), F.lit("/"), F.col("fname"))
        return self.files.select("checksum", "size", F.concat_ws(":", "checksum", F.col("size").cast("string"), target).alias("task_id"), "alias", target.alias("target_path"), "backup_dest", F.when(F.col("doc_id") % 5 != 0, "pending").otherwise("copied").alias("state"), "doc_id")

    @property
    def roots(self) -> DataFrame:
        rows = [("/src1", 3), ("/src1/en", 1), ("/src2/", 2), ("/src", 0), ("/src3/fr", 5), ("/src3", 4)]
        return self.spark.createDataFrame(rows, "root string, seq int")

    @property
    def samples(self) -> DataFrame:
        return self.table("events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 8 + 1).cast("int").alias("tokens"), F.round(F.col("value") * 1000).cast("long").alias("bytes"))

    @property
    def names(self) -> DataFrame:
        i = F.col("doc_id")
        n = F.concat(F.lit("doc_"), i)
        fname = (
            F.when(i % 6 == 0, F.concat(n, F.lit("(3).jpg"))).when(i % 6 == 1, F.concat(n, F.lit(".jpg.jpg"))).when(i % 6 == 2, F.concat(n, F.lit("  a..b.mp4"))).when(i % 6 == 3, F.concat(n, F.lit("_calc.flv")))
            .when(i % 6 == 4, F.concat(F.lit("same_"), (i % 50).cast("string"), F.lit("_calc.mpg"))).otherwise(F.concat(n, F.lit(".txt")))
        )
        return self.files.select("doc_id", "dir", fname.alias("fname"))


#: DuckDB definitions of the same views.
SQL = {
    "files": """SELECT doc_id, source AS alias, '/' || source || '/' || lang AS dir, 'doc_' || doc_id || '.txt' AS fname, '/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path,
      md5(text) AS checksum, n_chars AS size, CAST(1700000000 + doc_id AS BIGINT) AS mtime, list_slice(['VOL_01', 'VOL_02', 'VOL_03'], 1, doc_id % 4) AS backup_dest FROM documents""",
    "src": "SELECT * FROM files",
    "dst": """SELECT doc_id, alias, CASE WHEN doc_id % 3 = 0 THEN dir ELSE '/vol' || dir END AS dir, fname, CASE WHEN doc_id % 3 = 0 THEN path ELSE '/vol' || path END AS path,
      CASE WHEN doc_id % 3 = 0 THEN checksum ELSE md5('old:' || checksum) END AS checksum, size + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS size, mtime, backup_dest FROM files""",
    "stat": """SELECT dir, CASE WHEN doc_id % 10 = 0 THEN 'new_' || fname ELSE fname END AS fname, size + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size, mtime FROM files
      UNION ALL SELECT '/pages', 'page_' || page_id || '.html', CAST(length(html) AS BIGINT), CAST(1700000000 + page_id AS BIGINT) FROM pages""",
    "sources": "SELECT DISTINCT source AS alias, '/' || source AS path FROM documents WHERE source NOT IN ('src1', 'src2')",
    "restore_dests": "SELECT DISTINCT source AS alias, '/restore/' || source AS path FROM documents WHERE source NOT IN ('src0', 'src2', 'src3')",
    "targets": """SELECT checksum, size, checksum || ':' || size || ':' || '/restore/' || alias || '/' || fname AS task_id, alias, '/restore/' || alias || '/' || fname AS target_path, backup_dest,
      CASE WHEN doc_id % 5 <> 0 THEN 'pending' ELSE 'copied' END AS state, doc_id FROM files""",
    "roots": "SELECT * FROM (VALUES ('/src1', 3), ('/src1/en', 1), ('/src2/', 2), ('/src', 0), ('/src3/fr', 5), ('/src3', 4)) t(root, seq)",
    "samples": "SELECT ts, CAST(user_id % 8 + 1 AS INTEGER) AS tokens, CAST(round(value * 1000) AS BIGINT) AS bytes FROM events",
    "names": """SELECT doc_id, dir, CASE doc_id % 6 WHEN 0 THEN 'doc_' || doc_id || '(3).jpg' WHEN 1 THEN 'doc_' || doc_id || '.jpg.jpg' WHEN 2 THEN 'doc_' || doc_id || '  a..b.mp4'
      WHEN 3 THEN 'doc_' || doc_id || '_calc.flv' WHEN 4 THEN 'same_' || (doc_id % 50) || '_calc.mpg' ELSE 'doc_' || doc_id || '.txt' END AS fname FROM files""",
}
NEEDS = {"src": ["files"], "dst": ["files"], "stat": ["files"], "targets": ["files"], "names": ["files"]}


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the views that it names before it."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in (*NEEDS.get(name, []), name) if n not in wanted]
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    if views and sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {sql.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {views} {sql}" if views else sql
