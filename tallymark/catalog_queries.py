"""The catalog queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import checksums, codecs, names, paths, tags, units
from .operators import content, coverage, discovery, durable, filters, nesting, progress, restore, roots, sequential, state, tuning, visit
from .plans import tables
from .sources import contexts, documents, journals, sink, store, walk
from .streaming import events, feed
from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RULES = ("(.*)_calc", "(.*)_bob_(.*)")
V = "VOL_01"
VOLS = "array_to_string(list_sort(backup_dest), ',')"


def query(sql: str | None = None, views: str = ""):
    """Registers a query over :class:`Views`, and the SQL that must give the same rows."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, *views.split())
        return f

    return add


def _vols(column: str = "backup_dest"):
    return tags.joined(F.col(column)).alias("volumes")


_ROOT = "coalesce(r.path, s.path)"
_INGEST = f"""SELECT f.checksum, f.size, {_ROOT} || '/' || regexp_extract(f.dir, '[^/]*$') || '/' || f.fname AS target_path, f.alias,
  CASE WHEN {_ROOT} IS NULL THEN 'failed' ELSE 'pending' END AS state FROM files f LEFT JOIN restore_dests r ON f.alias = r.alias LEFT JOIN sources s ON f.alias = s.alias"""


# ---------------------------------------------------------------- scans, sources, sinks


@query("SELECT alias, path, size FROM src UNION ALL SELECT alias, path, size FROM dst", "src dst")
def union_sources(v: Views) -> DataFrame:
    return v.src.select("alias", "path", "size").unionByName(v.dst.select("alias", "path", "size"))


@query(
    f"""SELECT coalesce(m.dir, d.dir) AS dir, coalesce(m.fname, d.fname) AS fname,
      CASE WHEN m.fname IS NULL THEN 'new' WHEN d.fname IS NULL THEN 'delete' WHEN m.size <> d.size OR m.mtime <> d.mtime THEN 'changed' ELSE 'keep' END AS action,
      coalesce(d.size, m.size) AS size, coalesce(d.mtime, m.mtime) AS mtime,
      CASE WHEN m.fname IS NULL OR (d.fname IS NOT NULL AND (m.size <> d.size OR m.mtime <> d.mtime)) THEN '' ELSE m.checksum END AS checksum,
      CASE WHEN m.fname IS NULL OR (d.fname IS NOT NULL AND (m.size <> d.size OR m.mtime <> d.mtime)) THEN '' ELSE {VOLS} END AS volumes
    FROM files m FULL JOIN stat d ON m.dir = d.dir AND m.fname = d.fname""",
    "files stat",
)
def stat_overlay(v: Views) -> DataFrame:
    return state.overlay(v.files, v.stat).withColumn("volumes", _vols()).drop("backup_dest")


@query("SELECT alias, dir, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(len(backup_dest)) AS BIGINT) AS n_volumes FROM files GROUP BY alias, dir", "files")
def journal_rollup(v: Views) -> DataFrame:
    """Through the journal's text: written as XML, read back, and summed."""
    read = documents.read_journal(documents.write_journal(v.files), "xml")
    return read.groupBy("alias", "dir").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"), F.sum(F.size("backup_dest")).alias("n_volumes"))


@query(f"SELECT alias, dir, fname, checksum, size, mtime, {VOLS} AS volumes FROM files", "files")
def journal_ranges(v: Views) -> DataFrame:
    """A journal on disk, a directory in each root, read in ranges that cut it anywhere."""
    place = f"{durable.shared_dir(v.spark)}/journal-{uuid.uuid4().hex}"
    documents.write_journal(v.files).select("xml").write.text(place)
    return journals.read_journals(v.spark, [place.removeprefix("file:")], 50_001).select("alias", "dir", "fname", "checksum", "size", "mtime", _vols())


@query(f"SELECT '/' || alias AS src_path, regexp_replace(dir, '^/[^/]*/', '') AS dir, fname AS name, size, CAST(mtime AS DOUBLE) AS mtime, checksum AS md5, {VOLS} AS volumes FROM files", "files")
def restore_contexts(v: Views) -> DataFrame:
    """Nested contexts on disk, read in ranges that cut them anywhere."""
    place = f"{durable.shared_dir(v.spark)}/context-{uuid.uuid4().hex}"
    rows = v.files.select(F.concat(F.lit("/"), "alias").alias("src_path"), F.regexp_replace("dir", "^/[^/]*/", "").alias("dir"), F.col("fname").alias("name"), "size", F.col("mtime").cast("double").alias("mtime"), F.col("checksum").alias("md5"), "backup_dest")
    contexts.write_contexts(rows).select("xml").write.text(place)
    return contexts.read_contexts(v.spark, [place.removeprefix("file:")], 50_001).select("src_path", "dir", "name", "size", "mtime", "md5", _vols())


@query(f"SELECT state, count(*) AS n FROM ({_INGEST}) GROUP BY state", "files sources restore_dests")
def ingest_counts(v: Views) -> DataFrame:
    """How many entries of a journal became targets, and how many have nowhere to go."""
    return restore.ingest(v.files, v.restore_dests, v.sources).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT alias, dir, fname, checksum, unnest(backup_dest) AS volume FROM files", "files")
def journal_file_dest(v: Views) -> DataFrame:
    return documents.journal_file_dest(v.files)


@query(f"SELECT dir, fname, checksum, size, mtime, {VOLS} AS volumes FROM files WHERE NOT ends_with(dir, '/de')", "files")
def directory_documents(v: Views) -> DataFrame:
    """Through the directories' documents, of which those of one language have been cut off: they read as empty."""
    docs = documents.write_directories(v.files.drop("alias"))
    cut = docs.withColumn("xml", F.when(F.col("dir").endswith("/de"), F.substring("xml", 1, 25)).otherwise(F.col("xml")))
    return documents.read_directories(cut).select("dir", "fname", "checksum", "size", "mtime", _vols())


@query("SELECT DISTINCT dir, CASE WHEN starts_with(dir, '/src2/') THEN 'delete' ELSE 'write' END AS action FROM files WHERE starts_with(dir, '/src1/') OR starts_with(dir, '/src2/')", "files")
def stale_documents(v: Views) -> DataFrame:
    """Documents to write or to delete after a scan that met other sizes in one tree and nothing of another."""
    files = v.files.drop("alias")
    now = files.filter(~F.col("dir").startswith("/src2/")).withColumn("size", F.col("size") + F.col("dir").startswith("/src1/").cast("long"))
    return documents.stale_documents(documents.write_directories(files), documents.write_directories(now)).select("dir", "action")


@query(f"SELECT dir, fname, checksum, size + CASE WHEN starts_with(dir, '/src1/') THEN 1 ELSE 0 END AS size, mtime, {VOLS} AS volumes FROM files WHERE NOT starts_with(dir, '/src2/')", "files")
def documents_on_disk(v: Views) -> DataFrame:
    """Documents of a tree on disk, written twice: after the second scan one source is gone, and the files of another are larger."""
    place = f"{durable.shared_dir(v.spark)}/documents-{uuid.uuid4().hex}".removeprefix("file://")
    files = v.files.drop("alias").withColumn("dir", F.concat(F.lit(place), "dir"))
    for r in files.select("dir").distinct().toLocalIterator():
        os.makedirs(r["dir"], exist_ok=True)
    sink.persist(files, [place])
    grown = F.col("size") + F.col("dir").startswith(f"{place}/src1/").cast("long")
    sink.persist(files.filter(~F.col("dir").startswith(f"{place}/src2/")).withColumn("size", grown), [place])
    below = F.substring("dir", len(place) + 1, 1 << 20).alias("dir")
    return documents.read_directories(sink.on_disk(v.spark, [place])).select(below, "fname", "checksum", "size", "mtime", _vols())


@query("SELECT DISTINCT dir FROM files WHERE NOT starts_with(dir, '/src1') AND NOT starts_with(dir, '/src3/e') AND NOT ends_with(dir, '/de')", "files")
def pruned_walk(v: Views) -> DataFrame:
    """Directories on disk, listed without those that prefixes and a pattern rule out, which are never read."""
    place = f"{durable.shared_dir(v.spark)}/tree-{uuid.uuid4().hex}".removeprefix("file://")
    files = v.files.drop("alias").withColumn("dir", F.concat(F.lit(place), "dir"))
    for r in files.select("dir").distinct().toLocalIterator():
        os.makedirs(r["dir"], exist_ok=True)
    sink.persist(files, [place])
    found = walk.listed(v.spark, [place], ignore=["/de/"], outside=[f"{place}/src1", f"{place}/src3/e"])
    return found.select(F.substring("dir", len(place) + 1, 1 << 20).alias("dir"))


@query("SELECT array_to_string(list_sort(list_distinct([alias, 'src1', 'src2'])), ',') AS labels FROM files", "files")
def label_set(v: Views) -> DataFrame:
    """Labels added to a list in order, each once."""
    labels = F.array(F.col("alias"))
    for label in ("src1", "src2"):
        labels = tags.added(labels, label)
    return v.files.select(F.concat_ws(",", F.array_sort(tags.added(labels, F.col("alias")))).alias("labels"))


@query(f"SELECT *, checksum || ':' || size || ':' || target_path AS task_id FROM ({_INGEST})", "files sources restore_dests")
def restore_ingest(v: Views) -> DataFrame:
    return restore.ingest(v.files, v.restore_dests, v.sources).select("checksum", "size", "target_path", "alias", "state", "task_id")


@query(
    """SELECT f.path, (SELECT arg_min(r.root, -length(r.root) * 1000 + r.seq) FROM roots r WHERE starts_with(f.path, rtrim(r.root, '/') || '/')) AS root FROM files f""",
    "files roots",
)
def volume_for_dir(v: Views) -> DataFrame:
    """The nearest root above each file."""
    return roots.source_root(v.files, v.roots, nearest=True).select("path", "root")


@query(
    """SELECT conv_id, turn, x AS value FROM (SELECT conv_id, turn, unnest(string_split(CASE turn % 3 WHEN 0 THEN '# ' WHEN 1 THEN '// ' ELSE '' END || coalesce(text, ''), chr(10))) AS x FROM conversations)
    WHERE trim(x) <> '' AND NOT starts_with(trim(x), '#') AND NOT starts_with(trim(x), '//')"""
)
def rule_lines(v: Views) -> DataFrame:
    head = F.when(F.col("turn") % 3 == 0, "# ").when(F.col("turn") % 3 == 1, "// ").otherwise("")
    lines = v.table("conversations").select("conv_id", "turn", F.explode(F.split(F.concat(head, F.coalesce("text", F.lit(""))), "\n")).alias("value"))
    return filters.rule_lines(lines)


@query("SELECT page_id, hex(encode(url)) AS as_hex, to_base64(encode(url)) AS as_base64, substr(hex(encode(url)), 1, 32) AS head FROM pages")
def dump_object(v: Views) -> DataFrame:
    """Whole objects, and their first 16 bytes."""
    data = F.encode("url", "UTF-8")
    return v.table("pages").select("page_id", codecs.dump(data, "hex").alias("as_hex"), codecs.dump(data, "base64").alias("as_base64"), codecs.dump(data, "hex", 16).alias("head"))


@query("SELECT path, length(j) AS n_bytes, size, path AS back FROM (SELECT *, '{\"Size\":' || size || ',\"FpathStr\":\"' || path || '\",\"BackupDest\":[' || array_to_string(list_transform(backup_dest, lambda x: '\"' || x || '\"'), ',') || ']}' AS j FROM files)", "files")
def payload_codec(v: Views) -> DataFrame:
    """Payloads written and read back; n_bytes is the length that stands before each."""
    stored = v.files.select("path", codecs.encode_payload(F.col("size"), F.col("path"), F.col("backup_dest")).alias("data"))
    read = stored.withColumn("p", codecs.decode_payload(F.col("data")))
    return read.select("path", (F.octet_length("data") - 4).cast("long").alias("n_bytes"), F.col("p.Size").alias("size"), F.col("p.FpathStr").alias("back"))


@query("SELECT alias, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY alias", "files")
def catalog_store(v: Views) -> DataFrame:
    """Through a stored catalog: an older version, a newer one, and what a session reads."""
    catalog = store.Catalog(v.spark, f"{durable.shared_dir(v.spark)}/catalog-{uuid.uuid4().hex}")
    files = v.files.drop("doc_id")
    catalog.write("files", files.limit(1))
    catalog.write("files", files)
    return catalog.read("files").groupBy("alias").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


@query("SELECT alias, path, size + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size FROM files WHERE doc_id % 11 <> 0 UNION ALL SELECT alias, '/more' || path, size FROM files WHERE doc_id % 13 = 0", "files")
def store_change(v: Views) -> DataFrame:
    """A stored catalog after a change: some rows replaced, some new, some gone, all else left where it was."""
    catalog = store.Catalog(v.spark, f"{durable.shared_dir(v.spark)}/catalog-{uuid.uuid4().hex}")
    files = v.files
    catalog.write("files", files.drop("doc_id"))
    larger = files.filter("doc_id % 7 = 0 AND doc_id % 11 <> 0").withColumn("size", F.col("size") + 1)
    more = files.filter("doc_id % 13 = 0").withColumn("path", F.concat(F.lit("/more"), "path"))
    catalog.change("files", put=larger.unionByName(more).drop("doc_id"), drop=files.filter("doc_id % 11 = 0").select("alias", "path"))
    return catalog.read("files").select("alias", "path", "size")


@query("SELECT count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM files", "files")
def progress_total(v: Views) -> DataFrame:
    """The counting pass before a walk."""
    return v.spark.createDataFrame([progress.amount(v.files)], "n_files long, bytes long")


# ---------------------------------------------------------------- filters


@query("SELECT path FROM (SELECT path, CASE WHEN doc_id % 9 = 0 THEN '.mdbackup.xml' ELSE fname END AS fname FROM files) WHERE fname NOT IN ('.directory.xml', '.mdcfg.xml', '.mdjournal.xml', '.mdbackup.xml', '.mdSkipDir')", "files")
def filter_metadata(v: Views) -> DataFrame:
    return filters.drop_metadata(v.files.withColumn("fname", F.when(F.col("doc_id") % 9 == 0, ".mdbackup.xml").otherwise(F.col("fname")))).select("path")


@query("SELECT path, dir FROM (SELECT path, CASE doc_id % 4 WHEN 0 THEN dir || '/.git' WHEN 1 THEN './x/..' ELSE dir END AS dir FROM files) WHERE NOT regexp_matches(dir, '(^|/)[.]([^./]|[.][^/])')", "files")
def filter_hidden(v: Views) -> DataFrame:
    d = F.when(F.col("doc_id") % 4 == 0, F.concat("dir", F.lit("/.git"))).when(F.col("doc_id") % 4 == 1, "./x/..").otherwise(F.col("dir"))
    return filters.drop_hidden(v.files.withColumn("dir", d)).select("path", "dir")


@query("SELECT path FROM files f WHERE NOT (f.dir = '/src1' OR starts_with(f.dir, '/src1/') OR f.dir = '/src2/en' OR starts_with(f.dir, '/src2/en/'))", "files")
def filter_skipdir(v: Views) -> DataFrame:
    markers = v.spark.createDataFrame([("/src1",), ("/src2/en",)], "dir string")
    return filters.drop_skipped(v.files, markers).select("path")


@query("SELECT path FROM files WHERE NOT regexp_matches(path, '7[.]txt$') AND NOT regexp_matches(path, '/src3/')", "files")
def filter_ignore(v: Views) -> DataFrame:
    return filters.drop_ignored(v.files, ["7[.]txt$", "/src3/", "(unclosed"]).select("path")


@query("SELECT doc_id, fname FROM names WHERE lower(fname) = 'doc_' || doc_id || '.txt'", "names")
def same_name(v: Views) -> DataFrame:
    """Names that are equal but for case."""
    return v.names.filter(names.same_name(F.initcap("fname"), F.concat(F.lit("DOC_"), "doc_id", F.lit(".TXT")))).select("doc_id", "fname")


@query("SELECT path, starts_with(path, '/src1/') AS below FROM files", "files")
def is_under(v: Views) -> DataFrame:
    return v.files.select("path", paths.is_under(F.col("path"), F.lit("/src1")).alias("below"))


@query(f"SELECT path FROM files WHERE list_contains(backup_dest, '{V}')", "files")
def on_volume(v: Views) -> DataFrame:
    return filters.on_volume(v.files, V).select("path")


@query("SELECT path, size FROM files WHERE NOT list_contains(backup_dest, 'VOL_02')", "files")
def not_on_volume(v: Views) -> DataFrame:
    return filters.not_on_volume(v.files, "VOL_02").select("path", "size")


@query("SELECT m.dir, m.fname, d.size, d.mtime FROM files m JOIN stat d ON m.dir = d.dir AND m.fname = d.fname WHERE m.size <> d.size OR m.mtime <> d.mtime", "files stat")
def changed_files(v: Views) -> DataFrame:
    return state.changed(v.files, v.stat)


def _lacking(v: Views) -> DataFrame:
    return v.files.withColumn("checksum", F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 13 == 0, F.lit(None)).otherwise(F.col("checksum")))


@query("SELECT path FROM files WHERE doc_id % 11 = 0 OR doc_id % 13 = 0", "files")
def missing_checksum(v: Views) -> DataFrame:
    return filters.missing_checksum(_lacking(v)).select("path")


@query("SELECT path FROM files WHERE doc_id % 17 = 0 OR size = 0", "files")
def zero_length(v: Views) -> DataFrame:
    return filters.zero_length(v.files.withColumn("size", F.when(F.col("doc_id") % 17 == 0, 0).otherwise(F.col("size")))).select("path")


@query("SELECT doc_id, fname FROM names WHERE regexp_matches(fname, '[.](go|jpg|gif|jpeg|wmv|flv|mov|mp4|mpg)$')", "names")
def known_ext(v: Views) -> DataFrame:
    return v.names.filter(names.has_known_extension(F.col("fname"))).select("doc_id", "fname")


@query("SELECT path, CAST(len(backup_dest) AS BIGINT) AS n_dest FROM files WHERE len(backup_dest) <= 2", "files")
def coverage_cap(v: Views) -> DataFrame:
    return filters.coverage_cap(v.files, 2).select("path", F.size("backup_dest").cast("long").alias("n_dest"))


@query("SELECT k.doc_id, coalesce(l.toxic, -1) AS toxic FROM documents k LEFT JOIN (SELECT doc_id, min(toxic) AS toxic FROM labels GROUP BY doc_id) l ON k.doc_id = l.doc_id")
def lookup_many(v: Views) -> DataFrame:
    return filters.lookup_many(v.table("documents").select("doc_id"), v.table("labels"), "doc_id", "toxic", -1)


@query("SELECT path FROM files f WHERE NOT EXISTS (SELECT 1 FROM stat s WHERE s.dir = f.dir AND s.fname = f.fname)", "files stat")
def missing_on_disk(v: Views) -> DataFrame:
    return state.missing_on_disk(v.files, v.stat).select("path")


@query("SELECT doc_id FROM files WHERE ends_with(rtrim(dir, '/'), '/en') OR contains(dir, '/en/')", "files")
def dir_segment(v: Views) -> DataFrame:
    return v.files.filter(paths.has_segment(F.col("dir"), "en")).select("doc_id")


@query("SELECT path, checksum || ':' || size AS content_key FROM files", "files")
def content_key(v: Views) -> DataFrame:
    return v.files.select("path", F.concat_ws(":", "checksum", F.col("size").cast("string")).alias("content_key"))


# ---------------------------------------------------------------- contents, joins, set operations

_FOLD = f"""first_vol AS (SELECT checksum, v, min(path) AS p FROM (SELECT checksum, path, unnest(backup_dest) AS v FROM {{0}}) GROUP BY ALL),
  seen AS (SELECT f.checksum, f.path, f.size, len(f.backup_dest) AS n, (SELECT count(*) FROM first_vol u WHERE u.checksum = f.checksum AND u.p < f.path) AS before FROM {{0}} f),
  folded AS (SELECT checksum, coalesce(arg_max(size, path) FILTER (WHERE n < before), arg_min(size, path)) AS size, coalesce(max(path) FILTER (WHERE n < before), min(path)) AS path FROM seen GROUP BY checksum),
  merged AS (SELECT f.checksum, f.size, f.path, coalesce((SELECT list(DISTINCT v) FROM first_vol u WHERE u.checksum = f.checksum), []) AS backup_dest FROM folded f)"""


@query(with_views("", "files", "src") + ", " + _FOLD.format("src") + f" SELECT checksum, size, path, {VOLS} AS volumes FROM merged")
def src_content(v: Views) -> DataFrame:
    return content.merge_sources(v.src).select("checksum", "size", "path", _vols())


@query(
    """SELECT f.checksum, arg_min(f.size, f.path) AS size, min(f.path) AS path, coalesce(array_to_string(list_sort(list_distinct(flatten(list(f.backup_dest)))), ','), '') AS volumes FROM dst f GROUP BY f.checksum""",
    "dst",
)
def dst_content(v: Views) -> DataFrame:
    return content.merge_destination(v.dst).select("checksum", "size", "path", _vols())


@query(
    with_views("", "src", "dst") + ", " + _FOLD.format("src") + """, d AS (SELECT checksum, arg_min(size, path) AS size, min(path) AS path FROM dst GROUP BY checksum)
    SELECT coalesce(s.checksum, d.checksum) AS checksum, s.path AS src_path, d.path AS dst_path, coalesce(s.size, d.size) AS size,
      CASE WHEN d.path IS NULL THEN 'to_copy' WHEN s.path IS NULL THEN 'orphan' ELSE 'both' END AS status FROM merged s FULL JOIN d ON s.checksum = d.checksum"""
)
def compare_sides(v: Views) -> DataFrame:
    return content.compare(content.merge_sources(v.src), content.merge_destination(v.dst))


@query("SELECT path FROM src WHERE checksum IN (SELECT checksum FROM dst)", "src dst")
def src_in_dst(v: Views) -> DataFrame:
    return content.present(v.src, v.dst).select("path")


@query("SELECT checksum, min(path) AS path FROM dst WHERE checksum NOT IN (SELECT checksum FROM src) GROUP BY checksum", "src dst")
def orphans(v: Views) -> DataFrame:
    return content.absent(content.merge_destination(v.dst), v.src).select("checksum", "path")


@query("SELECT path, checksum FROM dst WHERE checksum NOT IN (SELECT checksum FROM src)", "src dst")
def orphans_all(v: Views) -> DataFrame:
    return content.absent(v.dst, v.src).select("path", "checksum")


_TODO = with_views("", "src", "dst") + ", " + _FOLD.format("src") + ", todo AS (SELECT * FROM merged WHERE checksum NOT IN (SELECT checksum FROM dst))"


def _to_back_up(v: Views) -> DataFrame:
    return content.absent(content.merge_sources(v.src), v.dst)


@query("SELECT row_number() OVER (ORDER BY size DESC, path) AS rank, path FROM files WHERE NOT list_contains(backup_dest, 'VOL_02')", "files")
def backup_order(v: Views) -> DataFrame:
    """What a volume lacks, largest first."""
    return content.ranked(filters.not_on_volume(v.files, "VOL_02"), order=[F.col("size").desc(), F.col("path")]).select("rank", "path")


@query("SELECT row_number() OVER (ORDER BY fname, path) AS rank, path FROM files", "files")
def name_order(v: Views) -> DataFrame:
    return content.ranked(v.files, order=[F.col("fname"), F.col("path")]).select("rank", "path")


@query("SELECT row_number() OVER (ORDER BY checksum, size, path) AS rank, path FROM files", "files")
def content_order(v: Views) -> DataFrame:
    """The byte order of checksums, of which half are spelt in base64."""
    spelt = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(F.base64(F.unhex("checksum")), "=+$", "")).otherwise(F.col("checksum"))
    return content.ranked(v.files.withColumn("checksum", spelt), order=content.by_content()).select("rank", "path")


@query(
    _TODO.replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (SELECT row_number() OVER (ORDER BY len(backup_dest), size DESC, path) AS rank, size FROM todo),
    run(rank, action, space, target, tried, filling, done) AS (
      SELECT CAST(0 AS BIGINT), '', CAST((SELECT sum(size) // 2 FROM r) AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, false
      UNION ALL
      SELECT rank, CASE step WHEN 0 THEN 'skip' WHEN 1 THEN 'skip' WHEN 2 THEN 'copy' ELSE 'no_space' END, CASE WHEN step = 2 THEN space - size ELSE space END,
        CASE WHEN step = 3 THEN CASE WHEN size > 1024 THEN size // 2 ELSE 0 END ELSE target END, CASE WHEN step >= 2 THEN size ELSE tried END, filling OR step = 3, done OR step = 1
      FROM (SELECT r.rank, r.size, run.space, run.target, run.tried, run.filling, run.done,
          CASE WHEN run.done OR (run.target > 0 AND r.size > run.target) THEN 0 WHEN run.filling AND r.size > run.tried THEN 1 WHEN r.size <= run.space THEN 2 ELSE 3 END AS step
        FROM run JOIN r ON r.rank = run.rank + 1) x)
    SELECT rank, action FROM run WHERE rank > 0"""
)
def capacity_plan(v: Views) -> DataFrame:
    """What fits a volume of half of all bytes."""
    todo = content.ranked(_to_back_up(v))
    capacity = todo.agg(F.sum("size")).first()[0] or 0
    return sequential.fill_volume(todo, capacity // 2)


@query(_TODO + f" SELECT checksum, path, size, {VOLS} AS volumes FROM todo")
def to_copy(v: Views) -> DataFrame:
    return _to_back_up(v).select("checksum", "path", "size", _vols())


@query(
    f"""SELECT f.path, array_to_string(list_sort(CASE WHEN k.hit AND NOT list_contains(f.backup_dest, 'VOL_09') THEN list_append(f.backup_dest, 'VOL_09') ELSE f.backup_dest END), ',') AS volumes, coalesce(k.hit, false) AS updated
    FROM src f LEFT JOIN (SELECT DISTINCT checksum, size, true AS hit FROM dst) k ON f.checksum = k.checksum AND f.size = k.size""",
    "src dst",
)
def discover(v: Views) -> DataFrame:
    return discovery.discover(v.src, v.dst, "VOL_09").select("path", _vols(), "updated")


@query(
    """SELECT f.path, array_to_string(list_sort(CASE WHEN k.hit AND NOT list_contains(f.backup_dest, 'VOL_02') THEN list_append(f.backup_dest, 'VOL_02') ELSE f.backup_dest END), ',') AS volumes
    FROM src f LEFT JOIN (SELECT DISTINCT checksum, true AS hit FROM dst) k ON f.checksum = k.checksum""",
    "src dst",
)
def discover_md5(v: Views) -> DataFrame:
    return discovery.discover(v.src, v.dst, "VOL_02", keys=("checksum",)).select("path", _vols())


@query("SELECT count(DISTINCT (checksum, size)) AS matches, CAST(count(*) FILTER (WHERE NOT list_contains(backup_dest, 'VOL_02')) AS BIGINT) AS updates FROM src s WHERE EXISTS (SELECT 1 FROM dst d WHERE d.checksum = s.checksum AND d.size = s.size)", "src dst")
def discover_stats(v: Views) -> DataFrame:
    return discovery.statistics(v.src, v.dst, "VOL_02")


@query("SELECT f.alias, coalesce(r.path, s.path) AS root, count(*) AS n FROM files f LEFT JOIN restore_dests r ON f.alias = r.alias LEFT JOIN sources s ON f.alias = s.alias GROUP BY ALL", "files sources restore_dests")
def alias_resolve(v: Views) -> DataFrame:
    return restore.resolve_aliases(v.files, v.restore_dests, v.sources).groupBy("alias", "root").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT path, unnest(CASE WHEN len(backup_dest) = 0 THEN [NULL] ELSE backup_dest END) AS volume FROM files", "files")
def file_dest_bridge(v: Views) -> DataFrame:
    return coverage.bridge(v.files)


@query("SELECT f.path, (SELECT arg_min(r.root, r.seq) FROM roots r WHERE starts_with(f.path, rtrim(r.root, '/') || '/')) AS root FROM files f", "files roots")
def source_root(v: Views) -> DataFrame:
    return roots.source_root(v.files, v.roots).select("path", "root")


@query("SELECT CASE WHEN d.fname IS NULL THEN 'only_left' WHEN s.fname IS NULL THEN 'only_right' WHEN s.checksum = d.checksum THEN 'equal' ELSE 'different' END AS status, count(*) AS n FROM src s FULL JOIN dst d ON s.fname = d.fname GROUP BY 1", "src dst")
def dir_diff(v: Views) -> DataFrame:
    return state.difference(v.src, v.dst)


@query("SELECT checksum, size, count(*) AS n_files, min(path) AS first_path, CAST(size * (count(*) - 1) AS BIGINT) AS wasted FROM files GROUP BY checksum, size HAVING count(*) > 1", "files")
def dup_groups(v: Views) -> DataFrame:
    return content.duplicates(v.files)


@query("SELECT f.checksum, f.path FROM files f JOIN (SELECT checksum, size FROM files GROUP BY ALL HAVING count(*) > 1) g ON f.checksum = g.checksum AND f.size = g.size", "files")
def md5_clash(v: Views) -> DataFrame:
    return v.files.join(content.duplicates(v.files).select("checksum", "size"), ["checksum", "size"], "left_semi").select("checksum", "path")


@query("SELECT checksum, size, count(DISTINCT fname) AS n_names, count(*) AS n_files FROM files GROUP BY ALL HAVING count(DISTINCT fname) > 1", "files")
def collision_warn(v: Views) -> DataFrame:
    return content.collisions(v.files)


@query("SELECT checksum FROM src INTERSECT SELECT checksum FROM dst", "src dst")
def content_intersect(v: Views) -> DataFrame:
    return v.src.select("checksum").intersect(v.dst.select("checksum"))


@query("(SELECT checksum, 'src' AS side FROM src WHERE checksum NOT IN (SELECT checksum FROM dst)) UNION (SELECT checksum, 'dst' AS side FROM dst WHERE checksum NOT IN (SELECT checksum FROM src))", "src dst")
def content_except(v: Views) -> DataFrame:
    a, b = v.src.select("checksum"), v.dst.select("checksum")
    return a.subtract(b).withColumn("side", F.lit("src")).union(b.subtract(a).withColumn("side", F.lit("dst")))


@query("SELECT doc_id, array_to_string(CASE doc_id % 4 WHEN 0 THEN ['VOL_02', 'VOL_07'] WHEN 1 THEN ['VOL_01', 'VOL_02', 'VOL_07'] WHEN 2 THEN ['VOL_01', 'VOL_02', 'VOL_07'] ELSE ['VOL_01', 'VOL_02', 'VOL_03', 'VOL_07'] END, ',') AS volumes FROM documents")
def merge_dests(v: Views) -> DataFrame:
    return v.files.select("doc_id", F.array_join(tags.union(F.col("backup_dest"), F.array(F.lit("VOL_02"), F.lit("VOL_07"))), ",").alias("volumes"))


# ---------------------------------------------------------------- order


@query(_TODO + " SELECT checksum, path, size, row_number() OVER (ORDER BY len(backup_dest), size DESC, path) AS rank FROM todo WHERE len(backup_dest) <= 2")
def priority_rank(v: Views) -> DataFrame:
    """What to back up next: contents that the destination lacks, on at most two volumes, in priority order."""
    return content.ranked(filters.coverage_cap(_to_back_up(v), 2)).select("checksum", "path", "size", "rank")


@query(_TODO + " SELECT path, size FROM todo WHERE len(backup_dest) <= 2 ORDER BY len(backup_dest), size DESC, path LIMIT 20")
def priority_topk(v: Views) -> DataFrame:
    return content.prioritise(_to_back_up(v), most=2).limit(20).select("path", "size")


@query("SELECT path, row_number() OVER (ORDER BY len(backup_dest), size DESC, path) AS rank FROM files WHERE NOT list_contains(backup_dest, 'VOL_03')", "files")
def prioritize_label(v: Views) -> DataFrame:
    return content.ranked(filters.not_on_volume(v.files, "VOL_03")).select("path", "rank")


# ---------------------------------------------------------------- coverage and restore


@query("SELECT b.n AS n_dest, count(f.path) AS n_files, CAST(coalesce(sum(f.size), 0) AS BIGINT) AS bytes FROM (SELECT unnest(generate_series(0, greatest(2, (SELECT max(len(backup_dest)) FROM files)))) AS n) b LEFT JOIN files f ON len(f.backup_dest) = b.n GROUP BY b.n", "files")
def coverage_bytes(v: Views) -> DataFrame:
    return coverage.bytes_by_coverage(v.files)


@query("SELECT CAST(len(backup_dest) AS BIGINT) AS n_dest, count(*) AS n_files FROM files GROUP BY 1", "files")
def coverage_files(v: Views) -> DataFrame:
    return coverage.bytes_by_coverage(v.files, dense=False).select("n_dest", "n_files")


@query("SELECT CAST(len(backup_dest) AS BIGINT) AS n_dest, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1", "files")
def coverage_bytes_sparse(v: Views) -> DataFrame:
    return coverage.bytes_by_coverage(v.files, dense=False).select("n_dest", "bytes")


@query("SELECT alias, dir, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY ROLLUP (alias, dir)", "files")
def coverage_rollup(v: Views) -> DataFrame:
    return coverage.by_alias_and_directory(v.files)


@query("SELECT v AS volume, count(*) AS n_files FROM (SELECT unnest(backup_dest) AS v FROM files f WHERE NOT EXISTS (SELECT 1 FROM stat s WHERE s.dir = f.dir AND s.fname = f.fname)) GROUP BY v", "files stat")
def missing_by_volume(v: Views) -> DataFrame:
    return coverage.by_volume(state.missing_on_disk(v.files, v.stat))


@query("SELECT v AS volume, count(*) AS n_pending FROM (SELECT unnest(backup_dest) AS v FROM targets WHERE state = 'pending') GROUP BY v", "targets")
def pending_by_volume(v: Views) -> DataFrame:
    return restore.pending_by_volume(v.targets)


@query("SELECT state, count(DISTINCT (checksum, size)) AS n_contents, count(*) AS n_targets FROM targets GROUP BY state", "targets")
def pending_content(v: Views) -> DataFrame:
    return restore.contents(v.targets)


@query("SELECT checksum, size, count(*) AS n_targets, min(target_path) AS first_target, coalesce(array_to_string(list_sort(list_distinct(flatten(list(backup_dest)))), ','), '') AS volumes FROM targets GROUP BY ALL", "targets")
def restore_nodes(v: Views) -> DataFrame:
    return restore.nodes(v.targets).select("checksum", "size", "n_targets", "first_target", _vols())


@query("SELECT d.source, t.target_path, t.task_id FROM (SELECT checksum, size, min(path) AS source FROM dst GROUP BY ALL) d JOIN targets t ON d.checksum = t.checksum AND d.size = t.size WHERE t.state = 'pending'", "dst targets")
def copy_once(v: Views) -> DataFrame:
    return restore.copy_once(v.dst, v.targets).select("source", "target_path", "task_id")


@query("SELECT d.path AS source, t.target_path, t.task_id FROM dst d JOIN targets t ON d.checksum = t.checksum AND d.size = t.size WHERE t.state = 'pending'", "dst targets")
def copy_plan(v: Views) -> DataFrame:
    return restore.copy_plan(v.dst, v.targets).select("source", "target_path", "task_id")


@query(
    """SELECT count(*) FILTER (WHERE k.n IS NOT NULL) AS matched, count(*) FILTER (WHERE k.n IS NULL) AS unmatched, CAST(coalesce(sum(k.n), 0) AS BIGINT) AS operations
    FROM dst d LEFT JOIN (SELECT checksum, size, count(*) AS n FROM targets WHERE state = 'pending' GROUP BY ALL) k ON d.checksum = k.checksum AND d.size = k.size""",
    "dst targets",
)
def scan_stats(v: Views) -> DataFrame:
    return restore.scan_statistics(v.dst, v.targets)


@query("SELECT s.path AS wanted, min(d.path) AS local_path FROM src s JOIN dst d ON s.checksum = d.checksum AND s.size = d.size WHERE s.path NOT IN (SELECT path FROM dst) GROUP BY s.path", "src dst")
def populate_plan(v: Views) -> DataFrame:
    return restore.populate(v.src, v.dst).select("wanted", "local_path")


def _actions(v: Views) -> DataFrame:
    on_disk = v.dst.select("alias", "dir", "fname", F.when(F.col("doc_id") % 2 == 0, F.col("checksum")).otherwise("other").alias("checksum"))
    return restore.actions(v.files, on_disk, ["VOL_02"])


_ACTIONS = """SELECT f.path, f.backup_dest, CASE WHEN f.doc_id % 6 = 0 THEN 'skip' WHEN list_contains(f.backup_dest, 'VOL_02') THEN 'copy' ELSE 'missing_volume' END AS action FROM files f"""


@query(f"SELECT path, action FROM ({_ACTIONS})", "files")
def restore_actions(v: Views) -> DataFrame:
    return _actions(v).select("path", "action")


@query(f"SELECT DISTINCT unnest(backup_dest) AS volume FROM ({_ACTIONS}) WHERE action = 'missing_volume'", "files")
def missing_volumes(v: Views) -> DataFrame:
    return restore.missing_volumes(_actions(v))


@query(f"SELECT action, count(*) AS n FROM ({_ACTIONS}) GROUP BY action", "files")
def restore_summary(v: Views) -> DataFrame:
    return _actions(v).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT dir) AS n_dirs, count(*) AS n_files FROM files", "files")
def dir_counts(v: Views) -> DataFrame:
    return coverage.directories(v.files)


@query("SELECT dir, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT dir, size FROM files UNION ALL SELECT '/' || split_part(dir, '/', 2), size FROM files) GROUP BY dir", "files")
def dir_tree(v: Views) -> DataFrame:
    return coverage.tree(v.files)


_DEEP = "SELECT *, dir || '/' || array_to_string(list_transform(range(1, 9), lambda i: translate(substr(md5(path), i, 1), '0123456789abcdef', 'aaaaaaaabbbbbbbb')), '/') AS deep FROM files"


def _deep(v: Views) -> DataFrame:
    letters = F.split(F.translate(F.substring(F.md5("path"), 1, 8), "0123456789abcdef", "aaaaaaaabbbbbbbb"), "")
    return v.files.withColumn("dir", F.concat_ws("/", "dir", F.array_join(F.filter(letters, lambda c: c != ""), "/")))


@query(
    f"""WITH RECURSIVE own AS ({_DEEP}), t(place, size) AS (SELECT deep, size FROM own UNION ALL SELECT regexp_replace(place, '/[^/]*$', ''), size FROM t WHERE regexp_replace(place, '/[^/]*$', '') <> ''),
    d AS (SELECT place AS dir, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM t GROUP BY place)
    SELECT d.*, (SELECT count(*) FROM d AS c WHERE regexp_replace(c.dir, '/[^/]*$', '') = d.dir) AS n_dirs FROM d""",
    "files",
)
def nested_tree(v: Views) -> DataFrame:
    """Trees ten levels deep, nested in documents that none is long of, and what every directory in them says."""
    return nesting.flatten(nesting.nest(_deep(v), 20_000))[1]


@query(f"SELECT deep AS dir, fname, checksum, size, mtime, {VOLS} AS volumes FROM ({_DEEP})", "files")
def nested_files(v: Views) -> DataFrame:
    """The files of nested trees."""
    return nesting.flatten(nesting.nest(_deep(v), 20_000))[0].select("dir", "fname", "checksum", "size", "mtime", _vols())


# ---------------------------------------------------------------- scalar functions


@query("SELECT doc_id, rtrim(to_base64(unhex(md5(text))), '=') AS checksum FROM documents")
def checksum_b64(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", checksums.md5_base64(F.col("text")).alias("checksum"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE md5(text) END AS checksum FROM documents")
def checksum_norm(v: Views) -> DataFrame:
    t = F.col("text")
    spelt = F.when(F.col("doc_id") % 3 == 0, F.upper(F.md5(t))).when(F.col("doc_id") % 3 == 1, checksums.md5_base64(t)).otherwise("no checksum")
    return v.table("documents").select("doc_id", checksums.canonical(spelt).alias("checksum"))


@query("SELECT path, fname AS base, dir AS parent, regexp_replace(path, '^/[^/]*/', '') AS below FROM files", "files")
def path_parts(v: Views) -> DataFrame:
    p = F.col("path")
    return v.files.select("path", paths.base(p).alias("base"), paths.parent(p).alias("parent"), paths.relative(p, F.concat(F.lit("/"), F.col("alias"))).alias("below"))


_REL = "substr(path, length('/' || alias) + 2)"


@query(f"SELECT path, '/backup/' || {_REL} AS target FROM files", "files")
def dest_path(v: Views) -> DataFrame:
    return roots.destination_path(v.files.withColumn("root", F.concat(F.lit("/"), F.col("alias"))), "/backup").select("path", "target")


@query(f"SELECT path, '/backup/' || alias || '/' || {_REL} AS target FROM files", "files")
def dest_path_py(v: Views) -> DataFrame:
    return roots.destination_path(v.files.withColumn("root", F.concat(F.lit("/"), F.col("alias"), F.lit("/"))), "/backup", True).select("path", "target")


_STRIPPED = "regexp_replace(fname, '([.](go|jpg|gif|jpeg|wmv|flv|mov|mp4|mpg))+$', '')"


@query(f"SELECT doc_id, regexp_replace({_STRIPPED}, '[(][0-9]+[)]$', '') AS name FROM names", "names")
def strip_number(v: Views) -> DataFrame:
    return v.names.select("doc_id", names.strip_number(names.strip_extensions(F.col("fname"))).alias("name"))


@query(f"SELECT doc_id, {_STRIPPED} AS name, regexp_extract(fname, '[.](go|jpg|gif|jpeg|wmv|flv|mov|mp4|mpg)$') AS ext FROM names", "names")
def strip_ext(v: Views) -> DataFrame:
    return v.names.select("doc_id", names.strip_extensions(F.col("fname")).alias("name"), names.last_extension(F.col("fname")).alias("ext"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(fname || '. ', '[.]{2,}', '.', 'g'), ' {2,}', ' ', 'g'), '[.]$', ''), ' $', '') AS name FROM names", "names")
def squeeze(v: Views) -> DataFrame:
    return v.names.select("doc_id", names.squeeze(F.concat("fname", F.lit(". "))).alias("name"))


@query("SELECT doc_id, CASE WHEN contains(fname, '_calc') THEN split_part(fname, '_calc', 1) ELSE fname END AS name FROM names", "names")
def rename_rules(v: Views) -> DataFrame:
    return v.names.select("doc_id", names.rename_by_rules(F.col("fname"), RULES).alias("name"))


_STEM = """CASE WHEN contains(bare, '_calc') THEN split_part(bare, '_calc', 1) ELSE bare END"""
_SQUEEZED = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_STEM}, '[.]{{2,}}', '.', 'g'), ' {{2,}}', ' ', 'g'), '[.]$', ''), ' $', '')"


@query(
    with_views("", "names") + f""", parts AS (SELECT dir, fname, regexp_replace({_STRIPPED}, '[(][0-9]+[)]$', '') AS bare, regexp_extract(fname, '[.](go|jpg|gif|jpeg|wmv|flv|mov|mp4|mpg)$') AS ext FROM names),
    wanted AS (SELECT dir, fname, {_SQUEEZED} AS stem, ext FROM parts WHERE ext <> ''),
    claims AS (SELECT *, row_number() OVER (PARTITION BY dir, stem, ext ORDER BY fname) AS place FROM wanted WHERE stem || ext <> fname),
    slots AS (SELECT g.dir, g.stem, g.ext, n FROM (SELECT dir, stem, ext, count(*) AS c FROM claims GROUP BY ALL) g, range(-1, 2000) t(n) WHERE n < 2 * c + 20),
    free AS (SELECT s.dir, s.stem, s.ext, CASE WHEN n >= 0 THEN n END AS free, row_number() OVER (PARTITION BY s.dir, s.stem, s.ext ORDER BY n) AS place FROM slots s
      WHERE NOT EXISTS (SELECT 1 FROM names x WHERE x.dir = s.dir AND x.fname = s.stem || CASE WHEN n >= 0 THEN '(' || n || ')' ELSE '' END || s.ext))
    SELECT dir, fname, CASE WHEN free IS NULL THEN stem || ext ELSE stem || '(' || free || ')' || ext END AS new_name FROM (
      SELECT c.*, f.free FROM claims c JOIN free f ON f.dir = c.dir AND f.stem = c.stem AND f.ext = c.ext AND f.place = c.place)"""
)
def rename_plan(v: Views) -> DataFrame:
    return sequential.rename_plan(v.names, RULES)


@query("SELECT doc_id, CAST(CASE WHEN strlen(dir) > 8 THEN 2 ELSE 0 END - CASE WHEN strlen(fname) > 10 THEN 1 ELSE 0 END AS INTEGER) AS score FROM files", "files")
def score_pair(v: Views) -> DataFrame:
    return v.files.select("doc_id", names.pair_score(F.col("dir"), F.col("fname"), F.lit("/src1/en"), F.lit("doc_10.txt")).alias("score"))


@query("SELECT doc_id, CASE WHEN b >= 1024 * 1024 THEN printf('%.2f MiB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.2f KiB', b / 1024.0) ELSE printf('%.2f B', CAST(b AS DOUBLE)) END AS human FROM (SELECT doc_id, n_chars * (doc_id % 500) AS b FROM documents)")
def human_bytes(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", units.human_bytes(F.col("n_chars") * (F.col("doc_id") % 500)).alias("human"))


@query("SELECT doc_id, CAST(least((n_chars * n_chars * 1000000) // 1024, 2147483647) AS INTEGER) AS kib FROM documents")
def size_kib(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", units.kib_clamped(F.col("n_chars") * F.col("n_chars") * 1000000).alias("kib"))


@query("SELECT doc_id, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d %H:%M:%S') AS changed FROM files", "files")
def mtime_ts(v: Views) -> DataFrame:
    return v.files.select("doc_id", F.date_format(units.seconds_to_timestamp(F.col("mtime")), "yyyy-MM-dd HH:mm:ss").alias("changed"))


@query("SELECT doc_id, doc_id % 2 = 0 AS valid FROM documents")
def valid_volume_id(v: Views) -> DataFrame:
    m = F.md5("text")
    uuid = F.concat_ws("-", *(F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return v.table("documents").select("doc_id", names.is_volume_id(F.when(F.col("doc_id") % 2 == 0, uuid).otherwise(m)).alias("valid"))


@query("SELECT doc_id, list_contains(backup_dest, 'VOL_01') AS has, array_to_string(list_sort(list_distinct(list_append(backup_dest, 'VOL_02'))), ',') AS more, coalesce(array_to_string(list_sort(list_filter(backup_dest, lambda x: x <> 'VOL_01')), ','), '') AS less FROM files", "files")
def tag_ops(v: Views) -> DataFrame:
    b = F.col("backup_dest")
    return v.files.select("doc_id", tags.has(b, V).alias("has"), tags.joined(tags.added(b, "VOL_02")).alias("more"), tags.joined(tags.removed(b, V)).alias("less"))


# ---------------------------------------------------------------- state changes


def _computed(v: Views) -> DataFrame:
    return v.files.filter("doc_id % 4 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.md5("path")).otherwise(F.col("checksum")).alias("new_checksum"))


@query(f"SELECT path, CASE WHEN doc_id % 4 <> 0 AND doc_id % 5 = 0 THEN md5(path) ELSE checksum END AS checksum, CASE WHEN doc_id % 4 <> 0 AND doc_id % 5 = 0 THEN '' ELSE {VOLS} END AS volumes FROM files", "files")
def recalc(v: Views) -> DataFrame:
    return state.recalculate(v.files, _computed(v)).select("path", "checksum", _vols())


@query("SELECT path FROM files WHERE doc_id % 4 <> 0 AND doc_id % 5 = 0", "files")
def validate(v: Views) -> DataFrame:
    return state.mismatches(v.files, _computed(v)).select("path")


@query("SELECT path, 0 AS n_dest FROM files", "files")
def scrub(v: Views) -> DataFrame:
    return state.scrub(v.files).select("path", F.size("backup_dest").alias("n_dest"))


@query("SELECT f.path, CASE WHEN f.doc_id % 11 = 0 OR f.doc_id % 13 = 0 THEN rtrim(to_base64(unhex(f.checksum)), '=') ELSE f.checksum END AS checksum FROM files f", "files")
def fill_checksum(v: Views) -> DataFrame:
    contents = v.files.select("path", "doc_id").join(v.table("documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    return state.fill_checksums(_lacking(v), contents).select("path", "checksum")


@query("SELECT path FROM files f WHERE EXISTS (SELECT 1 FROM stat s WHERE s.dir = f.dir AND s.fname = f.fname)", "files stat")
def prune(v: Views) -> DataFrame:
    return state.prune(v.files, v.stat).select("path")


@query("SELECT path, array_to_string(list_sort(CASE WHEN doc_id % 3 = 0 AND NOT list_contains(backup_dest, 'VOL_03') THEN list_append(backup_dest, 'VOL_03') ELSE backup_dest END), ',') AS volumes FROM files", "files")
def apply_copies(v: Views) -> DataFrame:
    return state.apply_copies(v.files, v.dst.select("path"), "VOL_03").select("path", _vols())


@query("SELECT path, dir, fname, array_to_string(list_sort(list_distinct(CASE WHEN doc_id % 3 = 0 THEN list_append(backup_dest, 'VOL_03') ELSE backup_dest END)), ',') AS volumes, mtime FROM files UNION ALL SELECT '/vol3' || path, '/vol3' || dir, fname, array_to_string(list_sort(list_distinct(list_append(backup_dest, 'VOL_03'))), ','), mtime + 5 FROM files WHERE doc_id % 3 = 0", "files")
def record_copies(v: Views) -> DataFrame:
    """Sources tagged and rows added at the destination."""
    done = v.targets.filter("doc_id % 3 = 0").select("doc_id").join(v.files, "doc_id").select("path", F.concat(F.lit("/vol3"), "path").alias("target"), (F.col("mtime") + 5).alias("mtime"))
    return state.record_copies(v.files, done, "VOL_03").select("path", "dir", "fname", _vols(), "mtime")


_CHECK = "CASE WHEN doc_id % 4 <> 0 AND doc_id % 5 = 0 THEN md5(path) ELSE checksum END"


@query(
    f"""SELECT dir || '/' || fname AS path, CASE WHEN m IS NULL THEN 'new' WHEN d IS NULL THEN 'delete' WHEN NOT kept THEN 'changed' WHEN other THEN 'mismatch' ELSE 'keep' END AS action,
      CASE WHEN m IS NULL THEN '' WHEN d IS NOT NULL AND (other OR NOT kept) THEN coalesce(fresh, CASE WHEN kept THEN checksum ELSE '' END) ELSE checksum END AS checksum FROM (
      SELECT coalesce(f.dir, s.dir) AS dir, coalesce(f.fname, s.fname) AS fname, f.doc_id AS m, s.mtime AS d, f.size = s.size AND f.mtime = s.mtime AS kept, f.checksum,
        CASE WHEN f.doc_id % 4 <> 0 THEN {_CHECK} END AS fresh, f.doc_id % 4 <> 0 AND f.doc_id % 5 = 0 AS other
      FROM files f FULL JOIN stat s ON f.dir = s.dir AND f.fname = s.fname)""",
    "files stat",
)
def check_run(v: Views) -> DataFrame:
    """A rescan that recomputes every checksum."""
    return state.check(v.files, v.stat, _computed(v), recompute=True).select("path", "action", "checksum")


@query("SELECT task_id, CASE WHEN doc_id % 3 = 0 THEN 'copied' ELSE state END AS state FROM targets", "targets")
def move_to_copied(v: Views) -> DataFrame:
    return restore.move_to_copied(v.targets, v.targets.filter("doc_id % 3 = 0").select("task_id")).select("task_id", "state")


@query("SELECT alias, path, size FROM files WHERE doc_id % 3 <> 0 UNION ALL SELECT alias, path, size + 1 FROM dst", "dst")
def upsert(v: Views) -> DataFrame:
    scanned = v.dst.withColumn("size", F.col("size") + 1)
    return state.upsert(v.src, scanned).select("alias", "path", "size")


@query("SELECT path FROM files WHERE alias NOT IN (SELECT alias FROM dst WHERE alias < 'src3') OR (doc_id % 3 = 0 AND alias < 'src3')", "dst")
def mark_sweep(v: Views) -> DataFrame:
    return state.sweep(v.files, v.dst.filter("alias < 'src3'")).select("path")


_MOVE = "SELECT path AS {0}, size % 100 AS size, 'f' || (doc_id % 7) AS fname, row_number() OVER (PARTITION BY size % 100, doc_id % 7 ORDER BY path) AS nth FROM {1}"


@query(f"SELECT o.size, o.fname, old_path, new_path FROM ({_MOVE.format('old_path', 'src')}) o JOIN ({_MOVE.format('new_path', 'dst')}) n ON o.size = n.size AND o.fname = n.fname AND o.nth = n.nth", "src dst")
def move_detect(v: Views) -> DataFrame:
    keyed = lambda f: f.withColumn("size", F.col("size") % 100).withColumn("fname", F.concat(F.lit("f"), F.col("doc_id") % 7))
    return state.moved(keyed(v.src), keyed(v.dst)).drop("nth")


_WINS = " ".join(
    f"{sign} {n} * (CASE WHEN {test} THEN 1 ELSE 0 END)"
    for sign, n, test in (
        ("+", 2, "strlen(b.d) > strlen(a.d)"), ("-", 2, "strlen(a.d) > strlen(b.d)"), ("-", 1, "strlen(b.f) > strlen(a.f)"), ("+", 1, "strlen(a.f) > strlen(b.f)"),
        ("-", 2, "ends_with(rtrim(b.d, '/'), '/to') OR contains(b.d, '/to/')"), ("+", 2, "ends_with(rtrim(a.d, '/'), '/to') OR contains(a.d, '/to/')"),
        ("+", 2, "ends_with(rtrim(b.d, '/'), '/favs') OR contains(b.d, '/favs/')"), ("-", 2, "ends_with(rtrim(a.d, '/'), '/favs') OR contains(a.d, '/favs/')"),
    )
)


@query(
    f"""SELECT checksum, size, best.p AS path, n_files FROM (SELECT checksum, size, count(*) AS n_files,
      list_reduce(list({{'d': dir, 'f': fname, 'p': path}} ORDER BY path), lambda a, b: CASE WHEN 0 {_WINS} > 0 THEN b ELSE a END) AS best FROM files GROUP BY checksum, size HAVING count(*) > 1)""",
    "files",
)
def dup_keep(v: Views) -> DataFrame:
    return sequential.keep_best(v.files)


@query(
    """SELECT src_path, filename, size, volumes FROM (SELECT '/' || source AS src_path, lang || '/doc_' || doc_id || '.txt' AS filename, n_chars AS size, array_to_string(list_slice(['VOL_01', 'VOL_02', 'VOL_03'], 1, doc_id % 4), ',') AS volumes FROM documents)
    UNION ALL SELECT '/pages', 'page_' || page_id, CAST(length(html) AS BIGINT), '' FROM pages"""
)
def add_context(v: Views) -> DataFrame:
    """A restore context of the pages beside the catalog's files."""
    known = v.files.select(F.concat(F.lit("/"), "alias").alias("src_path"), paths.relative(F.col("path"), F.concat(F.lit("/"), "alias")).alias("filename"), "size", "mtime", F.col("checksum").alias("md5"), "backup_dest")
    pages = v.table("pages").select(F.lit("/pages").alias("src_path"), F.lit("").alias("dir"), F.concat(F.lit("page_"), "page_id").alias("name"), F.length("html").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.md5("html").alias("md5"), F.array().cast("array<string>").alias("backup_dest"))
    return restore.add_context(known, pages).select("src_path", "filename", "size", _vols())


@query(
    """SELECT f.path AS source, NULL AS target, 'empty' AS reason FROM files f WHERE f.size = 0
    UNION ALL SELECT f.path, k.p, 'duplicate' FROM files f JOIN (SELECT checksum, size, min(path) AS p FROM files GROUP BY ALL HAVING count(*) > 1) k ON f.checksum = k.checksum AND f.size = k.size WHERE f.path <> k.p AND f.size > 0
    UNION ALL SELECT path, NULL, 'orphan' FROM dst WHERE checksum NOT IN (SELECT checksum FROM src)""",
    "src dst",
)
def delete_plan(v: Views) -> DataFrame:
    kept = content.duplicates(v.files).select("checksum", "size", F.col("first_path").alias("path"))
    return tables.deletions(v.files, kept, content.absent(v.dst, v.src)).select("source", "target", "reason")


@query("SELECT path AS source, '/all/' || f AS target, count(*) OVER (PARTITION BY f) > 1 AS clash FROM (SELECT path, 'doc_' || (doc_id % 900) || '.txt' AS f FROM files)", "files")
def concentrate(v: Views) -> DataFrame:
    return tables.concentrate(v.files.withColumn("fname", F.concat(F.lit("doc_"), F.col("doc_id") % 900, F.lit(".txt"))), "/all")


# ---------------------------------------------------------------- tuner

_THROUGHPUT = "tp AS (SELECT date_trunc('hour', ts) AS ts, tokens, sum(bytes) / 3600 AS throughput FROM samples GROUP BY ALL HAVING sum(bytes) > 0)"
_SERIES = _THROUGHPUT + ", series AS (SELECT *, row_number() OVER (PARTITION BY tokens % 2 ORDER BY ts, tokens) AS seq, tokens % 2 AS track FROM tp)"


def _series(v: Views) -> DataFrame:
    from pyspark.sql import Window

    tp = tuning.throughput(v.samples)
    return tp.withColumn("track", F.col("tokens") % 2).withColumn("seq", F.row_number().over(Window.partitionBy("track").orderBy("ts", "tokens")).cast("long"))


@query(with_views("", "samples") + ", " + _THROUGHPUT + " SELECT strftime(ts, '%Y-%m-%d %H') AS hour, tokens, round(throughput, 6) AS throughput FROM tp")
def throughput(v: Views) -> DataFrame:
    return tuning.throughput(v.samples).select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "tokens", F.round("throughput", 6).alias("throughput"))


@query(with_views("", "samples") + ", " + _SERIES + " SELECT track, seq, round((throughput - lag(throughput) OVER w) / lag(throughput) OVER w * 100, 4) AS change FROM series WINDOW w AS (PARTITION BY track ORDER BY seq)")
def tuner_change(v: Views) -> DataFrame:
    return tuning.changes(_series(v), ["track"]).select("track", "seq", F.round("change", 4).alias("change"))


@query(
    with_views("", "samples") + ", " + _SERIES + """, b AS (SELECT track, seq, max(throughput) OVER (PARTITION BY track ORDER BY seq) AS best FROM series)
    SELECT b.track, b.seq, round(b.best, 6) AS best, (SELECT arg_min(s.tokens, s.seq) FROM series s WHERE s.track = b.track AND s.throughput = b.best AND s.seq <= b.seq) AS best_tokens FROM b"""
)
def tuner_best(v: Views) -> DataFrame:
    return tuning.best_so_far(_series(v), ["track"]).select("track", "seq", F.round("best", 6).alias("best"), "best_tokens")


@query(
    with_views("", "samples").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _SERIES + """, run(track, seq, action, now, last_tokens, before, best, best_tokens, frozen) AS (
      SELECT track, CAST(0 AS BIGINT), '', 1, 0, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), 1, false FROM (SELECT DISTINCT track FROM series)
      UNION ALL
      SELECT track, seq, CASE step WHEN 0 THEN 'hold' WHEN 1 THEN CASE WHEN now >= 16 THEN 'hold' ELSE 'increase' END WHEN 2 THEN 'freeze' ELSE 'hold' END,
        CASE WHEN step = 1 AND now < 16 THEN now + 1 WHEN step = 2 THEN top_tokens ELSE now END, tokens, throughput, top, top_tokens, frozen OR step = 2
      FROM (SELECT *, CASE WHEN frozen THEN 0 WHEN before IS NULL THEN 1 WHEN tokens > last_tokens AND (throughput - before) / before * 100 > 0.01 THEN 1
            WHEN (throughput - before) / before * 100 < -1 THEN 2 WHEN (throughput - top) / top * 100 > 0.02 THEN 1 ELSE 3 END AS step
        FROM (SELECT s.track, s.seq, s.tokens, s.throughput, run.now, run.last_tokens, run.before, run.frozen, greatest(run.best, s.throughput) AS top, CASE WHEN s.throughput > run.best THEN s.tokens ELSE run.best_tokens END AS top_tokens
          FROM run JOIN series s ON s.track = run.track AND s.seq = run.seq + 1) x) y)
    SELECT track, seq, action, now AS tokens FROM run WHERE seq > 0"""
)
def tuner_decision(v: Views) -> DataFrame:
    """The feedback loop over each series."""
    return tuning.feedback(_series(v), "track")


def _tuner_stream(v: Views) -> DataFrame:
    place = f"{durable.shared_dir(v.spark)}/series-{uuid.uuid4().hex}"
    series = _series(v).select("track", "seq", "tokens", "throughput")
    series.write.parquet(place)
    return events.drain(tuning.stream_feedback(v.spark.readStream.schema(series.schema).parquet(place), "track"), "append")


@query(ORACLE_SQL["tuner_decision"])
def tuner_stream(v: Views) -> DataFrame:
    """The same loop as a stream with state."""
    return _tuner_stream(v)


@query(
    with_views("", "samples") + ", " + _SERIES + """, c AS (SELECT *, (throughput - lag(throughput) OVER w) / lag(throughput) OVER w * 100 AS change FROM series WINDOW w AS (PARTITION BY track ORDER BY seq))
    SELECT track, seq, CASE WHEN change IS NULL OR change > 1 THEN CASE WHEN tokens >= 7 THEN 'hold' ELSE 'increase' END WHEN change < -1 THEN 'freeze' ELSE 'hold' END AS action FROM c"""
)
def tuner_decision_simple(v: Views) -> DataFrame:
    s = tuning.changes(tuning.best_so_far(_series(v), ["track"]), ["track"])
    d = tuning.simple_decision(F.col("change"), F.col("tokens"), F.col("best_tokens"), 7)
    return s.select("track", "seq", d["action"].alias("action"))


@query(with_views("", "samples") + ", " + _THROUGHPUT + """, o AS (SELECT row_number() OVER (ORDER BY ts, tokens) AS seq, tokens, throughput FROM tp)
    SELECT seq, round((throughput - lag(throughput) OVER w) / lag(throughput) OVER w * 100, 4) AS change, round(max(throughput) OVER w, 6) AS best FROM o WINDOW w AS (ORDER BY seq)""")  # fmt: skip
def tuner_one_series(v: Views) -> DataFrame:
    """All throughputs as one series: its changes and its best so far."""
    tp = content.ranked(tuning.throughput(v.samples), "seq", [F.col("ts").asc(), F.col("tokens").asc()])
    return tuning.best_so_far(tuning.changes(tp)).select("seq", F.round("change", 4).alias("change"), F.round("best", 6).alias("best"))


@query(
    """SELECT seq, CASE WHEN b IS NOT NULL AND b <> '' AND path <> b AND NOT starts_with(path, b || '/') THEN b END AS closed
    FROM (SELECT doc_id AS seq, dir AS path, lag(dir) OVER (ORDER BY doc_id) AS b FROM files)""",
    "files",
)
def path_close_one(v: Views) -> DataFrame:
    """All visits as one session."""
    return sequential.closed_paths(v.files.select(F.col("doc_id").alias("seq"), F.col("dir").alias("path")), None).select("seq", "closed")


@query(
    f"""SELECT path, CASE WHEN size % 5 = 0 THEN 'delete' WHEN size % 2 = 1 THEN 'changed' ELSE 'keep' END AS action, size + CASE WHEN size % 5 <> 0 AND size % 2 = 1 THEN 1 ELSE 0 END AS size, {VOLS} AS volumes FROM files""",
    "files",
)
def visit_rows(v: Views) -> DataFrame:
    """A visitor that deletes some rows, makes odd sizes even, and gives others back as they are."""

    def visitor(row: dict) -> dict | str | None:
        if row["size"] % 5 == 0:
            return visit.DELETE
        return {"size": row["size"] + row["size"] % 2} if row["size"] % 3 else {"size": row["size"] + 1} if row["size"] % 2 else visit.IGNORE

    return visit.mutate(v.files, visitor).select("path", "action", "size", _vols())


@query(
    """SELECT session, seq, CASE WHEN b IS NOT NULL AND b <> '' AND path <> b AND NOT starts_with(path, b || '/') THEN b END AS closed
    FROM (SELECT alias AS session, doc_id AS seq, dir AS path, lag(dir) OVER (PARTITION BY alias ORDER BY doc_id) AS b FROM files)""",
    "files",
)
def path_close(v: Views) -> DataFrame:
    return sequential.closed_paths(v.files.select(F.col("alias").alias("session"), F.col("doc_id").alias("seq"), F.col("dir").alias("path"))).select("session", "seq", "closed")


# ---------------------------------------------------------------- streams (extensions)


@query("SELECT strftime(time_bucket(INTERVAL 30 minutes, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_tumbling(v: Views) -> DataFrame:
    out = events.drain(events.tumbling(events.read_stream(v.spark, f"{v.sf_dir}/events.parquet")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 minutes, ts), time_bucket(INTERVAL 30 minutes, ts) - INTERVAL 30 minutes]) AS s FROM events) GROUP BY s")
def stream_sliding(v: Views) -> DataFrame:
    out = events.drain(events.sliding(events.read_stream(v.spark, f"{v.sf_dir}/events.parquet")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query(
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (
      SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (
        SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= ts - INTERVAL 30 minutes THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k"""
)
def stream_session(v: Views) -> DataFrame:
    out = events.drain(events.sessions(events.read_stream(v.spark, f"{v.sf_dir}/events.parquet")))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(v: Views) -> DataFrame:
    seen = events.first_seen(events.read_stream(v.spark, f"{v.sf_dir}/events.parquet"), ["user_id", "event_type"], "3650 days")
    return events.drain(seen, "append")


@query("SELECT DISTINCT checksum, size FROM files", "files")
def stream_contents(v: Views) -> DataFrame:
    """The catalog as a stream in which every content comes once."""
    place = f"{durable.shared_dir(v.spark)}/contents-{uuid.uuid4().hex}"
    rows = v.files.select(F.timestamp_seconds("mtime").alias("ts"), "checksum", "size")
    rows.write.parquet(place)
    return events.drain(events.first_seen(v.spark.readStream.schema(rows.schema).parquet(place), ["checksum", "size"], "3650 days"), "append")


@query(
    """SELECT CAST(1 AS BIGINT) AS scan, 'created' AS change, dir, fname, size, mtime FROM files UNION ALL
    SELECT 2, CASE WHEN f.fname IS NULL THEN 'created' WHEN s.fname IS NULL THEN 'deleted' ELSE 'changed' END, coalesce(s.dir, f.dir), coalesce(s.fname, f.fname), coalesce(s.size, f.size), coalesce(s.mtime, f.mtime)
    FROM files f FULL JOIN stat s ON s.dir = f.dir AND s.fname = f.fname WHERE f.fname IS NULL OR s.fname IS NULL OR f.size <> s.size OR f.mtime <> s.mtime""",
    "files stat",
)
def change_feed(v: Views) -> DataFrame:
    """Two states of the catalog as two scans, with a restart of the feed between them."""
    place = f"{durable.shared_dir(v.spark)}/feed-{uuid.uuid4().hex}"
    out = []
    for scan, files in ((1, v.files), (2, v.stat)):
        rows = feed.as_scan(files, scan)
        rows.write.mode("append").parquet(f"{place}/scans")
        out.append(events.drain(feed.changes(v.spark.readStream.schema(rows.schema).parquet(f"{place}/scans")), "append", f"{place}/feed"))
    return out[0].unionByName(out[1])
