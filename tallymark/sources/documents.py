"""Directory documents, journals and restore contexts as XML, read by Spark and written by Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "_fname string, _checksum string, _mtime bigint, _size bigint, _bd string, tag array<string>, bd array<string>"
DIRECTORY = f"_dir string, fr array<struct<{ENTRY}>>"
JOURNAL = f"mdj array<struct<_alias string, dr array<struct<{DIRECTORY}>>>>"


_DOCUMENT = r"^\s*(<\?xml[^>]*\?>)?\s*<dr\b"


def entries(nested: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the fields of entries (fr, parsed by ENTRY)."""
    none = F.array().cast("array<string>")
    attribute = F.when(F.coalesce(F.col("fr._bd"), F.lit("")) != "", F.split("fr._bd", ",")).otherwise(none)
    return nested.select(
        *keep, F.col("fr._fname").alias("fname"), F.col("fr._checksum").alias("checksum"), F.col("fr._size").alias("size"), F.coalesce("fr._mtime", F.lit(0)).alias("mtime"),
        F.coalesce("fr.tag", none).alias("tags"), F.array_union(attribute, F.coalesce("fr.bd", none)).alias("backup_dest"),
    )


def read_directories(documents: DataFrame, xml: str = "xml", dir_: str = "dir") -> DataFrame:
    """Files of directory documents (dir, xml).  A document that can't be parsed has none; unknown attributes don't count."""
    parsed = documents.select(F.col(dir_).alias("dir"), F.from_xml(F.col(xml), DIRECTORY, {"mode": "PERMISSIVE"}).alias("d"))
    return entries(parsed.select("dir", F.explode("d.fr").alias("fr")), "dir")


def read_journal(texts: DataFrame, xml: str = "value") -> DataFrame:
    """Files of journals, each a text with any number of roots; volumes may be elements or an attribute.  A blank alias is an error."""
    inner = F.regexp_replace(F.col(xml), r"<\?xml[^>]*\?>", "")
    parsed = texts.select(F.from_xml(F.concat(F.lit("<j>"), inner, F.lit("</j>")), JOURNAL).alias("j")).select(F.explode("j.mdj").alias("m"))
    alias = F.when(F.trim(F.coalesce("m._alias", F.lit(""))) == "", F.raise_error(F.lit("a journal entry without an alias"))).otherwise(F.col("m._alias"))
    dirs = parsed.select(alias.alias("alias"), F.explode("m.dr").alias("d")).select("alias", F.col("d._dir").alias("dir"), F.explode("d.fr").alias("fr"))
    return entries(dirs, "alias", "dir")


def journal_file_dest(files: DataFrame) -> DataFrame:
    """A row for each file and volume; files without volumes and entries with a blank alias vanish."""
    return files.filter(F.trim("alias") != "").select("alias", "dir", "fname", "checksum", F.explode("backup_dest").alias("volume"))


def escape(text: Column) -> Column:
    """As the value of an attribute or the text of an element."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _entry_xml() -> Column:
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), escape(value.cast("string")), F.lit('"'))
    elements = lambda name, values: F.array_join(F.transform(values, lambda v: F.concat(F.lit(f"<{name}>"), escape(v), F.lit(f"</{name}>"))), "")
    mtime = F.when(F.col("mtime") != 0, attribute("mtime", F.col("mtime"))).otherwise("")
    return F.concat(F.lit("<fr"), attribute("fname", F.col("fname")), attribute("checksum", F.coalesce("checksum", F.lit(""))), mtime, attribute("size", F.col("size")), F.lit(">"), elements("tag", F.col("tags")), elements("bd", F.col("backup_dest")), F.lit("</fr>"))


def write_directories(files: DataFrame, with_dir: bool = False) -> DataFrame:
    """(dir, xml): the document of each directory, its entries in the order of their names.  As large as a directory's listing."""
    rows = files.select(*(["alias"] if "alias" in files.columns else []), "dir", "fname", _entry_xml().alias("e"))
    keys = [c for c in ("alias", "dir") if c in rows.columns]
    docs = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fname", "e"))), lambda x: x["e"]), "").alias("b"))
    head = F.concat(F.lit('<dr dir="'), escape(F.col("dir")), F.lit('">')) if with_dir else F.lit("<dr>")
    return docs.select(*keys, F.concat(head, F.col("b"), F.lit("</dr>")).alias("xml"))


def write_journal(files: DataFrame) -> DataFrame:
    """(alias, dir, xml): parts of a journal, each with a root of its own, so a journal is written by many tasks."""
    docs = write_directories(files, with_dir=True)
    return docs.select("alias", "dir", F.concat(F.lit('<mdj alias="'), escape(F.col("alias")), F.lit('">'), F.col("xml"), F.lit("</mdj>")).alias("xml"))


def stale_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """(dir, action, xml): documents to write, because they differ, or to delete, because no file is left."""
    j = old.select("dir", F.col("xml").alias("_o")).join(new.select("dir", "xml"), "dir", "full_outer")
    action = F.when(F.col("xml").isNull(), "delete").when(~F.col("xml").eqNullSafe(F.col("_o")), "write")
    return j.select("dir", action.alias("action"), "xml").filter("action IS NOT NULL")


def is_valid(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """``documents`` with valid: whether the document can be parsed, and each of its entries has a name."""
    whole = F.from_xml(F.col(xml), f"{DIRECTORY}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    named = F.forall(F.coalesce("_p.fr", F.array().cast(f"array<struct<{ENTRY.replace(' ', ': ').replace(',:', ',')}>>")), lambda e: F.coalesce(e["_fname"], F.lit("")) != "")
    right = F.col("_p").isNotNull() & F.col("_p._bad").isNull() & F.col(xml).rlike(_DOCUMENT) & named
    return documents.withColumn("_p", whole).withColumn("valid", F.coalesce(right, F.lit(False))).drop("_p")


def get_entries(files: DataFrame, names: DataFrame) -> DataFrame:
    """The entries that ``names`` (dir, fname) asks for."""
    return files.join(names.select("dir", "fname").distinct(), ["dir", "fname"], "left_semi")


def set_entries(files: DataFrame, entries: DataFrame) -> DataFrame:
    """``files`` in which ``entries`` replace those of the same directory and name, or come to them; of several alike one counts, the largest."""
    rest = [c for c in files.columns if c not in ("dir", "fname")]
    one = entries.groupBy("dir", "fname").agg(F.max(F.struct(*rest)).alias("_r")).select("dir", "fname", "_r.*").select(*files.columns)
    return files.join(one.select("dir", "fname"), ["dir", "fname"], "left_anti").select(*files.columns).unionByName(one)


def is_document(text: str) -> bool:
    return bool(re.match(_DOCUMENT, text))
