"""URL filtering with a sorted digest array.

Blocked hosts and path rules are a table of any size.  Its strings become sorted
arrays of 64-bit xxhash keys with the full strings beside them, cut into shards
by the first bits of the key; each shard is sorted and written, by the task that
has its rows, as flat files in the folder that all executors share.  Workers map
the shards that they need into memory, probe them with a vectorised binary
search and compare the stored string of every hit, so that a collision of
digests can never decide a verdict.  The driver holds no list.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, lean, new_path, unused

#: (verdict, host and path): the path starts at the first slash.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: What an entry says: a host that is blocked, or a rule's verdict.
HOST, ALLOW, BLOCK = 0, 1, 2
#: Strings in a shard, about; shards at most.
SHARD, SHARDS = 1 << 20, 1 << 12


def example_hosts() -> list[str]:
    """The list beside this module."""
    lines = resources.files(__package__).joinpath("blocked_hosts.txt").read_text("utf-8").splitlines()
    return [x.strip() for x in lines if x.strip() and not x.startswith("#")]


class DigestArray:
    """Strings with a small number each, found by digest and then by themselves."""

    PARTS = ("keys", "starts", "values", "text")

    def __init__(self, at: str, bits: int, digest=xxhash.xxh64_intdigest):
        (self.fs, self.path), self.bits, self.digest = file_system(at), bits, digest
        self.shards: dict[int, tuple | None] = {}

    @staticmethod
    def write(entries: DataFrame, digest=xxhash.xxh64_intdigest) -> tuple[str, int]:
        """Writes ``entries`` (string, value); of equal strings the largest value counts.  The folder, and the number of bits that tell a shard."""
        spark = entries.sparkSession
        entries = entries.groupBy("string").agg(F.max("value").cast("int").alias("value"))
        at, n = new_path(spark, "digests"), entries.count()
        bits = min(SHARDS.bit_length() - 1, max(0, (-(-n // SHARD) - 1).bit_length()))
        fs, path = file_system(at)
        fs.create_dir(path, recursive=True)

        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = np.fromiter((digest(x.encode()) for x in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
                shard = (key >> np.uint64(64 - bits) if bits else key * np.uint64(0)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64)), pa.array(shard)], ["string", "value", "key", "shard"])

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [b for b in batches if b.num_rows]
            if not rows:
                return
            table = pa.Table.from_batches(rows)
            own, _ = file_system(at)
            shard, key = table["shard"].to_numpy(), table["key"].to_numpy().view(np.uint64)
            for k in np.unique(shard).tolist():
                some = np.flatnonzero(shard == k)
                strings = [x.encode() for x in table["string"].take(pa.array(some)).to_pylist()]
                order = sorted(range(len(some)), key=lambda i: (key[some[i]], strings[i]))
                parts = {
                    "keys": key[some[order]],
                    "starts": np.cumsum([0, *(len(strings[i]) for i in order)]).astype(np.int64),
                    "values": table["value"].to_numpy()[some[order]],
                    "text": np.frombuffer(b"".join(strings[i] for i in order) or b"\0", np.uint8),
                }
                for name, array in parts.items():  # a task that runs again writes the same again
                    out = io.BytesIO()
                    np.save(out, array)
                    with own.open_output_stream(f"{path}/{k}-{name}.npy") as f:
                        f.write(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([len(shard)], pa.int64())], ["n"])

        dealt = entries.mapInArrow(lean(digests), "string string, value int, key long, shard int").repartition(1 << bits, "shard")
        stored = dealt.mapInArrow(lean(store), "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
        if stored != n:
            raise RuntimeError(f"{stored} of {n} strings were written")
        return at, bits

    def shard(self, k: int) -> tuple | None:
        """Mapped where the folder is mounted; else read."""
        if k not in self.shards:
            from pyarrow import fs

            if self.fs.get_file_info(f"{self.path}/{k}-text.npy").type == fs.FileType.NotFound:
                self.shards[k] = None
            elif self.fs.type_name == "local":
                self.shards[k] = tuple(np.load(f"{self.path}/{k}-{n}.npy", mmap_mode="r") for n in self.PARTS)
            else:
                self.shards[k] = tuple(np.load(io.BytesIO(self.fs.open_input_file(f"{self.path}/{k}-{n}.npy").read())) for n in self.PARTS)
        return self.shards[k]

    def find(self, strings: list[bytes]) -> np.ndarray:
        """The number of each string, or -1."""
        out = np.full(len(strings), -1, np.int64)
        if not strings:
            return out
        wanted = np.fromiter(map(self.digest, strings), np.uint64, len(strings))
        shard = (wanted >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(wanted), np.int64)
        for s in np.unique(shard).tolist():
            if (arrays := self.shard(s)) is None:
                continue
            keys, starts, values, text = arrays
            some = np.flatnonzero(shard == s)
            at = np.searchsorted(keys, wanted[some])
            for j in np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == wanted[some]).tolist():
                i, k = int(some[j]), int(at[j])
                while k < len(keys) and keys[k] == wanted[i]:  # all strings of one digest
                    if text[starts[k] : starts[k + 1]].tobytes() == strings[i]:
                        out[i] = values[k]
                        break
                    k += 1
        return out


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host with A-Z in lower case, and path; both empty without a scheme."""
    _, scheme, rest = (url or "").partition("://")
    if not scheme:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.encode().lower().decode(), slash + path


def judge_urls(pages: DataFrame, *, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules: DataFrame | Iterable[tuple[str, str]] = RULES, blocked: DataFrame | Iterable[str] | None = None) -> DataFrame:
    """``keep`` columns, host, path, rule and verdict of every row, in one narrow pass.

    ``rules``: (verdict, rule), ``blocked``: (host), as tables or lists; without
    ``blocked`` it is the example list.  A rule fits its host and all subdomains
    if the path starts with the rule's; the longest that fits decides (of equally
    long ones, the longer host).  Where none fits, a host is blocked if it or a
    parent domain is listed.  A null url, or one without "://", has an empty host
    and path, which no rule fits: it is allowed.  Repeated rows are judged each;
    an empty table gives an empty one.  Of the lists only the distinct lengths of
    the rules' paths reach the driver.
    """
    spark, width = pages.sparkSession, len(keep)
    if blocked is None:
        blocked = example_hosts()
    if not isinstance(blocked, DataFrame):
        blocked = spark.createDataFrame([(h,) for h in blocked], "host string")
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, rule string")
    entries = blocked.select(F.concat(F.lit("h "), "host").alias("string"), F.lit(HOST).alias("value"))
    entries = entries.union(rules.select(F.concat(F.lit("r "), "rule"), F.when(F.col("verdict") == "allow", ALLOW).otherwise(BLOCK))).filter("string IS NOT NULL")
    at, bits = DigestArray.write(entries)
    lengths = sorted(r["n"] for r in rules.filter("rule IS NOT NULL").select((F.length("rule") - F.instr("rule", "/") + 1).alias("n")).distinct().collect())
    slim = pages.select(*keep, F.col(url).cast("string").alias(unused("__url", list(keep))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(at, bits)
        for batch in batches:
            split = [host_and_path(u) for u in batch.column(width).to_pylist()]
            owner, probes = [], []
            for i, (host, path) in enumerate(split):
                labels = host.split(".")
                for k in range(len(labels)):
                    domain = ".".join(labels[k:])
                    for n in (0, *lengths):
                        if n <= len(path):
                            owner.append(i)
                            probes.append(f"r {domain}{path[:n]}" if n else f"h {domain}")
            found = array.find([p.encode() for p in probes])
            rule, verdict, listed = [None] * len(split), [None] * len(split), [False] * len(split)
            for k in np.flatnonzero(found >= 0).tolist():
                i, own = owner[k], probes[k][2:]
                if found[k] == HOST:
                    listed[i] = True
                elif rule[i] is None or (len(own), own.index("/")) > (len(rule[i]), rule[i].index("/")):
                    rule[i], verdict[i] = own, "allow" if found[k] == ALLOW else "block"
            verdict = [v or ("block" if b else "allow") for v, b in zip(verdict, listed)]
            columns = [pa.array(x, pa.string()) for x in ([h for h, _ in split], [p for _, p in split], rule, verdict)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], [*keep, "host", "path", "rule", "verdict"])

    schema = slim.select(*keep).schema
    for name in ("host", "path", "rule", "verdict"):
        schema = schema.add(name, "string")
    return slim.mapInArrow(lean(run), schema)


def oracle() -> str:
    """DuckDB SQL for :func:`judge_urls` over ``pages`` with the standing rules and the example list."""
    rules = ", ".join(f"('{v}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{r}')" for v, r in RULES)
    listed = ", ".join(f"('{h}')" for h in example_hosts())
    return f"""
    WITH rules(verdict, host, path, rule) AS (VALUES {rules}), listed(host) AS (VALUES {listed}),
    rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS r FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '/.*$', 0, 's') AS path FROM rest)
    SELECT p.page_id, p.host, p.path,
      (SELECT arg_max(r.rule, length(r.rule)) FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule,
      coalesce((SELECT arg_max(r.verdict, length(r.rule)) FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
        CASE WHEN EXISTS (SELECT 1 FROM listed l WHERE p.host = l.host OR ends_with(p.host, '.' || l.host)) THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts p"""

