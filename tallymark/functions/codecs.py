"""Payloads of stored objects: JSON behind its length, four bytes with the smallest first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of a payload, by the names that stored objects have.
PAYLOAD = "struct<Size: bigint, FpathStr: string, BackupDest: array<string>>"


def encode_payload(size: Column, path: Column, backup_dest: Column) -> Column:
    """Bytes of a payload; an empty list stays a list."""
    body = F.encode(F.to_json(F.struct(size.alias("Size"), path.alias("FpathStr"), backup_dest.alias("BackupDest"))), "UTF-8")
    length = F.lpad(F.hex(F.octet_length(body)), 8, "0")
    first = F.concat(*(F.substring(length, k, 2) for k in (7, 5, 3, 1)))
    return F.concat(F.unhex(first), body)


def decode_payload(data: Column) -> Column:
    """struct(Size, FpathStr, BackupDest); null where the bytes are fewer than they say, or no JSON.  What follows the payload doesn't count."""
    head = F.hex(F.substring(data, 1, 4))
    length = F.conv(F.concat(*(F.substring(head, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")
    whole = (F.octet_length(data) >= 4) & (length <= F.octet_length(data) - 4)
    return F.when(whole, F.from_json(F.decode(F.substring(data, F.lit(5), length.cast("int")), "UTF-8"), PAYLOAD))


def dump(data: Column, kind: str = "hex", limit: int | None = None) -> Column:
    """A stored object as hex, base64 or raw; of its first ``limit`` bytes, if one is set.  Base64 is one line: Spark may break it after 76 characters."""
    some = data if limit is None else F.substring(data, 1, limit)
    return {"hex": F.hex, "base64": lambda c: F.translate(F.base64(c), "\r\n", ""), "raw": lambda c: c}[kind](some)
