"""Checksum spellings: hex, and base64 without padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_base64(content: Column) -> Column:
    """MD5 of text or bytes as 22 base64 characters."""
    return F.regexp_replace(F.base64(F.unhex(F.md5(content))), "=+$", "")


def canonical(checksum: Column) -> Column:
    """32 lower-case hex digits of either spelling; null where it is neither."""
    padded = F.concat(checksum, F.lit("=="))
    as_bytes = F.when(checksum.rlike("^[0-9a-fA-F]{32}$"), F.unhex(checksum)).when(checksum.rlike("^[A-Za-z0-9+/]{22}$"), F.try_to_binary(padded, F.lit("base64")))
    return F.lower(F.hex(as_bytes))


def key_bytes(checksum: Column) -> Column:
    """The 16 bytes of either spelling, whose order is that of keys; base64 text sorts otherwise."""
    return F.unhex(canonical(checksum))
