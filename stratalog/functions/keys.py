"""Scalar expressions over keys, file names and times. Keys are binary or ASCII strings, compared byte by byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def successor(prefix: bytes | str) -> bytes | str | None:
    """The least key above all keys that start with prefix; None if there is none (all bytes FF)."""
    raw = prefix.encode() if isinstance(prefix, str) else prefix
    raw = raw.rstrip(b"\xff")
    if not raw:
        return None
    out = raw[:-1] + bytes([raw[-1] + 1])
    return out.decode("latin-1") if isinstance(prefix, str) else out


def shown(key: Column, most: int = 32) -> Column:
    """Hex of a key for messages, cut after `most` bytes."""
    raw = key.cast("binary")
    return F.concat(F.lower(F.hex(F.substring(raw, 1, most))), F.when(F.octet_length(raw) > most, F.lit("...")).otherwise(F.lit("")))


def file_name(number: Column, suffix: str) -> Column:
    return F.concat(F.lpad(number.cast("string"), 6, "0"), F.lit(suffix))


def file_number(path: Column) -> Column:
    """The number in a file name; null if it has none."""
    found = F.regexp_extract(path, r"(\d+)\.[a-z]+$", 1)
    return F.when(found != "", found.cast("long"))


def seconds(nanos: Column) -> Column:
    """Whole seconds, below 0 too, in integers throughout."""
    return ((nanos - F.pmod(nanos, F.lit(1_000_000_000))).cast("decimal(38,0)") / F.lit(1_000_000_000).cast("decimal(38,0)")).cast("long")


def age_seconds(now: Column, then: Column) -> Column:
    """Never below 0, whatever the clocks said."""
    return F.greatest(F.lit(0).cast("long"), seconds(now) - seconds(then))


def checksum(*parts: Column) -> Column:
    """CRC32 (IEEE) of the parts one after the other; null counts as empty."""
    return F.crc32(F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def byte_size(*parts: Column, fixed: int = 0) -> Column:
    """Bytes of the parts, null as none, and `fixed` for the record's own fields."""
    total = F.lit(fixed).cast("long")
    for p in parts:
        total = total + F.coalesce(F.octet_length(p), F.lit(0)).cast("long")
    return total
