"""Column functions for text, paths and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha_id(*parts: Column | str) -> Column:
    """Hex SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"), 256)


def packed(text: Column) -> Column:
    """A text as binary for a shuffle, a hex SHA-256 in half its length; :func:`unpacked` gives it back. Equal texts stay equal, but their order is lost."""
    return F.when((F.octet_length(text) == 64) & text.rlike(r"\A[0-9a-f]{64}\z"), F.concat(F.lit(b"\1"), F.unhex(text))).otherwise(F.concat(F.lit(b"\0"), text.cast("binary")))


def unpacked(data: Column) -> Column:
    rest = F.substring(data, 2, 2**31 - 1)
    return F.when(F.substring(data, 1, 1) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def trimmed(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased last extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))
