"""Typed encodings and integers from digests; the same numbers come from any engine with SHA-256 and MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def typed(value: str | Column, kind: str) -> Column:
    """'kind:value', so that equal texts of different types are different items."""
    return F.concat(F.lit(f"{kind}:"), (F.col(value) if isinstance(value, str) else value).cast("string"))


def sha_int(text: Column, digits: int = 15, first: int = 1) -> Column:
    """`digits` (at most 15) hex digits of the SHA-256 of a string as a BIGINT."""
    return F.conv(F.substring(F.sha2(text, 256), first, digits), 16, 10).cast("bigint")


def sha_u64(text: Column) -> Column:
    """The first 8 bytes of the SHA-256 as an unsigned integer."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def md5_u64(text: Column) -> Column:
    """The first 8 bytes of the MD5 as an unsigned integer."""
    return F.conv(F.substring(F.md5(text), 1, 16), 16, 10).cast("decimal(20,0)")
