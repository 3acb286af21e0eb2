"""Deterministic identities: SHA-256 and name-based UUIDs, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: Column, name: Column) -> Column:
    """Version-5 UUID: SHA-1 of namespace bytes and name, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def version_id(document_id: Column, sha256: Column) -> Column:
    return uuid5(document_id, sha256)


def block_id(version: Column, start: Column, end: Column, kind: Column) -> Column:
    return uuid5(version, F.concat(F.lit("block:"), start.cast("string"), F.lit(":"), end.cast("string"), F.lit(":"), kind, F.lit(":1.0.0")))


def chunk_id(version: Column, section: Column, start: Column, end: Column) -> Column:
    return uuid5(version, F.concat(F.lit("chunk:"), section, F.lit(":"), start.cast("string"), F.lit(":"), end.cast("string"), F.lit(":1.1.0")))


def path_key(path: Column, insensitive: bool = True) -> Column:
    """A path's comparison key: forward slashes, and folded case where the vault ignores it."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return casefold(slashed) if insensitive else slashed


def casefold(x: Column) -> Column:
    """Lower case with sharp s spelled out; the rest of full case folding has no built-in."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def upper_letters(x: Column) -> Column:
    """Upper case letter by letter, so that none becomes two: sharp s has its own capital, a ligature stays as it is."""
    each = F.transform(F.split(x, ""), lambda c: F.when(c == "ß", "ẞ").when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c))
    return F.array_join(each, "")
