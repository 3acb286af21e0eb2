"""Files of a vault as a DataFrame, through Spark's own readers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 20 * 1024 * 1024


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ``**/`` spans any number of folders, none too."""
    out = ""
    for part in re.findall(r"\*\*/|\*\*|\*|\?|\[!?[^\]]+\]|.", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or ("[" + part[1:-1].replace("!", "^", 1) + "]" if part[0] == "[" and len(part) > 2 else re.escape(part))
    return f"^(?:.*/)?{out}$" if "/" not in glob else f"^{out}$"


def _inside(root: str, path: str) -> str:
    if ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"{path} leaves {root}")
    return path


def scan_vault(spark: SparkSession, root: str, include: tuple[str, ...] = ("**/*.md",), exclude: tuple[str, ...] = (), allowed_roots: tuple[str, ...] = ()) -> DataFrame:
    """``relative_path, size, mtime, content`` of the files that the globs take, in path order when sorted.

    The root must lie under one of ``allowed_roots`` if there are any. Spark's readers skip files
    without a byte, so an empty note has no row here.
    """
    root = _inside(root, root).rstrip("/")
    if allowed_roots and not any(root == r.rstrip("/") or root.startswith(r.rstrip("/") + "/") for r in allowed_roots):
        raise PermissionError(f"{root} isn't an allowed root")
    names = ",".join(sorted({g.rstrip("/").rsplit("/", 1)[-1].replace("**", "*") for g in include}))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{names}}}").load(root)  # others aren't opened
    bare = re.sub(r"^[a-z][a-z0-9+.-]*:/*", "/", root)
    path = F.substr(F.col("path"), F.locate(bare + "/", F.col("path")) + len(bare) + 1)
    rows = files.select(path.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    taken = F.lit(False)
    for g in include:
        taken = taken | F.col("relative_path").rlike(glob_regex(g))
    for g in exclude:
        taken = taken & ~F.col("relative_path").rlike(glob_regex(g)) & ~F.col("relative_path").rlike(glob_regex(g.rstrip("/") + "/**"))
    return rows.where(taken)


def decode_notes(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """``relative_path, content_sha256, text, error``: strict UTF-8, a byte-order mark dropped, at most ``most`` bytes."""
    ok = F.expr("is_valid_utf8(cast(content as string))")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    error = F.when(F.col("size") > most, "too_large").when(~ok, "invalid_utf8")
    return files.select("relative_path", F.sha2("content", 256).alias("content_sha256"), F.when(error.isNull(), text).alias("text"), error.alias("error"))


def json_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
