"""Digests of a graph snapshot: the model's own hash, which is read in one order, and a tree of digests by range.

A tree has a digest for each range of keys (a range of a hash of the object's type and key) and one
of those. Two generations are compared range by range, and only ranges whose
digests differ are read again, diffed and rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import MOST_OBJECTS
from .lineage import exists

#: Ranges of a tree; bytes of text that go to a hash as one row, at about the most.
RANGES, PIECE = 1024, 1 << 16


# JSON's short escapes of control characters.
SHORT = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}


def _quoted(value: Column) -> Column:
    """A string as JSON writes it where it escapes nothing that it needn't."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = plain
    for code in range(32):
        full = F.replace(full, F.lit(chr(code)), F.lit("\\" + SHORT.get(code, f"u{code:04x}")))
    return F.concat(F.lit('"'), F.when(value.rlike(r"[\x00-\x1f]"), full).otherwise(plain), F.lit('"'))


def _json(value: Column, kind: T.DataType) -> Column:
    """A value as compact JSON with sorted keys; null is ``null``. Numbers are integers."""
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f'"{f.name}":'), _json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        inner = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, T.MapType):
        held = F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _json(e["value"], kind.valueType)))
        inner = F.concat(F.lit("{"), F.array_join(held, ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        inner = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StringType):
        inner = _quoted(value)
    elif isinstance(kind, T.BooleanType):
        inner = F.when(value, "true").otherwise("false")
    else:
        inner = value.cast("string")
    return F.when(value.isNull(), F.lit("null")).otherwise(inner)


def canonical_objects(parts: dict[str, DataFrame]) -> DataFrame | None:
    """``part, id, body``: the objects of node or edge sets, in their own canonical JSON; ``id``, from ``_order`` if a set has that, gives their order in it."""
    out = None
    for name, df in sorted(parts.items()):
        key = F.concat_ws("\n", *[F.col(c) for c in ("_order", "id", "source_id", "target_id") if c in df.columns])
        shown = [c for c in df.columns if c != "_order"]
        body = _json(F.struct(*shown), df.select(F.struct(*shown).alias("x")).schema["x"].dataType)
        rows = df.select(F.lit(name).alias("part"), key.cast("string").alias("id"), body.alias("body"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted bodies in stretches of one part, with a comma between them: ``place, nth, part, n, text``."""
    place, nth, of, held, size = TaskContext.get().partitionId(), 0, None, [], 0
    row = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((place, nth, of, len(held), b",".join(held)), (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary()))], ["place", "nth", "part", "n", "text"])
    for batch in batches:
        for part, body in zip(batch.column("part").to_pylist(), batch.column("body").cast(pa.binary()).to_pylist()):
            if held and (part != of or size >= PIECE):
                yield row()
                nth, held, size = nth + 1, [], 0
            of, size = part, size + len(body)
            held.append(body)
    if held:
        yield row()


def snapshot_sha256(nodes: dict[str, DataFrame], relationships: dict[str, DataFrame], most: int | None = MOST_OBJECTS) -> DataFrame:
    """``n_objects, sha256`` of a snapshot as the model hashes it: the compact JSON, keys sorted, of
    its node and relationship sets by label, each a list in the order of ids.

    More than ``most`` objects are refused, as a projection refuses them; None takes any size. Objects
    are sorted by all tasks; SHA-256 takes bytes in their order, so one task hashes the text, of which
    it holds a batch of pieces at a time. Empty sets are part of the hash.
    """
    both = canonical_objects({f"n:{k}": v for k, v in nodes.items()} | {f"r:{k}": v for k, v in relationships.items()})
    if most is not None and both.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} objects")
    parts = [f"{mark}:{k}" for mark, sets in (("n", nodes), ("r", relationships)) for k in sorted(sets)]
    side = lambda sets: "{" + ",".join(f'"{k}":[\0]' for k in sorted(sets)) + "}"
    leads = [x.encode() for x in f'{{"nodes":{side(nodes)},"relationships":{side(relationships)}}}'.split("\0")]  # before each set's objects, and after the last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, found, at, begun = sha256(leads[0]), 0, 0, False
        for batch in batches:
            for part, n, text in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "text"))):
                while n and parts[at] != part:
                    at, begun = at + 1, False
                    whole.update(leads[at])
                if n:
                    whole.update(b"," + text if begun else text)
                    found, begun = found + n, True
        for lead in leads[at + 1 :]:
            whole.update(lead)
        yield pa.RecordBatch.from_pydict({"n_objects": [found], "sha256": [whole.hexdigest()]})

    form = "place int, nth long, part string, n long, text binary"
    none = both.sparkSession.createDataFrame([(-1, 0, "", 0, b"")], form)  # without a row the task wouldn't run
    pieces = both.orderBy("part", "id", "body").select("part", "body").mapInArrow(_pieces, form).unionByName(none)
    return pieces.repartition(1).sortWithinPartitions("place", "nth").mapInArrow(run, "n_objects long, sha256 string")


def placed(objects: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Objects (part, id, body) with the number of their key's range."""
    return objects.withColumn("range", F.pmod(F.xxhash64("part", "id"), F.lit(ranges)).cast("int"))


def leaves(objects: DataFrame) -> DataFrame:
    """``range, n, digest``: order-free digests of placed objects by range, combined before the shuffle."""
    h = F.sha2(F.concat_ws("\n", "part", "id", "body"), 256)
    half = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return objects.groupBy("range").agg(F.count("*").alias("n"), F.concat_ws(":", half(1), half(16)).alias("digest"))


def root(found: DataFrame) -> DataFrame:
    """``n_objects, digest`` over a tree's ranges, which are RANGES at the most."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", F.format_string("%08d", "range"), F.col("n").cast("string"), F.col("digest"))))
    return found.agg(F.sum("n").alias("n_objects"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def changed_ranges(old: DataFrame, new: DataFrame) -> DataFrame:
    """``range`` of two trees' leaves that differ or that only one has."""
    both = old.select("range", F.struct("n", "digest").alias("a")).join(new.select("range", F.struct("n", "digest").alias("b")), "range", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("range")


def write_generation(objects: DataFrame, path: str, ranges: int = RANGES) -> list[int]:
    """Bring the objects stored under ``path``, a folder for each range, to ``objects``; the ranges that were rewritten.

    Leaves are kept beside the objects. A changed range is overwritten whole and its
    leaf last, so a write that breaks off is found and done again by the next one.
    """
    spark = objects.sparkSession
    rows = placed(objects, ranges)
    tree = rows.sparkSession.createDataFrame(leaves(rows).collect(), "range int, n long, digest string")  # RANGES rows at the most
    known = _leaves_at(spark, f"{path}/leaves")
    differ = sorted(r[0] for r in (tree.select("range") if known is None else changed_ranges(known, tree)).collect())
    if differ:
        kept = rows.where(F.col("range").isin(differ))
        kept.repartition("range").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range").parquet(f"{path}/objects")
        tree.coalesce(1).write.mode("overwrite").parquet(f"{path}/leaves")
    return differ


def _leaves_at(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.createDataFrame(spark.read.parquet(path).collect(), "range int, n long, digest string") if exists(spark, path) else None


def read_generation(spark: SparkSession, path: str) -> DataFrame:
    """``part, id, body`` of the stored objects; ranges that the leaves don't name are empty."""
    held = spark.read.parquet(f"{path}/objects")
    return held.join(spark.read.parquet(f"{path}/leaves").select("range"), "range", "left_semi").select("part", "id", "body")
