"""A vault's ingest: a scan's changes, the parse of what they touch, and the store after it.

A store is a folder: ``elements`` (sections, blocks, chunks, links, tags and flags by buckets of
documents) and a folder ``scan=<n>`` for each scan with the narrow tables ``documents`` and
``versions`` after it, its ``changes``, ``failures``, the chunks that went, and ``outcome``, which is
written last: a scan counts once that is there. A scan that broke off is run again under its own
number, finds the state that the one before it left, and replaces whatever it had written.
Texts are read from the source, twice where they changed (to hash, then to parse, as the
source may change in between), and are kept in no table. One vault has one scan at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import lineage, parse, scan, writers
from ..schemas import DOMAINS
from ..sources import vault

DOCUMENTS = "document_id string, key string, hash string, size long, mtime long, lifecycle string, current_version_id string, title string"
VERSIONS = "document_id string, version_id string, hash string, status string"
ELEMENTS = f"document_id string, {parse.SCHEMA}, version_id string"
OUTCOME = "scan long, scan_type string, discovered long, hashed long, new_count long, modified_count long, renamed_count long, deleted_count long, unchanged_count long, failed_count long, parsed_documents long, failed_documents long, markdown_bytes long"
CHUNKS = "document_id string, version_id string, chunk_id string"


@dataclass
class Source:
    """``listing``: key, size, mtime and failed (null: no) of each file, without its content. ``read`` gives key, hash, text and
    error of at least the files whose keys (key, mtime) it is asked for; what it gives beyond isn't used."""

    listing: DataFrame
    read: Callable[[DataFrame], DataFrame]


def vault_source(spark: SparkSession, root: str, include: tuple[str, ...] = ("**/*.md",), exclude: tuple[str, ...] = (), allowed_roots: tuple[str, ...] = ()) -> Source:
    """The files of a folder. Only files within the asked ones' range of times are opened, so a scan after few late changes opens few."""
    files = vault.scan_vault(spark, root, include, exclude, allowed_roots)
    at = F.unix_micros("mtime")

    def read(asked: DataFrame) -> DataFrame:
        low, high = asked.agg(F.timestamp_micros(F.min("mtime")), F.timestamp_micros(F.max("mtime"))).first()
        notes = vault.decode_notes(files.where(F.col("mtime").between(F.lit(low), F.lit(high))))
        return notes.select(F.col("relative_path").alias("key"), F.col("content_sha256").alias("hash"), "text", "error")

    return Source(files.select(F.col("relative_path").alias("key"), "size", at.alias("mtime"), F.lit(False).alias("failed")), read)


@dataclass
class Store:
    """A store after its last whole scan (0: none yet)."""

    spark: SparkSession
    path: str
    scan: int = 0

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Store:
        jvm = spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/scan=*/outcome/_SUCCESS")
        found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
        return cls(spark, path, max((int(f.getPath().getParent().getParent().getName()[5:]) for f in found or []), default=0))

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/scan={self.scan}/{name}") if self.scan else self.spark.createDataFrame([], schema)

    @property
    def documents(self) -> DataFrame:
        """All documents ever seen; a deleted one has no current version."""
        return self._table("documents", DOCUMENTS)

    @property
    def versions(self) -> DataFrame:
        return self._table("versions", VERSIONS)

    @property
    def gone_chunks(self) -> DataFrame:
        """Chunks that the last scan removed: where ``cascade.cascade`` starts."""
        return self._table("gone_chunks", CHUNKS)

    @property
    def outcome(self) -> DataFrame:
        """One row of counts for each scan."""
        return self.spark.read.schema(OUTCOME).parquet(f"{self.path}/scan=*/outcome")

    @property
    def elements(self) -> DataFrame:
        """Elements of current versions of active documents, and of no others."""
        current = self.documents.where("lifecycle = 'active'").select("document_id", F.col("current_version_id").alias("version_id"))
        return self._stored().join(current, ["document_id", "version_id"], "left_semi")

    def _stored(self) -> DataFrame:
        if not lineage.exists(self.spark, f"{self.path}/elements"):
            return self.spark.createDataFrame([], ELEMENTS)
        return self.spark.read.schema(f"{ELEMENTS}, bucket int").parquet(f"{self.path}/elements").drop("bucket")


def ingest(spark: SparkSession, path: str, source: Source, namespace: str, scan_type: str = "incremental", buckets: int = 256) -> Store:
    """Scan a vault (``namespace``: its UUID) into the store at ``path``; the store after it.

    Files that are new, of another size or another time are hashed (all of them unless ``scan_type``
    is incremental), and so are those of documents in error. Renames keep their document; new
    paths get a new one; documents without a file are deleted with their elements. A document
    that can't be read or parsed is in error, keeps its former version and is tried again by
    the next scan; all others are stored. ``measure`` counts and changes nothing.
    """
    if scan_type not in DOMAINS["scan_type"]:
        raise ValueError(f"{scan_type} isn't a type of scan")
    before = Store.at(spark, path)
    number = before.scan + 1
    folder = f"{path}/scan={number}"
    written = lambda df, name: _written(spark, df, f"{folder}/{name}")
    known = before.documents.where("lifecycle <> 'deleted'")
    files = written(_hashed(known, source, full=scan_type != "incremental"), "files")
    changes = written(scan.diff(known.select("key", "hash"), files.select("key", "hash", "failed")), "changes")
    if scan_type == "measure":
        none = spark.createDataFrame([], "document_id string, version_id string, title string, error string")
        _publish(before.documents, before.versions, none, before.gone_chunks.limit(0), files, changes, scan_type, number, folder)
        return Store(spark, path, number)
    after = written(_assigned(known, files, changes, namespace, number), "assigned")
    todo = after.where("todo").select("document_id", "key", "hash", "mtime")
    parsed = written(_parsed(todo, source), "parsed")
    results = written(_results(todo, parsed), "results")
    stored = results.where("error IS NULL").select("document_id", "version_id")
    removed = after.where("lifecycle = 'deleted'").select("document_id")
    rows = parsed.where("element NOT IN ('error', 'title')").join(stored.select("document_id"), "document_id", "left_semi")
    replaced = before._stored().where("element = 'chunk'").join(removed.unionByName(stored.select("document_id")), "document_id", "left_semi")
    gone = _chunks(replaced).join(_chunks(rows).select("chunk_id"), "chunk_id", "left_anti")
    if lineage.exists(spark, f"{folder}/gone_chunks/_SUCCESS"):  # a former try may have replaced them already
        gone = lineage.settle(gone.unionByName(spark.read.schema(CHUNKS).parquet(f"{folder}/gone_chunks")).distinct())
    gone = written(gone, "gone_chunks")
    writers.store_versions(spark, rows, f"{path}/elements", buckets=buckets, gone=removed)
    documents = _documents(before.documents.where("lifecycle = 'deleted'"), after, results)
    _publish(documents, _versions(before.versions, after, results), results, gone, files, changes, scan_type, number, folder)
    return Store(spark, path, number)


def handlers(spark: SparkSession, places: Callable[[Row], tuple[str, Source, str]]) -> dict[str, Callable[[Row], None]]:
    """Handlers for ``state.run_once``; ``places`` gives a job's store, source and vault. A scan's type is the job's, if it has one."""

    def scan_vault(job: Row) -> None:
        path, source, namespace = places(job)
        ingest(spark, path, source, namespace, job.asDict().get("scan_type") or "incremental")

    return {"scan_vault": scan_vault}


def _written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hashed(known: DataFrame, source: Source, full: bool) -> DataFrame:
    """The listed files with their hash (carried over unless it is needed), ``needs_hash`` and ``failed``."""
    listed = source.listing.withColumn("failed", F.coalesce("failed", F.lit(False))).withColumn("hash", F.lit(None).cast("string"))
    marked = scan.carry_hashes(known, listed, full).join(known.where("lifecycle = 'error' OR current_version_id IS NULL").select("key", F.lit(True).alias("again")), "key", "left")
    marked = marked.withColumn("needs_hash", (F.col("needs_hash") | F.coalesce("again", F.lit(False))) & ~F.col("failed")).drop("again")
    found = source.read(marked.where("needs_hash").select("key", "mtime")).select("key", F.col("hash").alias("found"))
    both = marked.join(found, "key", "left")
    failed = F.col("failed") | (F.col("needs_hash") & F.col("found").isNull())
    return both.select("key", "size", "mtime", "needs_hash", F.when(F.col("needs_hash"), F.col("found")).otherwise(F.col("hash")).alias("hash"), failed.alias("failed"))


def _assigned(known: DataFrame, files: DataFrame, changes: DataFrame, namespace: str, number: int) -> DataFrame:
    """Documents after the changes, with the files' sizes and times, and whether they must be parsed (``todo``)."""
    moved = scan.apply_changes(known.select("key", "document_id", "hash", "lifecycle"), changes.where("kind <> 'read_failed'"))
    fresh = ids.uuid5(F.lit(namespace), F.concat(F.lit(f"{number}:"), F.col("key")))  # a path that is taken anew isn't the document that left it
    old = known.select("document_id", F.col("hash").alias("old_hash"), F.col("lifecycle").alias("old_lifecycle"), "current_version_id", "title", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    both = moved.join(old, "document_id", "left").join(files.select("key", "size", "mtime", "failed"), "key", "left")
    new = F.col("old_hash").isNull()
    live = (F.col("lifecycle") != "deleted") & ~F.coalesce("failed", F.lit(True))
    pending = (F.col("old_lifecycle") == "error") | F.col("current_version_id").isNull() | (F.col("old_hash") != F.col("hash"))
    read = ~F.coalesce("failed", F.lit(True))
    return both.select(
        F.when(new, fresh).otherwise(F.col("document_id")).alias("document_id"), "key", "hash", F.when(read, F.col("size")).otherwise(F.col("old_size")).alias("size"),
        F.when(read, F.col("mtime")).otherwise(F.col("old_mtime")).alias("mtime"), F.when((F.col("old_lifecycle") == "error") & (F.col("lifecycle") != "deleted"), "error").otherwise(F.col("lifecycle")).alias("lifecycle"),
        "current_version_id", "title", (live & pending).alias("todo"))


def _parsed(todo: DataFrame, source: Source) -> DataFrame:
    """Elements of the documents to parse; those that can't be read or are no longer what was hashed have one of element ``error``."""
    found = source.read(todo.select("key", "mtime")).select("key", F.col("hash").alias("found"), "text", F.col("error").alias("refused"))
    both = todo.join(found, "key", "left").withColumn("version_id", ids.version_id(F.col("document_id"), F.col("hash")))
    error = F.when(F.col("found").isNull(), "unreadable").when(F.col("found") != F.col("hash"), "source_changed").otherwise(F.col("refused"))
    # one pass over the source: a text that isn't parsed goes through empty, and its elements give way to the error
    rows = both.select(F.struct("document_id", "version_id", error.alias("refused")).alias("d"), F.when(error.isNull(), F.col("text")).alias("text"))
    named = rows.select(F.to_json("d").alias("document"), "text", F.col("d.version_id").alias("version_id"))
    elements = parse.parse_markdown(named, id_col="document", version_col="version_id")
    d = F.from_json("document", "document_id string, version_id string, refused string")
    rows = elements.withColumn("d", d).where("d.refused IS NULL OR element = 'section' AND kind = 'root'").withColumn("refused", F.col("d.refused"))
    off = F.col("refused").isNotNull()
    columns = [F.when(off, F.lit("error")).otherwise(F.col(c)).alias(c) if c == "element" else F.when(off, F.col("refused")).otherwise(F.col(c)).alias(c) if c == "kind" else F.col(c) for c in elements.columns if c != "document"]
    return rows.select("d.document_id", *columns, "d.version_id")


def _results(todo: DataFrame, parsed: DataFrame) -> DataFrame:
    """``document_id, version_id, title, error`` of each document that was to be parsed."""
    title, error = (F.max(F.when(F.col("element") == e, F.col(c))).alias(e) for e, c in (("title", "target"), ("error", "kind")))
    said = parsed.where("element IN ('title', 'error')").groupBy("document_id").agg(title, error)
    return todo.select("document_id", ids.version_id(F.col("document_id"), F.col("hash")).alias("version_id")).join(said, "document_id", "left")


def _chunks(elements: DataFrame) -> DataFrame:
    return elements.where("element = 'chunk'").select("document_id", "version_id", F.col("id").alias("chunk_id"))


def _documents(dead: DataFrame, after: DataFrame, results: DataFrame) -> DataFrame:
    r = results.select("document_id", F.col("version_id").alias("new"), F.col("title").alias("new_title"), "error", F.lit(True).alias("done"))
    ok, off = F.col("done") & F.col("error").isNull(), F.col("lifecycle") == "deleted"
    rows = after.join(r, "document_id", "left").select(
        "document_id", "key", "hash", "size", "mtime", F.when(ok, "active").when(F.col("done"), "error").otherwise(F.col("lifecycle")).alias("lifecycle"),
        F.when(ok, F.col("new")).when(~off, F.col("current_version_id")).alias("current_version_id"), F.when(ok, F.col("new_title")).otherwise(F.col("title")).alias("title"))
    return rows.unionByName(dead)


def _versions(before: DataFrame, after: DataFrame, results: DataFrame) -> DataFrame:
    """A stored version is ready, the one that it replaced and a deleted document's are superseded, one that failed again is failed."""
    tried = after.join(results.select("document_id", "version_id", "error"), "document_id")
    now = tried.where("error IS NULL").select("document_id", "version_id", "hash", F.lit("ready").alias("now"))
    left = after.where("lifecycle = 'deleted'").select("document_id", F.col("current_version_id").alias("version_id"))
    left = left.unionByName(tried.where("error IS NULL AND current_version_id <> version_id").select("document_id", F.col("current_version_id").alias("version_id")))
    marks = now.unionByName(left.where("version_id IS NOT NULL").select("*", F.lit(None).cast("string").alias("hash"), F.lit("superseded").alias("now")))
    marks = marks.unionByName(tried.where("error IS NOT NULL").join(before, ["document_id", "version_id"], "left_semi").select("document_id", "version_id", F.lit(None).cast("string").alias("hash"), F.lit("failed").alias("now")))
    both = before.join(marks.withColumnRenamed("hash", "new_hash"), ["document_id", "version_id"], "full")
    return both.select("document_id", "version_id", F.coalesce("hash", "new_hash").alias("hash"), F.coalesce("now", "status").alias("status"))


def _publish(documents: DataFrame, versions: DataFrame, results: DataFrame, gone: DataFrame, files: DataFrame, changes: DataFrame, scan_type: str, number: int, folder: str) -> None:
    """The narrow tables, and last the scan's one row."""
    documents.write.mode("overwrite").parquet(f"{folder}/documents")
    versions.write.mode("overwrite").parquet(f"{folder}/versions")
    if scan_type == "measure":
        gone.write.mode("overwrite").parquet(f"{folder}/gone_chunks")
    results.where("error IS NOT NULL").select("document_id", "version_id", "error").write.mode("overwrite").parquet(f"{folder}/failures")
    seen = files.agg(F.count("*").alias("discovered"), F.count_if("needs_hash").alias("hashed"), F.coalesce(F.sum("size"), F.lit(0)).alias("markdown_bytes"))
    done = results.agg(F.count_if(F.col("error").isNull()).alias("parsed_documents"), F.count_if(F.col("error").isNotNull()).alias("failed_documents"))
    row = {"scan": number, "scan_type": scan_type, **scan.counters(changes).first().asDict(), **seen.first().asDict(), **done.first().asDict()}
    row["unchanged_count"] = files.where("NOT failed").join(changes.select("key"), "key", "left_anti").count()
    spark = files.sparkSession
    spark.createDataFrame([row], OUTCOME).coalesce(1).write.mode("overwrite").parquet(f"{folder}/outcome")
    for name in ("files", "assigned", "parsed", "results"):
        lineage.remove(spark, f"{folder}/{name}")
