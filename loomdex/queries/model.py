"""The document model derived from the test tables, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk as C

SEP = "chr(10)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """vault = source; a toxic document's version isn't ready, one of low quality is deleted."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    rows = docs.join(marks, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("vault_id"), F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.when(F.col("quality") == 0, "deleted").otherwise("active").alias("lifecycle"), F.when(F.col("toxic") == 1, "parsing").otherwise("ready").alias("status"), (F.col("doc_id") * 10 + 1).alias("current_version_id"), "text")


DOCUMENTS = """documents_m AS (SELECT d.doc_id AS document_id, source AS vault_id, source || '/' || lang || '/' || d.doc_id || '.md' AS path,
    CASE WHEN quality = 0 THEN 'deleted' ELSE 'active' END AS lifecycle, CASE WHEN toxic = 1 THEN 'parsing' ELSE 'ready' END AS status, d.doc_id * 10 + 1 AS current_version_id, text
    FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """The current version and an older, superseded one of each document."""
    docs = documents(spark, d)
    now = docs.select("document_id", F.col("current_version_id").alias("version_id"), "status")
    return now.unionByName(now.select("document_id", (F.col("version_id") - 1).alias("version_id"), F.lit("superseded").alias("status")))


VERSIONS = "versions_m AS (SELECT document_id, current_version_id AS version_id, status FROM documents_m UNION ALL SELECT document_id, current_version_id - 1, 'superseded' FROM documents_m)"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """A chunk for each line that isn't blank, in current and in superseded versions' numbering."""
    lines = C.line_spans(table(spark, d, "documents"))
    rows = lines.where("line <> ''").select((F.col("doc_id") * 100000 + F.col("pos")).alias("chunk_id"), (F.col("doc_id") * 10 + 1).alias("version_id"), F.col("doc_id").alias("section_id"), F.col("pos").cast("long").alias("ordinal"), "char_start", "char_end", F.col("line").alias("text"))
    return rows.withColumn("role", F.when(F.length("text") < 40, "structural_anchor").otherwise("content_evidence"))


LINES = """lines_m AS (SELECT doc_id, pos, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS char_end,
    CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 - length(line) AS BIGINT) AS char_start
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))"""
CHUNKS = LINES + """, chunks_m AS (SELECT doc_id * 100000 + pos AS chunk_id, doc_id * 10 + 1 AS version_id, doc_id AS section_id, CAST(pos AS BIGINT) AS ordinal, char_start, char_end, line AS text,
    CASE WHEN length(line) < 40 THEN 'structural_anchor' ELSE 'content_evidence' END AS role FROM lines_m WHERE line <> '')"""
MODEL = f"{DOCUMENTS}, {VERSIONS}, {CHUNKS}"
CURRENT = """current_m AS (SELECT c.*, d.document_id, d.vault_id FROM chunks_m c JOIN versions_m v USING (version_id) JOIN documents_m d ON d.document_id = v.document_id AND d.current_version_id = v.version_id
    WHERE d.lifecycle = 'active' AND v.status = 'ready')"""
