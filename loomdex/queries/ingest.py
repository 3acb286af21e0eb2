"""Queries: two scans of a vault, from its files to the stored elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lineage import scratch
from ..plans.ingest import Source, Store, ingest
from . import query
from .model import table

VAULT = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
_stores: dict[tuple[str, str], str] = {}


def _sources(spark, d):
    """The table's texts as files: an older scan and a newer one with edits, moves, removals, arrivals and files that can't be read."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))

    def source(rows, key, text, failed):
        files = rows.select(key.alias("key"), text.alias("text"), failed.alias("failed"))
        contents = files.where("NOT failed").select("key", F.sha2("text", 256).alias("hash"), "text", F.lit(None).cast("string").alias("error"))
        return Source(files.select("key", F.length("text").cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), "failed"), lambda asked: contents)

    n = F.col("doc_id")
    edited = F.when(n % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    moved = F.when(n % 13 == 0, F.concat("path", F.lit("-moved"))).otherwise(F.col("path"))
    return source(docs.where(n % 10 != 0), F.col("path"), F.col("text"), F.lit(False)), source(docs.where(n % 10 != 1), moved, edited, n % 17 == 0)


def store(spark, d) -> Store:
    """The store after both scans, once a session."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _stores:
        path = scratch(spark, "vault")
        for s in _sources(spark, d):
            ingest(spark, path, s, VAULT, buckets=64)
        _stores[at] = path
    return Store.at(spark, _stores[at])


_STEPS = """old AS (SELECT source || '/' || doc_id AS key, sha256(coalesce(text, '')) AS hash, length(coalesce(text, '')) AS size FROM documents WHERE doc_id % 10 <> 0),
    new AS (SELECT source || '/' || doc_id || CASE WHEN doc_id % 13 = 0 THEN '-moved' ELSE '' END AS key, coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END AS body, doc_id % 17 = 0 AS failed FROM documents WHERE doc_id % 10 <> 1),
    now AS (SELECT key, sha256(body) AS hash, length(body) AS size, failed FROM new),
    gone AS (SELECT key, hash FROM old WHERE key NOT IN (SELECT key FROM now)), came AS (SELECT key, hash FROM now WHERE NOT failed AND key NOT IN (SELECT key FROM old)),
    pairs AS (SELECT gk, ck FROM (SELECT hash, count(*) AS n, min(key) AS gk FROM gone GROUP BY 1) JOIN (SELECT hash, count(*) AS m, min(key) AS ck FROM came GROUP BY 1) USING (hash) WHERE n = 1 AND m = 1),
    edits AS (SELECT key, n.hash, n.size FROM old o JOIN now n USING (key) WHERE o.hash <> n.hash AND NOT failed)"""


@query(f"""WITH {_STEPS} SELECT coalesce(ck, o.key) AS key, CASE WHEN g.key IS NOT NULL AND ck IS NULL THEN 'deleted' ELSE 'active' END AS lifecycle, CASE WHEN g.key IS NULL OR ck IS NOT NULL THEN coalesce(e.hash, o.hash) END AS current_hash,
        CASE WHEN e.key IS NULL THEN 1 ELSE 2 END::BIGINT AS n_versions, CASE WHEN e.key IS NOT NULL OR (g.key IS NOT NULL AND ck IS NULL) THEN 1 ELSE 0 END::BIGINT AS n_superseded, CASE WHEN g.key IS NULL OR ck IS NOT NULL THEN coalesce(e.size, o.size) END::BIGINT AS root_end
    FROM old o LEFT JOIN gone g USING (key) LEFT JOIN pairs ON gk = o.key LEFT JOIN edits e ON e.key = o.key
    UNION ALL SELECT c.key, 'active', c.hash, 1, 0, n.size FROM came c JOIN now n USING (key) WHERE c.key NOT IN (SELECT ck FROM pairs)""")
def ingest_documents(spark, d):
    """Each document after two scans: its state, the hash of its current version, and the end of that version's stored root section."""
    s = store(spark, d)
    counted = s.versions.groupBy("document_id").agg(F.count("*").alias("n_versions"), F.count_if(F.col("status") == "superseded").alias("n_superseded"))
    current = s.versions.where("status = 'ready'").select("document_id", F.col("version_id").alias("current_version_id"), F.col("hash").alias("current_hash"))
    roots = s.elements.where("element = 'section' AND kind = 'root'").select("document_id", F.col("char_end").alias("root_end"))
    rows = s.documents.drop("hash").join(counted, "document_id", "left").join(current, ["document_id", "current_version_id"], "left").join(roots, "document_id", "left")
    return rows.select("key", "lifecycle", "current_hash", "n_versions", "n_superseded", "root_end")


@query(f"""WITH {_STEPS}, several AS (SELECT hash FROM (SELECT hash, count(*) AS n FROM gone GROUP BY 1) JOIN (SELECT hash, count(*) AS m FROM came GROUP BY 1) USING (hash) WHERE n > 1 OR m > 1),
    one AS (SELECT count(*) AS n, sum(size) AS bytes FROM old), p AS (SELECT count(*) AS n FROM pairs), e AS (SELECT count(*) AS n FROM edits),
    f AS (SELECT count(*) AS n, count(*) FILTER (failed) AS bad, count(*) FILTER (NOT failed AND (o.key IS NULL OR o.size <> x.size)) AS hashed, sum(x.size) AS bytes FROM now x LEFT JOIN old o USING (key)),
    c AS (SELECT count(*) AS n, count(*) FILTER (hash IN (SELECT hash FROM several)) AS unclear FROM came), g AS (SELECT count(*) AS n, count(*) FILTER (hash IN (SELECT hash FROM several)) AS unclear FROM gone)
    SELECT 1::BIGINT AS scan, n AS discovered, n AS hashed, n AS new_count, 0::BIGINT AS modified_count, 0::BIGINT AS renamed_count, 0::BIGINT AS deleted_count, 0::BIGINT AS unchanged_count, 0::BIGINT AS failed_count, n AS parsed_documents, 0::BIGINT AS failed_documents, bytes::BIGINT AS markdown_bytes FROM one
    UNION ALL SELECT 2, f.n, f.hashed, c.n - p.n + g.unclear, e.n, p.n, g.n - p.n + c.unclear, f.n - f.bad - c.n - e.n, f.bad, c.n - p.n + e.n, 0, f.bytes::BIGINT FROM f, p, e, c, g""")
def ingest_outcome(spark, d):
    """The two scans' counts."""
    return store(spark, d).outcome.drop("scan_type")
