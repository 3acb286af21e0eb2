"""Queries: scans, gates, chunks, aggregates, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import ids, text
from ..operators import chunk as C
from ..operators import gates, parse, scan
from ..operators import spans as I
from ..operators import state as S
from . import query
from .model import CHUNKS, CURRENT, DOCUMENTS, LINES, MODEL, VERSIONS, chunks, documents, table, versions


# --- scans -----------------------------------------------------------------
def _snapshots(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    old = docs.where("doc_id % 10 <> 0").select(path.alias("key"), F.sha2("text", 256).alias("hash"), F.length("text").cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"))
    moved = F.when(F.col("doc_id") % 13 == 0, F.concat(path, F.lit("-moved"))).otherwise(path)
    body = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 10 <> 1").select(moved.alias("key"), F.sha2(body, 256).alias("hash"), F.length(body).cast("long").alias("size"), F.when(F.col("doc_id") % 11 == 0, 2).otherwise(1).cast("long").alias("mtime"), (F.col("doc_id") % 17 == 0).alias("failed"))
    return old, new


_SNAP = """old AS (SELECT source || '/' || doc_id AS key, sha256(text) AS hash, length(text) AS size, 1 AS mtime FROM documents WHERE doc_id % 10 <> 0),
    new AS (SELECT source || '/' || doc_id || CASE WHEN doc_id % 13 = 0 THEN '-moved' ELSE '' END AS key, sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS hash,
        length(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS size, CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END AS mtime, doc_id % 17 = 0 AS failed FROM documents WHERE doc_id % 10 <> 1)"""
_CHANGES = _SNAP + """, gone AS (SELECT key, hash FROM old WHERE key NOT IN (SELECT key FROM new)), came AS (SELECT key, hash FROM new WHERE NOT failed AND key NOT IN (SELECT key FROM old)),
    m AS (SELECT hash, a.n AS ng, b.n AS nc, gk, ck FROM (SELECT hash, count(*) AS n, min(key) AS gk FROM gone GROUP BY 1) a JOIN (SELECT hash, count(*) AS n, min(key) AS ck FROM came GROUP BY 1) b USING (hash)),
    changes AS (SELECT 'renamed' AS kind, ck AS key, gk AS old_key, hash FROM m WHERE ng = 1 AND nc = 1
        UNION ALL SELECT 'ambiguous_rename', key, NULL, hash FROM gone WHERE hash IN (SELECT hash FROM m WHERE ng > 1 OR nc > 1) UNION ALL SELECT 'ambiguous_rename', key, NULL, hash FROM came WHERE hash IN (SELECT hash FROM m WHERE ng > 1 OR nc > 1)
        UNION ALL SELECT 'deleted', key, NULL, hash FROM gone WHERE hash NOT IN (SELECT hash FROM m) UNION ALL SELECT 'created', key, NULL, hash FROM came WHERE hash NOT IN (SELECT hash FROM m)
        UNION ALL SELECT 'modified', o.key, NULL, n.hash FROM old o JOIN new n USING (key) WHERE o.hash <> n.hash AND NOT failed UNION ALL SELECT 'read_failed', key, NULL, NULL FROM new WHERE failed)"""


@query(f"WITH {_CHANGES} SELECT kind, key, old_key, hash FROM changes")
def scan_changes(spark, d):
    return scan.diff(*_snapshots(spark, d))


@query(f"""WITH {_CHANGES} SELECT count(*) FILTER (kind IN ('created', 'ambiguous_rename')) AS new_count, count(*) FILTER (kind = 'modified') AS modified_count, count(*) FILTER (kind = 'renamed') AS renamed_count,
    count(*) FILTER (kind IN ('deleted', 'ambiguous_rename')) AS deleted_count, count(*) FILTER (kind = 'read_failed') AS failed_count FROM changes""")
def scan_counters(spark, d):
    return scan.counters(scan.diff(*_snapshots(spark, d)))


@query(f"WITH {_SNAP} SELECT n.key, o.key IS NULL OR o.size <> n.size OR o.mtime <> n.mtime AS needs_hash, CASE WHEN o.key IS NULL OR o.size <> n.size OR o.mtime <> n.mtime THEN n.hash ELSE o.hash END AS hash FROM new n LEFT JOIN old o USING (key)")
def scan_hash_reuse(spark, d):
    return scan.carry_hashes(*_snapshots(spark, d)).select("key", "needs_hash", "hash")


@query(f"""WITH {_CHANGES}, moved AS (SELECT coalesce(c.key, o.key) AS key, sha256(o.key) AS document_id, o.hash FROM old o LEFT JOIN (SELECT key, old_key FROM changes WHERE kind = 'renamed') c ON c.old_key = o.key)
    SELECT coalesce(m.key, c.key) AS key, coalesce(document_id, sha256(c.key)) AS document_id, CASE WHEN gone THEN m.hash ELSE coalesce(c.hash, m.hash) END AS hash,
    CASE WHEN gone THEN 'deleted' WHEN kind = 'read_failed' THEN 'error' ELSE 'active' END AS lifecycle FROM
    (SELECT *, coalesce(c.kind = 'deleted' OR (c.kind = 'ambiguous_rename' AND m.document_id IS NOT NULL), false) AS gone FROM moved m FULL JOIN changes c ON m.key = c.key) AS x(mkey, document_id, mhash, kind, ckey, old_key, chash, gone),
    LATERAL (SELECT mkey AS key, mhash AS hash) m, LATERAL (SELECT ckey AS key, chash AS hash) c""")
def scan_apply(spark, d):
    old, new = _snapshots(spark, d)
    states = old.select("key", F.sha2("key", 256).alias("document_id"), "hash", F.lit("active").alias("lifecycle"))
    return scan.apply_changes(states, scan.diff(old, new))


# --- gates and joins ---------------------------------------------------------
@query(f"WITH {MODEL}, {CURRENT} SELECT chunk_id, document_id, vault_id FROM current_m")
def current_chunks_gate(spark, d):
    return gates.current_chunks(chunks(spark, d), documents(spark, d), versions(spark, d)).select("chunk_id", "document_id", "vault_id")


@query(f"WITH {MODEL}, {CURRENT} SELECT chunk_id, document_id FROM current_m WHERE vault_id = 'src3'")
def current_chunks_in_vault(spark, d):
    return gates.current_chunks(chunks(spark, d), documents(spark, d), versions(spark, d), vault="src3").select("chunk_id", "document_id")


@query(f"WITH {DOCUMENTS}, {VERSIONS} SELECT d.document_id, v.status, v.version_id FROM documents_m d LEFT JOIN versions_m v ON v.version_id = d.current_version_id")
def documents_with_version(spark, d):
    v = versions(spark, d).select("version_id", "status")
    return documents(spark, d).drop("status").join(v, F.col("version_id") == F.col("current_version_id"), "left").select("document_id", "status", "version_id")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def unresolved_candidates(spark, d):
    decided = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return table(spark, d, "orders").join(decided, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, ns.n_name AS subject, nc.n_name AS object FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN supplier ON s_suppkey = l_suppkey JOIN nation ns ON ns.n_nationkey = s_nationkey JOIN nation nc ON nc.n_nationkey = c_nationkey WHERE ns.n_name <> nc.n_name AND l_quantity > 45""")
def assertion_two_aliases(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_suppkey")
    rows = rows.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    s, o = n.select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("subject")), n.select(F.col("n_nationkey").alias("ok"), F.col("n_name").alias("object"))
    return rows.join(s, F.col("sk") == F.col("s_nationkey")).join(o, F.col("ok") == F.col("c_nationkey")).where("subject <> object").select("l_orderkey", "l_linenumber", "subject", "object")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate)::VARCHAR AS latest FROM orders GROUP BY 1")
def latest_run_per_document(spark, d):
    rows = gates.latest(table(spark, d, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey")), ["o_custkey"], "at", "o_orderkey", "o_orderdate")
    return rows.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def stale_projection(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey")
    return table(spark, d, "part").where("p_partkey % 2 = 0").join(used, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey", "p_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0")
def upsert_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return gates.upsert(c.where("c_custkey % 5 <> 0"), c.where("c_custkey % 3 = 0").withColumn("segment", F.lit("new")), "c_custkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def insert_missing_rows(spark, d):
    have = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"))
    return gates.insert_missing(have, table(spark, d, "orders").select("o_custkey"), "o_custkey")


# --- aggregates and top-k ------------------------------------------------------
@query(f"""WITH {DOCUMENTS} SELECT vault_id, count(*) AS n_documents, count(*) FILTER (lifecycle = 'active') AS n_active, count(*) FILTER (status = 'ready') AS n_ready, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents_m GROUP BY 1""")
def vault_overview(spark, d):
    return documents(spark, d).groupBy("vault_id").agg(F.count("*").alias("n_documents"), F.count_if(F.col("lifecycle") == "active").alias("n_active"), F.count_if(F.col("status") == "ready").alias("n_ready"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT kind, status, count(*) AS n FROM (SELECT 'order' AS kind, o_orderstatus AS status FROM orders UNION ALL SELECT 'line', l_linestatus FROM lineitem UNION ALL SELECT 'return', l_returnflag FROM lineitem) GROUP BY ALL")
def status_counts_union(spark, d):
    parts = [table(spark, d, t).select(F.lit(k).alias("kind"), F.col(c).alias("status")) for t, k, c in (("orders", "order", "o_orderstatus"), ("lineitem", "line", "l_linestatus"), ("lineitem", "return", "l_returnflag"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind", "status").agg(F.count("*").alias("n"))


@query("SELECT CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS prompt, CAST(coalesce(sum(length(source)), 0) AS BIGINT) AS completion FROM documents WHERE lang = 'fr'")
def token_totals(spark, d):
    rows = table(spark, d, "documents").where("lang = 'fr'")
    return rows.agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("prompt"), F.coalesce(F.sum(F.length("source")), F.lit(0)).alias("completion"))


@query("SELECT o_custkey, coalesce(max(o_orderkey), 0) + 1 AS generation FROM orders GROUP BY 1")
def next_generation(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("generation"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_aliases(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("SELECT l_suppkey, max(l_extendedprice) AS score, list_sort(list(DISTINCT l_returnflag)) AS channels FROM lineitem GROUP BY 1")
def channel_set_per_entity(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("score"), F.sort_array(F.collect_set("l_returnflag")).alias("channels"))


@query("SELECT l_suppkey, bool_or(l_returnflag = 'R') AS partial FROM lineitem GROUP BY 1")
def run_status(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("partial"))


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 24")
def recent_jobs(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(24).select("o_orderkey", "o_orderpriority")


@query("SELECT doc_id, lang FROM documents ORDER BY source, length(text) DESC, doc_id LIMIT 50")
def extraction_selection(spark, d):
    return table(spark, d, "documents").orderBy("source", F.length("text").desc(), "doc_id").limit(50).select("doc_id", "lang")


@query("SELECT count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(length(text)) AS shortest, max(length(text)) AS longest, quantile_cont(length(text), 0.5) AS p50, quantile_cont(length(text), 0.9) AS p90, quantile_cont(length(text), 0.99) AS p99 FROM documents")
def corpus_stats(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), *[F.percentile(n, p).alias(a) for a, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))])


# --- identities and text -------------------------------------------------------
_NS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query(f"""WITH h AS (SELECT doc_id, sha1(unhex(replace('{_NS}', '-', '')) || encode('doc:' || doc_id)) AS h FROM documents)
    SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (CAST('0x' || h[17:17] AS INTEGER) & 3) + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM h""")
def uuid5_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.uuid5(F.lit(_NS), F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("id"))


@query("SELECT doc_id, sha256(text) AS sha, strlen(text) AS bytes FROM documents")
def sha256_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT p_partkey, 'vault/' || replace(url_encode(p_name || '/' || p_type), '%2F', '/') || '#chars=0,' || p_size AS uri FROM part")
def provenance_uris(spark, d):
    return table(spark, d, "part").select("p_partkey", text.provenance_uri(F.lit("vault/"), F.concat("p_name", F.lit("/"), "p_type"), F.lit(0), F.col("p_size")).alias("uri"))


@query("SELECT doc_id, replace(lower(source || '/' || lang), '\\', '/') AS key FROM documents")
def path_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.path_key(F.concat("source", F.lit("\\"), "lang")).alias("key")).withColumn("key", F.col("key"))


@query("SELECT p_partkey, 'chunks_' || trim(regexp_replace(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}]+', '_', 'g')[1:40], '') || '_' || p_size AS name FROM part")
def collection_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" "), "p_type"), F.col("p_size")).alias("name"))


# --- lines and chunks ------------------------------------------------------------
@query(f"WITH {LINES} SELECT doc_id, CAST(pos AS BIGINT) AS pos, char_start, char_end, sha256(line) AS sha FROM lines_m")
def line_spans(spark, d):
    return C.line_spans(table(spark, d, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), "char_start", "char_end", F.sha2("line", 256).alias("sha"))


@query(f"""WITH {LINES} SELECT doc_id, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}([ \\t]|$)') THEN 'heading' WHEN regexp_matches(line, '^ {{0,3}}(```|~~~)') THEN 'fenced_code'
    WHEN regexp_matches(line, '^(    |\\t)') THEN 'indented_code' WHEN regexp_matches(line, '^ {{0,3}}\\|.*\\|[ \\t]*$') THEN 'table' WHEN regexp_matches(line, '^ {{0,3}}([-+*]|[0-9]{{1,9}}[.)])[ \\t]+\\S') THEN 'list'
    WHEN regexp_matches(line, '^ {{0,3}}>') THEN 'blockquote' WHEN regexp_matches(line, '^ {{0,3}}<[A-Za-z/!?]') THEN 'html' ELSE 'paragraph' END AS kind, count(*) AS n FROM lines_m GROUP BY ALL""")
def block_kind_by_line(spark, d):
    return C.line_spans(table(spark, d, "documents")).groupBy("doc_id", C.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {LINES}, b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, char_start, char_end FROM lines_m WHERE line <> ''),
    g AS (SELECT doc_id, i, 0 AS ordinal, char_start AS first, char_end FROM b WHERE i = 1
    UNION ALL SELECT b.doc_id, b.i, CASE WHEN b.char_end - g.first <= 400 THEN g.ordinal ELSE g.ordinal + 1 END, CASE WHEN b.char_end - g.first <= 400 THEN g.first ELSE b.char_start END, b.char_end FROM g JOIN b ON b.doc_id = g.doc_id AND b.i = g.i + 1)
    SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, first AS char_start, max(char_end) AS char_end, count(*) AS n_blocks FROM g GROUP BY ALL""")
def chunk_greedy(spark, d):
    return C.greedy_chunks(C.line_spans(table(spark, d, "documents")).where("line <> ''"), ["doc_id"], 400)


@query("""WITH RECURSIVE p AS (SELECT doc_id, text, 0 AS s, CASE WHEN length(text) <= 700 THEN length(text) WHEN contains(text[1:700], chr(10)) THEN 700 - strpos(reverse(text[1:700]), chr(10)) + 1 ELSE 700 END AS e FROM documents WHERE length(text) > 0
    UNION ALL SELECT doc_id, text, e, CASE WHEN length(text) - e <= 700 THEN length(text) WHEN contains(text[e + 1:e + 700], chr(10)) THEN e + 700 - strpos(reverse(text[e + 1:e + 700]), chr(10)) + 1 ELSE e + 700 END FROM p WHERE e < length(text))
    SELECT doc_id, CAST(s AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end FROM p""")
def chunk_hard_split(spark, d):
    return C.hard_split(table(spark, d, "documents"), most=700)


_POINTS = "points AS (SELECT doc_id, unnest([10, 250, 900]) AS at FROM documents)"


@query(f"WITH {CHUNKS}, {_POINTS} SELECT p.doc_id, CAST(p.at AS BIGINT) AS at, c.chunk_id FROM points p JOIN chunks_m c ON c.section_id = p.doc_id AND p.at >= char_start AND p.at < char_end")
def tag_to_chunk(spark, d):
    points = table(spark, d, "documents").select("doc_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (10, 250, 900)])).alias("at"))
    return I.inside(points, chunks(spark, d).withColumnRenamed("section_id", "doc_id").select("doc_id", "chunk_id", "char_start", "char_end"), "doc_id", "at").select("doc_id", "at", "chunk_id")


@query(f"WITH {CHUNKS}, {_POINTS} SELECT p.doc_id, CAST(p.at AS BIGINT) AS at, arg_min(c.chunk_id, c.ordinal) AS chunk_id FROM points p LEFT JOIN chunks_m c ON c.section_id = p.doc_id AND p.at >= char_start AND p.at < char_end GROUP BY ALL")
def link_to_first_chunk(spark, d):
    points = table(spark, d, "documents").select("doc_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (10, 250, 900)])).alias("at"))
    held = chunks(spark, d).select(F.col("section_id").alias("doc_id"), "chunk_id", "ordinal", "char_start", "char_end")
    return I.first_inside(points, held, "doc_id", "at", "chunk_id", "ordinal")


@query(f"WITH {CHUNKS} SELECT section_id AS doc_id, CASE WHEN bool_and(length(text) < 40) THEN 'structural_anchor' ELSE 'content_evidence' END AS role FROM chunks_m GROUP BY 1")
def chunk_roles(spark, d):
    kinds = chunks(spark, d).groupBy(F.col("section_id").alias("doc_id")).agg(F.collect_set(F.when(F.length("text") < 40, "heading").otherwise("paragraph")).alias("k"))
    return kinds.select("doc_id", C.role(F.col("k")).alias("role"))


#: A note of each whole text: a heading, the text as a quotation, a heading below with code, whose fence stays open.
_NOTES = "notes_m AS (SELECT doc_id, length('# T' || doc_id) + 1 AS a, length('> ' || replace(text, chr(10), chr(10) || '> ')) + 2 AS q FROM documents)"


def _notes(spark, d):
    quoted = F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))
    note = F.concat(F.lit("# T"), F.col("doc_id").cast("string"), F.lit("\n"), quoted, F.lit("\n\n## Code\n\n~~~py\nx = 1\n"))
    version = ids.uuid5(F.lit("6ba7b811-9dad-11d1-80b4-00c04fd430c8"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", note.alias("text"), version.alias("version"))


@query(f"""WITH {_NOTES} SELECT doc_id, unnest([{{'element': 'block', 'kind': 'heading', 'char_start': 0, 'char_end': a, 'heading_path': 'T' || doc_id}}, {{'element': 'block', 'kind': 'blockquote', 'char_start': a, 'char_end': a + q, 'heading_path': 'T' || doc_id}},
    {{'element': 'block', 'kind': 'heading', 'char_start': a + q, 'char_end': a + q + 8, 'heading_path': 'T' || doc_id || '/Code'}}, {{'element': 'block', 'kind': 'fenced_code', 'char_start': a + q + 9, 'char_end': a + q + 21, 'heading_path': 'T' || doc_id || '/Code'}},
    {{'element': 'section', 'kind': 'root', 'char_start': 0, 'char_end': a + q + 21, 'heading_path': ''}}, {{'element': 'section', 'kind': 'heading', 'char_start': 0, 'char_end': a + q + 21, 'heading_path': 'T' || doc_id}}, {{'element': 'section', 'kind': 'heading', 'char_start': a + q, 'char_end': a + q + 21, 'heading_path': 'T' || doc_id || '/Code'}},
    {{'element': 'flag', 'kind': 'unclosed_fence', 'char_start': a + q + 9, 'char_end': a + q + 9, 'heading_path': ''}}], recursive := true) FROM notes_m""")
def markdown_parse(spark, d):
    found = parse.parse_markdown(_notes(spark, d)).where("element IN ('block', 'section', 'flag')")
    return found.select("doc_id", "element", "kind", "char_start", "char_end", F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), "/").alias("heading_path"))


@query(f"""WITH {_NOTES}, t AS (SELECT doc_id, a, q, '# T' || doc_id || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || '## Code' || chr(10) || chr(10) || '~~~py' || chr(10) || 'x = 1' || chr(10) AS note FROM notes_m JOIN documents USING (doc_id)),
    c AS (SELECT doc_id, unnest([{{'char_start': 0, 'char_end': a + q}}, {{'char_start': a + q, 'char_end': a + q + 21}}], recursive := true), note FROM t)
    SELECT doc_id, char_start, char_end, 'content_evidence' AS role, sha256(note[char_start + 1:char_end]) AS content_hash FROM c""")
def markdown_chunks(spark, d):
    found = parse.parse_markdown(_notes(spark, d), version_col="version", target=1_000_000, most=2_000_000).where("element = 'chunk'")
    return found.select("doc_id", "char_start", "char_end", F.col("kind").alias("role"), F.col("sha256").alias("content_hash"))


@query("""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text || ' [[note' || (doc_id % 7) || CASE WHEN doc_id % 2 = 0 THEN '#Part' ELSE '^b1' END || CASE WHEN doc_id % 3 = 0 THEN '|' || lang ELSE '' END || ']] y', '\\[\\[([^\\]\\n]+)\\]\\]', 1)) AS l FROM documents),
    p AS (SELECT doc_id, string_split(l, '|')[1] AS t, CASE WHEN contains(l, '|') THEN regexp_replace(l, '^[^|]*[|]', '') END AS alias FROM l)
    SELECT doc_id, string_split(string_split(t, '#')[1], '^')[1] AS path, string_split(t, '#')[2] AS heading, string_split(t, '^')[2] AS block, alias FROM p""")
def links_split(spark, d):
    """The links of each whole text, one put behind it."""
    doc = table(spark, d, "documents")
    more = F.concat(F.lit(" [[note"), (F.col("doc_id") % 7).cast("string"), F.when(F.col("doc_id") % 2 == 0, "#Part").otherwise("^b1"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("|"), "lang")).otherwise(""), F.lit("]] y"))
    return doc.select("doc_id", F.explode(C.links(F.concat("text", more))).alias("l")).select("doc_id", "l.path", "l.heading", "l.block", "l.alias")


@query("""SELECT doc_id, unnest(regexp_extract_all(text || ' x#no [#no (#' || upper(lang) || '/a-b)', '(?:^|[^\\pL\\pN_/\\[])#([^\\s#.,;:!?()\\[\\]{}]+)', 1)) AS tag FROM documents""")
def tags_extract(spark, d):
    """The tags of each whole text, some put behind it."""
    return table(spark, d, "documents").select("doc_id", F.explode(C.tags(F.concat("text", F.lit(" x#no [#no (#"), F.upper("lang"), F.lit("/a-b)")))).alias("tag"))


# --- data quality --------------------------------------------------------------
@query("SELECT text AS body, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return schemas.duplicates(table(spark, d, "documents").select(F.col("text").alias("body")), "body")


@query(f"WITH {CHUNKS} SELECT chunk_id FROM chunks_m WHERE NOT (char_start >= 0 AND char_start < char_end AND char_end <= 500)")
def span_violations(spark, d):
    return schemas.bad_spans(chunks(spark, d).withColumn("n", F.lit(500)), "char_start", "char_end", "n").select("chunk_id")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def dangling_labels(spark, d):
    return schemas.dangling(table(spark, d, "labels"), "doc_id", table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("parent")), "parent").select("doc_id")


@query("SELECT o_orderkey, least(300, 2 ** least(l_linenumber, 8))::BIGINT AS delay FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def outbox_backoff(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", S.backoff_seconds(F.col("l_linenumber")).alias("delay"))
