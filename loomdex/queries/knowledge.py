"""Queries: graph, evidence, ontology, resolution, queues and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import extract as X
from ..operators import graph as G
from ..operators import answers as A
from ..operators import ontology as O
from ..operators import state as S
from ..operators import writers as W
from ..operators.lineage import scratch
from ..streaming import leases, snapshots
from . import query
from .model import CHUNKS, chunks, table

_EDGES = """edges_m AS (SELECT 's' || s_suppkey AS source_id, 'n' || s_nationkey AS target_id, 'sn' || s_suppkey AS edge_id, 'LOCATED' AS predicate FROM supplier
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nr' || n_nationkey, 'PART_OF' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey, 'rr' || r_regionkey, 'SAME' FROM region)"""
_STEPS = _EDGES + ", steps AS (SELECT source_id AS a, target_id AS b, edge_id, predicate FROM edges_m UNION ALL SELECT target_id, source_id, edge_id, predicate FROM edges_m WHERE source_id <> target_id)"


def _edges(spark, d):
    c = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    s = table(spark, d, "supplier").select(c("s", "s_suppkey").alias("source_id"), c("n", "s_nationkey").alias("target_id"), c("sn", "s_suppkey").alias("edge_id"), F.lit("LOCATED").alias("predicate"))
    n = table(spark, d, "nation").select(c("n", "n_nationkey").alias("source_id"), c("r", "n_regionkey").alias("target_id"), c("nr", "n_nationkey").alias("edge_id"), F.lit("PART_OF").alias("predicate"))
    r = table(spark, d, "region").select(c("r", "r_regionkey").alias("source_id"), c("r", "r_regionkey").alias("target_id"), c("rr", "r_regionkey").alias("edge_id"), F.lit("SAME").alias("predicate"))
    return s.unionByName(n).unionByName(r)


def _walk(seed: str, hops: int) -> str:
    return f"""WITH RECURSIVE {_STEPS}, t AS (SELECT ['{seed}'] AS nodes, []::VARCHAR[] AS edges, 0::BIGINT AS hops
        UNION ALL SELECT list_append(nodes, b), list_append(edges, edge_id), hops + 1 FROM t JOIN steps ON a = nodes[-1] AND NOT list_contains(edges, edge_id) WHERE hops < {hops})"""


@query(f"""WITH {_EDGES} SELECT target_id AS neighbor_id, edge_id, predicate, 'out' AS direction FROM edges_m WHERE source_id = 'n3'
    UNION ALL SELECT source_id, edge_id, predicate, 'in' FROM edges_m WHERE target_id = 'n3' AND source_id <> 'n3'""")
def neighbors_directed(spark, d):
    return G.neighbors(_edges(spark, d), "n3")


@query(f"{_walk('n3', 4)} SELECT nodes, edges, hops FROM t WHERE hops > 0 AND nodes[-1] = 'r3' ORDER BY hops, edges LIMIT 51")
def paths_bounded(spark, d):
    return G.bounded_paths(_edges(spark, d), "n3", "r3")


@query(f"{_walk('s1', 3)} SELECT nodes, edges, hops FROM t WHERE hops > 0 AND nodes[-1] <> 's1' ORDER BY hops, nodes, edges LIMIT 40")
def expand_seeds(spark, d):
    return G.expand(_edges(spark, d), spark.createDataFrame([("s1",)], "id string"), 3, 40)


@query(f"{_walk('s1', 3)}, p AS (SELECT nodes, edges, hops FROM t WHERE hops > 0) SELECT * FROM p WHERE len(list_filter(edges, lambda e: e IN ('rr0', 'rr1', 'nr3', 'nr7'))) = 0")
def stale_paths_dropped(spark, d):
    e = _edges(spark, d)
    return G.drop_stale(G.trails(e, spark.createDataFrame([("s1",)], "id string"), 3), e.where(~F.col("edge_id").isin("rr0", "rr1", "nr3", "nr7")))


@query("SELECT 'nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'LIVES_IN', count(*) FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'PLACED', count(*) FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'order', count(*) FROM orders WHERE o_orderstatus = 'O'")
def graph_snapshot_counts(spark, d):
    c = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    cust, orders = table(spark, d, "customer"), table(spark, d, "orders")
    nodes = {"nation": table(spark, d, "nation").select(c("n", "n_nationkey").alias("id")), "customer": cust.where("c_custkey % 2 = 0").select(c("c", "c_custkey").alias("id")), "order": orders.where("o_orderstatus = 'O'").select(c("o", "o_orderkey").alias("id"))}
    edges = {"LIVES_IN": cust.select(c("c", "c_custkey").alias("source_id"), c("n", "c_nationkey").alias("target_id")), "PLACED": orders.select(c("c", "o_custkey").alias("source_id"), c("o", "o_orderkey").alias("target_id"))}
    n, e = G.snapshot(nodes, edges)
    return n.groupBy("label").agg(F.count("*").alias("n")).unionByName(e.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")))


@query(f"""WITH {_EDGES}, h AS (SELECT sha256('{{"edge_id":"' || edge_id || '","predicate":"' || predicate || '","source_id":"' || source_id || '","target_id":"' || target_id || '"}}')[1:15] AS h FROM edges_m)
    SELECT count(*) AS n_objects, sum(list_sum(list_transform(range(1, 16), lambda i: (instr('0123456789abcdef', h[i]) - 1)::HUGEINT * (16::HUGEINT ** (15 - i))::HUGEINT)))::HUGEINT::VARCHAR AS digest FROM h""")
def graph_fingerprint(spark, d):
    return G.fingerprint(_edges(spark, d))


@query("SELECT item_id, count(*) AS n_documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def evidence_in_documents(spark, d):
    found = X.find_quotes(table(spark, d, "documents"), table(spark, d, "benchmark").withColumnRenamed("text", "quote"), "doc_id", "text", "item_id", "quote")
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"))


@query(f"""WITH {CHUNKS}, q AS (SELECT *, text[1:3] AS quote FROM chunks_m), o AS (SELECT *, list_filter(range(1, length(text) - length(quote) + 2), lambda i: text[i:i + length(quote) - 1] = quote) AS pos FROM q)
    SELECT chunk_id, CASE WHEN len(pos) = 1 THEN char_start + pos[1] - 1 WHEN len(pos) >= 2 THEN char_start + pos[2] - 1 END AS char_start, CASE WHEN len(pos) = 1 THEN char_start + pos[1] - 1 + length(quote) WHEN len(pos) >= 2 THEN char_start + pos[2] - 1 + length(quote) END AS char_end FROM o""")
def evidence_locate(spark, d):
    rows = chunks(spark, d).select("chunk_id", X.locate(F.col("text"), F.col("char_start"), F.left("text", F.lit(3)), F.lit(2)).alias("e"))
    return rows.select("chunk_id", "e.char_start", "e.char_end")


@query("""SELECT o_orderkey, list_sort(list_distinct(list_filter([CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'unknown_type' END, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'unknown_predicate' END, CASE WHEN o_totalprice < 0 THEN 'bad_layer' END], lambda x: x IS NOT NULL))) AS errors FROM orders""")
def ontology_errors(spark, d):
    e = X.error_list(X.ontology_errors(F.col("o_orderstatus"), ["O", "F"], "unknown_type"), X.ontology_errors(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"], "unknown_predicate"), F.when(F.col("o_totalprice") < 0, "bad_layer"))
    return table(spark, d, "orders").select("o_orderkey", e.alias("errors"))


@query("""SELECT r.l_orderkey AS chunk_id, r.l_linenumber AS source_local, r.l_linenumber + 1 AS target_local, a.l_partkey AS source_id, b.l_partkey AS target_id FROM lineitem r JOIN lineitem a ON a.l_orderkey = r.l_orderkey AND a.l_linenumber = r.l_linenumber
    JOIN lineitem b ON b.l_orderkey = r.l_orderkey AND b.l_linenumber = r.l_linenumber + 1 WHERE r.l_quantity > 40""")
def endpoint_resolution(spark, d):
    l = table(spark, d, "lineitem")
    entities = l.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("local_id"), F.col("l_partkey").alias("entity_id"))
    relations = l.where("l_quantity > 40").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("source_local"), (F.col("l_linenumber") + 1).alias("target_local"))
    return X.resolve_endpoints(relations, entities).select("chunk_id", "source_local", "target_local", "source_id", "target_id")


@query("""WITH e AS (SELECT p_brand AS block, p_type AS name, p_partkey AS entity_id, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part)
    SELECT a.entity_id AS left_id, b.entity_id AS right_id FROM e a JOIN e b ON a.block = b.block AND a.name = b.name AND a.n < b.n AND a.n <= 5""")
def review_pairs(spark, d):
    return X.review_pairs(table(spark, d, "part").select(F.col("p_brand").alias("block"), F.col("p_type").alias("name"), F.col("p_partkey").alias("entity_id")), 5)


@query("""WITH c AS (SELECT doc_id, lang AS block, sha256(text) AS key FROM documents), f AS (SELECT block, key, min(doc_id) AS first FROM c GROUP BY ALL)
    SELECT 'c' || lpad(doc_id::VARCHAR, 9, '0') AS candidate_id, CASE WHEN doc_id = first THEN 'create' ELSE 'merge' END AS decision, 'c' || lpad(first::VARCHAR, 9, '0') AS entity_id FROM c JOIN f USING (block, key)""")
def resolve_candidates(spark, d):
    name = F.concat(F.lit("c"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    return X.resolve(table(spark, d, "documents").select(F.col("lang").alias("block"), F.col("doc_id").alias("seq"), name.alias("candidate_id"), F.array(F.sha2("text", 256)).alias("keys")))


@query(f"SELECT doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(text, '{text.IPV4}'), list_transform(regexp_extract_all(text, '{text.EMAIL}'), lambda e: lower(e))))) AS ids FROM documents WHERE regexp_matches(text, '{text.IPV4}') OR regexp_matches(text, '{text.EMAIL}')")
def strong_ids(spark, d):
    ip = F.regexp_extract_all("text", F.lit(text.IPV4), 0)
    mail = F.transform(F.regexp_extract_all("text", F.lit(text.EMAIL), 0), lambda e: F.lower(e))
    return table(spark, d, "documents").select("doc_id", F.array_sort(F.array_distinct(F.concat(ip, mail))).alias("ids")).where("size(ids) > 0")


@query("SELECT p_partkey, trim(regexp_replace(replace(lower(' ' || p_name || '  ' || p_type), 'ß', 'ss'), '\\s+', ' ', 'g')) AS name FROM part")
def name_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normal_name(F.concat(F.lit(" "), "p_name", F.lit("  "), "p_type")).alias("name"))


# --- queues ------------------------------------------------------------------------
_JOBS = """jobs_m AS (SELECT user_id AS job_id, arg_max(CASE event_type WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'click' THEN 'running' ELSE 'failed' END, (ts, event_id)) AS status,
    min(ts) AS created_at, max(ts) AS updated_at, count(*) FILTER (event_type IN ('signup', 'click')) AS attempts FROM events GROUP BY 1)"""


def _jobs(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "view", "queued").when(kind.isin("signup", "click"), "running").when(kind == "purchase", "succeeded").otherwise("failed")
    return S.job_states(table(spark, d, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", status.alias("status")))


@query(f"WITH {_JOBS} SELECT job_id, status, attempts FROM jobs_m")
def job_fold(spark, d):
    return _jobs(spark, d).select("job_id", "status", "attempts")


_LEASED = "leased AS (SELECT *, updated_at + INTERVAL 1 HOUR AS lease_expires_at, CASE WHEN job_id % 3 = 0 THEN NULL ELSE updated_at + INTERVAL 10 MINUTE END AS next_attempt_at, job_id % 5 AS priority, (SELECT max(ts) FROM events) AS now FROM jobs_m)"


def _leased(spark, d):
    now = F.lit(table(spark, d, "events").agg(F.max("ts")).first()[0])
    jobs = _jobs(spark, d)
    due = F.when(F.col("job_id") % 3 != 0, F.col("updated_at") + F.expr("INTERVAL 10 MINUTES"))
    return jobs.withColumns({"lease_expires_at": F.col("updated_at") + F.expr("INTERVAL 1 HOUR"), "next_attempt_at": due, "priority": F.col("job_id") % 5}), now


@query(f"WITH {_JOBS}, {_LEASED} SELECT job_id FROM leased WHERE ((status = 'queued' AND (next_attempt_at IS NULL OR next_attempt_at <= now)) OR (status = 'running' AND lease_expires_at <= now)) AND attempts < 500 ORDER BY priority DESC, next_attempt_at NULLS FIRST, created_at, job_id LIMIT 20")
def job_claim_order(spark, d):
    jobs, now = _leased(spark, d)
    return S.claim_order(S.claimable(jobs, now, 500)).limit(20).select("job_id")


@query(f"WITH {_JOBS}, {_LEASED} SELECT job_id, CASE WHEN status = 'running' AND lease_expires_at <= now THEN CASE WHEN attempts >= 5 THEN 'failed' ELSE 'queued' END ELSE status END AS status FROM leased")
def lease_recovery_fold(spark, d):
    jobs, now = _leased(spark, d)
    return S.recover(jobs, now).select("job_id", "status")


@query(f"WITH {_JOBS}, late AS (SELECT max(ts) - INTERVAL 2 HOUR AS now FROM events) SELECT job_id, CASE WHEN status = 'running' AND date_trunc('millisecond', updated_at + INTERVAL 1 HOUR) <= date_trunc('millisecond', now) THEN CASE WHEN attempts >= 5 THEN 'failed' ELSE 'queued' END ELSE status END AS status, attempts FROM jobs_m, late")
def lease_timers(spark, d):
    """The job log as a stream: what its last events and its timers leave, at a watermark two hours behind."""
    path = scratch(spark, "leases")
    kind = F.col("event_type")
    status = F.when(kind == "view", "queued").when(kind.isin("signup", "click"), "running").when(kind == "purchase", "succeeded").otherwise("failed")
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")  # a pattern may match a file as well as a folder
    log = events.select(F.col("user_id").alias("job_id"), "event_id", "ts", status.alias("status"))
    stream = leases.lease_transitions(log).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").groupBy("job_id").agg(F.max_by("status", F.struct("at", "attempts")).alias("status"), F.max("attempts").alias("attempts"))


@query("SELECT 'd' || doc_id AS key, CASE WHEN doc_id % 5 = 1 THEN 'deleted' ELSE 'active' END AS lifecycle, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 1 AND doc_id % 5 <> 0 THEN 'g' ELSE 'h' END || doc_id AS hash FROM documents")
def scan_stream(spark, d):
    """Two scans as a stream: between them some documents came, some changed, some went."""
    path = scratch(spark, "scans")
    docs = table(spark, d, "documents")
    n, key = F.col("doc_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key")
    for scanned, mark in ((docs.where(n % 5 != 0), F.lit("h")), (docs.where(n % 5 != 1), F.when((n % 3 == 0) & (n % 5 != 0), "g").otherwise("h"))):
        scanned.select(key, F.concat(mark, n.cast("string")).alias("hash"), F.lit(False).alias("failed")).coalesce(1).write.mode("append").parquet(f"{path}/in")
        snapshots.follow(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out/states/batch=1").select("key", "lifecycle", "hash")


@query("""WITH cur AS (SELECT 'c' || doc_id AS chunk_id, doc_id % 3 AS generation FROM documents WHERE doc_id % 3 <> 0), pro AS (SELECT 'c' || doc_id AS chunk_id, doc_id % 4 AS generation, CASE WHEN doc_id % 5 = 0 THEN 'deleted' ELSE 'current' END AS status FROM documents WHERE doc_id % 2 = 0),
    sent AS (SELECT 'qdrant:chunk:' || chunk_id || ':' || generation || ':upsert:p1' AS key FROM pro WHERE status <> 'deleted'),
    ops AS (SELECT chunk_id, 'upsert' AS op, generation FROM cur UNION ALL SELECT chunk_id, 'delete', generation + 1 FROM pro WHERE status <> 'deleted' AND chunk_id NOT IN (SELECT chunk_id FROM cur)),
    keyed AS (SELECT *, 'qdrant:chunk:' || chunk_id || ':' || generation || ':' || op || ':p1' AS idempotency_key FROM ops)
    SELECT * FROM keyed WHERE idempotency_key NOT IN (SELECT key FROM sent)""")
def outbox_diff(spark, d):
    name = F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id")
    docs = table(spark, d, "documents")
    done = docs.where("doc_id % 2 = 0").select(name, (F.col("doc_id") % 4).alias("generation"), F.when(F.col("doc_id") % 5 == 0, "deleted").otherwise("current").alias("status"))
    sent = done.where("status <> 'deleted'").select(F.concat(F.lit("qdrant:chunk:"), "chunk_id", F.lit(":"), F.col("generation").cast("string"), F.lit(":upsert:p1")).alias("idempotency_key"))
    return S.outbox_diff(docs.where("doc_id % 3 <> 0").select(name, (F.col("doc_id") % 3).alias("generation")), done, sent, "p1")


@query("SELECT CASE WHEN bool_or(n_regionkey = 0 AND n_nationkey > 2) THEN 'not_ready' WHEN bool_or(n_nationkey > 2) THEN 'degraded' ELSE 'ready' END AS status FROM nation")
def readiness_fold(spark, d):
    return S.readiness(table(spark, d, "nation").select((F.col("n_nationkey") <= 2).alias("healthy"), (F.col("n_regionkey") == 0).alias("required")))


@query("SELECT count(*) FILTER (e.vec_id IS NOT NULL) AS projected, count(*) AS expected, count(*) FILTER (e.vec_id IS NULL) AS missing FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def projection_health(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("there"))
    return table(spark, d, "documents").select("doc_id").join(v, "doc_id", "left").agg(F.count("there").alias("projected"), F.count("*").alias("expected"), F.count_if(F.col("there").isNull()).alias("missing"))


# --- writers, envelopes, answers -------------------------------------------------------
@query("""SELECT doc_id AS document_id, CASE WHEN doc_id % 4 = 0 THEN 'deleted' ELSE 'active' END AS lifecycle, CASE WHEN doc_id % 4 <> 0 THEN doc_id * 10 + 1 END AS current_version_id FROM documents""")
def soft_delete(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit("active").alias("lifecycle"), (F.col("doc_id") * 10 + 1).alias("current_version_id"))
    return W.soft_delete(docs, docs.where("document_id % 4 = 0"))


@query("""SELECT doc_id AS document_id, doc_id * 10 AS version_id, CASE WHEN doc_id % 3 = 0 THEN 'superseded' ELSE 'ready' END AS status FROM documents UNION ALL SELECT doc_id, doc_id * 10 + 1, 'ready' FROM documents WHERE doc_id % 3 = 0""")
def version_supersede(spark, d):
    docs = table(spark, d, "documents")
    old = docs.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") * 10).alias("version_id"), F.lit("ready").alias("status"))
    new = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") * 10 + 1).alias("version_id"))
    return W.supersede(old, new)


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS fresh FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 3 = 0")
def vector_upsert_delete(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit(0).alias("fresh"))
    return W.put_vectors(v, v.where("chunk_id % 3 = 0").withColumn("fresh", F.lit(1)), v.where("chunk_id % 7 = 0 AND chunk_id % 3 <> 0"), 64).select("chunk_id", "fresh")


@query("SELECT count(*) AS n, count(*) = 500 AS complete, min(len(embedding))::INTEGER AS least_dimension, max(len(embedding))::INTEGER AS most_dimension FROM embeddings")
def vector_collection_state(spark, d):
    return W.collection_state(table(spark, d, "embeddings"), 500)


@query("SELECT conv_id, turn, sha256(text) AS query_sha256, length(text) AS result_count FROM conversations WHERE role = 'user'")
def query_audit(spark, d):
    t = F.lit("2024-01-01").cast("timestamp")
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", W.audit_row(F.col("text"), F.lit("hybrid"), F.lit("succeeded"), F.length("text").cast("long"), t, t).alias("a"))
    return rows.select("conv_id", "turn", "a.query_sha256", "a.result_count")


@query("""SELECT o_orderkey, list_sort(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'not_an_envelope' END, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 THEN 'repeated_local_id' END, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 THEN 'unknown_endpoint' END], lambda x: x IS NOT NULL)) AS errors FROM orders""")
def envelope_errors(spark, d):
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"entities":[{"local_id":"e1"},{"local_id":"'), F.when(k % 3 == 0, "e1").otherwise("e2"), F.lit('"}],"relationships":[{"local_id":"r1","source":"e1","target":"'), F.when(k % 7 == 0, "x").otherwise("e1"), F.lit('"}],"claims":[]}'))
    answer = F.when(k % 5 == 0, "no json").otherwise(body)
    return table(spark, d, "orders").select("o_orderkey", O.envelope_errors(O.read_envelope(answer)).alias("errors"))


@query("SELECT s_suppkey, 'Read ' || s_name || ' in A > ' || s_nationkey || ': text' AS prompt FROM supplier")
def prompt_render(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", O.prompt("Read {path} in {headings}: {text}", F.col("s_name"), F.array(F.lit("A"), F.col("s_nationkey").cast("string")), F.lit("text")).alias("prompt"))


@query(f"""WITH {CHUNKS}, names AS (SELECT DISTINCT t[1] AS name, CAST(ascii(t[1]) AS BIGINT) AS entity_id FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS t FROM benchmark) WHERE len(t) > 0)
    SELECT chunk_id, entity_id, count(*) AS n FROM (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-záéíóöőúüű0-9]+')) AS token FROM chunks_m) JOIN names ON name = token GROUP BY ALL""")
def rule_extraction(spark, d):
    t = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    names = table(spark, d, "benchmark").where(F.size(t) > 0).select(t[0].alias("name")).distinct().withColumn("entity_id", F.ascii("name").cast("long"))
    return O.rule_extract(chunks(spark, d), names)


@query("SELECT l_orderkey AS run_id, count(*) FILTER (l_returnflag <> 'R') AS valid, count(*) FILTER (l_returnflag = 'R') AS invalid, CASE WHEN bool_or(l_returnflag = 'R') THEN 'partial' ELSE 'succeeded' END AS status FROM lineitem GROUP BY 1")
def run_finalize(spark, d):
    return O.finalize(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "R", "invalid").otherwise("valid").alias("status")))


_RANKED = "ranked_m AS (SELECT chunk_id, section_id AS document_id, role, 'a/b.md' AS path FROM chunks_m WHERE section_id = 5 OR (section_id = 6 AND role = 'content_evidence'))"


@query(f"WITH {CHUNKS}, {_RANKED} SELECT chunk_id FROM chunks_m WHERE role = 'content_evidence' AND section_id IN (SELECT min(document_id) FROM ranked_m WHERE role = 'structural_anchor' HAVING count(DISTINCT document_id) = 1)")
def anchor_expansion(spark, d):
    c = chunks(spark, d).withColumnRenamed("section_id", "document_id")
    ranked = c.where("document_id = 5 OR (document_id = 6 AND role = 'content_evidence')").withColumn("path", F.lit("a/b.md"))
    return A.expand_anchor(ranked, c)[1].select("chunk_id")


@query(f"""WITH {CHUNKS}, rows AS (SELECT *, row_number() OVER (ORDER BY ordinal, chunk_id) AS n FROM chunks_m WHERE section_id = 9 AND role = 'content_evidence' AND char_start >= 0 AND char_end <= 3000),
    cum AS (SELECT chunk_id, sum(length(text)) OVER (ORDER BY ordinal, chunk_id) AS s FROM rows WHERE n <= 32) SELECT chunk_id FROM cum WHERE s <= 2000""")
def document_context(spark, d):
    c = chunks(spark, d).withColumnRenamed("section_id", "document_id")
    seeds = spark.createDataFrame([(9, 0, 3000)], "document_id long, span_start long, span_end long")
    return A.document_context(seeds, c, 32, 2000).select("chunk_id")


@query("SELECT CASE l_linenumber % 2 WHEN 0 THEN 'graph' ELSE 'claim' END AS channel, l_partkey AS id, round(1.0::DOUBLE / (60 + min(l_suppkey)), 12) AS score FROM lineitem GROUP BY ALL")
def channel_scores(spark, d):
    ranks = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "graph").otherwise("claim").alias("channel"), F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("rank"))
    return A.channel_scores(ranks).select("channel", "id", F.round("score", 12).alias("score"))


@query("SELECT min(l_orderkey) AS l_orderkey, l_suppkey FROM lineitem GROUP BY l_suppkey")
def source_map(spark, d):
    return A.first_sources(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey").distinct(), "l_suppkey", "l_orderkey")


@query("""SELECT round(avg((o_orderstatus = 'O')::INT), 12) AS query_type, round(avg((o_orderkey % 3 = 0)::INT), 12) AS sources, 1.0::DOUBLE AS entities, 1.0::DOUBLE AS predicates, round(avg((o_orderkey % 2 = 0)::INT), 12) AS no_warnings,
    round(avg((o_orderstatus = 'O' AND o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)::INT), 12) AS accepted FROM orders""")
def evaluation_checks(spark, d):
    none = F.array().cast("array<string>")
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.lit("O").alias("expected_type"), F.col("o_orderstatus").alias("got_type"), F.array(F.lit("s")).alias("expected_sources"), F.when(k % 3 == 0, F.array(F.lit("s"), F.lit("t"))).otherwise(none).alias("got_sources"), none.alias("expected_entities"), none.alias("got_entities"), none.alias("expected_predicates"), none.alias("got_predicates"), F.when(k % 2 == 0, none).otherwise(F.array(F.lit("w"))).alias("warnings"))
    out = A.case_checks(rows)
    return out.select(*[F.round(c, 12).alias(c) for c in out.columns])
