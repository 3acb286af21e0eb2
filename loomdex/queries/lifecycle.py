"""Queries: hydration, seeds, resolution and extraction runs, projections, views, ontology, identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import cascade as Z
from ..operators import extract as X
from ..operators import gates, graph
from ..operators import hydrate as H
from ..operators import lifecycle as L
from ..operators import links as Y
from ..operators import ontology as O
from ..operators import outbox as B
from ..operators import scan
from ..operators import sketches as K
from ..operators import snapshots as N
from ..operators import views as V
from ..operators.lineage import scratch
from . import query
from .model import CHUNKS, CURRENT, MODEL, chunks, documents, table, versions

#: Knowledge derived from the tables: nations are entities, a region's name their alias, every chunk an evidence that
#: mentions one of them; a third of the chunks assert something between two, another third claims something.
KNOWLEDGE = f"""{MODEL}, {CURRENT},
    entities_m AS (SELECT 'n' || n_nationkey AS entity_id, n_name AS name, CASE WHEN n_nationkey % 9 = 0 THEN 'superseded' ELSE 'active' END AS status, 'LOCATION' AS entity_type FROM nation),
    aliases_m AS (SELECT 'n' || n_nationkey AS entity_id, r_name AS alias FROM nation JOIN region ON r_regionkey = n_regionkey),
    evidence_m AS (SELECT chunk_id AS evidence_id, chunk_id, ordinal % 5 <> 4 AS exact, CASE WHEN ordinal % 7 = 3 THEN 'old' ELSE sha256(text) END AS chunk_hash, text[1:12] AS quote FROM chunks_m),
    mentions_m AS (SELECT 'n' || (section_id % 25) AS entity_id, chunk_id, chunk_id AS evidence_id FROM chunks_m),
    assertions_m AS (SELECT 'a' || chunk_id AS assertion_id, 'n' || (section_id % 25) AS source_id, 'n' || ((section_id + ordinal) % 25) AS target_id, CASE WHEN ordinal % 2 = 0 THEN 'PART_OF' ELSE 'USES' END AS predicate, chunk_id AS evidence_id FROM chunks_m WHERE ordinal % 3 = 0),
    claims_m AS (SELECT 'k' || chunk_id AS claim_id, text AS claim, chunk_id AS evidence_id FROM chunks_m WHERE ordinal % 3 = 1),
    proof_m AS (SELECT e.evidence_id, e.quote, c.* FROM evidence_m e JOIN current_m c ON c.chunk_id = e.chunk_id AND sha256(c.text) = e.chunk_hash WHERE exact),
    claimed_m AS (SELECT k.claim_id, k.claim, p.* FROM claims_m k JOIN proof_m p USING (evidence_id)),
    asserted_m AS (SELECT a.assertion_id, a.source_id, a.target_id, a.predicate, s.name AS source_name, t.name AS target_name, p.chunk_id, p.document_id FROM assertions_m a JOIN proof_m p USING (evidence_id)
        JOIN entities_m s ON s.entity_id = source_id AND s.status = 'active' JOIN entities_m t ON t.entity_id = target_id AND t.status = 'active')"""


class Knowledge:
    """The same in DataFrames."""

    def __init__(self, spark, d):
        n = lambda c: F.concat(F.lit("n"), c.cast("string"))
        c = chunks(spark, d)
        nation = table(spark, d, "nation")
        self.chunks, self.documents, self.versions = c, documents(spark, d), versions(spark, d)
        self.sources = gates.current_chunks(c, self.documents, self.versions).withColumn("content_hash", F.sha2("text", 256))
        self.entities = nation.select(n(F.col("n_nationkey")).alias("entity_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 9 == 0, "superseded").otherwise("active").alias("status"), F.lit("LOCATION").alias("entity_type"))
        self.aliases = nation.join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(n(F.col("n_nationkey")).alias("entity_id"), F.col("r_name").alias("alias"))
        self.evidence = c.select(F.col("chunk_id").alias("evidence_id"), "chunk_id", (F.col("ordinal") % 5 != 4).alias("exact"), F.when(F.col("ordinal") % 7 == 3, "old").otherwise(F.sha2("text", 256)).alias("chunk_hash"), F.substring("text", 1, 12).alias("quote"), "char_start", "char_end")
        self.mentions = c.select(n(F.col("section_id") % 25).alias("entity_id"), "chunk_id", F.col("chunk_id").alias("evidence_id"), F.lit("active").alias("status"))
        self.assertions = c.where("ordinal % 3 = 0").select(F.concat(F.lit("a"), F.col("chunk_id").cast("string")).alias("assertion_id"), n(F.col("section_id") % 25).alias("source_id"), n((F.col("section_id") + F.col("ordinal")) % 25).alias("target_id"), F.when(F.col("ordinal") % 2 == 0, "PART_OF").otherwise("USES").alias("predicate"), F.col("chunk_id").alias("evidence_id"))
        self.claims = c.where("ordinal % 3 = 1").select(F.concat(F.lit("k"), F.col("chunk_id").cast("string")).alias("claim_id"), F.col("text").alias("claim"), F.col("chunk_id").alias("evidence_id"))


# --- hydration and seeds ---------------------------------------------------------------
@query(f"WITH {KNOWLEDGE} SELECT claim_id, chunk_id, document_id, vault_id, quote FROM claimed_m")
def claims_hydrated(spark, d):
    k = Knowledge(spark, d)
    return H.claims(k.claims, k.evidence, k.sources).select("claim_id", "chunk_id", "document_id", "vault_id", "quote")


@query(f"WITH {KNOWLEDGE} SELECT assertion_id, source_name, target_name, predicate, chunk_id, document_id FROM asserted_m")
def assertions_hydrated(spark, d):
    k = Knowledge(spark, d)
    return H.assertions(k.assertions, k.entities, k.evidence, k.sources).select("assertion_id", "source_name", "target_name", "predicate", "chunk_id", "document_id")


_TERMS = ["france", "asia", "kenya"]
_RANKED = [600000, 700000, 1000000]  # a channel's ranked chunks, which a caller hands over


@query(f"""WITH {KNOWLEDGE}, pairs AS (SELECT e.entity_id, e.name, m.chunk_id, coalesce(list_position([600000, 700000, 1000000], m.chunk_id), 0) AS pos, regexp_matches(lower(e.name), 'france|asia|kenya') AS named
        FROM entities_m e JOIN (SELECT DISTINCT entity_id, chunk_id FROM mentions_m SEMI JOIN current_m USING (chunk_id)) m USING (entity_id) WHERE e.status = 'active'
        AND (named OR pos > 0 OR EXISTS (SELECT 1 FROM aliases_m a WHERE a.entity_id = e.entity_id AND regexp_matches(lower(alias), 'france|asia|kenya'))) ORDER BY name, entity_id, chunk_id LIMIT 1000),
    s AS (SELECT *, named AND lower(name) IN ('france', 'asia', 'kenya') AS whole FROM pairs),
    r AS (SELECT entity_id, name, chunk_id, greatest(CASE WHEN whole THEN 1.0::DOUBLE ELSE 0 END, CASE WHEN pos > 0 THEN 1.0::DOUBLE / pos ELSE 0 END) AS score, whole, pos FROM s WHERE whole OR pos > 0)
    SELECT entity_id, name, round(max(score), 9) AS score, CASE WHEN bool_or(pos > 0) AND bool_or(whole) THEN 'chunk,entity' WHEN bool_or(pos > 0) THEN 'chunk' ELSE 'entity' END AS channels, count(DISTINCT chunk_id) AS n_sources FROM r GROUP BY ALL""")
def entity_seeds_channels(spark, d):
    k = Knowledge(spark, d)
    found = H.entity_seeds(k.entities, k.aliases, k.mentions, k.sources, _TERMS, _RANKED, 50)
    return found.select("entity_id", "name", F.round("score", 9).alias("score"), F.array_join("channels", ",").alias("channels"), F.size("source_chunk_ids").cast("long").alias("n_sources"))


@query(f"""WITH {KNOWLEDGE}, c AS (SELECT claim_id, (contains(lower(claim), 'the'))::INT + (contains(lower(claim), 'and'))::INT + (contains(lower(claim), 'pri'))::INT AS overlap, coalesce(list_position([100001, 200001, 400004], chunk_id), 0) AS pos FROM claimed_m
        WHERE (regexp_matches(lower(claim), 'the|and|pri') OR pos > 0) ORDER BY claim_id LIMIT 2000),
    s AS (SELECT claim_id, greatest(CASE WHEN overlap >= 2 THEN overlap / 3.0::DOUBLE ELSE 0 END, CASE WHEN pos > 0 THEN 1.0::DOUBLE / pos ELSE 0 END) AS score FROM c)
    SELECT claim_id, round(score, 9) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, claim_id LIMIT 30""")
def claim_candidates_channels(spark, d):
    k = Knowledge(spark, d)
    current = H.claims(k.claims, k.evidence, k.sources)
    return H.claim_candidates(current, ["the", "and", "pri"], [100001, 200001, 400004], 30).select("claim_id", F.round("score", 9).alias("score"))


@query(f"""WITH {KNOWLEDGE}, p AS (SELECT a.assertion_id AS path_id, [a.assertion_id, b.assertion_id] AS edges FROM assertions_m a JOIN assertions_m b ON b.evidence_id = a.evidence_id + 3)
    SELECT path_id, x.predicate || '>' || y.predicate AS predicates, least(x.chunk_id, y.chunk_id) AS first_source FROM p JOIN asserted_m x ON x.assertion_id = edges[1] JOIN asserted_m y ON y.assertion_id = edges[2]""")
def graph_enriched_paths(spark, d):
    k = Knowledge(spark, d)
    nxt = k.assertions.select(F.col("assertion_id").alias("second"), (F.col("evidence_id") - 3).alias("evidence_id"))
    paths = k.assertions.join(nxt, "evidence_id").select(F.col("assertion_id").alias("path_id"), F.array("assertion_id", "second").alias("edges"))
    found = H.enrich_paths(paths, H.assertions(k.assertions, k.entities, k.evidence, k.sources))
    return found.select("path_id", F.array_join("predicates", ">").alias("predicates"), F.element_at("source_chunk_ids", 1).alias("first_source"))


@query(f"""WITH {KNOWLEDGE}, p AS (SELECT m.entity_id, count(DISTINCT p.evidence_id) AS n, list_sort(list(DISTINCT p.document_id)) AS documents FROM mentions_m m JOIN proof_m p USING (evidence_id) GROUP BY 1)
    SELECT e.entity_id, name, list_sort((SELECT list(DISTINCT alias) FROM aliases_m a WHERE a.entity_id = e.entity_id)) AS aliases, coalesce(n, 0) AS n_evidence, coalesce(documents, []) AS documents FROM entities_m e LEFT JOIN p USING (entity_id)""")
def entity_detail(spark, d):
    k = Knowledge(spark, d)
    none = k.aliases.select("entity_id", F.lit("fqdn").alias("kind"), F.lit("x").alias("value")).where("false")
    return H.entity_details(k.entities, k.aliases, none, k.mentions, k.evidence, k.sources).drop("identifiers")


# --- extraction and resolution runs -------------------------------------------------------
@query("""SELECT o_custkey AS run_id, o_orderkey AS chunk_id, CASE o_orderstatus WHEN 'O' THEN 'pending' ELSE 'provider_failed' END AS status FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('O', 'P') AND c_mktsegment = 'BUILDING'""")
def pending_chunks(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "provider_failed").otherwise("succeeded")
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_mktsegment") == "BUILDING", "running").otherwise("succeeded").alias("status"))
    return L.pending_chunks(table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("chunk_id"), status.alias("status")), runs)


@query("""SELECT l_orderkey AS run_id, l_linenumber AS chunk, l_partkey AS item FROM lineitem WHERE l_returnflag <> 'R' AND (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'R')
    UNION ALL SELECT l_orderkey, l_linenumber, -l_partkey FROM lineitem WHERE l_returnflag = 'R'""")
def results_replaced(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("chunk"), F.col("l_partkey").alias("item"), "l_returnflag")
    return L.replace_results(l.drop("l_returnflag"), l.where("l_returnflag = 'R'").select("run_id", "chunk", (-F.col("item")).alias("item")), "run_id", "chunk")


@query(f"""WITH {KNOWLEDGE} SELECT 'c' || e.evidence_id AS candidate_id, chunk_id, quote, 'v' || (evidence_id % 4) AS vault_id FROM evidence_m e WHERE evidence_id % 3 <> 0 AND evidence_id % 2 = 1""")
def candidates_unresolved(spark, d):
    k = Knowledge(spark, d)
    name = F.concat(F.lit("c"), F.col("evidence_id").cast("string"))
    candidates = k.evidence.select(name.alias("candidate_id"), (F.col("evidence_id") % 4).alias("run_id"), "evidence_id", F.when(F.col("evidence_id") % 3 == 0, F.array(F.lit("unknown_entity_type"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    runs = spark.range(4).select(F.col("id").alias("run_id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("vault_id"))
    decisions = k.evidence.where("evidence_id % 2 = 0").select(name.alias("candidate_id"))
    return L.unresolved(candidates, k.evidence, runs, decisions).select("candidate_id", "chunk_id", "quote", "vault_id")


@query("""SELECT list_filter([CASE WHEN l_quantity > 45 THEN 'long' END, CASE WHEN l_discount > 0.08 THEN 'cheap' END], lambda x: x IS NOT NULL) AS errors, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY ALL""")
def candidate_summary(spark, d):
    errors = F.array_compact(F.array(F.when(F.col("l_quantity") > 45, "long"), F.when(F.col("l_discount") > 0.08, "cheap")))
    return L.summary(table(spark, d, "lineitem").select(errors.alias("errors"), F.col("l_linestatus").alias("status")), "errors", "status")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS entity_id, lower(l_returnflag) AS alias FROM lineitem), m AS (SELECT DISTINCT l_suppkey AS entity_id, l_orderkey * 10 + l_linenumber AS evidence_id FROM lineitem)
    SELECT 'alias' AS kind, count(*) AS n, sum(entity_id)::BIGINT AS total FROM a WHERE alias <> 'n' UNION ALL SELECT 'mention', count(*), sum(entity_id)::BIGINT FROM m WHERE evidence_id % 2 = 1""")
def resolution_writes(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("name"), F.col("l_orderkey").alias("chunk_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"))
    aliases = l.select("entity_id", F.lit("n").alias("alias")).distinct()
    new_aliases, new_mentions = L.resolution_writes(l, aliases, l.where("evidence_id % 2 = 0").select("entity_id", "chunk_id", "evidence_id"))
    total = [F.count("*").alias("n"), F.sum("entity_id").alias("total")]
    return new_aliases.agg(*total).select(F.lit("alias").alias("kind"), "n", "total").unionByName(new_mentions.agg(*total).select(F.lit("mention").alias("kind"), "n", "total"))


@query("""WITH r AS (SELECT l_orderkey AS chunk_id, l_linenumber AS local_id, l_partkey AS entity_id FROM lineitem WHERE l_returnflag <> 'N')
    SELECT l_orderkey * 10 + l_linenumber AS relation_id, s.entity_id AS source_id, t.entity_id AS target_id FROM lineitem JOIN r s ON s.chunk_id = l_orderkey AND s.local_id = l_linenumber JOIN r t ON t.chunk_id = l_orderkey AND t.local_id = l_linenumber + 1""")
def assertions_materialised(spark, d):
    l = table(spark, d, "lineitem")
    relations = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("source_local"), (F.col("l_linenumber") + 1).alias("target_local"), F.lit("USES").alias("predicate"))
    claims = l.select(F.col("l_orderkey").alias("claim_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("subject_local"))
    resolved = l.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("local_id"), F.col("l_partkey").alias("entity_id"))
    return L.materialise(relations, claims, resolved)[0].drop("predicate")


@query("SELECT l_orderkey AS run_id, count(*) FILTER (l_returnflag = 'N') AS created, count(*) FILTER (l_returnflag = 'A') AS merged, count(*) FILTER (l_returnflag = 'R') AS deferred, count(*) FILTER (l_quantity > 40) AS reviewed FROM lineitem GROUP BY 1")
def resolution_counters(spark, d):
    decision = F.when(F.col("l_returnflag") == "N", "create").when(F.col("l_returnflag") == "A", "merge").otherwise("defer")
    return L.resolution_counters(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), decision.alias("decision"), (F.col("l_quantity") > 40).alias("review")))


@query("""SELECT o_custkey AS job_id, o_orderkey AS run_id, CASE WHEN c_custkey IS NULL THEN 'unknown_run' ELSE 'other_vault' END AS error FROM orders LEFT JOIN customer ON c_custkey = o_orderkey WHERE c_custkey IS NULL OR c_nationkey <> o_custkey % 25""")
def job_scope_errors(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), (F.col("o_custkey") % 25).alias("vault_id"), F.col("o_orderkey").alias("run_id"))
    return L.out_of_scope(asked, table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").alias("vault_id")))


@query("SELECT a.p_partkey, CASE WHEN lower(trim(p_name)) = lower(trim(p_type)) OR p_partkey % 2 = 0 THEN 1.0000::DECIMAL(6,4) END::DOUBLE AS score FROM part a")
def exact_name_score(spark, d):
    other = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "))).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", L.exact_name_score(F.col("p_name"), other).cast("double").alias("score"))


@query("""SELECT kind, content_hash, active FROM (SELECT p_brand AS kind, sha256(p_type) AS content_hash, sha256(p_type) = arg_max(sha256(p_type), (p_type, sha256(p_type))) OVER (PARTITION BY p_brand) AS active FROM (SELECT DISTINCT p_brand, p_type FROM part))""")
def runtime_registry(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("kind"), F.col("p_type").alias("name"), F.col("p_type").alias("content")).distinct()
    return L.register(part.where("name LIKE '%A%'").withColumn("active", F.lit(True)), part.withColumn("active", F.lit(False))).select("kind", "content_hash", "active")


# --- projections and views ------------------------------------------------------------------
_OUTBOX = f"""{MODEL}, outbox_m AS (SELECT chunk_id, version_id, 'key' || chunk_id AS idempotency_key, CASE WHEN ordinal % 4 = 0 THEN 'delete' ELSE 'upsert' END AS op, ['pending', 'processing', 'succeeded', 'failed'][1 + ordinal % 4] AS status, 'p' || (ordinal % 3) AS profile FROM chunks_m)"""


def _outbox(c):
    state = F.element_at(F.array(*map(F.lit, ("pending", "processing", "succeeded", "failed"))), (F.col("ordinal") % 4 + 1).cast("int"))
    return c.select("chunk_id", F.concat(F.lit("key"), F.col("chunk_id").cast("string")).alias("idempotency_key"), F.when(F.col("ordinal") % 4 == 0, "delete").otherwise("upsert").alias("op"), state.alias("status"), F.concat(F.lit("p"), (F.col("ordinal") % 3).cast("string")).alias("profile"))


@query(f"WITH {_OUTBOX}, {CURRENT} SELECT idempotency_key, CASE WHEN op = 'upsert' AND chunk_id IN (SELECT chunk_id FROM current_m) THEN 'upsert' ELSE 'delete' END AS side FROM outbox_m")
def outbox_split(spark, d):
    k = Knowledge(spark, d)
    up, down = V.outbox_split(_outbox(k.chunks), k.sources)
    return up.select("idempotency_key", F.lit("upsert").alias("side")).unionByName(down.select("idempotency_key", F.lit("delete").alias("side")))


@query(f"WITH {_OUTBOX} SELECT profile, count(*) FILTER (status IN ('pending', 'processing')) AS pending, count(*) FILTER (status = 'failed') AS failed, false AS may_switch FROM outbox_m GROUP BY 1")
def outbox_outstanding(spark, d):
    return V.outstanding(_outbox(chunks(spark, d)))


@query(f"WITH {_OUTBOX} SELECT d.vault_id, o.status, count(*) AS n FROM outbox_m o JOIN versions_m v USING (version_id) JOIN documents_m d USING (document_id) GROUP BY ALL")
def outbox_by_status(spark, d):
    c = chunks(spark, d)
    return V.outbox_by_status(_outbox(c), c, documents(spark, d), versions(spark, d))


_SCANS = "scans_m AS (SELECT event_id AS scan_id, 's' || (user_id % 5) AS vault_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN event_type = 'view' THEN 'measure' ELSE 'incremental' END AS scan_type, event_id % 3 AS changed, ts AS started_at, ts + INTERVAL 5 MINUTE AS finished_at FROM events)"


def _scans(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").select(F.col("event_id").alias("scan_id"), F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("vault_id"), F.when(kind == "error", "failed").otherwise("succeeded").alias("status"), F.when(kind == "view", "measure").otherwise("incremental").alias("scan_type"), (F.col("event_id") % 3).alias("changed"), F.col("ts").alias("started_at"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("finished_at"))


@query(f"""WITH {_SCANS}, last AS (SELECT vault_id, max_by(scan_id, finished_at) AS scan_id, max_by(started_at, finished_at) AS started_at, max(finished_at) AS finished_at FROM scans_m WHERE status = 'succeeded' AND scan_type <> 'measure' AND changed > 0 GROUP BY 1),
    shown AS (SELECT vault_id, max(finished_at) AS shown_at FROM scans_m WHERE scan_id % 2 = 0 AND status = 'succeeded' AND vault_id <> 's1' GROUP BY 1),
    due AS (SELECT last.* FROM last LEFT JOIN shown USING (vault_id) WHERE shown_at IS NULL OR shown_at < finished_at), changes AS (SELECT scan_id, doc_id AS document_id, source AS path FROM documents CROSS JOIN due),
    runs AS (SELECT o_orderkey % 1000 AS document_id, max(o_orderkey) AS run_id FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
    SELECT vault_id, document_id, path, run_id AS extraction_run FROM changes JOIN due USING (scan_id) LEFT JOIN runs USING (document_id)""")
def pending_refresh(spark, d):
    scans = _scans(spark, d)
    # every document changed in every vault's latest scan, and was extracted long after it
    usable = scans.where("status = 'succeeded' AND scan_type <> 'measure' AND changed > 0").groupBy("vault_id").agg(F.max_by("scan_id", "finished_at").alias("scan_id")).select("scan_id")
    changes = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("path"), F.lit("modified").alias("kind")).withColumn("scan_id", F.explode(F.array(*[F.lit(r.scan_id) for r in usable.collect()])))
    graphs = scans.where("scan_id % 2 = 0 AND vault_id <> 's1'").select("vault_id", "status", "finished_at")
    runs = table(spark, d, "orders").select((F.col("o_orderkey") % 1000).alias("document_id"), F.col("o_orderkey").alias("run_id"), F.lit("2999-01-01").cast("timestamp").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "partial").otherwise("succeeded").alias("status"))
    return V.pending_refresh(scans, changes, graphs, runs)


@query(f"""WITH {MODEL}, {CURRENT}, state AS (SELECT vault_id, count(*) AS documents, count(*) FILTER (lifecycle = 'active') AS active, count(*) FILTER (lifecycle = 'deleted') AS deleted FROM documents_m GROUP BY 1)
    SELECT state.*, coalesce(n, 0) AS current_chunks FROM state LEFT JOIN (SELECT vault_id, count(*) AS n FROM current_m GROUP BY 1) USING (vault_id)""")
def operator_overview(spark, d):
    return V.vault_overview(documents(spark, d), versions(spark, d), chunks(spark, d), _scans(spark, d)).drop("last_scan", "scan_status")


@query("SELECT r_regionkey, r_name AS name FROM region WHERE r_regionkey <> 2")
def active_vaults(spark, d):
    return V.active_vaults(table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("name"), F.when(F.col("r_regionkey") == 2, "deleted").otherwise("active").alias("status"))).drop("status")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 33")
def primary_key_lookup(spark, d):
    return V.lookup(table(spark, d, "orders"), "o_orderkey", 33).select("o_orderkey", "o_custkey")


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'created' WHEN doc_id % 5 = 0 THEN 'deleted' WHEN doc_id % 3 = 0 THEN 'modified' END AS kind FROM documents) WHERE kind IS NOT NULL GROUP BY 1""")
def measure_scan(spark, d):
    docs = table(spark, d, "documents")
    key, own = F.col("doc_id").cast("string").alias("key"), F.concat(F.lit("h"), F.col("doc_id").cast("string"))
    now = F.when((F.col("doc_id") % 3 == 0) & (F.col("doc_id") % 7 != 0), F.concat(own, F.lit("!"))).otherwise(own)
    old = docs.where("doc_id % 7 <> 0").select(key, own.alias("hash"))
    new = docs.where("doc_id % 7 = 0 OR doc_id % 5 <> 0").select(key, now.alias("hash"), F.lit(False).alias("failed"))
    return V.measure(scan.diff(old, new))


@query(f"""WITH {CHUNKS} SELECT chunk_id, '{{"version_id":' || version_id || ',"section_id":' || section_id || ',"ordinal":' || ordinal || ',"role":"' || role || '"}}' AS payload FROM chunks_m""")
def chunk_payload(spark, d):
    return V.payload(chunks(spark, d), "version_id", "section_id", "ordinal", "role")


@query("SELECT c_custkey, coalesce(o.total, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def update_from(spark, d):
    totals = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("c_acctbal"))
    return V.update_from(table(spark, d, "customer").select("c_custkey", "c_acctbal"), totals, "c_custkey", "c_acctbal")


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(b.x, a.x) AS x, coalesce(b.y, a.y) AS y FROM (SELECT s_suppkey AS k, s_name AS x, s_acctbal AS y FROM supplier) a
    FULL JOIN (SELECT s_suppkey + 5 AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'new' END AS x, CASE WHEN s_suppkey % 3 = 0 THEN 1.0::DOUBLE END AS y FROM supplier) b ON a.k = b.k""")
def upsert_coalesced(spark, d):
    s = table(spark, d, "supplier")
    old = s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("x"), F.col("s_acctbal").alias("y"))
    new = s.select((F.col("s_suppkey") + 5).alias("k"), F.when(F.col("s_suppkey") % 2 == 0, "new").alias("x"), F.when(F.col("s_suppkey") % 3 == 0, 1.0).alias("y"))
    return V.merge(old, new, "k")


@query("""WITH r AS (SELECT o_custkey % 50 AS vault_id, o_orderpriority AS snapshot, o_orderkey AS generation, o_orderstatus = 'F' AS done FROM orders), asked AS (SELECT DISTINCT vault_id, snapshot FROM r UNION SELECT DISTINCT vault_id, 'zz' FROM r),
    k AS (SELECT vault_id, snapshot, max(generation) AS known, bool_or(done) AS done FROM r GROUP BY ALL), l AS (SELECT vault_id, max(generation) AS last FROM r GROUP BY 1)
    SELECT vault_id, snapshot, coalesce(known, last + 1) AS generation, (NOT coalesce(done, false)) AS should_project FROM asked LEFT JOIN k USING (vault_id, snapshot) LEFT JOIN l USING (vault_id)""")
def projection_prepare(spark, d):
    runs = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("vault_id"), F.col("o_orderpriority").alias("snapshot"), F.col("o_orderkey").alias("generation"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status"))
    asked = runs.select("vault_id", "snapshot").unionByName(runs.select("vault_id", F.lit("zz").alias("snapshot")))
    return V.prepare_projection(asked, runs)


@query(f"""WITH {MODEL}, held AS (SELECT version_id, count(*) AS n_chunks, count(DISTINCT section_id) AS n_sections FROM chunks_m GROUP BY 1)
    SELECT d.document_id, d.vault_id, d.path, d.lifecycle, v.status AS version_status, coalesce(n_sections, 0) AS n_sections, coalesce(n_chunks, 0) AS n_chunks FROM documents_m d LEFT JOIN versions_m v ON v.version_id = d.current_version_id LEFT JOIN held ON held.version_id = d.current_version_id""")
def documents_view(spark, d):
    return V.documents_view(documents(spark, d), versions(spark, d), chunks(spark, d))


_SETS = ["Vault", "Document", "DocumentVersion", "Section", "Chunk", "Entity", "RelationshipAssertion", "Claim", "Evidence"]


@query(f"""WITH {KNOWLEDGE}, n AS (SELECT 'Vault' AS label, count(DISTINCT vault_id) AS n FROM documents_m UNION ALL SELECT 'Document', count(*) FROM documents_m UNION ALL SELECT 'DocumentVersion', count(*) FROM versions_m UNION ALL SELECT 'Section', count(DISTINCT section_id) FROM chunks_m
    UNION ALL SELECT 'Chunk', count(*) FROM chunks_m UNION ALL SELECT 'Entity', count(*) FROM entities_m UNION ALL SELECT 'RelationshipAssertion', count(*) FROM assertions_m UNION ALL SELECT 'Claim', count(*) FROM claims_m UNION ALL SELECT 'Evidence', count(*) FROM evidence_m
    UNION ALL SELECT 'CONTAINS', count(*) FROM documents_m WHERE vault_id IS NOT NULL UNION ALL SELECT 'HAS_VERSION', count(*) FROM versions_m UNION ALL SELECT 'HAS_SECTION', count(DISTINCT section_id) FROM chunks_m UNION ALL SELECT 'HAS_CHUNK', count(*) FROM chunks_m
    UNION ALL SELECT 'MENTIONS', count(*) FROM mentions_m UNION ALL SELECT x, count(*) FROM assertions_m, (VALUES ('SUBJECT'), ('OBJECT'), ('ENTITY_LINK'), ('ASSERTION_SUPPORTED_BY')) v(x) GROUP BY x UNION ALL SELECT 'CLAIM_SUPPORTED_BY', count(*) FROM claims_m UNION ALL SELECT 'LOCATED_IN', count(*) FROM evidence_m)
    SELECT label, n FROM n WHERE n > 0""")
def graph_sets(spark, d):
    k = Knowledge(spark, d)
    sections = k.chunks.select("section_id", "version_id").distinct().withColumn("parent_id", F.lit(None).cast("long"))
    links = k.documents.select("document_id", F.lit(None).cast("long").alias("target_document_id"))
    vaults = k.documents.where("vault_id IS NOT NULL").select("vault_id").distinct()
    nodes, edges = graph.snapshot(*V.snapshot_sets(vaults, k.documents, k.versions, sections, k.chunks, links, k.entities, k.mentions, k.assertions, k.claims, k.evidence))
    return nodes.groupBy("label").agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")))


@query(f"""WITH {KNOWLEDGE}, e AS (SELECT assertion_id AS edge_id, source_id, target_id, predicate FROM assertions_m WHERE predicate = 'USES'),
    n AS (SELECT target_id AS neighbor_id, edge_id, 'out' AS direction FROM e WHERE source_id = 'n6' UNION ALL SELECT source_id, edge_id, 'in' FROM e WHERE target_id = 'n6' AND source_id <> 'n6')
    SELECT neighbor_id, name, edge_id, direction FROM n JOIN entities_m ON entity_id = neighbor_id ORDER BY lower(name), neighbor_id, edge_id LIMIT 21""")
def neighbor_page(spark, d):
    k = Knowledge(spark, d)
    edges = k.assertions.withColumnRenamed("assertion_id", "edge_id")
    return graph.neighbor_page(edges, k.entities, "n6", predicates=["USES"], types=["LOCATION"], most=20).select("neighbor_id", "name", "edge_id", "direction")


@query("""WITH r AS (SELECT 'node:{"id":"n' || n_nationkey || '","label":"nation"}' AS row FROM nation UNION ALL SELECT 'edge:{"source_id":"n' || n_nationkey || '","target_id":"r' || n_regionkey || '"}' FROM nation)
    SELECT count(*) AS n_objects, sha256(string_agg(row, chr(10) ORDER BY row)) AS sha256 FROM r""")
def snapshot_hash(spark, d):
    nation = table(spark, d, "nation")
    n = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    nodes = nation.select(F.lit("nation").alias("label"), n.alias("id"))
    return graph.canonical_hash(nodes, nation.select(n.alias("source_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("target_id")))


@query(f"""WITH {MODEL} SELECT c.chunk_id AS source_id, d.vault_id, d.document_id, d.path AS relative_path, c.char_start, c.char_end, sha256(c.text) AS content_hash, 'vault://' || d.vault_id || '/' || d.path AS source_uri, CASE WHEN d.vault_id < 'm' THEN 'note://open?file=' || d.path END AS note_uri
    FROM chunks_m c JOIN documents_m d ON d.current_version_id = c.version_id WHERE d.lifecycle = 'active' AND d.vault_id IS NOT NULL""")
def source_view(spark, d):
    docs = documents(spark, d)
    vaults = docs.where("vault_id IS NOT NULL").select("vault_id").distinct().select("vault_id", F.concat(F.lit("vault://"), "vault_id", F.lit("/")).alias("prefix"), F.when(F.col("vault_id") < "m", "note://open?file={relative_path}").alias("uri_template"))
    return V.source_view(chunks(spark, d), docs, vaults).drop("version_id", "section_id", "quote")


@query(f"""WITH {MODEL} SELECT c.section_id, d.document_id, count(*) AS n_chunks FROM chunks_m c JOIN documents_m d ON d.current_version_id = c.version_id WHERE d.lifecycle = 'active' GROUP BY ALL""")
def sections_view(spark, d):
    sections = chunks(spark, d).groupBy("version_id", "section_id").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("n_chunks"))
    return V.sections_view(documents(spark, d), sections).select("section_id", "document_id", "n_chunks")


_OUTBOX = """box AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'processing' ELSE 'succeeded' END AS status, o_orderkey % 6 AS attempts, o_custkey % 500 AS chunk_id, o_orderkey % 3 AS generation, o_orderkey % 4 = 0 AS gone, o_orderdate::TIMESTAMP AS created_at, o_orderdate::TIMESTAMP + INTERVAL 30 DAY AS expires FROM orders),
    swept AS (SELECT * REPLACE (CASE WHEN status = 'processing' AND expires < TIMESTAMP '1997-01-01' AND attempts >= 5 THEN 'failed' ELSE status END AS status) FROM box),
    taken AS (SELECT id FROM swept WHERE attempts < 5 AND (status = 'pending' OR (status = 'processing' AND expires < TIMESTAMP '1997-01-01')) ORDER BY created_at, id LIMIT 400),
    claimed AS (SELECT s.*, t.id IS NOT NULL AS mine FROM swept s LEFT JOIN taken t USING (id)),
    marked AS (SELECT id, CASE WHEN NOT mine THEN status WHEN id % 5 <> 0 THEN 'succeeded' WHEN attempts + 1 < 5 THEN 'pending' ELSE 'failed' END AS status, attempts + mine::INT AS attempts, CASE WHEN mine AND id % 5 = 0 AND attempts + 1 < 5 THEN least(300, pow(2, least(attempts + 1, 8)))::BIGINT END AS wait, mine FROM claimed)"""


@query(f"WITH {_OUTBOX} SELECT status, attempts, wait, count(*) AS n, sum(id)::BIGINT AS total FROM marked GROUP BY ALL")
def outbox_marked(spark, d):
    """A batch is claimed and marked: four of five rows succeed."""
    o = table(spark, d, "orders")
    created, now = F.col("o_orderdate").cast("timestamp"), F.lit("1997-01-01").cast("timestamp")
    none = F.lit(None)
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "processing").otherwise("succeeded")
    box = o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.when(F.col("o_orderkey") % 4 == 0, "delete").otherwise("upsert").alias("operation"), (F.col("o_orderkey") % 3).alias("generation"), (F.col("o_custkey") % 500).alias("chunk_id"), (F.col("o_orderkey") % 6).alias("attempts"), F.lit(5).alias("max_attempts"), none.cast("timestamp").alias("next_attempt_at"), none.cast("string").alias("lease_owner"), (created + F.expr("INTERVAL 30 DAYS")).alias("lease_expires_at"), created.alias("created_at"), none.cast("string").alias("error"))
    after, mine = B.claim_batch(B.exhaust(box, now), "w", now, 400, 60)
    results = mine.select("id", F.lit(True).alias("is_current"), F.when(F.col("id") % 5 == 0, "provider_down").alias("error"))
    states = box.select("chunk_id", F.lit(0).cast("long").alias("generation"), F.lit("pending").alias("status")).distinct()
    box, _ = B.mark(after, states, results, now)
    wait = F.unix_timestamp("next_attempt_at") - F.unix_timestamp(now)
    return box.groupBy("status", "attempts", wait.alias("wait")).agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query("""WITH jobs AS (SELECT c_custkey AS job_id, c_nationkey AS vault_id FROM customer), asked AS (SELECT DISTINCT o_custkey AS job_id, o_orderkey AS chunk_id FROM orders WHERE o_orderstatus = 'O')
    SELECT sha256('run:' || job_id) AS run_id, job_id, vault_id, count(*) AS requested FROM jobs JOIN asked USING (job_id) WHERE job_id % 7 <> 0 GROUP BY ALL""")
def runs_prepared(spark, d):
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_nationkey").alias("vault_id"))
    asked = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("chunk_id"))
    return L.prepare_runs(jobs, jobs.where("job_id % 7 = 0"), asked)[0].drop("status")


@query("""WITH r AS (SELECT l_suppkey AS entity_id, l_orderkey * 10 + l_linenumber AS candidate_id, CAST(l_partkey % 20 AS VARCHAR) AS value FROM lineitem)
    SELECT entity_id, 'asset_id' AS kind, value, min(candidate_id) AS candidate_id, min(candidate_id) AS evidence_id FROM r WHERE value <> '7' GROUP BY ALL""")
def identifier_writes(spark, d):
    l = table(spark, d, "lineitem")
    ids = F.array(F.struct(F.lit("asset_id").alias("kind"), (F.col("l_partkey") % 20).cast("string").alias("value")))
    one = (F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    resolved = l.select(F.col("l_suppkey").alias("entity_id"), one.alias("candidate_id"), one.alias("evidence_id"), ids.alias("ids"))
    known = l.select(F.col("l_suppkey").alias("entity_id"), F.lit("asset_id").alias("kind"), F.lit("7").alias("value")).distinct()
    return L.identifier_writes(resolved, known)


@query("""WITH c AS (SELECT doc_id, lang AS block, sha256(text) AS key FROM documents), f AS (SELECT block, key, min(doc_id) AS first FROM c GROUP BY ALL)
    SELECT decision, method, count(*) AS n, count(score) AS scored FROM (SELECT CASE WHEN doc_id = first THEN 'create' ELSE 'merge' END AS decision, CASE WHEN doc_id = first THEN 'no_match' ELSE 'strong_identifier' END AS method, CASE WHEN doc_id <> first THEN 1.0 END AS score FROM c JOIN f USING (block, key) WHERE doc_id % 10 <> 0) GROUP BY ALL""")
def decisions_recorded(spark, d):
    docs = table(spark, d, "documents")
    made = X.resolve(docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").alias("block"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("candidate_id"), F.array(F.sha2("text", 256)).alias("keys")))
    rows = L.decision_rows(made, docs.where("doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("candidate_id")))
    return rows.groupBy("decision", "method").agg(F.count("*").alias("n"), F.count("score").alias("scored"))


@query("""WITH n AS (SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation), s AS (SELECT 's' || s_suppkey AS id, s_name AS name, 'n' || s_nationkey AS nation FROM supplier),
    t AS (SELECT '{"nodes":{"Nation":[' || (SELECT string_agg('{"id":"' || id || '","managed":true,"name":"' || name || '"}', ',' ORDER BY id) FROM n) || '],"Supplier":[' || (SELECT string_agg('{"id":"' || id || '","managed":true,"name":"' || name || '"}', ',' ORDER BY id) FROM s)
        || ']},"relationships":{"LOCATED_IN":[' || (SELECT string_agg('{"properties":{"by":"nation"},"source_id":"' || id || '","target_id":"' || nation || '"}', ',' ORDER BY id, nation) FROM s) || ']}}' AS text)
    SELECT (SELECT count(*) FROM n) + 2 * (SELECT count(*) FROM s) AS n_objects, sha256(text) AS sha256 FROM t""")
def snapshot_model_hash(spark, d):
    own = lambda name, p, key, shown: table(spark, d, name).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.lit(True).alias("managed"), F.col(shown).alias("name"))
    located = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("target_id"), F.create_map(F.lit("by"), F.lit("nation")).alias("properties"))
    return N.snapshot_sha256({"Nation": own("nation", "n", "n_nationkey", "n_name"), "Supplier": own("supplier", "s", "s_suppkey", "s_name")}, {"LOCATED_IN": located}, most=None)


@query("""SELECT o_orderstatus AS part, count(*) AS n, count(*) FILTER (o_orderkey % 100 = 7) AS changed FROM orders WHERE o_orderkey % 50 <> 3 GROUP BY 1""")
def snapshot_generations(spark, d):
    """A generation is written, and then brought to the next, in which some objects changed and some went."""
    path = scratch(spark, "generation")
    orders = table(spark, d, "orders").select(F.col("o_orderstatus").alias("part"), F.col("o_orderkey").cast("string").alias("id"), F.lit("old").alias("body"))
    N.write_generation(orders, path, 64)
    key = F.col("id").cast("long")
    N.write_generation(orders.where(key % 50 != 3).withColumn("body", F.when(key % 100 == 7, "new").otherwise(F.col("body"))), path, 64)
    return N.read_generation(spark, path).groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("body") == "new").alias("changed"))


_NOTES = """notes AS (SELECT doc_id, source || '/' || lang || '/' || (doc_id % 700) || '.md' AS path, lang, source, (doc_id * 7 + 1) % 900 AS other FROM documents),
    suffixes AS (SELECT doc_id, CAST(doc_id % 700 AS VARCHAR) AS suffix, false AS whole FROM notes WHERE path IS NOT NULL UNION ALL SELECT doc_id, lang || '/' || (doc_id % 700), false FROM notes WHERE path IS NOT NULL UNION ALL SELECT doc_id, source || '/' || lang || '/' || (doc_id % 700), true FROM notes WHERE path IS NOT NULL),
    asked AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(other AS VARCHAR) WHEN 1 THEN lang || '/' || other || '.md' WHEN 2 THEN source || '/' || lang || '/' || other ELSE 'https://x.org/' || other END AS target FROM notes),
    hits AS (SELECT a.doc_id, count(*) AS n, count(*) FILTER (whole) AS n_whole, min(s.doc_id) AS any_hit, min(s.doc_id) FILTER (whole) AS exact FROM asked a JOIN suffixes s ON s.suffix = lower(regexp_replace(a.target, '[.]md$', '')) GROUP BY 1),
    linked AS (SELECT a.doc_id, a.target, coalesce(n, 0) AS n, CASE WHEN target IS NULL THEN a.doc_id WHEN n_whole = 1 THEN exact WHEN n = 1 THEN any_hit END AS found FROM asked a LEFT JOIN hits USING (doc_id))"""


def _notes(spark, d):
    docs = table(spark, d, "documents")
    key = lambda x: F.col(x) if isinstance(x, str) else x.cast("string")
    stem, other = F.col("doc_id") % 700, (F.col("doc_id") * 7 + 1) % 900
    join = lambda *parts: F.concat(*[p for part in parts for p in (F.lit("/"), key(part))][1:])
    notes = docs.select(F.col("doc_id").alias("document_id"), F.lit("v").alias("vault_id"), F.concat(join("source", "lang", stem), F.lit(".md")).alias("path"))
    n = F.col("doc_id") % 4
    target = F.when(n == 0, key(other)).when(n == 1, F.concat(join("lang", other), F.lit(".md"))).when(n == 2, join("source", "lang", other)).otherwise(F.concat(F.lit("https://x.org/"), key(other)))
    links = docs.select(F.col("doc_id").alias("link_id"), F.col("doc_id").alias("document_id"), F.lit("wikilink").alias("kind"), target.alias("target"), F.lit(None).cast("string").alias("heading"))
    return notes, links, docs.select(F.col("doc_id").alias("document_id"), F.lit("top").alias("heading"))


@query(f"""WITH {_NOTES} SELECT doc_id AS link_id, CASE WHEN target LIKE 'https:%' THEN 'external' WHEN found IS NOT NULL THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, found AS target_document_id, n AS n_targets FROM linked""")
def links_resolved(spark, d):
    notes, links, sections = _notes(spark, d)
    return Y.resolve_links(links, notes, sections).drop("anchor_found")


@query(f"WITH {_NOTES} SELECT 'LINKS_TO' AS label, count(*) AS n FROM linked WHERE found IS NOT NULL UNION ALL SELECT 'Document', count(*) FROM notes")
def links_in_snapshot(spark, d):
    """The LINKS_TO edges of a snapshot whose links are resolved, which callers ask for; of a label without objects, 0."""
    notes, links, sections = _notes(spark, d)
    edges = Y.links_to(links, Y.resolve_links(links, notes, sections))
    name = lambda c: F.col(c).cast("string")
    nodes, edges = graph.snapshot({"Document": notes.select(name("document_id").alias("id"))}, {"LINKS_TO": edges.select(name("document_id").alias("source_id"), name("target_document_id").alias("target_id"))})
    count = lambda df, label: df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
    return count(nodes, "Document").unionByName(count(edges, "LINKS_TO"))


@query(f"""WITH {KNOWLEDGE}, gone AS (SELECT chunk_id FROM chunks_m WHERE section_id % 25 < 5 OR section_id % 4 = 0), ge AS (SELECT evidence_id FROM evidence_m WHERE chunk_id IN (SELECT chunk_id FROM gone)),
    dead AS (SELECT entity_id FROM mentions_m GROUP BY 1 HAVING bool_and(evidence_id IN (SELECT evidence_id FROM ge)))
    SELECT 'chunks' AS part, count(*) AS n FROM gone UNION ALL SELECT 'evidence', count(*) FROM ge UNION ALL SELECT 'entities', count(*) FROM entities_m SEMI JOIN dead USING (entity_id) UNION ALL SELECT 'aliases', count(*) FROM aliases_m SEMI JOIN dead USING (entity_id)
    UNION ALL SELECT 'mentions', count(*) FROM mentions_m WHERE evidence_id IN (SELECT evidence_id FROM ge) UNION ALL SELECT 'claims', count(*) FROM claims_m WHERE evidence_id IN (SELECT evidence_id FROM ge)
    UNION ALL SELECT 'assertions', count(*) FROM assertions_m WHERE evidence_id IN (SELECT evidence_id FROM ge) OR source_id IN (SELECT entity_id FROM dead) OR target_id IN (SELECT entity_id FROM dead)""")
def cascade_deleted(spark, d):
    """What goes with the chunks of some documents: the last mentions of five entities are among it."""
    k = Knowledge(spark, d)
    tables = {"chunks": k.chunks, "evidence": k.evidence, "entities": k.entities, "mentions": k.mentions.withColumn("mention_id", F.col("evidence_id")), "aliases": k.aliases.withColumn("alias_id", F.concat("entity_id", F.lit(":"), "alias")), "assertions": k.assertions, "claims": k.claims.withColumn("subject_id", F.lit(None).cast("string"))}
    went, _ = Z.cascade(tables, Z.support(k.mentions), k.chunks.where("section_id % 25 < 5 OR section_id % 4 = 0"))
    out = None
    for name, keys in went.items():
        row = keys.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT event_type, true AS close FROM events GROUP BY 1")
def distinct_sketches(spark, d):
    """Sketches by day and type, merged by type, against exact counts."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    found = K.distinct_estimates(K.distinct_sketches(e, ["day", "event_type"], "event_id"), "event_type")
    exact = e.groupBy("event_type").agg(F.count_distinct("event_id").alias("exact"))
    return found.join(exact, "event_type").select("event_type", (F.abs(F.col("n") / F.col("exact") - 1) < 0.1).alias("close"))


@query("SELECT s_nationkey AS nation, min(s_suppkey) AS first FROM supplier WHERE s_nationkey NOT IN (1, 3, 5) GROUP BY 1")
def vaults_registered(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("root_path"), "s_suppkey")
    found = V.register_vaults(s.where("root_path IN ('1', '3', '5')"), s)
    return found.select(F.col("root_path").cast("int").alias("nation"), F.col("s_suppkey").alias("first"))


# --- ontology and identifiers -----------------------------------------------------------------
_SEED = ", ".join([f"('entity-type', NULL, '{c}')" for c in O.ENTITY_TYPES] + [f"('entity-subtype', '{t}', '{c}')" for t, cs in O.ENTITY_SUBTYPES.items() for c in cs] + [f"('predicate', NULL, '{c}')" for c in O.PREDICATES] + ["('property', NULL, 'network_layer')"])


@query(f"SELECT * FROM (VALUES {_SEED}) v(kind, parent, code)")
def ontology_seed(spark, d):
    return O.seed(spark).drop("id")


@query("""SELECT p_partkey, list_sort(list_filter([CASE WHEN p_size % 3 = 0 THEN 'unknown_entity_type' WHEN p_size % 4 = 0 THEN 'unknown_entity_subtype' END, CASE WHEN p_size % 5 = 0 THEN 'unknown_entity_scope' END, CASE WHEN p_size % 7 = 0 THEN 'unknown_assertion_kind' END], lambda x: x IS NOT NULL)) AS errors FROM part""")
def entity_validation(spark, d):
    n = F.col("p_size")
    kind = F.when(n % 3 == 0, "STAR").otherwise("DEVICE_MODEL")
    subtype = F.when(n % 4 == 0, "OLT").when(n % 2 == 0, "ONT")
    return table(spark, d, "part").select("p_partkey", O.validate_entity(kind, subtype, F.when(n % 5 == 0, "x").otherwise("model"), F.when(n % 7 != 0, "explicit")).alias("errors"))


@query("""SELECT p_partkey, list_sort(list_filter([CASE WHEN p_size % 3 = 0 THEN 'unknown_predicate' END, CASE WHEN p_size % 5 = 0 THEN 'unknown_network_layer' END], lambda x: x IS NOT NULL)) AS errors FROM part""")
def relationship_validation(spark, d):
    n = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", O.validate_relationship(F.when(n % 3 == 0, "LIKES").otherwise("USES"), F.lit("inferred"), F.when(n % 5 == 0, "layer_9").when(n % 2 == 0, "layer_2")).alias("errors"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'ip_address:10.0.' || s_nationkey || '.1' WHEN 1 THEN 'mac_address:AA:BB:CC:DD:EE:' || lpad((s_suppkey % 90 + 10)::VARCHAR, 2, '0') WHEN 2 THEN 'email_address:u' || s_suppkey || '@ex.org' WHEN 3 THEN 'fqdn:h' || s_suppkey || '.example.com' ELSE 'serial_number:ONT-' || s_suppkey END AS ids FROM supplier""")
def surface_identifiers(spark, d):
    k = F.col("s_suppkey").cast("string")
    r = F.col("s_suppkey") % 5
    name = F.when(r == 0, F.concat(F.lit(" 10.0."), F.col("s_nationkey").cast("string"), F.lit(".1"))).when(r == 1, F.concat(F.lit("aa-bb-cc-dd-ee-"), (F.col("s_suppkey") % 90 + 10).cast("string")))
    name = name.when(r == 2, F.concat(F.lit("U"), k, F.lit("@EX.org"))).when(r == 3, F.concat(F.lit("H"), k, F.lit(".Example.COM."))).otherwise(F.concat(F.lit("ont-"), k))
    quote = F.concat(F.lit("the device, Serial  number: ONT-"), k, F.lit(" and asset id=OTHER-1"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(F.transform(text.strong_identifiers(name, quote), lambda x: F.concat_ws(":", x["kind"], x["value"])), ",").alias("ids"))
