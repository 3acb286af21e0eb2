"""Lookups, operator views and the projections' bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gates import current_versions


def active_vaults(vaults: DataFrame) -> DataFrame:
    return vaults.where("status = 'active'").orderBy("name")


def register_vaults(vaults: DataFrame, new: DataFrame) -> DataFrame:
    """What would be registered: new vaults (name, root_path, ...) whose name and root no other has; of several alike the first by name."""
    once = new.groupBy("root_path").agg(F.min_by(F.struct(*new.columns), "name").alias("r")).select("r.*").dropDuplicates(["name"])
    return once.join(vaults.select("name"), "name", "left_anti").join(vaults.select("root_path"), "root_path", "left_anti").select(*new.columns)


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The one row of a key; a literal, so that the filter reaches the scan."""
    return rows.where(F.col(key) == F.lit(value)).limit(1)


def measure(changes: DataFrame) -> DataFrame:
    """A scan that only counts: changes by kind, and nothing is applied."""
    return changes.groupBy("kind").agg(F.count("*").alias("n"))


def payload(chunks: DataFrame, *columns: str) -> DataFrame:
    """``chunk_id, payload``: the JSON that goes with a chunk's vector."""
    return chunks.select("chunk_id", F.to_json(F.struct(*columns)).alias("payload"))


def update_from(rows: DataFrame, other: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows with columns taken from the row of ``other`` with their key, where there is one; keys of ``other`` are unique."""
    new = other.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_found"))
    joined = rows.join(new, key, "left")
    return joined.select(*[F.when(F.col("_found"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def merge(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Insert or update by key: a new row's values that aren't null take the place of the old ones."""
    rest = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in rest])
    return old.join(new, list(keys), "full").select(*keys, *[F.coalesce(c, f"_old_{c}").alias(c) for c in rest])


def outbox_split(items: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claimed items as upserts (their chunk is current) and deletes (all else)."""
    keep = current.select("chunk_id").distinct()
    live = items.where("op = 'upsert'").join(keep, "chunk_id", "left_semi")
    return live, items.join(live.select("idempotency_key"), "idempotency_key", "left_anti")


def outstanding(outbox: DataFrame) -> DataFrame:
    """``profile, pending, failed, may_switch``: a collection's alias moves only when nothing is outstanding."""
    rows = outbox.groupBy("profile").agg(F.count_if(F.col("status").isin("pending", "processing")).alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"))
    return rows.withColumn("may_switch", (F.col("pending") == 0) & (F.col("failed") == 0))


def outbox_by_status(outbox: DataFrame, chunks: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Items by vault and status, of chunks whose version is known."""
    owner = versions.join(documents.select("document_id", "vault_id"), "document_id").select("version_id", "vault_id")
    return outbox.join(chunks.select("chunk_id", "version_id"), "chunk_id").join(owner, "version_id").groupBy("vault_id", "status").agg(F.count("*").alias("n"))


def vault_overview(documents: DataFrame, versions: DataFrame, chunks: DataFrame, scans: DataFrame) -> DataFrame:
    """A row a vault: documents by state, current chunks, and the last scan's time and status."""
    state = documents.groupBy("vault_id").agg(F.count("*").alias("documents"), F.count_if(F.col("lifecycle") == "active").alias("active"), F.count_if(F.col("lifecycle") == "deleted").alias("deleted"))
    live = current_versions(documents, versions).join(chunks.select("version_id"), "version_id").groupBy("vault_id").agg(F.count("*").alias("current_chunks"))
    last = scans.groupBy("vault_id").agg(F.max("finished_at").alias("last_scan"), F.max_by("status", "finished_at").alias("scan_status"))
    return state.join(live, "vault_id", "left").join(last, "vault_id", "left").withColumn("current_chunks", F.coalesce("current_chunks", F.lit(0)))


def pending_refresh(scans: DataFrame, changes: DataFrame, graphs: DataFrame, extractions: DataFrame) -> DataFrame:
    """``vault_id, document_id, path, extraction_run``: documents that a vault's graph doesn't show yet.

    The latest succeeded scan that changed something counts (not one that only measures), unless
    a graph was finished at that time or later. ``extractions`` (document_id, run_id, created_at,
    status) name for each document the latest usable run since that scan began, if there is one.
    """
    last = scans.where("status = 'succeeded' AND scan_type <> 'measure' AND changed > 0").groupBy("vault_id").agg(F.max_by(F.struct("scan_id", "started_at", "finished_at"), "finished_at").alias("s")).select("vault_id", "s.*")
    shown = graphs.where("status = 'succeeded'").groupBy("vault_id").agg(F.max("finished_at").alias("shown_at"))
    due = last.join(shown, "vault_id", "left").where("shown_at IS NULL OR shown_at < finished_at")
    rows = changes.where("kind IN ('created', 'modified') AND document_id IS NOT NULL AND path IS NOT NULL").join(due.select("vault_id", "scan_id", "started_at"), "scan_id")
    runs = extractions.where("status IN ('succeeded', 'partial')").select("document_id", "run_id", "created_at")
    usable = rows.select("scan_id", "document_id", "started_at").join(runs, "document_id").where("created_at >= started_at").groupBy("scan_id", "document_id").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("extraction_run"))
    return rows.join(usable, ["scan_id", "document_id"], "left").select("vault_id", "document_id", "path", "extraction_run")


def prepare_projection(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """``vault_id, snapshot, generation, should_project`` of asked snapshots (vault_id, snapshot).

    A snapshot that a vault's run has already keeps its generation, and isn't projected again
    once it succeeded; a new one is the vault's next.
    """
    known = runs.groupBy("vault_id", "snapshot").agg(F.max("generation").alias("known"), F.bool_or(F.col("status") == "succeeded").alias("done"))
    last = runs.groupBy("vault_id").agg(F.max("generation").alias("last"))
    rows = asked.distinct().join(known, ["vault_id", "snapshot"], "left").join(last, "vault_id", "left")
    nth = F.sum(F.col("known").isNull().cast("long")).over(Window.partitionBy("vault_id").orderBy("snapshot"))  # asked snapshots of one vault are few
    return rows.select("vault_id", "snapshot", F.coalesce("known", F.coalesce("last", F.lit(0)) + nth).cast("long").alias("generation"), (~F.coalesce("done", F.lit(False))).alias("should_project"))


def documents_view(documents: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each document with its current version's status and numbers of sections and chunks."""
    held = chunks.groupBy("version_id").agg(F.count("*").alias("n_chunks"), F.count_distinct("section_id").alias("n_sections"))
    rows = documents.join(versions.select(F.col("version_id").alias("current_version_id"), F.col("status").alias("version_status")), "current_version_id", "left").join(held, F.col("current_version_id") == F.col("version_id"), "left")
    return rows.select("document_id", "vault_id", "path", "lifecycle", "version_status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sections", "n_chunks")])


def sections_view(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """The sections (version_id, section_id, ordinal, ...) of active documents' current versions, each with its document."""
    live = documents.where("lifecycle = 'active'").select("document_id", F.col("current_version_id").alias("version_id"))
    return sections.join(live, "version_id").orderBy("document_id", "ordinal")


def source_view(chunks: DataFrame, documents: DataFrame, vaults: DataFrame) -> DataFrame:
    """Chunks of active documents' current versions, whatever its state, with their document and addresses.

    ``source_uri`` is the vault's prefix and the path as they are: neither quoted nor with a
    span, and a slash at the prefix's end stays. ``note_uri`` fills the vault's template
    (vault_id, prefix, uri_template), in which {relative_path} stands for the path; null without one.
    """
    live = documents.where("lifecycle = 'active'").select("document_id", "vault_id", "path", F.col("current_version_id").alias("version_id"))
    rows = chunks.join(live, "version_id").join(vaults.select("vault_id", "prefix", "uri_template"), "vault_id")
    note = F.replace("uri_template", F.lit("{relative_path}"), F.col("path"))
    return rows.select(F.col("chunk_id").alias("source_id"), "vault_id", "document_id", "version_id", "section_id", F.col("path").alias("relative_path"), F.col("text").alias("quote"), "char_start", "char_end", F.sha2("text", 256).alias("content_hash"), F.concat("prefix", "path").alias("source_uri"), note.alias("note_uri"))


def snapshot_sets(vaults: DataFrame, documents: DataFrame, versions: DataFrame, sections: DataFrame, chunks: DataFrame, links: DataFrame, entities: DataFrame, mentions: DataFrame, assertions: DataFrame, claims: DataFrame, evidence: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The nine node sets (id) and thirteen edge sets (source_id, target_id) of a vault's graph, for ``graph.snapshot``.

    Ids are prefixed by their kind, so that they are apart in one node table.
    """
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    node = lambda df, kind, c: df.select(name(kind, c).alias("id")).distinct()
    edge = lambda df, a, ca, b, cb: df.where(F.col(ca).isNotNull() & F.col(cb).isNotNull()).select(name(a, ca).alias("source_id"), name(b, cb).alias("target_id"))
    nodes = {
        "Vault": node(vaults, "vault", "vault_id"), "Document": node(documents, "document", "document_id"), "DocumentVersion": node(versions, "version", "version_id"),
        "Section": node(sections, "section", "section_id"), "Chunk": node(chunks, "chunk", "chunk_id"), "Entity": node(entities, "entity", "entity_id"),
        "RelationshipAssertion": node(assertions, "assertion", "assertion_id"), "Claim": node(claims, "claim", "claim_id"), "Evidence": node(evidence, "evidence", "evidence_id"),
    }
    edges = {
        "CONTAINS": edge(documents, "vault", "vault_id", "document", "document_id"), "HAS_VERSION": edge(versions, "document", "document_id", "version", "version_id"),
        "HAS_SECTION": edge(sections, "version", "version_id", "section", "section_id"), "HAS_CHILD": edge(sections, "section", "parent_id", "section", "section_id"),
        "HAS_CHUNK": edge(chunks, "section", "section_id", "chunk", "chunk_id"), "LINKS_TO": edge(links, "document", "document_id", "document", "target_document_id"),
        "MENTIONS": edge(mentions, "chunk", "chunk_id", "entity", "entity_id"), "SUBJECT": edge(assertions, "assertion", "assertion_id", "entity", "source_id"),
        "OBJECT": edge(assertions, "assertion", "assertion_id", "entity", "target_id"), "ENTITY_LINK": edge(assertions, "entity", "source_id", "entity", "target_id"),
        "ASSERTION_SUPPORTED_BY": edge(assertions, "assertion", "assertion_id", "evidence", "evidence_id"), "CLAIM_SUPPORTED_BY": edge(claims, "claim", "claim_id", "evidence", "evidence_id"),
        "LOCATED_IN": edge(evidence, "evidence", "evidence_id", "chunk", "chunk_id"),
    }
    return nodes, edges


def too_large(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """One row: the number of objects, and whether they exceed what a projection takes."""
    count = nodes.agg(F.count("*").alias("n")).unionByName(edges.agg(F.count("*").alias("n")))
    return count.agg(F.sum("n").alias("n_objects"), (F.sum("n") > most).alias("too_large"))
