"""The typed property graph of one vault: nine node sets and thirteen edge sets of what is current and active.

Nodes have an ``id`` and properties; edges ``source_id, target_id, properties`` (a map) and
``_order``, the id of the row that they come from (versions: of their document), which is their place in the canonical form
that ``snapshots.snapshot_sha256`` hashes. Every set is one gated join; none is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Sets = dict[str, DataFrame]


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def vault_graph(vault: str, vaults: DataFrame, documents: DataFrame, versions: DataFrame, sections: DataFrame, chunks: DataFrame, links: DataFrame, entities: DataFrame, mentions: DataFrame, assertions: DataFrame, claims: DataFrame, evidence: DataFrame) -> tuple[Sets, Sets]:
    """Node and edge sets of a vault.

    Documents are active with a ready current version, whose sections, chunks and resolved links
    to other such documents count; entities, mentions, assertions and claims are active, mentions and
    evidence lie in those chunks, assertions join two of those entities; evidence is what an
    assertion or claim rests on. Null properties stay null.
    """
    common = {"gks_managed": F.lit(True), "vault_id": F.lit(vault)}

    def nodes(df: DataFrame, key: str, **shown: Column) -> DataFrame:
        return df.select(_text(key).alias("id"), *[c.alias(n) for n, c in (common | shown).items()])

    def placed(df: DataFrame, order: str, key: str, **shown: Column) -> DataFrame:
        return nodes(df.withColumn("_order", _text(order)), key, _order=F.col("_order"), **shown)

    def edges(df: DataFrame, order: str, source: str, target: str, **properties: Column) -> DataFrame:
        none = F.array().cast("array<struct<key: string, value: string>>")
        held = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")) for n, c in properties.items()]) if properties else none)
        return df.select(_text(order).alias("_order"), _text(source).alias("source_id"), _text(target).alias("target_id"), held.alias("properties"))

    own = documents.where((F.col("vault_id") == vault) & (F.col("lifecycle") == "active")).drop("vault_id")
    ready = versions.where("status = 'ready'").select("version_id", "content_sha256", "parser_version", "chunker_version")
    docs = own.join(ready, own.current_version_id == ready.version_id).drop("current_version_id")
    live = docs.select("version_id", "document_id")
    secs = sections.join(live.select("version_id"), "version_id", "left_semi")
    parts = chunks.join(live.select("version_id"), "version_id", "left_semi")
    to = live.select(F.col("document_id").alias("target_document_id"))
    joined = links.where("resolution = 'resolved'").join(live, "version_id").join(to, "target_document_id", "left_semi")
    people = entities.where((F.col("vault_id") == vault) & (F.col("status") == "active"))
    key = people.select("entity_id")
    seen = mentions.where("status = 'active'").join(key, "entity_id", "left_semi").join(parts.select("chunk_id"), "chunk_id", "left_semi")
    said = assertions.where("status = 'active'").join(key.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi").join(key.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
    told = claims.where((F.col("vault_id") == vault) & (F.col("status") == "active"))
    used = said.select("evidence_id").unionByName(told.select("evidence_id")).distinct()
    proof = evidence.join(used, "evidence_id", "left_semi").join(parts.select("chunk_id"), "chunk_id", "left_semi")
    c = F.col
    node_sets = {
        "Vault": nodes(vaults.where(c("vault_id") == vault), "vault_id", name=c("name")),
        "Document": nodes(docs, "document_id", relative_path=c("path"), title=c("title"), status=c("lifecycle")),
        "DocumentVersion": placed(docs, "document_id", "version_id", document_id=_text("document_id"), content_sha256=c("content_sha256"), parser_version=c("parser_version"), chunker_version=c("chunker_version")),
        "Section": nodes(secs, "section_id", heading=c("heading"), heading_path=c("heading_path"), heading_level=c("heading_level"), ordinal=c("ordinal")),
        "Chunk": nodes(parts, "chunk_id", section_id=_text("section_id"), content_sha256=c("content_sha256"), ordinal=c("ordinal"), char_start=c("char_start"), char_end=c("char_end")),
        "Entity": nodes(people, "entity_id", canonical_name=c("name"), normalized_name=c("normalized_name"), entity_type=c("entity_type"), entity_subtype=c("entity_subtype"), scope=c("scope"), status=c("status")),
        "RelationshipAssertion": nodes(said, "assertion_id", predicate=c("predicate"), assertion_kind=c("assertion_kind"), review_status=c("review_status"), network_layer=c("network_layer"), status=c("status")),
        "Claim": nodes(told, "claim_id", text=c("text"), assertion_kind=c("assertion_kind"), review_status=c("review_status"), status=c("status")),
        "Evidence": nodes(proof, "evidence_id", chunk_id=_text("chunk_id"), quote=c("quote"), quote_sha256=c("quote_sha256"), char_start=c("char_start"), char_end=c("char_end")),
    }
    edge_sets = {
        "CONTAINS": edges(docs.withColumn("_vault", F.lit(vault)), "document_id", "_vault", "document_id"),
        "HAS_VERSION": edges(docs, "document_id", "document_id", "version_id"),
        "HAS_SECTION": edges(secs, "section_id", "version_id", "section_id"),
        "HAS_CHILD": edges(secs.where("parent_id IS NOT NULL"), "section_id", "parent_id", "section_id"),
        "HAS_CHUNK": edges(parts, "chunk_id", "section_id", "chunk_id"),
        "LINKS_TO": edges(joined, "link_id", "document_id", "target_document_id", link_id=c("link_id"), link_kind=c("link_kind")),
        "MENTIONS": edges(seen, "mention_id", "chunk_id", "entity_id", mention_id=c("mention_id"), surface_form=c("surface_form")),
        "SUBJECT": edges(said, "assertion_id", "assertion_id", "source_id"),
        "OBJECT": edges(said, "assertion_id", "assertion_id", "target_id"),
        "ENTITY_LINK": edges(said, "assertion_id", "source_id", "target_id", assertion_id=c("assertion_id"), predicate=c("predicate"), review_status=c("review_status"), assertion_kind=c("assertion_kind")),
        "ASSERTION_SUPPORTED_BY": edges(said, "assertion_id", "assertion_id", "evidence_id"),
        "CLAIM_SUPPORTED_BY": edges(told, "claim_id", "claim_id", "evidence_id"),
        "LOCATED_IN": edges(proof, "evidence_id", "evidence_id", "chunk_id"),
    }
    return node_sets, edge_sets
