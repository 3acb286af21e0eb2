"""Retrieval over five channels: keyword, semantic, entity, graph and claim, with context and closure.

Every step is a DataFrame over the one before. The corpus is read by a few top-k scans and by
joins with their hits; what a step hands on is bounded by the request's limits, holds ids, ranks
and scores but no text, and is kept as a local table, so that no scan is run for each of its readers.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import casefold
from ..functions.text import terms_of
from ..operators import answers as A
from ..operators import graph as G
from ..operators import hydrate as H
from ..operators import search as R
from ..operators.lineage import held
from ..operators.spans import within
from ..operators.writers import audit_row


@dataclass
class Corpus:
    """Current chunks (chunk_id, document_id, section_id, ordinal, char_start, char_end, path, role, text), vectors
    (chunk_id, embedding), active entities, aliases and mentions, all assertions (assertion_id, source_id,
    target_id, predicate), and the hydrated, current assertions and claims. Without vectors the semantic
    channel is down, without assertions the graph. Sections (section_id, span_start, span_end) hold
    their subsections; without them a section is as long as its own chunks. Chunks, and vectors if
    they can, have a vault_id where a request names a vault."""

    chunks: DataFrame
    vectors: DataFrame | None
    entities: DataFrame
    aliases: DataFrame
    mentions: DataFrame
    assertions: DataFrame | None
    current_assertions: DataFrame
    current_claims: DataFrame
    sections: DataFrame | None = None

    def of(self, vault: str | None) -> Corpus:
        """What one vault holds of it."""
        if vault is None:
            return self
        own = lambda df: df.where(F.col("vault_id") == vault) if df is not None and "vault_id" in df.columns else df
        return replace(self, chunks=own(self.chunks), vectors=own(self.vectors), entities=own(self.entities), current_assertions=own(self.current_assertions), current_claims=own(self.current_claims))


@dataclass
class Limits:
    results: int = 10
    candidates: int = 50
    entities: int = 20
    claims: int = 20
    hops: int = 2
    paths: int = G.MOST_PATHS
    context_chunks: int = 32
    context_chars: int = 30_000


@dataclass
class Answer:
    query_type: str
    reason: str
    chunks: list[tuple] = field(default_factory=list)  # id, score, channels
    context: list = field(default_factory=list)
    entities: list = field(default_factory=list)
    relationships: list = field(default_factory=list)
    claims: list = field(default_factory=list)
    paths: list = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    truncated: bool = False

    @property
    def status(self) -> str:
        return "degraded" if self.warnings else "succeeded"


@dataclass
class Found:
    """An answer's parts as DataFrames, each in its order by ``nth``."""

    query_type: str
    reason: str
    chunks: DataFrame  # chunk_id, score, channels
    context: DataFrame  # chunk_id
    entities: DataFrame  # entity_id, name, score, channels, source_chunk_ids
    relationships: DataFrame  # the current assertions' columns
    claims: DataFrame  # the current claims' columns
    paths: DataFrame  # nodes, edges, hops, source_chunk_ids
    warnings: list[str]
    truncated: bool

    def rows(self) -> DataFrame:
        """``part, nth, id``, all as text: the answer as one table."""
        spark = self.chunks.sparkSession
        keys = {"chunk": (self.chunks, F.col("chunk_id")), "context": (self.context, F.col("chunk_id")), "entity": (self.entities, F.col("entity_id")), "relationship": (self.relationships, F.col("assertion_id")), "claim": (self.claims, F.col("claim_id")), "path": (self.paths, F.array_join("edges", "\n"))}
        said = [("warning", n, w) for n, w in enumerate(self.warnings, 1)] + [("type", 1, self.query_type), ("type", 2, self.reason), ("truncated", 1, str(self.truncated).lower())]
        out = spark.createDataFrame(said, "part string, nth long, id string")
        for part, (df, key) in keys.items():
            out = out.unionByName(df.select(F.lit(part).alias("part"), "nth", key.cast("string").alias("id")))
        return out

    def answer(self) -> Answer:
        listed = lambda df: df.orderBy("nth").collect()
        chunks = [(r.chunk_id, r.score, r.channels) for r in listed(self.chunks)]
        return Answer(self.query_type, self.reason, chunks, [r.chunk_id for r in listed(self.context)], listed(self.entities), listed(self.relationships), listed(self.claims), listed(self.paths), self.warnings, self.truncated)


def _nth(df: DataFrame, *order: Column | str, by: str | None = None, name: str = "nth") -> DataFrame:
    """Rows numbered from 1 in an order; they are few."""
    window = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn(name, F.row_number().over(window.orderBy(*order)).cast("long"))


def _first(parts: list[DataFrame]) -> DataFrame:
    """``chunk_id, rank`` of lists (chunk_id, a, b) one after the other: each chunk where it comes first."""
    out = None
    for n, part in enumerate(parts):
        rows = part.select("chunk_id", F.struct(F.lit(n).alias("n"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).alias("at"))
        out = rows if out is None else out.unionByName(rows)
    return _nth(out.groupBy("chunk_id").agg(F.min("at").alias("at")), "at", "chunk_id", name="rank").select("chunk_id", "rank")


def _best(name: str = "score") -> list[Column]:
    return [F.desc(name), F.col("chunk_id").cast("string")]


class _Graph:
    """Entities, paths, relationships and chunks that the entities which a query names lead to."""

    def __init__(self, corpus: Corpus, terms: list[str], seeds: DataFrame, limits: Limits):
        spark = seeds.sparkSession
        self.warnings: list[str] = []
        found = H.entity_seeds(corpus.entities, corpus.aliases, corpus.mentions, corpus.chunks, terms, seeds, limits.entities)
        named = held(_nth(H.graph_seeds(found), F.desc("score"), casefold(F.col("name")), "entity_id"))
        self.named = named.held > 0
        paths = spark.createDataFrame([], "nodes array<string>, edges array<string>, hops long")
        if self.named and corpus.assertions is None:
            self.warnings.append("graph_unavailable")
        elif self.named:
            edges = corpus.assertions.select("source_id", "target_id", F.col("assertion_id").alias("edge_id"), "predicate")
            paths = G.expand(edges, named.select(F.col("entity_id").alias("id")), limits.hops, limits.paths + 1)
        paths = held(_nth(paths, "hops", "nodes", "edges").withColumn("path_id", F.array_join("edges", "\n")))
        self.truncated = paths.held > limits.paths
        paths = held(paths.where(F.col("nth") <= limits.paths)) if self.truncated else paths
        used = paths.select(F.explode("edges").alias("assertion_id")).distinct()
        current = held(corpus.current_assertions.join(F.broadcast(used), "assertion_id", "left_semi").drop("text"))
        kept = held(paths.join(H.enrich_paths(paths.select("path_id", "edges"), current).drop("predicates"), "path_id"))
        if kept.held < paths.held:
            self.warnings.append("stale_graph_filtered")
        self.paths = kept
        steps = kept.select("nth", F.posexplode("edges").alias("b", "assertion_id")).join(current, "assertion_id")
        self.relationships = current.join(steps.select("assertion_id").distinct(), "assertion_id", "left_semi")
        own = named.select(F.col("nth").alias("a"), F.posexplode("source_chunk_ids").alias("b", "chunk_id"))
        self.chunks = held(_first([own, steps.select("chunk_id", F.col("nth").alias("a"), "b")]))
        met = kept.select(F.explode(F.array_distinct("nodes")).alias("entity_id"), "source_chunk_ids").groupBy("entity_id").agg(F.array_distinct(F.flatten(F.collect_list("source_chunk_ids"))).alias("more"))
        names = corpus.entities.select("entity_id", F.col("name").alias("own_name")).join(F.broadcast(met.select("entity_id")), "entity_id", "left_semi")
        both = named.drop("nth").join(met, "entity_id", "full").join(names, "entity_id", "left").where("name IS NOT NULL OR own_name IS NOT NULL")
        sources = lambda c: F.coalesce(c, F.array().cast(named.schema["source_chunk_ids"].dataType))
        all_of = F.array_sort(F.array_distinct(F.concat(sources("source_chunk_ids"), sources("more"))))
        merged = both.select("entity_id", F.coalesce("name", "own_name").alias("name"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("channels", F.array(F.lit("graph"))).alias("channels"), all_of.alias("source_chunk_ids"))
        self.entities = held(_nth(merged, F.desc("score"), casefold(F.col("name")), "entity_id"))
        seen = self.entities.where(F.exists("channels", lambda c: c != "graph")).select(F.col("nth").alias("a"), F.posexplode("source_chunk_ids").alias("b", "chunk_id"))
        self.entity_chunks = held(_first([seen.join(self.chunks.select("chunk_id"), "chunk_id", "left_semi")]))


def find(corpus: Corpus, query: str, vector: list[float] | None, strategy: str = "hybrid", limits: Limits | None = None, vault: str | None = None) -> Found:
    """Answer a query. Ties go to the smaller id as text; a blank query is refused.

    ``keyword`` and ``semantic`` run their own channel only, in its order. Otherwise all five are
    fused; where keyword and strong semantic hits agree, only those count, and graph and claim
    chunks only if the query names an entity outright. Anchors for structure bring their
    document's evidence as context and aren't results. What loses a source is left out.
    """
    if not query.strip():
        raise ValueError("query must not be blank")
    limits, corpus = limits or Limits(), corpus.of(vault)
    spark, chunks = corpus.chunks.sparkSession, corpus.chunks
    asked = spark.range(1).select(R.plan_route(F.lit(query), F.lit(strategy)).alias("p"), H.entity_terms(F.lit(query)).alias("terms")).first()
    alone, most = strategy in ("keyword", "semantic"), max(limits.results, limits.candidates)
    warnings: list[str] = []
    none = chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    keyword = none if strategy == "semantic" else R.keyword_topk(chunks, query, most)
    keyword = held(_nth(keyword, F.desc("score"), "chunk_id", name="rank"))
    semantic = none
    if strategy != "keyword":
        if corpus.vectors is None or vector is None:
            if alone:
                raise ValueError("the semantic channel is down")
            warnings.append("semantic_unavailable")
        else:
            hits = held(R.vector_topk(corpus.vectors, vector, most, "chunk_id"))
            semantic = held(hits.join(chunks.select("chunk_id").join(F.broadcast(hits.select("chunk_id")), "chunk_id", "left_semi"), "chunk_id", "left_semi"))
            if semantic.held < hits.held:
                warnings.append("stale_projection_filtered")
    semantic = held(_nth(semantic, F.desc("score"), "chunk_id", name="rank"))
    listed = lambda name, df: df.select(F.lit(name).alias("channel"), F.col("chunk_id").alias("id"), "rank")
    ranks = listed("keyword", keyword).unionByName(listed("semantic", semantic))
    empty = chunks.select("chunk_id", F.lit(0).cast("long").alias("rank")).limit(0)
    graph, claims, claim_chunks, truncated = None, None, held(empty), []
    if not alone:
        seeds = R.reciprocal_rank_fusion(ranks).select(F.col("id").alias("chunk_id"), "score")
        seeds = held(_nth(seeds, *_best(), name="rank").where(F.col("rank") <= most).select("chunk_id", "rank"))
        graph = _Graph(corpus, list(asked.terms), seeds, limits)
        warnings += graph.warnings
        truncated.append(graph.truncated)
        ranks = ranks.unionByName(listed("graph", graph.chunks)).unionByName(listed("entity", graph.entity_chunks))
        if words := terms_of(query):
            near = held(_first([df.select("chunk_id", F.col("rank").alias("a"), F.lit(0).alias("b")) for df in (seeds, graph.chunks)]))
            rows = held(_nth(H.claim_candidates(corpus.current_claims, words, near, limits.claims + 1), F.desc("score"), "claim_id"))
            truncated.append(rows.held > limits.claims)
            rows = rows.where(F.col("nth") <= limits.claims)
            claims = held(corpus.current_claims.drop("text").join(F.broadcast(rows.select("claim_id", "nth")), "claim_id"))
            claim_chunks = held(_first([claims.select("chunk_id", F.col("nth").alias("a"), F.lit(0).alias("b"))]))
            ranks = ranks.unionByName(listed("claim", claim_chunks))
    strong = semantic.join(keyword.select("chunk_id"), "chunk_id", "left_semi").join(semantic.agg(F.max("score").alias("best")), F.col("score") >= 0.85 * F.col("best")).select("chunk_id")
    strong = held(strong)
    ranks = held(ranks)
    if strong.held:
        allowed = strong
        if graph is not None and graph.named:
            allowed = allowed.unionByName(graph.chunks.select("chunk_id")).unionByName(claim_chunks.select("chunk_id"))
        kept = held(ranks.join(allowed.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi").select(*ranks.columns))
        truncated.append(not alone and kept.held < ranks.held)
        ranks = held(_nth(kept.withColumnRenamed("rank", "_was"), "_was", by="channel", name="rank").drop("_was"))
    if alone:
        score = (keyword if strategy == "keyword" else semantic).withColumnRenamed("rank", "place")
    else:
        score = _nth(R.reciprocal_rank_fusion(ranks).select(F.col("id").alias("chunk_id"), "score"), *_best(), name="place")
    by = ranks.groupBy(F.col("id").alias("chunk_id")).agg(F.array_sort(F.collect_set("channel")).alias("channels"))
    place = chunks.select("chunk_id", "document_id", "section_id", "ordinal", "path", "role").join(F.broadcast(score), "chunk_id")
    ranked = held(place.join(by, "chunk_id").withColumn("stem", R.is_navigation(F.col("path"))))
    results = held(_nth(ranked.where("role = 'content_evidence'"), "place"))
    truncated.append(results.held > limits.results)
    results = held(results.where(F.col("nth") <= limits.results))
    anchors = ranked.where("role = 'structural_anchor' AND NOT stem")
    agreed = results.where("NOT stem").join(strong, "chunk_id", "left_semi")
    context = _context(corpus, results, anchors, agreed, limits, truncated)
    shown = held(results.select("chunk_id").unionByName(context.select("chunk_id")))
    nothing = lambda df: _nth(df.limit(0), F.lit(1))
    if graph is None:
        relationships, claims = nothing(corpus.current_assertions.drop("text")), nothing(corpus.current_claims.drop("text"))
        paths = spark.createDataFrame([], "nodes array<string>, edges array<string>, hops long, nth long")
        entities = spark.createDataFrame([], "entity_id string, nth long")
    else:
        relationships = held(_nth(graph.relationships.join(shown, "chunk_id", "left_semi"), "assertion_id"))
        claims = nothing(corpus.current_claims.drop("text")) if claims is None else claims.join(shown, "chunk_id", "left_semi")
        lost = graph.paths.select("path_id", F.explode("source_chunk_ids").alias("chunk_id")).join(shown, "chunk_id", "left_anti").select("path_id").distinct()
        paths = held(graph.paths.join(lost, "path_id", "left_anti"))
        ends = relationships.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).unionByName(paths.select(F.explode("nodes").alias("entity_id")))
        seen = graph.entities.select("entity_id", F.explode("source_chunk_ids").alias("chunk_id")).join(shown, "chunk_id", "left_semi").select("entity_id")
        entities = graph.entities.join(ends.unionByName(seen).distinct(), "entity_id", "left_semi")
    return Found(asked.p.query_type, asked.p.reason, results.select("nth", "chunk_id", "score", "channels"), context, entities, relationships, claims, paths, warnings, any(truncated))


def retrieve(corpus: Corpus, query: str, vector: list[float] | None, strategy: str = "hybrid", limits: Limits | None = None, vault: str | None = None) -> Answer:
    """``find`` as lists."""
    return find(corpus, query, vector, strategy, limits, vault).answer()


def audit(found: Found, query: str, strategy: str, started: datetime, ended: datetime) -> DataFrame:
    """The run's record, one row: the query by its hash only, status, results and latency; warnings beside it."""
    status = "degraded" if found.warnings else "succeeded"
    row = audit_row(F.lit(query), F.lit(strategy), F.lit(status), F.col("n"), F.lit(started), F.lit(ended))
    one = found.chunks.agg(F.count("*").alias("n"))
    return one.select(row.alias("r"), F.array(*map(F.lit, found.warnings)).cast("array<string>").alias("warnings")).select("r.*", "warnings")


def _budgeted(rows: DataFrame, limits: Limits, truncated: list[bool]) -> DataFrame:
    """A document's evidence (without text) within chunks and characters; notes whether something was left out."""
    kept = held(R.budget(rows, ["ordinal", "chunk_id"], limits.context_chars, limits.context_chunks).drop("text"))
    truncated.append(kept.held < rows.limit(limits.context_chunks + 1).count())
    return kept


def _context(corpus: Corpus, results: DataFrame, anchors: DataFrame, agreed: DataFrame, limits: Limits, truncated: list[bool]) -> DataFrame:
    """``nth, chunk_id`` by path and place: the whole document of anchors in one, the sections (with what is
    below them) of agreed results in one, and neighbours in results' sections. Seeds are left out before anything is counted."""
    evidence = corpus.chunks.where("role = 'content_evidence'")
    own = ["chunk_id", "path", "char_start", "char_end"]
    parts = []
    document = held(A.single_document(anchors))
    if document.held:
        whole = evidence.join(F.broadcast(document), "document_id", "left_semi")
        parts.append(_budgeted(whole, limits, truncated).select(*own))
    document = held(A.single_document(agreed))
    if document.held:
        inside = corpus.chunks.join(F.broadcast(document), "document_id", "left_semi")
        wanted = held(agreed.select("document_id", "section_id").distinct())
        if corpus.sections is not None:
            spans = corpus.sections.join(F.broadcast(wanted), "section_id").select("document_id", "span_start", "span_end")
        else:
            spans = inside.join(F.broadcast(wanted.select("section_id")), "section_id", "left_semi").groupBy("document_id", "section_id").agg(F.min("char_start").alias("span_start"), F.max("char_end").alias("span_end")).drop("section_id")
        near = within(inside.where("role = 'content_evidence'"), held(spans.distinct()), "document_id").select(*corpus.chunks.columns).distinct()
        parts.append(_budgeted(near.join(F.broadcast(agreed.select("chunk_id")), "chunk_id", "left_anti"), limits, truncated).select(*own))
    if results.held:
        near = R.section_context(results, evidence.join(F.broadcast(results.select("section_id").distinct()), "section_id", "left_semi"))
        parts.append(near.orderBy("section_id", "ordinal", "chunk_id").limit(2 * results.held).select(*own))
    if not parts:
        return held(results.select("nth", "chunk_id").limit(0))
    rows = reduce(DataFrame.unionByName, parts).distinct().join(results.select("chunk_id"), "chunk_id", "left_anti")
    return held(_nth(rows, casefold(F.col("path")), "char_start", "char_end", F.col("chunk_id").cast("string")).select("nth", "chunk_id"))
