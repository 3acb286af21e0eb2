"""The last steps of retrieval: anchors, document context, graph enrichment, evaluation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import budget, is_navigation
from .spans import within


def single_document(hits: DataFrame, document: str = "document_id") -> DataFrame:
    """The one document of the hits; no row if they lie in several or none. Hits are a ranked top-k."""
    return hits.agg(F.min(document).alias(document), F.count_distinct(document).alias("_n")).where("_n = 1").select(document)


def expand_anchor(ranked: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Structural anchors (not of index documents) in exactly one document bring that document's evidence
    as context; anchors themselves leave the results. Returns (results, context)."""
    anchors = ranked.where((F.col("role") == "structural_anchor") & ~is_navigation(F.col("path")))
    document = single_document(anchors)
    context = chunks.where("role = 'content_evidence'").join(F.broadcast(document), "document_id", "left_semi")
    return ranked.where("role <> 'structural_anchor'"), context


def document_context(seeds: DataFrame, chunks: DataFrame, most_chunks: int = 32, most_chars: int = 30_000) -> DataFrame:
    """Chunks inside the seeds' section spans if the seeds lie in one document, within the budget.

    Spans are (document_id, span_start, span_end).
    """
    s = seeds.join(F.broadcast(single_document(seeds)), "document_id", "left_semi").select("document_id", "span_start", "span_end").distinct()
    held = within(chunks, s, "document_id")
    rows = held.where("role = 'content_evidence'").select(*chunks.columns).distinct()
    return budget(rows, ["document_id", "ordinal", "chunk_id"], most_chars, most_chunks)


def channel_scores(ranks: DataFrame, channels: tuple[str, ...] = ("graph", "claim"), k: int = 60) -> DataFrame:
    """1 / (k + rank) of each id's first position in channels that have no score of their own."""
    return ranks.where(F.col("channel").isin(*channels)).groupBy("channel", "id").agg((1.0 / (k + F.min("rank"))).alias("score"))


def first_sources(hits: DataFrame, by: str, order: str) -> DataFrame:
    """One row a source: its first hit."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("_n = 1").drop("_n")


def limited(rows: DataFrame, most: int) -> DataFrame:
    """One row ``truncated, n``: whether there are more than ``most`` rows, and how many are shown; one more than that is read."""
    return rows.limit(most + 1).agg((F.count("*") > most).alias("truncated"), F.least(F.count("*"), F.lit(most)).alias("n"))


def case_checks(answers: DataFrame) -> DataFrame:
    """Pass rates of a golden corpus's checks over expected_* and got_* columns: an expectation is met when all that
    it names was returned; one that is null or missing asks for nothing.

    Checked are the query's type and reason, sources, entities, predicates, claims by substring, the
    longest path's hops, the first expected source's rank within ``limit``, and that nothing was warned of.
    """
    held = set(answers.columns)
    all_of = lambda name: F.size(F.array_except(f"expected_{name}", f"got_{name}")) == 0
    tests = {
        "query_type": ("expected_type", lambda: F.col("expected_type") == F.col("got_type")),
        "reason": ("expected_reason", lambda: F.col("expected_reason") == F.col("got_reason")),
        "sources": ("expected_sources", lambda: all_of("sources")),
        "entities": ("expected_entities", lambda: all_of("entities")),
        "predicates": ("expected_predicates", lambda: all_of("predicates")),
        "claims": ("expected_claims", lambda: F.expr("forall(expected_claims, e -> exists(got_claims, g -> contains(lower(g), lower(e))))")),
        "hops": ("expected_hops", lambda: F.col("got_hops") >= F.col("expected_hops")),
        "rank": ("limit", lambda: F.exists("expected_sources", lambda e: F.array_contains(F.slice("got_sources", 1, F.col("limit")), e))),
        "no_warnings": ("warnings", lambda: F.size("warnings") == 0),
    }
    checks = {n: F.when(F.col(needs).isNull(), True).otherwise(F.coalesce(test(), F.lit(False))) for n, (needs, test) in tests.items() if needs in held}
    every = F.lit(True)
    for c in checks.values():
        every = every & c
    return answers.agg(*[F.avg(c.cast("int")).alias(n) for n, c in checks.items()], F.avg(every.cast("int")).alias("accepted"))
