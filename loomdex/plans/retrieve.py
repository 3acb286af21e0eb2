"""Hybrid retrieval: two channels, the consensus gate and fusion over ids; text stays out of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search as R
from ..operators.lineage import held


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, vector: list[float], limit: int = 10, per_channel: int = 50, gate: bool = False) -> DataFrame:
    """``rank, id, score, keyword_rank, semantic_rank`` of current chunks (chunk_id, text) for a query.

    ``vectors`` (chunk_id, embedding) may hold stale rows; hits that ``chunks`` doesn't have are
    dropped. With ``gate`` the channels are held to the ids that both agree on, if there are any.
    The corpus is scanned for either channel's top-k, and once for the vectors' chunks; every other
    step runs on these lists of at most ``per_channel`` rows.
    """
    keyword = held(R.keyword_topk(chunks, query, per_channel))
    hits = held(R.vector_topk(vectors, vector, per_channel, "chunk_id"))
    here = held(chunks.select("chunk_id").join(F.broadcast(hits.select("chunk_id")), "chunk_id", "left_semi"))
    semantic = hits.join(here, "chunk_id", "left_semi")
    order = [F.desc("score"), F.col("chunk_id")]
    ranks = R.ranked(keyword, "keyword", order, "chunk_id").unionByName(R.ranked(semantic, "semantic", order, "chunk_id"))
    if gate:
        agreed = R.consensus(keyword.select(F.col("chunk_id").alias("id")), semantic.select(F.col("chunk_id").alias("id"), "score"))
        ranks = R.gate_channels(ranks, agreed)
    fused = R.reciprocal_rank_fusion(ranks, channels=("keyword", "semantic"), keep_ranks=True)
    return fused.select("id", F.round("score", 12).alias("score"), "keyword_rank", "semantic_rank").orderBy(F.desc("score"), "id").limit(limit)


def visible(items: DataFrame, shown: DataFrame, sources: str = "source_ids") -> DataFrame:
    """Items all of whose source chunks are shown: relationships, claims and paths that lost one go."""
    used = items.select("item_id", F.explode(sources).alias("id")).join(shown.select("id"), "id", "left_anti").select("item_id").distinct()
    return items.join(used, "item_id", "left_anti")
