"""Retrieval channels: lexical and vector top-k, entity and claim matches; rank fusion, routing, context."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import casefold
from ..functions.text import TERM, groups_of, terms_of, tokens
from .postings import covers

# Substrings that mark a question about relationships; a query's token pattern.
GRAPH_CUES = ("kapcsol", "kommunik", "használ", "függ", "között", "útvonal", "keresztül", "elér", "tartoz", "connect", "communicat", "depend", "between", "path", "through", "uses")
ROUTE_TOKEN = r"[0-9A-Za-zÁÉÍÓÖŐÚÜŰáéíóöőúüű_.:/-]+"
CHANNELS = ("claim", "entity", "graph", "keyword", "semantic")
RRF_K = 60


def keyword_topk(chunks: DataFrame, query: str, k: int, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """Chunks with any of the query's terms by 0.1 times their occurrences, then by id.

    A query without terms asks for all of its tokens and ranks by minimal covers; see
    ``postings``, which gives the same hits from an index. Top-k is a per-partition heap and
    one merge of k rows from each; text stays out of it.
    """
    groups = groups_of(query)
    if not groups:
        return chunks.select(id_col, F.lit(0.0).alias("score")).limit(0)
    # a term is a token where no token character stands beside it, so no array of tokens is made
    edge = TERM.rstrip("+")
    whole = lambda some: f"(?<!{edge})(?:{'|'.join(map(re.escape, some))})(?!{edge})"
    rows = chunks.select(id_col, casefold(F.col(text_col)).alias("t"))
    if all(len(g) == 1 for g in groups):
        rows = rows.select(id_col, F.regexp_count("t", F.lit(whole([g[0] for g in groups]))).alias("n")).where("n > 0")
        found = rows.select(id_col, (F.col("n") * F.lit(0.1)).alias("score"))
    else:
        holds = [reduce(lambda a, b: a & b, [F.col("t").rlike(whole([w])) for w in g]) for g in groups]
        found = covers(rows.where(reduce(lambda a, b: a | b, holds)).select(id_col, F.posexplode(tokens(F.col("t"))).alias("pos", "term")), groups, id_col)
    return found.orderBy(F.desc("score"), id_col).limit(k)


def bm25_topk(chunks: DataFrame, query: str, k: int, id_col: str = "chunk_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 top-k: an alternative score. One pass for the corpus statistics, one for the scores."""
    words = terms_of(query)
    rows = chunks.select(id_col, tokens(F.col(text_col)).alias("t")).select(id_col, F.size("t").alias("n"), *[F.expr(f"size(filter(t, x -> x = '{w}'))").alias(f"f{i}") for i, w in enumerate(words)])
    stats = rows.agg(F.count("*"), F.avg("n"), *[F.count_if(F.col(f"f{i}") > 0) for i in range(len(words))]).first()
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = math.log(1 + (stats[0] - stats[i + 2] + 0.5) / (stats[i + 2] + 0.5))
        score = score + idf * F.col(f"f{i}") * (k1 + 1) / (F.col(f"f{i}") + k1 * (1 - b + b * F.col("n") / F.lit(stats[1] or 1.0)))
    return rows.select(id_col, score.alias("score")).where("score > 0").orderBy(F.desc("score"), id_col).limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", where: Column | None = None, digits: int = 6) -> DataFrame:
    """Exact cosine top-k of one query, payload filters first; scores are rounded, ties go to the smaller id."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(id_col, F.round(cosine(F.col(vec_col), q), digits).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def hydrate(hits: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Hits with ``stale``: whether what they point to is no longer current."""
    return hits.join(current.select(key).distinct().withColumn("_here", F.lit(True)), key, "left").withColumn("stale", F.col("_here").isNull()).drop("_here")


def ranked(hits: DataFrame, channel: str, order: list[Column], id_col: str) -> DataFrame:
    """(channel, id, rank) of a channel's top-k; a window over those k rows."""
    return hits.select(F.lit(channel).alias("channel"), F.col(id_col).alias("id"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def reciprocal_rank_fusion(ranks: DataFrame, k: int = RRF_K, by: tuple[str, ...] = (), channels: tuple[str, ...] = CHANNELS, keep_ranks: bool = False) -> DataFrame:
    """``id, score`` (and each channel's rank): the sum of 1 / (k + rank) over channels, always added in the order of their
    names, so that the sum doesn't depend on partitions. Of an id's ranks in a channel the best counts."""
    best = [F.min(F.when(F.col("channel") == c, F.col("rank"))).alias(f"{c}_rank") for c in sorted(channels)]
    score = sum((F.coalesce(1.0 / (k + F.col(f"{c}_rank")), F.lit(0.0)) for c in sorted(channels)), F.lit(0.0))
    return ranks.groupBy(*by, "id").agg(*best).select(*by, "id", score.alias("score"), *([f"{c}_rank" for c in sorted(channels)] if keep_ranks else []))


def plan_route(query: Column, strategy: Column) -> Column:
    """(query_type, reason): explicit strategy, relationship cue, short identifier, else hybrid."""
    found = F.regexp_extract_all(query, F.lit(ROUTE_TOKEN), 0)
    special = F.exists(found, lambda t: ((F.upper(t) == t) & (F.lower(t) != t)) | t.rlike("[0-9]") | t.rlike("[_.:/-]"))
    cue = F.lit(False)
    for c in GRAPH_CUES:
        cue = cue | F.contains(casefold(query), F.lit(c))
    kind = F.when(strategy.isin("keyword", "semantic"), strategy).when(cue, "graph").when((F.size(found) > 0) & (F.size(found) <= 4) & special, "entity").otherwise("hybrid")
    reason = F.when(strategy == "keyword", "explicit_keyword_strategy").when(strategy == "semantic", "explicit_semantic_strategy").when(kind == "graph", "relationship_or_path_cue").when(kind == "entity", "short_identifier_or_acronym").otherwise("general_hybrid")
    return F.struct(kind.alias("query_type"), reason.alias("reason"))


def consensus(keyword: DataFrame, semantic: DataFrame, share: float = 0.85) -> DataFrame:
    """Ids in the keyword channel whose semantic score reaches ``share`` of the best one."""
    best = semantic.agg(F.max("score").alias("best"))
    strong = semantic.join(F.broadcast(best), F.col("score") >= share * F.col("best")).select("id")
    return keyword.join(strong, "id", "left_semi").select("id")


def gate_channels(ranks: DataFrame, agreed: DataFrame) -> DataFrame:
    """The ranks of agreed ids; all of them where there are none. ``agreed`` holds at most a channel's top-k."""
    flag = agreed.agg((F.count("*") > 0).alias("any"))
    marked = ranks.join(agreed.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left")
    return marked.join(F.broadcast(flag), F.col("_in").isNotNull() | ~F.col("any")).select(*ranks.columns)


def section_context(seeds: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Evidence chunks within ``window`` ordinals of a seed in its section, seeds left out. Seeds are few."""
    s = seeds.select(F.col("section_id").alias("_s"), F.col("ordinal").alias("_o"))
    near = chunks.join(s, (F.col("section_id") == F.col("_s")) & F.col("ordinal").between(F.col("_o") - window, F.col("_o") + window))
    return near.where("role = 'content_evidence'").select(*chunks.columns).distinct().join(seeds.select("chunk_id"), "chunk_id", "left_anti")


def budget(chunks: DataFrame, order: list[str], most_chars: int, most_rows: int | None = None, by: str = "document_id") -> DataFrame:
    """Rows in order until the first that would exceed the characters; it ends all documents. A cap of
    rows a document comes first. Texts aren't empty, so the characters bound the rows that are summed up."""
    rows = chunks
    if most_rows is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most_rows).drop("_n")
    rows = rows.orderBy(*order).limit(most_chars + 1)
    total = F.sum(F.length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_sum", total).where(F.col("_sum") <= most_chars).drop("_sum")


def is_navigation(path: Column) -> Column:
    """Index documents: a stem of ``index`` or one that ends in ``-index`` or ``_index``."""
    stem = F.regexp_replace(F.lower(F.substring_index(path, "/", -1)), r"[.][^.]*$", "")
    return stem.rlike("(^|[-_])index$")


def claim_overlap(claims: DataFrame, terms: list[str], k: int, id_col: str = "claim_id", text_col: str = "text") -> DataFrame:
    """Claims that contain enough of the terms (one of up to two, else two) by the share contained."""
    low = F.lower(text_col)
    hits = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    least = 1 if len(terms) <= 2 else 2
    return claims.select(id_col, hits.alias("overlap")).where(F.col("overlap") >= least).select(id_col, F.col("overlap").cast("long").alias("overlap"), (F.col("overlap") / F.lit(len(terms))).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def entity_seeds(entities: DataFrame, terms: list[str], k: int, cap: int | None = None) -> DataFrame:
    """Entities (entity_id, name) whose name matches a term; score 1.0 if all of its tokens are terms, else dropped.

    ``cap`` limits the candidates, by name and id, before they are scored; the model's own
    limit is min(1000, 20 k). An underscore in a term matches any character.
    """
    match = F.lit(False)
    for t in terms:
        match = match | F.col("name").ilike(f"%{t}%")
    rows = entities.where(match).orderBy("name", "entity_id").limit(cap or min(1000, max(20 * k, k)))
    return rows.where(F.forall(tokens(F.col("name")), lambda t: t.isin(*terms)) & (F.size(tokens(F.col("name"))) > 0)).select("entity_id", "name", F.lit(1.0).alias("score")).orderBy("name", "entity_id").limit(k)
