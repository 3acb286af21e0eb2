"""Property-graph operators over (source_id, target_id, edge_id, predicate) assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import casefold
from .lineage import settle
from .ontology import check_codes

MOST_HOPS, MOST_PATHS, MOST_OBJECTS = 4, 50, 20_000


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected steps (a, b, edge_id, predicate); a self-loop is one step."""
    out = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "edge_id", "predicate")
    back = edges.where("source_id <> target_id").select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), "edge_id", "predicate")
    return out.unionByName(back)


def neighbors(edges: DataFrame, node: str, direction: str = "both", predicates: list[str] | None = None) -> DataFrame:
    """``neighbor_id, edge_id, predicate, direction`` of a node; a self-loop counts as outgoing."""
    rows = edges if predicates is None else edges.where(F.col("predicate").isin(*predicates))
    out = rows.where(F.col("source_id") == node).select(F.col("target_id").alias("neighbor_id"), "edge_id", "predicate", F.lit("out").alias("direction"))
    back = rows.where((F.col("target_id") == node) & (F.col("source_id") != node)).select(F.col("source_id").alias("neighbor_id"), "edge_id", "predicate", F.lit("in").alias("direction"))
    return {"out": out, "in": back}.get(direction, out.unionByName(back))


def neighbor_page(edges: DataFrame, entities: DataFrame, node: str, direction: str = "both", predicates: list[str] | None = None, types: list[str] | None = None, reviewed: bool = True, most: int = MOST_PATHS) -> DataFrame:
    """Neighbours with their names, ordered by folded name, id and edge, one more than ``most`` so that a caller sees that there are more.

    Edges may have a ``review_status``; unless ``reviewed`` is false only accepted ones count.
    Predicates and entity types that the ontology doesn't have are refused.
    """
    check_codes(predicates, types)
    if not 1 <= most <= MOST_PATHS:
        raise ValueError(f"most must be 1 to {MOST_PATHS}")
    rows = edges.where("review_status = 'accepted'") if reviewed and "review_status" in edges.columns else edges
    named = entities.select(F.col("entity_id").alias("neighbor_id"), "name", "entity_type")
    named = named if types is None else named.where(F.col("entity_type").isin(*types))
    return neighbors(rows, node, direction, predicates).join(named, "neighbor_id").orderBy(casefold(F.col("name")), "neighbor_id", "edge_id").limit(most + 1)


def canonical_hash(nodes: DataFrame, edges: DataFrame, most: int = MOST_OBJECTS) -> DataFrame:
    """``n_objects, sha256`` of a whole snapshot: SHA-256 over its rows' compact JSON, keys and rows in order.

    The order needs all rows in one place, so a snapshot of more than ``most`` objects is
    refused, as a projection refuses it; ``fingerprint`` takes any size.
    """
    line = lambda df, kind: df.select(F.concat(F.lit(f"{kind}:"), F.to_json(F.struct(*sorted(df.columns)))).alias("row"))
    rows = line(nodes, "node").unionByName(line(edges, "edge"))
    found = rows.limit(most + 1).count()
    if found > most:
        raise ValueError(f"more than {most} objects")
    return rows.agg(F.count("*").alias("n_objects"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("row"))), 256).alias("sha256"))


def trails(edges: DataFrame, seeds: DataFrame, hops: int, predicates: list[str] | None = None) -> DataFrame:
    """All trails of 1 to ``hops`` steps from the seeds (id): ``nodes, edges, hops``.

    A trail never uses an edge twice; nodes may come again, parallel edges are different
    trails. One join a hop, on the trail's end, each of which can be split where skewed.
    """
    if not 1 <= hops <= MOST_HOPS:
        raise ValueError(f"hops must be 1 to {MOST_HOPS}")
    steps = both_ways(edges if predicates is None else edges.where(F.col("predicate").isin(*predicates)))
    at = seeds.select(F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    found = None
    for n in range(1, hops + 1):
        at = at.join(steps, F.element_at("nodes", -1) == F.col("a")).where(~F.array_contains("edges", F.col("edge_id")))
        at = at.select(F.concat("nodes", F.array("b")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges"))
        level = at.withColumn("hops", F.lit(n).cast("long"))
        found = level if found is None else found.unionByName(level)
    return found


def _longer(at: DataFrame, steps: DataFrame) -> DataFrame:
    """Trails of one step more, over edges that they don't have yet."""
    at = at.join(steps, F.element_at("nodes", -1) == F.col("a")).where(~F.array_contains("edges", F.col("edge_id")))
    return at.select(F.concat("nodes", F.array("b")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges"))


def bounded_paths(edges: DataFrame, source: str, target: str, hops: int = MOST_HOPS, most: int = MOST_PATHS, predicates: list[str] | None = None) -> DataFrame:
    """Shortest first, then by edges; one more than ``most`` shows that there are more.

    Trails meet in the middle: those of half the length from either end are joined on the node
    where they end, if they have no edge in common, so each path is made once and no trail
    is followed beyond half its length. Lengths are tried in order; longer ones that the
    limit doesn't need aren't looked at.
    """
    if not 1 <= hops <= MOST_HOPS:
        raise ValueError(f"hops must be 1 to {MOST_HOPS}")
    spark = edges.sparkSession
    steps = both_ways(edges if predicates is None else edges.where(F.col("predicate").isin(*predicates)))
    ends = [[spark.createDataFrame([([x], [])], "nodes array<string>, edges array<string>")] for x in (source, target)]
    found = spark.createDataFrame([], "nodes array<string>, edges array<string>, hops long")
    for n in range(1, hops + 1):
        for side, half in zip(ends, ((n + 1) // 2, n // 2)):
            while len(side) <= half:
                side.append(settle(_longer(side[-1], steps)))
        there, back = ends[0][(n + 1) // 2], ends[1][n // 2]
        meet = back.select(F.element_at("nodes", -1).alias("_middle"), F.col("nodes").alias("_nodes"), F.col("edges").alias("_edges"))
        level = there.join(meet, F.element_at("nodes", -1) == F.col("_middle")).where(~F.arrays_overlap("edges", "_edges"))
        rest = F.slice(F.reverse("_nodes"), 2, MOST_HOPS)
        level = level.select(F.concat("nodes", rest).alias("nodes"), F.concat("edges", F.reverse("_edges")).alias("edges"), F.lit(n).cast("long").alias("hops"))
        found = settle(found.unionByName(level.orderBy("edges").limit(most + 1)))
        if found.count() > most:
            break
    return found.orderBy("hops", "edges").limit(most + 1)


def expand(edges: DataFrame, seeds: DataFrame, hops: int, most: int = MOST_PATHS, predicates: list[str] | None = None) -> DataFrame:
    """The first ``most`` trails from seeds (id) to other nodes, by hops, nodes and edges.

    Hops come first in that order, so levels beyond the one that fills the limit aren't
    made. In a level every trail that can go on to another node gives a result at least, so
    if ``most`` of them or more come first by nodes, those behind can't contribute.
    """
    if not 1 <= hops <= MOST_HOPS:
        raise ValueError(f"hops must be 1 to {MOST_HOPS}")
    steps = both_ways(edges if predicates is None else edges.where(F.col("predicate").isin(*predicates)))
    other = F.element_at("nodes", -1) != F.element_at("nodes", 1)
    at = settle(seeds.select(F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edges")).distinct())
    found = edges.sparkSession.createDataFrame([], "nodes array<string>, edges array<string>, hops long")
    for n in range(1, hops + 1):
        left = most - found.count()
        if left <= 0:
            break
        goes_on = (F.element_at("nodes", -1) == F.col("a")) & ~F.array_contains("edges", F.col("edge_id")) & (F.col("b") != F.element_at("nodes", 1))
        first = at.join(steps, goes_on, "left_semi").select("nodes").orderBy("nodes").limit(left).collect()
        level = _longer(at.where(F.col("nodes") <= F.lit(first[-1].nodes)) if len(first) == left else at, steps)
        best = level.where(other).orderBy("nodes", "edges").limit(left).withColumn("hops", F.lit(n).cast("long"))
        found = settle(found.unionByName(best))
        if n < hops and len(first) < left and found.count() < most:
            at = settle(level)
        elif n < hops and found.count() < most:
            at = settle(_longer(at, steps))
    return found.orderBy("hops", "nodes", "edges").limit(most)


def drop_stale(paths: DataFrame, current: DataFrame) -> DataFrame:
    """Paths all of whose edges are current assertions (edge_id)."""
    used = paths.select("nodes", "edges", F.explode("edges").alias("edge_id"))
    stale = used.join(current.select("edge_id"), "edge_id", "left_anti").select("edges").distinct()
    return paths.join(stale, "edges", "left_anti")


def snapshot(node_sets: dict[str, DataFrame], edge_sets: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, id) and edges (type, source_id, target_id) of a graph; dangling edges go."""
    nodes = edges = None
    for label, df in sorted(node_sets.items()):
        part = df.select(F.lit(label).alias("label"), "id")
        nodes = part if nodes is None else nodes.unionByName(part)
    for kind, df in sorted(edge_sets.items()):
        part = df.select(F.lit(kind).alias("type"), "source_id", "target_id")
        edges = part if edges is None else edges.unionByName(part)
    ids = nodes.select("id").distinct()
    edges = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return nodes, edges


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free digest of a table: idempotent projections compare it first."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_objects"), F.sum(row).cast("string").alias("digest"))
