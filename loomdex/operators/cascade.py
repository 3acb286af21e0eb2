"""What goes with a chunk: deletions followed through evidence, entities and what rests on them.

Only what a deletion reaches is looked at. A row that needs a row of another table goes with it;
an entity goes with its last mention, which its support count tells without reading the
mentions that stay. Each round joins the rows that went in the round before to the tables that
refer to them, so work follows the deletion's size, and the rounds are as many as the references are deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settle

# Each table's own key, and what refers to what (table, column, table referred to).
KEYS = {"chunks": "chunk_id", "evidence": "evidence_id", "candidates": "candidate_id", "entities": "entity_id", "mentions": "mention_id", "aliases": "alias_id", "assertions": "assertion_id", "claims": "claim_id"}
NEEDS = (
    ("evidence", "chunk_id", "chunks"), ("candidates", "evidence_id", "evidence"), ("mentions", "evidence_id", "evidence"), ("mentions", "entity_id", "entities"), ("aliases", "entity_id", "entities"),
    ("assertions", "evidence_id", "evidence"), ("assertions", "source_id", "entities"), ("assertions", "target_id", "entities"), ("claims", "evidence_id", "evidence"), ("claims", "subject_id", "entities"),
)


def support(mentions: DataFrame) -> DataFrame:
    """``entity_id, n``: how many mentions hold each entity up."""
    return mentions.groupBy("entity_id").agg(F.count("*").alias("n"))


def cascade(tables: dict[str, DataFrame], supports: DataFrame, gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Keys of all rows that go with some chunks (chunk_id), by table, and the supports (entity_id, n) that are left.

    ``tables`` are those of KEYS, each with its key; a table may be missing. Null references
    need nothing. Entities without a mention from the start stay.
    """
    went = {"chunks": settle(gone.select("chunk_id").distinct())}
    news = dict(went)
    while news:
        found: dict[str, DataFrame] = {}
        for table, column, parent in NEEDS:
            if parent in news and table in tables:
                lost = news[parent].select(F.col(KEYS[parent]).alias(column))
                hit = tables[table].join(lost, column, "left_semi").select(KEYS[table])
                found[table] = found[table].unionByName(hit) if table in found else hit
        if "mentions" in news and "entities" in tables:
            fewer = tables["mentions"].join(news["mentions"], "mention_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("less"))
            supports = settle(supports.join(fewer, "entity_id", "left").select("entity_id", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")))
            dead = supports.where("n = 0").select("entity_id").join(fewer, "entity_id", "left_semi")
            found["entities"] = found["entities"].unionByName(dead) if "entities" in found else dead
        news = {}
        for table, keys in found.items():
            fresh = keys.distinct()
            fresh = settle(fresh.join(went[table], KEYS[table], "left_anti") if table in went else fresh)
            if not fresh.isEmpty():
                news[table] = fresh
                went[table] = settle(went[table].unionByName(fresh)) if table in went else fresh
    return went, supports.where("n > 0")


def remaining(tables: dict[str, DataFrame], went: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without what went."""
    return {t: df.join(went[t], KEYS[t], "left_anti") if t in went else df for t, df in tables.items()}


def chunks_of(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks (chunk_id) of versions (version_id) that are replaced or removed: where a cascade starts."""
    return chunks.join(versions.select("version_id"), "version_id", "left_semi").select("chunk_id")
