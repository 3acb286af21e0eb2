"""Evidence, ontology and entity resolution."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle


def occurrences(text: Column, quote: Column) -> Column:
    """1-based code-point positions of all occurrences, overlapping ones too.

    The text is split in front of every occurrence, so the pieces' running lengths are the
    positions; one pass, where trying each position would be quadratic.
    """
    ahead = F.concat(F.lit(r"(?=\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    zero = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))
    starts = F.aggregate(F.split(text, ahead), zero, lambda s, x: F.struct((s["next"] + F.length(x)).alias("next"), F.concat(s["at"], F.array(s["next"])).alias("at")), lambda s: s["at"])
    found = F.when(F.startswith(text, quote), starts).otherwise(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))))
    return F.when((F.length(quote) > 0) & F.contains(text, quote), found).otherwise(F.array().cast("array<int>"))


def locate(text: Column, start: Column, quote: Column, nth: Column) -> Column:
    """(char_start, char_end, error) of a quote: a unique one whatever its number, else the nth."""
    at = occurrences(text, quote)
    pick = F.when(F.size(at) == 1, F.element_at(at, 1)).when((F.size(at) > 1) & (nth >= 1) & (nth <= F.size(at)), F.get(at, nth.cast("int") - 1))
    begin = (start + pick - 1).cast("long")
    error = F.when(F.size(at) == 0, "missing_quote").when(pick.isNull(), "occurrence_out_of_range")
    return F.struct(begin.alias("char_start"), (begin + F.length(quote)).cast("long").alias("char_end"), error.alias("error"))


#: Characters of a quote that it is looked up by.
PROBE = 16


def find_quotes(docs: DataFrame, quotes: DataFrame, doc_id: str, doc_text: str, quote_id: str, quote_text: str) -> DataFrame:
    """``doc_id, quote_id`` of every document that holds a quote to the letter, a row for each pair; null ids have none.

    A quote's first word that starts inside it, and what follows up to PROBE characters, is
    hash-joined with the same stretches of the documents; only candidates are compared with the
    quote. Quotes too short for that are compared with every document, in the order of joins
    that Spark picks. Words start behind white space. A document's stretches are distinct and
    narrow; its text joins the candidates by id.
    """
    q = quotes.select(F.col(quote_id).alias("_q"), F.col(quote_text).alias("_t")).where("length(_t) > 0").distinct()
    inner = F.regexp_extract("_t", rf"(?s)\s(\S.{{{PROBE - 1}}})", 1)  # a word start of the quote is one of the document's
    q = q.withColumn("_p", inner)
    texts = docs.select(F.col(doc_id).alias("_d"), F.col(doc_text).alias("_x")).where("_d IS NOT NULL AND _x IS NOT NULL")
    wanted = q.where("_p <> ''").select("_q", "_t", F.xxhash64("_p").alias("_h"))
    stretches = F.regexp_extract_all("_x", F.lit(rf"(?s)\s(?=(\S.{{{PROBE - 1}}}))"), 1)
    probes = texts.select("_d", F.explode(F.array_distinct(F.transform(stretches, lambda p: F.xxhash64(p)))).alias("_h"))
    near = probes.join(wanted, "_h").select("_d", "_q", "_t").distinct()
    found = near.join(texts, "_d").where(F.contains("_x", F.col("_t"))).select("_d", "_q").distinct()
    short = q.where("_p = ''").select("_q", "_t")
    rest = texts.join(short, F.contains("_x", F.col("_t"))).select("_d", "_q").distinct()
    return found.unionByName(rest).select(F.col("_d").alias(doc_id), F.col("_q").alias(quote_id))


def ontology_errors(kind: Column, allowed: list[str], code: str) -> Column:
    """The code where a value isn't in the ontology's list; null, which ``error_list`` drops, else."""
    return F.when(kind.isNull() | ~kind.isin(*allowed), code)


def error_list(*errors: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*errors))))


def resolve_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (chunk_id, source_local, target_local) with both entities, found by (chunk_id, local_id)."""
    s = entities.select("chunk_id", F.col("local_id").alias("source_local"), F.col("entity_id").alias("source_id"))
    t = entities.select("chunk_id", F.col("local_id").alias("target_local"), F.col("entity_id").alias("target_id"))
    return relations.join(s, ["chunk_id", "source_local"]).join(t, ["chunk_id", "target_local"])


def review_pairs(entities: DataFrame, most: int = 20) -> DataFrame:
    """Pairs of entities of one block and normal name, never merged: each later one with up to
    ``most`` earlier ones. Numbered by a window a name, joined by number range, so a name that many
    entities share gives ``most`` rows each and not all pairs."""
    w = Window.partitionBy("block", "name").orderBy("entity_id")
    rows = entities.withColumn("n", F.row_number().over(w))
    offers = rows.select("block", "name", F.col("entity_id").alias("right_id"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("n"), F.col("n").alias("m")).where("n < m")
    return rows.join(offers, ["block", "name", "n"]).select(F.col("entity_id").alias("left_id"), "right_id")


#: Rounds in which candidates are decided by key before what is left is folded cluster by cluster, and candidates of a cluster so folded at the most.
ROUNDS, FOLDED = 6, 200_000


def resolve(candidates: DataFrame) -> DataFrame:
    """Decisions (candidate_id, decision, entity_id) of candidates (block, seq, candidate_id, keys).

    In the order of ``seq``: no known key creates an entity, keys of one entity merge into it,
    keys of several defer. A candidate that bridges entities isn't merged, so this isn't a
    connected-components problem. A key belongs to the entity of its first candidate that isn't
    deferred; a candidate can be decided once each of its keys has an owner, or all of the
    key's earlier candidates are decided. All such candidates are decided together in a
    round, so a key that a third of all candidates share takes two. Chains would take many:
    after ROUNDS, clusters of up to FOLDED undecided candidates that share keys without an owner are folded each
    in a task, and larger ones go on in rounds.
    """
    rows = settle(candidates.select("block", F.struct("seq", "candidate_id").alias("at"), F.array_distinct(F.array_compact(F.coalesce("keys", F.array().cast("array<string>")))).alias("keys")))
    new = F.col("at.candidate_id")
    done = [rows.where("size(keys) = 0").select(new.alias("candidate_id"), F.lit("create").alias("decision"), new.alias("entity_id"))]
    left = settle(rows.select("block", "at", F.explode("keys").alias("key"), F.lit(None).cast("string").alias("owner")))
    turn = 0
    while not left.isEmpty():
        turn += 1
        first = left.where("owner IS NULL").groupBy("block", "key").agg(F.min("at").alias("first"))
        ready = F.bool_and(F.col("owner").isNotNull() | (F.col("first") == F.col("at")))
        each = left.join(first, ["block", "key"], "left").groupBy("block", "at").agg(ready.alias("ready"), F.collect_set("owner").alias("met"))
        decided = each.where("ready").select("block", "at", F.when(F.size("met") == 0, "create").when(F.size("met") == 1, "merge").otherwise("defer").alias("decision"), F.when(F.size("met") == 0, new).when(F.size("met") == 1, F.col("met")[0]).alias("entity_id"))
        decided = settle(decided)
        done.append(decided.select(new.alias("candidate_id"), "decision", "entity_id"))
        owned = left.where("owner IS NULL").join(decided.where("entity_id IS NOT NULL"), ["block", "at"]).select("block", "key", F.col("entity_id").alias("_owner"))
        left = left.join(decided.select("block", "at"), ["block", "at"], "left_anti").join(owned, ["block", "key"], "left")
        left = settle(left.select("block", "at", "key", F.coalesce("owner", "_owner").alias("owner")))
        if turn % ROUNDS == 0 and not left.isEmpty():
            links = left.select("block", F.to_json("at").alias("candidate_id"), F.when(F.col("owner").isNull(), F.col("key")).alias("key"))
            cluster = _clusters(links).select("block", F.col("candidate_id").alias("_id"), "cluster")
            named = left.withColumn("_id", F.to_json("at")).join(cluster, ["block", "_id"]).drop("_id")
            small = settle(named.groupBy("block", "cluster").agg(F.count_distinct("at").alias("n")).where(F.col("n") <= FOLDED).select("block", "cluster"))
            done.append(settle(named.join(small, ["block", "cluster"], "left_semi").groupBy("block", "cluster").applyInArrow(_fold, "candidate_id string, decision string, entity_id string")))
            left = settle(named.join(small, ["block", "cluster"], "left_anti").drop("cluster"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _fold(group: pa.Table) -> pa.Table:
    """One cluster's candidates (at, key, owner) decided one after the other."""
    held: dict[tuple, list] = {}
    for r in group.select(["at", "key", "owner"]).to_pylist():
        held.setdefault((r["at"]["seq"], r["at"]["candidate_id"]), []).append((r["key"], r["owner"]))
    known: dict[str, str] = {}
    out = []
    for (_, candidate), keys in sorted(held.items()):
        met = {owner or known.get(key) for key, owner in keys} - {None}
        decision = ("create", "merge")[len(met)] if len(met) < 2 else "defer"
        entity = candidate if decision == "create" else next(iter(met)) if decision == "merge" else None
        if entity is not None:
            for key, owner in keys:
                if owner is None:
                    known.setdefault(key, entity)
        out.append((candidate, decision, entity))
    return pa.table({n: pa.array(c, pa.string()) for n, c in zip(("candidate_id", "decision", "entity_id"), zip(*out))})


def _clusters(links: DataFrame) -> DataFrame:
    """Candidates joined through shared keys: connected components of candidates and keys, by alternating
    large and small stars, so that a long chain takes few rounds and a hub's neighbours aren't gathered."""
    name = F.xxhash64
    nodes = settle(links.select("block", "candidate_id").distinct().withColumn("node", name("block", "candidate_id")))
    at = links.where("key IS NOT NULL").select(name("block", "candidate_id").alias("a"), name(F.lit("key"), "block", "key").alias("b"))
    e = settle(at.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while (now := tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())) != state:
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = settle(small.where("u <> v").distinct())
    found = nodes.join(e, nodes.node == e.u, "left")
    return found.select("block", "candidate_id", F.coalesce("v", "node").alias("cluster"))
