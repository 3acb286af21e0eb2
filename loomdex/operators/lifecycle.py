"""Extraction and resolution runs: what is still to do, what a run leaves behind, and its counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_name
from .gates import insert_missing

# States of an extracted chunk that are tried again; most items of a model's answer.
RETRIED = ("pending", "provider_failed")
MOST_ENTITIES, MOST_RELATIONSHIPS, MOST_CLAIMS = 12, 12, 8


def pending_chunks(states: DataFrame, runs: DataFrame) -> DataFrame:
    """Chunks (run_id, chunk_id, status) of running runs that are still to extract, in order."""
    live = runs.where("status = 'running'").select("run_id")
    return states.where(F.col("status").isin(*RETRIED)).join(live, "run_id", "left_semi").orderBy("run_id", "chunk_id")


def prepare_runs(jobs: DataFrame, runs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New extraction runs (run_id, job_id, vault_id, requested) of jobs (job_id, vault_id) that have none yet, and their chunks, pending.

    ``chunks`` (job_id, chunk_id) are what each job asks for; a job without any gets no run. A job
    that is prepared again keeps its run. The run's id follows from the job's, so a retry makes the same.
    """
    wanted = chunks.select("job_id", "chunk_id").distinct()
    new = jobs.join(runs.select("job_id"), "job_id", "left_anti").join(wanted.groupBy("job_id").agg(F.count("*").alias("requested")), "job_id")
    new = new.select(F.sha2(F.concat(F.lit("run:"), F.col("job_id").cast("string")), 256).alias("run_id"), "job_id", "vault_id", "requested", F.lit("running").alias("status"))
    return new, wanted.join(new.select("job_id", "run_id"), "job_id").select("run_id", "chunk_id", F.lit("pending").alias("status"))


def identifier_writes(resolved: DataFrame, identifiers: DataFrame) -> DataFrame:
    """New identifiers (entity_id, kind, value, candidate_id, evidence_id) of resolved candidates (entity_id, candidate_id, evidence_id,
    ids), ids being kinds and normal values; what an entity has isn't added again, and of several candidates the first brings it."""
    each = resolved.where("entity_id IS NOT NULL").select("entity_id", "candidate_id", "evidence_id", F.inline("ids"))
    first = each.groupBy("entity_id", "kind", "value").agg(F.min_by(F.struct("candidate_id", "evidence_id"), F.struct("candidate_id", "evidence_id")).alias("r"))
    return first.join(identifiers.select("entity_id", "kind", "value"), ["entity_id", "kind", "value"], "left_anti").select("entity_id", "kind", "value", "r.candidate_id", "r.evidence_id")


def decision_rows(decisions: DataFrame, decided: DataFrame) -> DataFrame:
    """New decision records (candidate_id, entity_id, decision, method, score) of a resolution's ``decisions``; candidates in ``decided`` have theirs."""
    score = F.when(F.col("decision") == "merge", F.lit("1.0000").cast("decimal(6,4)"))
    method = F.when(F.col("decision") == "create", "no_match").when(F.col("decision") == "merge", "strong_identifier").otherwise("ambiguous_identifier")
    return decisions.join(decided.select("candidate_id"), "candidate_id", "left_anti").select("candidate_id", "entity_id", "decision", method.alias("method"), score.alias("score"))


def replace_results(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """What a table holds after results are written again: rows of the keys (run, chunk) in ``new`` are replaced whole."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def unresolved(candidates: DataFrame, evidence: DataFrame, runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Valid candidates (candidate_id, run_id, evidence_id, ...) with their quote and vault that no decision names yet."""
    valid = candidates.where("size(errors) = 0").drop("errors")
    rows = valid.join(evidence.select("evidence_id", "chunk_id", "quote"), "evidence_id").join(runs.select("run_id", "vault_id"), "run_id")
    return rows.join(decisions.select("candidate_id"), "candidate_id", "left_anti")


def summary(candidates: DataFrame, *by: str) -> DataFrame:
    """Counts by any columns, arrays of errors included."""
    return candidates.groupBy(*by).agg(F.count("*").alias("n"))


def answer_schema(types: list[str], predicates: list[str], scopes: list[str], kinds: list[str], layers: list[str]) -> dict:
    """The JSON schema of a model's answer, small enough for a grammar, with the ontology's codes as enums."""
    text = {"type": "string"}
    proof = {"type": "object", "properties": {"quote": text, "quote_occurrence": {"type": "integer"}}, "required": ["quote", "quote_occurrence"], "additionalProperties": False}

    def many(most: int, **fields) -> dict:
        item = {"type": "object", "properties": fields | {"evidence": proof}, "required": [*fields, "evidence"], "additionalProperties": False}
        return {"type": "array", "maxItems": most, "items": item}

    maybe, kind = {"type": ["string", "null"]}, {"type": "string", "enum": list(kinds)}
    of = lambda codes: {"type": "string", "enum": list(codes)}
    parts = {
        "entities": many(MOST_ENTITIES, local_id=text, name=text, entity_type=of(types), entity_subtype=maybe, proposed_subtype=maybe, scope=of(scopes), assertion_kind=kind),
        "relationships": many(MOST_RELATIONSHIPS, subject_local_id=text, predicate=of(predicates), object_local_id=text, assertion_kind=kind, network_layer={"enum": [*layers, None]}),
        "claims": many(MOST_CLAIMS, text=text, assertion_kind=kind),
    }
    return {"type": "object", "properties": parts, "required": list(parts), "additionalProperties": False}


def register(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Profiles (kind, name, content, active) after new ones are registered: each has the hash of its content; of a
    kind only the newest is active, and one that is known by kind and hash isn't added again."""
    hashed = lambda df: df.withColumn("content_hash", F.sha2("content", 256))
    fresh = hashed(new).dropDuplicates(["kind", "content_hash"])
    kinds = fresh.groupBy("kind").agg(F.max_by("content_hash", F.struct("name", "content_hash")).alias("newest"))
    rows = hashed(existing).unionByName(insert_missing(hashed(existing), fresh, "kind", "content_hash")).join(kinds, "kind", "left")
    return rows.withColumn("active", F.when(F.col("newest").isNull(), F.col("active")).otherwise(F.col("newest") == F.col("content_hash"))).drop("newest")


def resolution_writes(resolved: DataFrame, aliases: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New aliases (entity_id, alias) and mentions (entity_id, chunk_id, evidence_id) of resolved candidates (entity_id, name, chunk_id, evidence_id)."""
    named = resolved.select("entity_id", normal_name(F.col("name")).alias("alias"))
    seen = resolved.select("entity_id", "chunk_id", "evidence_id")
    return insert_missing(aliases, named, "entity_id", "alias"), insert_missing(mentions, seen, "entity_id", "evidence_id")


def materialise(relations: DataFrame, claims: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assertions (relation_id, source_id, target_id, predicate) whose two ends are resolved in their chunk, and claims whose subject is.

    ``relations`` have (relation_id, chunk_id, source_local, target_local, predicate), ``claims``
    (claim_id, chunk_id, subject_local) and ``resolved`` (chunk_id, local_id, entity_id).
    """
    end = lambda local, name: resolved.select("chunk_id", F.col("local_id").alias(local), F.col("entity_id").alias(name))
    edges = relations.join(end("source_local", "source_id"), ["chunk_id", "source_local"]).join(end("target_local", "target_id"), ["chunk_id", "target_local"])
    return edges.select("relation_id", "source_id", "target_id", "predicate"), claims.join(end("subject_local", "subject_id"), ["chunk_id", "subject_local"]).select("claim_id", "subject_id")


def resolution_counters(decisions: DataFrame) -> DataFrame:
    """A run's outcome: created, merged and deferred candidates, and those kept for review."""
    of = lambda d: F.count_if(F.col("decision") == d)
    return decisions.groupBy("run_id").agg(of("create").alias("created"), of("merge").alias("merged"), of("defer").alias("deferred"), F.count_if("review").alias("reviewed"))


def out_of_scope(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that a job (job_id, vault_id, run_id) names but that don't exist or belong to another vault."""
    own = runs.select("run_id", F.col("vault_id").alias("_owner"))
    rows = asked.join(own, "run_id", "left")
    return rows.where("_owner IS NULL OR _owner <> vault_id").select("job_id", "run_id", F.when(F.col("_owner").isNull(), "unknown_run").otherwise("other_vault").alias("error"))


def exact_name_score(left: Column, right: Column) -> Column:
    """1.0000 for names that are equal in normal form, else null."""
    return F.when(normal_name(left) == normal_name(right), F.lit("1.0000").cast("decimal(6,4)"))
