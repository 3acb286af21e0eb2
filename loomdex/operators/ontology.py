"""Extraction envelopes: prompts, schema and ontology validation, a rule-based extractor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import uuid5

# Limits of an envelope.
MOST_ITEMS, MOST_LOCAL_ID = 40, 40
ENVELOPE = "entities array<struct<local_id:string,name:string,type:string,quote:string,occurrence:int>>, relationships array<struct<local_id:string,source:string,target:string,predicate:string,quote:string,occurrence:int>>, claims array<struct<local_id:string,text:string,quote:string,occurrence:int>>"

# The ontology's name and namespace, and its codes.
ONTOLOGY_CODE, ONTOLOGY_VERSION, ONTOLOGY_ID = "telecom-core", "0.1", "00000000-0000-4000-8000-000000000401"
ENTITY_TYPES = "ORGANIZATION ORG_UNIT PERSON ROLE PROCESS CAPABILITY POLICY PRODUCT SERVICE CUSTOMER_SEGMENT EXTERNAL_PARTY SYSTEM APPLICATION COMPONENT NETWORK_ELEMENT DEVICE_MODEL DEVICE_INSTANCE NETWORK_SEGMENT INTERFACE PROTOCOL TECHNOLOGY SITE LOCATION INFRASTRUCTURE_ASSET DOCUMENT CONCEPT OTHER".split()
ENTITY_SUBTYPES = {
    "NETWORK_ELEMENT": "CMTS CBR ASR_ROUTER OLT HFC_NODE ACCESS_NODE AGGREGATION_ROUTER".split(),
    "DEVICE_MODEL": "ONT CABLE_MODEM SMART_DEVICE ROUTER SWITCH SET_TOP_BOX".split(),
    "DEVICE_INSTANCE": "ONT CABLE_MODEM SMART_DEVICE ROUTER SWITCH SET_TOP_BOX".split(),
}
PREDICATES = "PART_OF INSTANCE_OF HAS_COMPONENT DEPENDS_ON USES SUPPORTS IMPLEMENTS OWNS RESPONSIBLE_FOR OPERATES MAINTAINS INPUT_TO OUTPUT_OF PRECEDES TRIGGERS PROVIDES SERVES SUPPLIED_BY CONNECTS_TO TERMINATES_AT ROUTES_VIA LOCATED_AT DESCRIBES APPLIES_TO REFERENCES RELATED_TO".split()
ENTITY_SCOPES = "category type model instance logical".split()
ASSERTION_KINDS = "explicit normalized inferred".split()
NETWORK_LAYERS = "physical access layer_2 layer_3 transport service business".split()


def seed(spark: SparkSession) -> DataFrame:
    """The ontology's rows: ``kind, parent, code, id``, 27 entity types, 19 subtypes, 26 predicates and a property."""
    rows = [("entity-type", None, c) for c in ENTITY_TYPES] + [("entity-subtype", t, c) for t, codes in ENTITY_SUBTYPES.items() for c in codes]
    rows += [("predicate", None, c) for c in PREDICATES] + [("property", None, "network_layer")]
    df = spark.createDataFrame(rows, "kind string, parent string, code string")
    return df.withColumn("id", uuid5(F.lit(ONTOLOGY_ID), F.concat_ws(":", "kind", "parent", "code")))


def validate_entity(kind: Column, subtype: Column, scope: Column, assertion: Column) -> Column:
    """An extracted entity's codes of error, sorted. A subtype is looked at only where the type is known; null is no subtype."""
    known = F.concat_ws(":", kind, subtype).isin(*[f"{t}:{c}" for t, codes in ENTITY_SUBTYPES.items() for c in codes])
    typed = F.when(~F.coalesce(kind.isin(*ENTITY_TYPES), F.lit(False)), "unknown_entity_type").when(subtype.isNotNull() & ~known, "unknown_entity_subtype")
    return F.array_sort(F.array_compact(F.array(typed, _unknown(scope, ENTITY_SCOPES, "unknown_entity_scope"), _unknown(assertion, ASSERTION_KINDS, "unknown_assertion_kind"))))


def validate_relationship(predicate: Column, assertion: Column, layer: Column) -> Column:
    """An extracted relationship's codes of error, sorted; a null layer is none."""
    placed = F.when(layer.isNotNull() & ~layer.isin(*NETWORK_LAYERS), "unknown_network_layer")
    return F.array_sort(F.array_compact(F.array(_unknown(predicate, PREDICATES, "unknown_predicate"), _unknown(assertion, ASSERTION_KINDS, "unknown_assertion_kind"), placed)))


def _unknown(value: Column, codes: list[str], error: str) -> Column:
    return F.when(~F.coalesce(value.isin(*codes), F.lit(False)), error)


def check_codes(predicates: list[str] | None = None, types: list[str] | None = None) -> None:
    """Refuse a request's filters that the ontology doesn't have."""
    for given, codes, what in ((predicates, PREDICATES, "predicate"), (types, ENTITY_TYPES, "entity type")):
        if bad := sorted(set(given or ()) - set(codes)):
            raise ValueError(f"unknown {what}: {', '.join(bad)}")


def prompt(template: str, path: Column, headings: Column, text: Column) -> Column:
    """A rendered prompt: the heading path is joined by `` > ``."""
    out = F.lit(template)
    for name, value in (("{path}", path), ("{headings}", F.concat_ws(" > ", headings)), ("{text}", text)):
        out = F.replace(out, F.lit(name), value)
    return out


def read_envelope(answer: Column) -> Column:
    """A model's JSON answer; null where it isn't one."""
    return F.from_json(answer, ENVELOPE, {"mode": "PERMISSIVE"})


def envelope_errors(e: Column) -> Column:
    """Why an envelope is rejected as a whole, sorted: size, ids that are empty, long or repeated, unknown endpoints."""
    ids = F.transform(e["entities"], lambda x: x["local_id"])
    all_ids = F.concat(ids, F.transform(e["relationships"], lambda x: x["local_id"]), F.transform(e["claims"], lambda x: x["local_id"]))
    errors = F.array(
        F.when(e.isNull() | e["entities"].isNull() | e["relationships"].isNull() | e["claims"].isNull(), "not_an_envelope"),
        F.when(F.greatest(F.size(e["entities"]), F.size(e["relationships"]), F.size(e["claims"])) > MOST_ITEMS, "too_many_items"),
        F.when(F.exists(all_ids, lambda i: i.isNull() | (F.length(i) == 0) | (F.length(i) > MOST_LOCAL_ID)), "bad_local_id"),
        F.when(F.size(F.array_distinct(all_ids)) < F.size(all_ids), "repeated_local_id"),
        F.when(F.exists(e["relationships"], lambda r: ~F.array_contains(ids, r["source"]) | ~F.array_contains(ids, r["target"])), "unknown_endpoint"),
    )
    return F.array_sort(F.array_compact(errors))


def rule_extract(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model: mentions (chunk_id, entity_id) of known names by token equality.

    Tokens are exploded and hash-joined with the names, so it's no scan of names against texts.
    """
    from ..functions.text import tokens

    words = chunks.select("chunk_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    return words.join(names.select(F.lower("name").alias("token"), "entity_id"), "token").groupBy("chunk_id", "entity_id").agg(F.count("*").alias("n"))


def finalize(counts: DataFrame) -> DataFrame:
    """A run's totals and status from (run_id, kind, status) rows: partial if anything is invalid."""
    bad = F.count_if(F.col("status") == "invalid")
    return counts.groupBy("run_id").agg(F.count_if(F.col("status") == "valid").alias("valid"), bad.alias("invalid"), F.when(bad > 0, "partial").otherwise("succeeded").alias("status"))
