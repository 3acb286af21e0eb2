"""The five-channel answer on small corpora."""

import pytest
from pyspark.sql import functions as F

from loomdex.operators import hydrate as H
from loomdex.plans.answer import Corpus, Limits, retrieve

CHUNK = "chunk_id string, document_id string, section_id string, ordinal long, char_start long, char_end long, path string, role string, text string, vault_id string"


def chunk(i, document, section, ordinal, text, role="content_evidence", path=None):
    return (i, document, section, ordinal, ordinal * 100, ordinal * 100 + 90, path or f"{document}.md", role, text, "v")


def corpus(spark, chunks, vectors=(), entities=(), mentions=(), assertions=(), claims=()):
    df = spark.createDataFrame(list(chunks), CHUNK)
    sources = df.withColumn("content_hash", F.sha2("text", 256))
    evidence = sources.select(F.col("chunk_id").alias("evidence_id"), "chunk_id", F.lit(True).alias("exact"), F.col("content_hash").alias("chunk_hash"), F.lit("q").alias("quote"), "char_start", "char_end")
    e = spark.createDataFrame([(i, n, "active", "SYSTEM") for i, n in entities], "entity_id string, name string, status string, entity_type string")
    a = spark.createDataFrame(list(assertions), "assertion_id string, source_id string, target_id string, predicate string, evidence_id string")
    k = spark.createDataFrame(list(claims), "claim_id string, claim string, evidence_id string")
    none = spark.createDataFrame([], "entity_id string, alias string")
    m = spark.createDataFrame([(x, c, "active") for x, c in mentions], "entity_id string, chunk_id string, status string")
    v = spark.createDataFrame([(c, x) for c, x in vectors], "chunk_id string, embedding array<double>") if vectors is not None else None
    return Corpus(df, v, e, none, m, a, H.assertions(a, e, evidence, sources), H.claims(k, evidence, sources))


def test_consensus_holds_every_channel(spark):
    c = corpus(spark, [chunk("rel", "d1", "s1", 0, "the modem restart guide"), chunk("smtp", "d2", "s2", 0, "the modem mail server")], [("rel", [1.0, 0.0]), ("smtp", [0.7, 0.714])])
    got = retrieve(c, "how to restart the modem?", [1.0, 0.0])
    assert [x[0] for x in got.chunks] == ["rel"] and got.truncated and got.status == "succeeded"
    assert (got.entities, got.relationships, got.claims, got.paths) == ([], [], [], [])


def test_stale_vectors_and_missing_channels(spark):
    c = corpus(spark, [chunk("a", "d1", "s1", 0, "apple pie")], [("a", [1.0, 0.0]), ("gone", [1.0, 0.1])])
    got = retrieve(c, "apple", [1.0, 0.0])
    assert [x[0] for x in got.chunks] == ["a"] and got.warnings == ["stale_projection_filtered"] and got.status == "degraded"
    down = corpus(spark, [chunk("a", "d1", "s1", 0, "apple pie")], None)
    assert retrieve(down, "apple", None).warnings == ["semantic_unavailable"]
    with pytest.raises(ValueError):
        retrieve(down, "apple", None, "semantic")
    with pytest.raises(ValueError):
        retrieve(c, "  ", None)


def test_own_channel_keeps_its_order(spark):
    c = corpus(spark, [chunk("a", "d1", "s1", 0, "pie"), chunk("b", "d2", "s2", 0, "pie pie")], [("a", [1.0, 0.0]), ("b", [0.9, 0.4])])
    one = retrieve(c, "pie", None, "keyword")
    assert (one.query_type, one.reason) == ("keyword", "explicit_keyword_strategy") and [x[:2] for x in one.chunks] == [("b", 0.2), ("a", 0.1)]
    assert [x[0] for x in retrieve(c, "pie", [1.0, 0.0], "semantic").chunks] == ["a", "b"]


def test_anchors_bring_their_document(spark):
    rows = [chunk("h", "d1", "s1", 0, "modem", "structural_anchor"), chunk("x", "d1", "s1", 1, "first step"), chunk("y", "d1", "s2", 2, "second step"), chunk("z", "d2", "s3", 0, "unrelated")]
    got = retrieve(corpus(spark, rows), "modem", [1.0])
    assert got.chunks == [] and got.context == ["x", "y"]
    index = [chunk("h", "d1", "s1", 0, "modem", "structural_anchor", "d1/index.md"), *rows[1:]]
    assert retrieve(corpus(spark, index), "modem", [1.0]).context == []


def test_graph_claims_and_closure(spark):
    rows = [chunk("c1", "d1", "s1", 0, "cmts talks to the modem"), chunk("c2", "d2", "s2", 0, "the modem uses docsis"), chunk("c3", "d3", "s3", 0, "nothing here")]
    entities = [("e1", "CMTS"), ("e2", "modem"), ("e3", "DOCSIS")]
    mentions = [("e1", "c1"), ("e2", "c1"), ("e2", "c2"), ("e3", "c2")]
    assertions = [("a1", "e1", "e2", "CONNECTS_TO", "c1"), ("a2", "e2", "e3", "USES", "c2"), ("a3", "e1", "e3", "USES", "missing")]
    claims = [("k1", "the cmts talks", "c1"), ("k2", "cmts of old", "missing")]
    got = retrieve(corpus(spark, rows, entities=entities, mentions=mentions, assertions=assertions, claims=claims), "What connects to the CMTS?", [1.0])
    assert got.query_type == "graph" and got.warnings == ["stale_graph_filtered"]
    assert {tuple(p.edges) for p in got.paths} == {("a1",), ("a1", "a2")}
    assert [r.assertion_id for r in got.relationships] == ["a1", "a2"] and [c.claim_id for c in got.claims] == ["k1"]
    assert {x[0]: x[2] for x in got.chunks} == {"c1": ["claim", "entity", "graph", "keyword"], "c2": ["entity", "graph"]}
    assert [(e.entity_id, e.score, e.channels) for e in got.entities] == [("e1", 1.0, ["chunk", "entity"]), ("e3", 0.0, ["graph"]), ("e2", 0.0, ["graph"])]
    few = retrieve(corpus(spark, rows, entities=entities, mentions=mentions, assertions=assertions, claims=claims), "What connects to the CMTS?", [1.0], limits=Limits(results=1, paths=1))
    assert few.truncated and len(few.chunks) == 1


def test_a_section_around_agreed_chunks_of_one_document(spark):
    rows = [chunk(f"g{i}", "guide", "s1", i, "modem guide" if i == 2 else f"part {i}") for i in range(6)] + [chunk("o", "other", "s9", 0, "modem")]
    got = retrieve(corpus(spark, rows, [("g2", [1.0, 0.0]), ("o", [0.0, 1.0])]), "modem", [1.0, 0.0])
    assert [x[0] for x in got.chunks] == ["g2"] and got.context == ["g0", "g1", "g3", "g4", "g5"]


def test_a_named_entity_without_edges_brings_its_evidence(spark):
    rows = [chunk("c1", "d1", "s1", 0, "nothing of the kind"), chunk("c2", "d2", "s2", 0, "else")]
    got = retrieve(corpus(spark, rows, entities=[("e1", "CMTS")], mentions=[("e1", "c1")]), "CMTS", [1.0])
    assert [(x[0], x[2]) for x in got.chunks] == [("c1", ["entity", "graph"])] and [e.entity_id for e in got.entities] == ["e1"]


def test_an_entity_that_only_a_chunk_brings_is_dropped(spark):
    got = retrieve(corpus(spark, [chunk("c1", "d1", "s1", 0, "modem guide")], entities=[("e1", "CMTS")], mentions=[("e1", "c1")]), "modem guide", [1.0])
    assert [x[:1] + x[2:] for x in got.chunks] == [("c1", ["keyword"])] and got.entities == []


def test_entities_on_paths_are_returned(spark):
    rows = [chunk("c1", "d1", "s1", 0, "one"), chunk("c2", "d2", "s2", 0, "two")]
    c = corpus(spark, rows, entities=[("e1", "CMTS"), ("e2", "b"), ("e3", "C")], mentions=[("e1", "c1")], assertions=[("a1", "e1", "e2", "USES", "c1"), ("a2", "e2", "e3", "USES", "c2")])
    got = retrieve(c, "CMTS", [1.0])
    assert [p.edges for p in got.paths] == [["a1"], ["a1", "a2"]] and [e.entity_id for e in got.entities] == ["e1", "e2", "e3"]
    assert [list(e.source_chunk_ids) for e in got.entities] == [["c1", "c2"], ["c1", "c2"], ["c1", "c2"]]
    c.assertions = None
    down = retrieve(c, "CMTS", [1.0])
    assert down.warnings == ["graph_unavailable"] and [e.entity_id for e in down.entities] == ["e1"] and [x[0] for x in down.chunks] == ["c1"]


def test_context_beyond_the_budget_is_truncated(spark):
    rows = [chunk("h", "d1", "s1", 0, "modem", "structural_anchor")] + [chunk(f"x{i:02d}", "d1", "s1", i, "step") for i in range(1, 36)]
    got = retrieve(corpus(spark, rows), "modem", [1.0])
    assert len(got.context) == 32 and got.truncated
    long = [chunk("h", "d1", "s1", 0, "modem", "structural_anchor"), chunk("x", "d1", "s1", 1, "s" * 20_000), chunk("y", "d1", "s1", 2, "t" * 20_000)]
    got = retrieve(corpus(spark, long), "modem", [1.0])
    assert got.context == ["x"] and got.truncated
    assert not retrieve(corpus(spark, long[:2]), "modem", [1.0]).truncated


def test_seeds_spend_no_budget_and_sections_hold_theirs(spark):
    rows = [chunk("g0", "d", "top", 0, "modem guide" * 2000), chunk("g1", "d", "sub", 1, "u" * 9000), chunk("g2", "d", "sub", 2, "v" * 9000), chunk("g3", "d", "far", 3, "w"), chunk("o", "e", "s", 0, "modem")]
    c = corpus(spark, rows, [("g0", [1.0, 0.0]), ("o", [0.0, 1.0])])
    c.sections = spark.createDataFrame([("top", 0, 290), ("sub", 100, 290), ("far", 300, 390)], "section_id string, span_start long, span_end long")
    got = retrieve(c, "modem", [1.0, 0.0])
    assert [x[0] for x in got.chunks] == ["g0"] and got.context == ["g1", "g2"]


def test_vaults_and_audit(spark):
    from datetime import datetime

    from loomdex.plans.answer import audit, find

    rows = [chunk("a", "d1", "s1", 0, "pie"), (*chunk("b", "d2", "s2", 0, "pie")[:-1], "w")]
    found = find(corpus(spark, rows), "pie", None, vault="w")
    assert [r.chunk_id for r in found.chunks.collect()] == ["b"]
    got = audit(found, "pie", "hybrid", datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 1)).first()
    assert (got.status, got.result_count, got.latency_ms, got.warnings) == ("degraded", 1, 1000, ["semantic_unavailable"])
    assert {r.part for r in found.rows().collect()} == {"chunk", "type", "truncated", "warning"}
