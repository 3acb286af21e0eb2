"""Whole jobs: queries that once ran on a part of their tables."""

import hashlib
import json

from loomdex.queries import answer, knowledge, lifecycle, retrieval


def test_fingerprint_covers_every_supplier(spark):
    d = "/root/testdata/sf0.01"
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet").collect()
    edges = [(f"sn{r.s_suppkey}", "LOCATED", f"s{r.s_suppkey}", f"n{r.s_nationkey}") for r in read("supplier")]
    edges += [(f"nr{r.n_nationkey}", "PART_OF", f"n{r.n_nationkey}", f"r{r.n_regionkey}") for r in read("nation")]
    edges += [(f"rr{r.r_regionkey}", "SAME", f"r{r.r_regionkey}", f"r{r.r_regionkey}") for r in read("region")]
    texts = [json.dumps(dict(zip(("edge_id", "predicate", "source_id", "target_id"), e)), separators=(",", ":")) for e in edges]
    want = sum(int(hashlib.sha256(t.encode()).hexdigest()[:15], 16) for t in texts)
    got = knowledge.graph_fingerprint(spark, d).first()
    assert len(edges) > 100 and (got.n_objects, int(got.digest)) == (len(edges), want)


def test_a_snapshot_without_links_counts_them(spark, tmp_path):
    df = spark.createDataFrame([(n, "x", "en", "s") for n in (0, 700, 1400)], "doc_id long, text string, lang string, source string")  # three notes of one path, so each link is ambiguous or has no note
    df.write.parquet(str(tmp_path / "a/documents.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    for at, n in (("a", 3), ("b", 0)):
        assert {tuple(r) for r in lifecycle.links_in_snapshot(spark, str(tmp_path / at)).collect()} == {("Document", n), ("LINKS_TO", 0)}


def test_routes_upper_case_letter_by_letter(spark, tmp_path):
    second = {"ß": "hybrid", "groß": "entity", "ﬁ": "hybrid", "otrs": "entity", "é": "entity", "": "hybrid"}
    rows = [(12 * i + 6, i, "user", f"Der {w} und") for i, w in enumerate(second)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r.query_type for r in retrieval.planner_route(spark, str(tmp_path)).orderBy("turn").collect()] == list(second.values())


def test_a_text_is_stored_once(spark):
    c = answer.corpus(spark, "/root/testdata/sf0.001")
    assert "text" in c.chunks.columns and not {"text", "content_hash"} & {*c.current_claims.columns, *c.current_assertions.columns}
    k = lifecycle.Knowledge(spark, "/root/testdata/sf0.001")
    paths = k.documents.select("document_id", "path")
    assert c.chunks.join(paths, ["document_id", "path"]).count() == c.chunks.count() == k.sources.count() > 100
    for got, want, key in ((c.current_claims, lifecycle.H.claims(k.claims, k.evidence, k.sources), "claim_id"), (c.current_assertions, lifecycle.H.assertions(k.assertions, k.entities, k.evidence, k.sources), "assertion_id")):
        both = [x for x in got.columns if x in want.columns]
        assert {"quote", "chunk_id", key} <= set(both)
        assert sorted(map(repr, got.select(*both).collect())) == sorted(map(repr, want.select(*both).collect())) != []
