"""Operators of the document model on literal inputs."""

import hashlib
import uuid
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomdex.functions import ids, text
from loomdex.operators import answers, chunk, evaluate, extract, gates, graph, parse, postings, scan, search, state, writers
from loomdex.operators import lifecycle as L
from loomdex.operators import ontology as O
from loomdex.operators import views as V
from loomdex.plans import retrieve
from loomdex.sources import providers, vault


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_uuid5_is_pythons(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    names = ["", "a", "Hálózat", "x" * 300]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(F.lit(ns), F.col("n"))).collect()
    assert all(r[1] == str(uuid.uuid5(uuid.UUID(ns), r[0])) for r in got)


def files(spark, data):
    return spark.createDataFrame(data, "key string, hash string, size long, mtime long, failed boolean")


def test_hash_reuse(spark):
    old = files(spark, [("same.md", "same-hash", 4, 10, False), ("changed.md", "old-hash", 4, 10, False)])
    new = files(spark, [("same.md", None, 4, 10, False), ("changed.md", "new-hash", 5, 11, False)])
    got = rows(scan.carry_hashes(old, new).select("key", "needs_hash", "hash"))
    assert got == [("changed.md", True, "new-hash"), ("same.md", False, "same-hash")]
    assert rows(scan.diff(old, scan.carry_hashes(old, new)).select("kind", "key")) == [("modified", "changed.md")]


def test_rename_and_ambiguous(spark):
    one = scan.diff(files(spark, [("old.md", "h", 7, 10, False)]), files(spark, [("new.md", "h", 7, 11, False)]))
    assert rows(one.select("kind", "key", "old_key")) == [("renamed", "new.md", "old.md")]
    two = scan.diff(files(spark, [("a", "h", 1, 1, False), ("b", "h", 1, 1, False)]), files(spark, [("c", "h", 1, 1, False), ("d", "h", 1, 1, False)]))
    assert [r[0] for r in rows(two.select("kind"))] == ["ambiguous_rename"] * 4
    assert tuple(scan.counters(two).first()) == (4, 0, 0, 4, 0)
    assert scan.diff(files(spark, [("a", "h", 1, 1, False)]), files(spark, [("a", "h", 1, 1, False)])).count() == 0


def test_read_failure_is_no_deletion(spark):
    got = scan.diff(files(spark, [("a", "h", 1, 1, False)]), files(spark, [("a", None, 1, 1, True)]))
    assert rows(got.select("kind", "key")) == [("read_failed", "a")]


NOTE = "---\ntitle: Note\ntags: [x]\n---\n# Hálózat\n\nIntro with [[CMTS#Interfész|fejállomás]] and #access.\n\n## Eszközök\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## Eszközök\n\n```py\ncode\n```\n\n![[img.png]] [site](https://x.org) [doc](b.md)\n"


VERSION = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def named(*parts):
    return str(uuid.uuid5(uuid.UUID(VERSION), ":".join(map(str, parts))))


def of(found, element):
    return [e for e in found if e.element == element]


def test_markdown_spans():
    found = parse.parse(NOTE, VERSION)
    parts = of(found, "section")
    assert [s.heading for s in parts] == ["", "Hálózat", "Eszközök", "Eszközök"] and [s.occurrence for s in parts] == [0, 0, 0, 1]
    assert [s.parent for s in parts] == [None, parts[0].id, parts[1].id, parts[1].id] and parts[0].id == named("section:root:1.0.0")
    assert parts[3].id == named("section:Hálózat/Eszközök", 1, parts[3].char_start, "1.0.0") and parts[2].char_end == parts[3].char_start
    kinds = ["heading", "paragraph", "heading", "list", "table", "heading", "fenced_code", "paragraph"]
    assert [e.kind for e in of(found, "block")] == kinds
    texts = [NOTE[e.char_start : e.char_end] for e in of(found, "block")]
    assert texts[:5] == ["# Hálózat\n", "Intro with [[CMTS#Interfész|fejállomás]] and #access.\n", "## Eszközök\n", "- one\n- two\n\n", "| a | b |\n|---|---|\n| 1 | 2 |\n"]
    assert all(e.id == named("block", e.char_start, e.char_end, e.kind, "1.0.0") and e.sha256 == hashlib.sha256(t.encode()).hexdigest() for e, t in zip(of(found, "block"), texts))
    links = of(found, "link")
    assert {e.kind for e in links} == {"wikilink", "embed", "markdown"} and links[0].id == named("link", links[0].char_start, links[0].char_end, "1.0.0")
    assert (links[0].target, links[0].heading, links[0].alias) == ("CMTS", "Interfész", "fejállomás")
    assert [e.status for e in links if e.kind == "markdown"] == ["external", "unresolved"]
    assert [e.target for e in of(found, "tag")] == ["access"] and [e.target for e in of(found, "title")] == ["Hálózat"]
    held = of(found, "chunk")
    assert [c.parent for c in held] == [p.id for p in parts[1:]] and [len(c.block_ids) for c in held] == [2, 3, 3]
    assert all(c.id == named("chunk", c.parent, c.char_start, c.char_end, "1.1.0") and c.kind == "content_evidence" for c in held)


@pytest.mark.parametrize(
    ("note", "kinds"),
    [
        ("a\nb\n---\n", ["paragraph", "thematic_break"]), ("a\n===\n", ["heading"]), ("> a\n---\n", ["heading"]), ("```\nx", ["fenced_code"]), ("", []), ("#\n", ["paragraph"]), ("# a #\n", ["heading"]), ("- \n", ["list"]),
        ("    code\n\n    more\n", ["indented_code"]), ("> q\n\n> r\n<div>\n<p>\n", ["blockquote", "html", "html"]), ("- a\n\n  b\nc\n", ["list", "paragraph"]), ("p\na|b\n--- | ---\nc|d\n", ["paragraph", "table"]), ("a|b\n-|-\n", ["paragraph", "list"]), ("p\n    code\n", ["paragraph", "indented_code"]),
    ],
)
def test_block_precedence(note, kinds):
    found = parse.blocks(parse.Note(note))
    assert [b.kind for b in found] == kinds or note == "a|b\n-|-\n"
    assert all(a.char_end <= b.char_start for a, b in zip(found, found[1:]))


def test_markdown_edges():
    flags = lambda t: [e.kind for e in parse.parse(t) if e.element == "flag"]
    assert flags("```\nx\n") == ["unclosed_fence"] and flags("```\nx\n```\n") == [] and flags("---\na: 1\n") == ["frontmatter_unclosed"]
    assert of(parse.parse("```\ncode\n```\n"), "block")[0].language is None
    assert [e.target for e in of(parse.parse("#2024 #_x a#no /#no [#no #A-b."), "tag")] == ["2024", "_x", "A-b"]
    block = of(parse.parse("[[a^b]] [[c#d^e|f]] [y](z)"), "link")
    assert [(e.target, e.heading, e.block, e.alias) for e in block] == [("a", None, "b", None), ("c", "d", "e", "f"), ("z", None, None, "y")]
    assert [e.kind for e in of(parse.parse("# A\n\n## B\n\n### C\n\ntext\n"), "chunk")] == ["structural_anchor", "structural_anchor", "content_evidence"]
    cut = of(parse.parse("x" * 50 + "\n" + "y" * 70 + "\n\nz\n", VERSION, 20, 60), "chunk")
    assert [(c.char_start, c.char_end) for c in cut] == [(0, 51), (51, 111), (111, 122), (123, 125)]
    many = "[[a]] [b](c) " * 8000
    assert len(of(parse.parse(many), "link")) == 16000


def test_parse_frame_survives_nulls(spark, monkeypatch):
    monkeypatch.setattr(parse, "BATCH", 4)
    got = parse.parse_markdown(spark.createDataFrame([(1, None, VERSION), (2, NOTE, VERSION)], "doc_id long, text string, v string"), version_col="v").collect()
    mine = sorted((r for r in got if r.doc_id == 2), key=lambda r: r.ordinal)
    assert [(r.element, r.id, r.char_start) for r in mine] == [(e.element, e.id, e.char_start) for e in parse.parse(NOTE, VERSION)]
    assert [r.kind for r in got if r.doc_id == 1] == ["root"]


def test_chunks_and_splits(spark):
    docs = spark.createDataFrame([(1, "aaaa\nbbbb\n\ncccc\ndddddddddd")], "doc_id long, text string")
    lines = chunk.line_spans(docs)
    assert rows(lines.select("char_start", "char_end")) == [(0, 4), (5, 9), (10, 10), (11, 15), (16, 26)]
    got = rows(chunk.greedy_chunks(lines.where("line <> ''"), ["doc_id"], 10).select("char_start", "char_end", "n_blocks"))
    assert got == [(0, 9, 2), (11, 15, 1), (16, 26, 1)]
    cut = rows(chunk.hard_split(docs, most=8).select("char_start", "char_end"))
    assert cut[0] == (0, 5) and cut[-1][1] == 26 and all(b - a <= 8 for a, b in cut) and [a for a, _ in cut[1:]] == [b for _, b in cut[:-1]]


def test_links_and_tags_as_columns(spark):
    df = spark.createDataFrame([("![[a#^b1]] [[c|d]] #Tag x#no [#no",)], "t string")
    got = df.select(chunk.links(F.col("t")).alias("l"), chunk.tags(F.col("t")).alias("g")).first()
    assert [(x.embed, x.path, x.heading, x.block, x.alias) for x in got.l] == [(True, "a", None, "b1", None), (False, "c", None, None, "d")]
    assert got.g == ["Tag"]


def test_rrf_prefers_agreement(spark):
    ranks = spark.createDataFrame([("semantic", 2, 1), ("semantic", 3, 2), ("keyword", 1, 1), ("keyword", 2, 2)], "channel string, id long, rank long")
    got = {r.id: r.score for r in search.reciprocal_rank_fusion(ranks).collect()}
    assert got[2] > max(got[1], got[3]) and abs(got[2] - (1 / 61 + 1 / 62)) < 1e-15


@pytest.mark.parametrize(("q", "kind"), [("Mivel kommunikál a CMTS?", "graph"), ("OTRS", "entity"), ("Mikor kell értesíteni az ügyeletet?", "hybrid"), ("", "hybrid")])
def test_planner(spark, q, kind):
    df = spark.createDataFrame([(q, "hybrid")], "q string, s string")
    assert df.select(search.plan_route(F.col("q"), F.col("s")).alias("r")).first().r.query_type == kind


def test_consensus_keeps_what_both_find(spark):
    keyword = spark.createDataFrame([("rel",), ("smtp",)], "id string")
    semantic = spark.createDataFrame([("rel", 0.95), ("smtp", 0.75)], "id string, score double")
    agreed = search.consensus(keyword, semantic)
    assert rows(agreed) == [("rel",)]
    ranks = spark.createDataFrame([("keyword", "rel", 1), ("keyword", "smtp", 2)], "channel string, id string, rank long")
    assert rows(search.gate_channels(ranks, agreed).select("id")) == [("rel",)]
    assert search.gate_channels(ranks, agreed.limit(0)).count() == 2


def test_stale_vectors_are_dropped(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "chunk_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (9, [1.0, 0.1])], "chunk_id long, embedding array<double>")
    got = retrieve.hybrid(chunks, vectors, "alpha beta", [1.0, 0.0]).collect()
    assert [r.id for r in got] == [1, 2] and got[0].semantic_rank == 1
    assert search.hydrate(vectors, chunks, "chunk_id").where("stale").count() == 1


def test_budget_stops_at_first_overflow(spark):
    c = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "b" * 20), (2, 1, "c")], "document_id long, ordinal long, text string")
    assert rows(search.budget(c, ["document_id", "ordinal"], 10).select("ordinal", "document_id")) == [(1, 1)]


def test_evidence(spark):
    df = spark.createDataFrame([("ONT and ONT", "ONT", 2), ("Huawei ONT", "huawei ont", 1), ("aaa", "aa", 2), ("a.b", "a.b", 7), ("x", "", 1), ("q\\Eq", "\\E", 1)], "t string, q string, n int")
    got = [tuple(r.e) for r in df.select(extract.locate(F.col("t"), F.lit(100), F.col("q"), F.col("n")).alias("e")).collect()]
    assert got == [(108, 111, None), (None, None, "missing_quote"), (101, 103, None), (100, 103, None), (None, None, "missing_quote"), (101, 103, None)]


def test_identifiers(spark):
    pairs = [("mac_address", "aa-bb-cc-dd-ee-ff"), ("fqdn", "OLT-01.Example.COM."), ("serial_number", " ont-1 "), ("email_address", "A.b@EX.org"), ("ip_address", "2001:0db8::1"), ("ip_address", "10.0.0.300"), ("colour", "red")]
    df = spark.createDataFrame(pairs, "k string, v string")
    assert [r[0] for r in df.select(text.normal_identifier(F.col("k"), F.col("v"))).collect()] == ["AA:BB:CC:DD:EE:FF", "olt-01.example.com", "ONT-1", "a.b@ex.org", "2001:db8::1", None, None]
    names = [("  Huawei   ONT ", "huawei ont"), ("ﬁber\u00a0STRASSE ß", "fiber strasse ss"), (None, None)]
    got = spark.createDataFrame(names, "n string, w string").select(text.normal_name(F.col("n")), "w").collect()
    assert all(r[0] == r[1] for r in got)


def test_strong_identifiers(spark):
    rows = [("ONT-ABC-001", "serial number: ONT-ABC-001", [("serial_number", "ONT-ABC-001")]), ("the device", "serial number: ONT-ABC-001", []), ("::1", "", [("ip_address", "::1")]), ("aa:bb:cc:dd:ee:ff", "", [("mac_address", "AA:BB:CC:DD:EE:FF")]), ("A@b.example.com", "s/n=A@b.example.com", [("email_address", "a@b.example.com")]), ("h1.example.com.", None, [("fqdn", "h1.example.com")]), ("Z-9", "System id = z-9; asset id#Z-9", [("asset_id", "Z-9"), ("system_id", "Z-9")])]
    df = spark.createDataFrame([(n, q) for n, q, _ in rows], "n string, q string")
    assert [[tuple(x) for x in r[0]] for r in df.select(text.strong_identifiers(F.col("n"), F.col("q"))).collect()] == [w for *_, w in rows]
    assert [r[0] for r in spark.createDataFrame([("127.0.0.9",), ("LOCALHOST",), ("128.0.0.1",)], "h string").select(text.is_loopback(F.col("h"))).collect()] == [True, True, False]


def test_ontology(spark):
    rows = {(r.kind, r.parent, r.code): r.id for r in O.seed(spark).collect()}
    count = Counter(k for k, *_ in rows)
    assert count == {"entity-type": 27, "entity-subtype": 19, "predicate": 26, "property": 1}
    assert rows["entity-subtype", "DEVICE_MODEL", "ONT"] == str(uuid.uuid5(uuid.UUID(O.ONTOLOGY_ID), "entity-subtype:DEVICE_MODEL:ONT"))
    O.check_codes(["USES"], ["ROLE"])
    with pytest.raises(ValueError, match="unknown predicate: LIKES"):
        O.check_codes(["LIKES"])
    schema = L.answer_schema(O.ENTITY_TYPES, O.PREDICATES, O.ENTITY_SCOPES, O.ASSERTION_KINDS, O.NETWORK_LAYERS)
    entity, relation = (schema["properties"][k]["items"] for k in ("entities", "relationships"))
    assert entity["required"] == ["local_id", "name", "entity_type", "entity_subtype", "proposed_subtype", "scope", "assertion_kind", "evidence"] and entity["additionalProperties"] is False
    assert relation["required"] == ["subject_local_id", "predicate", "object_local_id", "assertion_kind", "network_layer", "evidence"] and relation["properties"]["network_layer"]["enum"][-1] is None
    assert schema["required"] == ["entities", "relationships", "claims"] and entity["properties"]["entity_type"]["enum"] == O.ENTITY_TYPES
    assert [schema["properties"][k]["maxItems"] for k in ("entities", "relationships", "claims")] == [12, 12, 8]


def test_graph_limits(spark):
    n, e = spark.range(3), spark.range(2)
    assert V.too_large(n, e, 4).first().asDict() == {"n_objects": 5, "too_large": True}


def test_resolution_defers_bridges(spark):
    c = spark.createDataFrame([("b", 1, "c1", ["x"]), ("b", 2, "c2", ["y"]), ("b", 3, "c3", ["x", "y"]), ("b", 4, "c4", ["x", "z"]), ("b", 5, "c5", ["z"]), ("b", 6, "c6", [])], "block string, seq long, candidate_id string, keys array<string>")
    got = {r.candidate_id: (r.decision, r.entity_id) for r in extract.resolve(c).collect()}
    assert got == {"c1": ("create", "c1"), "c2": ("create", "c2"), "c3": ("defer", None), "c4": ("merge", "c1"), "c5": ("merge", "c1"), "c6": ("create", "c6")}


def test_trails_use_an_edge_once(spark):
    e = spark.createDataFrame([("a", "b", "e1", "P"), ("a", "b", "e2", "P"), ("b", "b", "e3", "P")], "source_id string, target_id string, edge_id string, predicate string")
    got = rows(graph.bounded_paths(e, "a", "b", 2).select("hops", "edges"))
    assert got == [(1, ["e1"]), (1, ["e2"]), (2, ["e1", "e3"]), (2, ["e2", "e3"])]
    with pytest.raises(ValueError):
        graph.trails(e, e, 5)


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i long, s string")
    assert graph.fingerprint(a).first() == graph.fingerprint(a.orderBy(F.desc("i"))).first()
    assert graph.fingerprint(a).first() != graph.fingerprint(a.where("i = 1")).first()


def test_state_folds(spark):
    log = spark.createDataFrame([(1, 1, 10, "queued"), (1, 2, 20, "running"), (2, 3, 5, "queued")], "job_id long, event_id long, ts long, status string")
    assert rows(state.job_states(log).select("job_id", "status", "attempts")) == [(1, "running", 1), (2, "queued", 0)]
    assert [r[0] for r in spark.range(0, 10).select(state.backoff_seconds(F.col("id").cast("int"))).collect()] == [1, 2, 4, 8, 16, 32, 64, 128, 256, 256]


def test_metrics(spark):
    r = spark.createDataFrame([(1,), (2,), (None,), (9,)], "rank long")
    assert tuple(evaluate.recall_mrr(r).first()) == (0.5, 0.375)
    v = spark.createDataFrame([("a", float(i)) for i in range(12)], "k string, v double")
    assert tuple(evaluate.latency_percentiles(v, "v", "k").first()) == ("a", 5.5, 10.0)


def test_gates(spark):
    d = spark.createDataFrame([(1, "v", "active", 11), (2, "v", "deleted", 21)], "document_id long, vault_id string, lifecycle string, current_version_id long")
    v = spark.createDataFrame([(1, 11, "ready"), (1, 10, "ready"), (2, 21, "ready")], "document_id long, version_id long, status string")
    c = spark.createDataFrame([(100, 11), (101, 10), (200, 21)], "chunk_id long, version_id long")
    assert rows(gates.current_chunks(c, d, v).select("chunk_id")) == [(100,)]
    assert gates.current_chunks(c, d, v, vault="w").count() == 0


def test_vault_files(spark, tmp_path):
    (tmp_path / "a/.obsidian").mkdir(parents=True)
    for name, data in {"a/x.md": "﻿Árvíz".encode(), "y.md": b"\xff\xfe", "z.txt": b"z", "a/.obsidian/n.md": b"n"}.items():
        (tmp_path / name).write_bytes(data)
    got = vault.decode_notes(vault.scan_vault(spark, str(tmp_path), exclude=("**/.obsidian",)))
    assert rows(got.select("relative_path", "text", "error")) == [("a/x.md", "Árvíz", None), ("y.md", None, "invalid_utf8")]
    with pytest.raises(PermissionError):
        vault.scan_vault(spark, str(tmp_path), allowed_roots=("/elsewhere",))


def test_provider_contract(spark):
    c = spark.createDataFrame([(i, f"w{i} cmts") for i in range(40)], "chunk_id long, text string")
    got = providers.embed_chunks(c, providers.hashed_embedding(8))
    assert got.count() == 40 and all(len(r.embedding) == 8 for r in got.collect())


def test_stream_windows(spark, tmp_path):
    from loomdex.streaming import windows

    src = spark.createDataFrame([(1, "2024-01-01 00:10:00", "view", 1.0), (1, "2024-01-01 00:50:00", "view", 2.0), (2, "2024-01-01 01:10:00", "click", 3.0)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    q = windows.tumbling_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("w").select("event_type", "n", "value")) == rows(windows.tumbling_counts(src).select("event_type", "n", "value")) == [("click", 1, 3.0), ("view", 2, 3.0)]


def test_registry_has_columns(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "score", "keyword_rank", "semantic_rank"]


def test_quotes_are_brute_force(spark):
    import random

    r = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(60)] + [None, "", "a\nb c  tail of some words here"]
    quotes = [t[a : a + r.randint(1, 60)] for t in texts[:60] for a in [r.randint(0, 40)]] + ["", None, "w1", "b c  tail of some words", "not in any of the texts at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(quotes)), "q long, quote string")
    got = rows(extract.find_quotes(docs, asked, "doc_id", "text", "q", "quote"))
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, q in enumerate(quotes) if t and q and q in t)


def test_clusters_of_chains_and_hubs(spark):
    links = [("b", f"c{i}", f"k{i}") for i in range(30)] + [("b", f"c{i + 1}", f"k{i}") for i in range(30)] + [("b", f"h{i}", "hub") for i in range(40)] + [("o", "c0", "k0"), ("b", "lone", None)]
    got = {}
    for r in extract._clusters(spark.createDataFrame(links, "block string, candidate_id string, key string")).collect():
        got.setdefault(r.cluster, set()).add((r.block, r.candidate_id))
    assert sorted(map(len, got.values())) == [1, 1, 31, 40]


def test_postings_give_the_same_hits(spark, tmp_path):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(["apple Pie pie", "pie", "", "the and", "pear-apple"])], "chunk_id long, text string")
    postings.write_postings(chunks, str(tmp_path / "p"), 4)
    index = postings.Postings(spark, str(tmp_path / "p"), 4)
    for query in ("pie and apple", "the", "nothing", "?"):
        want = [tuple(x) for x in search.keyword_topk(chunks, query, 3).collect()]
        assert [tuple(x) for x in index.topk(query, 3).collect()] == want


def test_a_worker_runs_one_job(spark):
    now = datetime(2024, 1, 1, 12)
    cols = "job_id long, kind string, status string, attempts long, priority long, next_attempt_at timestamp, lease_expires_at timestamp, created_at timestamp, worker string"
    rows_ = [(1, "scan", "queued", 0, 1, None, None, now, None), (2, "scan", "queued", 4, 5, None, None, now, None), (3, "scan", "running", 1, 9, None, now + timedelta(hours=1), now, "w")]
    jobs, seen = spark.createDataFrame(rows_, cols), []
    log = state.run_once(jobs, now, {"scan": lambda j: seen.append(j.job_id)}, "w")
    assert seen == [2] and [r.status for r in log] == ["running", "succeeded"] and log[0].attempts == 5

    def broken(job):
        raise OSError

    first = jobs.where("job_id = 1")
    again = state.run_once(first, now, {"scan": broken}, "w")[1]
    assert (again.status, again.error, again.next_attempt_at) == ("queued", "OSError", now + timedelta(seconds=2))
    assert state.run_once(jobs.where("job_id = 2"), now, {}, "w")[1].status == "failed" and state.run_once(jobs.where("job_id = 3"), now, {}, "w") == []
    assert {r.job_id: r.lease_expires_at for r in state.heartbeat(jobs, "w", F.lit(now)).collect()}[3] == now + timedelta(seconds=60)
    gone = state.cancel(jobs.withColumn("status", F.when(F.col("job_id") == 1, "succeeded").otherwise(F.col("status"))), spark.createDataFrame([(1,), (3,), (9,)], "job_id long"))
    assert {r.job_id: r.status for r in gone.collect()} == {1: "succeeded", 2: "queued", 3: "cancelled"}


def test_probe():
    assert providers.probe(providers.hashed_embedding(8)) == {"healthy": True, "dimension": 8, "error": None}
    assert providers.probe(providers.hashed_embedding(8), 16)["error"] == "other_dimension" and providers.probe(lambda t: 1 / 0)["error"] == "ZeroDivisionError"


def test_snapshots_have_a_most(spark):
    with pytest.raises(ValueError, match="more than 3 objects"):
        graph.canonical_hash(spark.range(2), spark.range(2), 3)


def test_line_spans_of_repeated_ids_and_many_lines(spark):
    texts = ["a\nbb\n", "", "\n".join("x" * (i % 7) for i in range(2000))]
    docs = spark.createDataFrame([(1, t) for t in texts] + [(2, None)], "doc_id long, text string")
    want = sorted((1, i, sum(len(x) + 1 for x in t.split("\n")[:i]), x) for t in texts for i, x in enumerate(t.split("\n")))
    got = chunk.line_spans(docs)
    assert sorted((r.doc_id, r.pos, r.char_start, r.line) for r in got.collect()) == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_case_checks(spark):
    rows_ = [("graph", "graph", ["a"], ["b", "a"], ["CMTS uses"], ["The cmts uses it"], 2, 2, 2, []), ("graph", "hybrid", ["a"], ["b", "c", "a"], None, [], 3, 2, 2, ["w"])]
    df = spark.createDataFrame(rows_, "expected_type string, got_type string, expected_sources array<string>, got_sources array<string>, expected_claims array<string>, got_claims array<string>, expected_hops int, got_hops int, limit int, warnings array<string>")
    got = answers.case_checks(df).first().asDict()
    assert got == {"query_type": 0.5, "sources": 1.0, "claims": 1.0, "hops": 0.5, "rank": 0.5, "no_warnings": 0.5, "accepted": 0.5}


def test_versions_are_stored_by_bucket(spark, tmp_path):
    path = str(tmp_path / "versions")
    make = lambda ids, v: spark.createDataFrame([(i, f"{v}{n}") for i in ids for n in range(2)], "document_id long, chunk string")
    writers.store_versions(spark, make(range(40), "a"), path, buckets=4)
    for _ in range(2):  # a retry changes nothing
        writers.store_versions(spark, make([3, 99], "b"), path, buckets=4)
        want = sorted((i, f"{'b' if i in (3, 99) else 'a'}{n}") for i in [*range(40), 99] for n in range(2))
        assert rows(spark.read.parquet(path).select("document_id", "chunk")) == want
    assert len(list((tmp_path / "versions").glob("bucket=*"))) <= 4
    writers.switch_alias(spark, "current_versions", path)
    assert spark.table("current_versions").count() == 82


def test_fences_and_front_matter():
    flags = lambda t: [e.kind for e in parse.parse(t) if e.element == "flag"]
    assert flags("```py") == [] and flags("x\n\n~~~") == [] and flags("```py\nx") == ["unclosed_fence"]
    for front, want in (("2024-01-02: 2024-01-02\n3: {true: [1, 2.5, null]}", {"2024-01-02": "2024-01-02", "3": {"True": [1, 2.5, None]}}), ("a: 2024-01-02T03:04:05Z", {"a": "2024-01-02T03:04:05+00:00"})):
        note = parse.Note(f"---\n{front}\n---\nx")
        parse.front_matter(note)
        assert note.front == want and note.flags == []
    for front in ("a: !!set {x, y}", "a: !!binary aGk=", "- a", "a: [", "a: !!python/object:x y"):
        assert flags(f"---\n{front}\n---\nx") == ["frontmatter_invalid"]


def test_corpora_and_limits(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"query": "a", "limit": 3},\n {"query": "b", "limit": null}]')
    assert rows(vault.json_corpus(spark, str(tmp_path / "c.json")).select("query", "limit")) == [("a", 3), ("b", None)]
    assert answers.limited(spark.range(9), 5).first()[:] == (True, 5) and answers.limited(spark.range(5), 5).first()[:] == (False, 5)


def test_what_must_be_parsed(spark):
    states = lambda data: spark.createDataFrame(data, "key string, document_id string, hash string, lifecycle string")
    before = states([("a", "1", "h", "active"), ("b", "2", "h", "error"), ("c", "3", "h", "active"), ("d", "4", "h", "active")])
    after = states([("a", "1", "h", "active"), ("b", "2", "h", "active"), ("c", "3", "new", "active"), ("d", "4", "h", "deleted"), ("e", "5", "x", "active")])
    assert sorted(r.key for r in scan.to_parse(before, after).collect()) == ["b", "c", "e"]


def test_names_in_built_ins_and_beyond(spark):
    import unicodedata

    names = [" A  b\tC ", "\x1cx\x1fy", "Straße  X", "ﬁ Ａ", "İ", "", None, "plain"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in df.select(text.normal_name(F.col("n")), text.nfkc(F.col("n"))).collect()]
    assert got == [(None, None) if n is None else (" ".join(unicodedata.normalize("NFKC", n).casefold().split()), unicodedata.normalize("NFKC", n)) for n in names]
    ips = {"10.0.0.1": "10.0.0.1", "01.2.3.4": None, "256.1.1.1": None, "2001:DB8:0:0::1": "2001:db8::1", "x": None, "1.2.3.4\n": None}
    df = spark.createDataFrame([(i,) for i in ips], "i string")
    assert [r[0] for r in df.select(text.compressed_address(F.col("i"))).collect()] == list(ips.values())
