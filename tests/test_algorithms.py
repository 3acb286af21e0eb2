"""Graph, postings, resolution, spans, selection, links, cascades, snapshots and streams against brute force."""

import json
import random
import shutil
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from loomdex.functions.text import groups_of
from loomdex.operators import cascade as K
from loomdex.operators import extract, graph, links, postings, scan, search, selection, snapshots, spans, state
from loomdex.operators.lineage import scratch
from loomdex.streaming import leases
from loomdex.streaming import snapshots as stream

# --- postings --------------------------------------------------------------------------


def cover_score(tokens, groups):
    """By looking at every stretch of tokens."""
    named = {t for g in groups for t in g}
    holds = lambda a, b: any(set(g) <= set(tokens[a : b + 1]) for g in groups)
    total = 0.0
    noise = []
    for a in range(len(tokens)):
        for b in range(a, len(tokens)):
            if tokens[a] in named and tokens[b] in named and holds(a, b) and not holds(a + 1, b) and not (b > a and holds(a, b - 1)):
                noise.append(sum(t not in named for t in tokens[a : b + 1]))
    for n in sorted(noise):
        total += 0.1 / (n + 1)
    return total


@pytest.mark.parametrize("first", [32, 1])
def test_covers_and_blocks_are_brute_force(spark, tmp_path, monkeypatch, first):
    monkeypatch.setattr(postings, "FIRST", first)
    r = random.Random(5)
    texts = [" ".join(r.choices(["the", "and", "a", "x", "y", "pie", "tart"], k=r.randint(0, 14))) for _ in range(120)] + [None, "The-AND the"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    postings.write_postings(chunks, str(tmp_path / "p"), 8, F.floor(F.col("chunk_id") / 10))
    index = postings.Postings(spark, str(tmp_path / "p"), 8)
    for query in ("the and", "the and a", "pie or tart", "the or and a", "or", "the the", "or the", "the or"):
        groups = groups_of(query)
        scores = {i: cover_score((t or "").lower().replace("-", " ").split(), groups) for i, t in enumerate(texts)}
        want = sorted(((i, s) for i, s in scores.items() if s), key=lambda x: (-x[1], x[0]))[:7]
        for got in (search.keyword_topk(chunks, query, 7), index.topk(query, 7)):
            got = [tuple(x) for x in got.collect()]
            assert [g[0] for g in got] == [w[0] for w in want], query
            assert all(abs(g[1] - w[1]) < 1e-12 for g, w in zip(got, want))
    assert groups_of("pie or tart") == [["pie"], ["tart"]] and groups_of("the or and a") == [["the"], ["and", "a"]]


def test_a_query_reads_its_own_terms_and_promising_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "FIRST", 1)
    chunks = spark.range(1000).select(F.col("id").alias("chunk_id"), F.expr("if(id = 7, repeat('pie ', 9), concat('pie w', id))").alias("text"))
    postings.write_postings(chunks, str(tmp_path / "p"), 4, F.floor(F.col("chunk_id") / 100))
    index = postings.Postings(spark, str(tmp_path / "p"), 4)
    found = index.topk("pie", 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "block#" in plan and "PushedFilters: [In(term, [pie])" in plan.replace("EqualTo(term,pie)", "In(term, [pie])") or "term" in plan
    assert [tuple(x) for x in found.collect()] == [(7, 0.9)]
    assert {r.block: r.bound for r in index.bounds([["pie"]]).collect()} == {b: 9 if b == 0 else 1 for b in range(10)}
    assert index.bounds([["pie", "w5"]]).count() == 1


@pytest.mark.parametrize("stretch", [1, 5, 1 << 19])
def test_an_index_is_grouped_where_it_is_read(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(postings, "STRETCH", stretch)
    r = random.Random(7)
    texts = [" ".join(r.choices(["the", "and", "x", "pie", "tart"], k=r.randint(0, 9))) for _ in range(40)] + [None, "", "--"]
    chunks = spark.createDataFrame([(f"c{i:02d}", t) for i, t in enumerate(texts)], "chunk_id string, text string").repartition(3)
    block = F.substring("chunk_id", 2, 1).cast("int")
    found = postings.positional(chunks, block)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the test's own
    got = sorted((t, b, i, p) for x in found.collect() for t, b, i, p in zip([x.term] * len(x.ids), [x.block] * len(x.ids), x.ids, x.positions) if x.most >= len(p))
    assert got == sorted((w, int(f"{i:02d}"[0]), f"c{i:02d}", [j for j, v in enumerate((t or "").split()) if v == w]) for i, t in enumerate(texts) for w in set((t or "").replace("--", "").split()))
    postings.write_postings(chunks, str(tmp_path / "p"), 4, block)
    index = postings.Postings(spark, str(tmp_path / "p"), 4)
    for query in ("pie tart", "x", "the and", "the or and"):
        assert [tuple(x) for x in index.topk(query, 9).collect()] == [tuple(x) for x in search.keyword_topk(chunks, query, 9).collect()]


# --- graph -----------------------------------------------------------------------------


def all_trails(edges, start, hops):
    steps = [(s, t, e) for s, t, e in edges] + [(t, s, e) for s, t, e in edges if s != t]
    level, out = [((start,), ())], []
    for _ in range(hops):
        level = [((*n, b), (*es, e)) for n, es in level for a, b, e in steps if a == n[-1] and e not in es]
        out += level
    return out


def edge_frame(spark, edges):
    return spark.createDataFrame([(*e, "USES") for e in edges], "source_id string, target_id string, edge_id string, predicate string")


@pytest.mark.parametrize("seed", range(3))
def test_paths_and_expansion_are_brute_force(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(6)}", f"n{r.randrange(6)}", f"e{i:02d}") for i in range(11)]
    df = edge_frame(spark, edges)
    for target, hops, most in (("n1", 4, 50), ("n1", 3, 2), ("n0", 4, 5), ("n9", 2, 5)):
        want = sorted(((len(e), list(e), list(n)) for n, e in all_trails(edges, "n0", hops) if n[-1] == target))[: most + 1]
        got = [(x.hops, x.edges, x.nodes) for x in graph.bounded_paths(df, "n0", target, hops, most).collect()]
        assert got == want
    seeds = spark.createDataFrame([("n0",), ("n2",)], "id string")
    every = sorted((len(e), list(n), list(e)) for s in ("n0", "n2") for n, e in all_trails(edges, s, 3) if n[-1] != s)
    for most in (1, 7, 40, 10_000):
        assert [(x.hops, x.nodes, x.edges) for x in graph.expand(df, seeds, 3, most).collect()] == every[:most]


def test_a_hub_of_ten_thousand_edges(spark):
    spokes = spark.range(10_000).select(F.lit("hub").alias("source_id"), F.format_string("x%05d", "id").alias("target_id"), F.format_string("e%05d", "id").alias("edge_id"), F.lit("USES").alias("predicate"))
    ends = edge_frame(spark, [("a", "hub", "ea"), ("hub", "b", "eb"), ("x00007", "b", "long")])
    df = spokes.unionByName(ends)
    assert [x.edges for x in graph.bounded_paths(df, "a", "b").collect()] == [["ea", "eb"], ["ea", "e00007", "long"]]
    got = graph.expand(df, spark.createDataFrame([("a",)], "id string"), 4, 40).collect()
    assert [x.nodes[-1] for x in got] == ["hub", "b", *[f"x{i:05d}" for i in range(38)]]


# --- resolution ------------------------------------------------------------------------


def folded(rows):
    known, out = {}, {}
    for seq, name, keys in sorted(rows):
        met = {known[k] for k in keys if k in known}
        out[name] = ("create", name) if not met else ("merge", met.pop()) if len(met) == 1 else ("defer", None)
        if out[name][1]:
            for k in keys:
                known.setdefault(k, out[name][1])
    return out


@pytest.mark.parametrize(("rounds", "most"), [(6, 200_000), (1, 200_000), (1, 0)])
def test_resolution_is_the_fold(spark, monkeypatch, rounds, most):
    monkeypatch.setattr(extract, "ROUNDS", rounds)
    monkeypatch.setattr(extract, "FOLDED", most)
    r = random.Random(rounds)
    rows = [(i % 40, f"c{i:03d}", [f"k{r.randrange(25)}" for _ in range(r.randint(0, 3))]) for i in range(70)]
    df = spark.createDataFrame([("b", *x) for x in rows] + [("other", 0, "o1", ["k1", None])], "block string, seq long, candidate_id string, keys array<string>")
    got = {x.candidate_id: (x.decision, x.entity_id) for x in extract.resolve(df).collect()}
    assert got == folded(rows) | {"o1": ("create", "o1")}
    assert {d for d, _ in got.values()} == {"create", "merge", "defer"}


def test_a_cluster_of_a_hundred_thousand(spark):
    n = 100_000
    own = F.format_string("c%06d", "id")
    keys = F.when(F.col("id") == 1, F.array(F.lit("other"))).when(F.col("id") % 1000 == 999, F.array(F.lit("hot"), F.lit("other"))).otherwise(F.array(F.lit("hot"), F.concat(F.lit("k"), (F.col("id") % 300).cast("string"))))
    df = spark.range(n).select(F.lit("b").alias("block"), F.col("id").alias("seq"), own.alias("candidate_id"), keys.alias("keys"))
    got = {r.decision: (r.n, r.first) for r in extract.resolve(df).groupBy("decision").agg(F.count("*").alias("n"), F.min("entity_id").alias("first")).collect()}
    assert got == {"create": (2, "c000000"), "merge": (n - 102, "c000000"), "defer": (100, None)}


def test_a_long_chain_of_keys(spark):
    rows = [(i, f"c{i:04d}", [f"k{i}", f"k{i + 1}"]) for i in range(400)]
    df = spark.createDataFrame([("b", *x) for x in rows], "block string, seq long, candidate_id string, keys array<string>")
    assert {x.candidate_id: (x.decision, x.entity_id) for x in extract.resolve(df).collect()} == folded(rows)


# --- spans and selection ---------------------------------------------------------------


def test_spans_are_brute_force(spark):
    r = random.Random(2)
    held = [(r.choice("ab"), a, a + r.choice([0, 1, 3, 17, 500, 4000]), f"s{i}", i) for i, a in enumerate(r.randrange(3000) for _ in range(80))] + [("a", None, 3, "null", 99)]
    points = [(r.choice("abc"), r.randrange(4000)) for _ in range(120)] + [(None, 3), ("a", None)]
    p, s = spark.createDataFrame(points, "key string, at long"), spark.createDataFrame(held, "key string, char_start long, char_end long, span string, ordinal long")
    want = sorted((k, x, n) for k, x in points for key, a, b, n, _ in held if k == key and None not in (x, a) and a <= x < b)
    assert sorted(tuple(x) for x in spans.inside(p, s, "key", "at").select("key", "at", "span").collect()) == want
    first = {(k, x): min(((o, n) for key, a, b, n, o in held if k == key and None not in (x, a) and a <= x < b), default=(0, None))[1] for k, x in points}
    got = spans.first_inside(p, s, "key", "at", "span", "ordinal").collect()
    assert len(got) == len(points) and all(first[g.key, g.at] == g.span for g in got)
    inner = spark.createDataFrame([("a", 10, 20, "in"), ("a", 10, 31, "out"), ("b", 5, 6, "in")], "key string, char_start long, char_end long, name string")
    outer = spark.createDataFrame([("a", 5, 30), ("b", 5, 6)], "key string, span_start long, span_end long")
    assert sorted(x.name for x in spans.within(inner, outer, "key").collect()) == ["in", "in"]
    assert spans.inside(p, s.limit(0), "key", "at").count() == 0


def test_a_document_of_many_spans_and_points(spark):
    n = 100_000
    s = spark.range(n).select(F.lit(1).alias("key"), (F.col("id") * 10).alias("char_start"), (F.col("id") * 10 + 10).alias("char_end"), F.col("id").alias("span"))
    p = spark.range(n).select(F.lit(1).alias("key"), (F.col("id") * 10 + 3).alias("at"))
    assert spans.inside(p, s, "key", "at").agg(F.count("*"), F.sum("span")).first()[:] == (n, n * (n - 1) // 2)


@pytest.mark.parametrize("few", [10_000, 5])
def test_ranks_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    r = random.Random(1)
    groups = {"a": [r.gauss(0, 1) for _ in range(900)], "ties": [1.0] * 500 + [2.0] * 400, "one": [5.0], "few": [3.0, 1.0, 2.0], "wide": [10.0**k for k in range(-150, 150)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("none", None)], "k string, v double")
    wanted = [(k, i) for k, vs in groups.items() for i in {0, len(vs) // 3, len(vs) - 1, len(vs) // 2}] + [("one", 1), ("none", 0)]
    got = selection.select_ranks(df, "v", "k", spark.createDataFrame(wanted, "k string, rank long")).collect()
    assert {(x.k, x["rank"]): x.value for x in got} == {(k, i): sorted(groups[k])[i] for k, i in wanted if i < len(groups.get(k, ()))}


# --- links -----------------------------------------------------------------------------


def test_links_find_the_shortest_unique_suffix(spark):
    docs = [(1, "v", "Networks/CMTS.md"), (2, "v", "b/note.md"), (3, "v", "c/note.md"), (4, "v", "index.md"), (5, "v", "c/index.md"), (6, "w", "only.md")]
    made = [
        (1, 4, "wikilink", "cmts", "Setup", "resolved", 1, True), (2, 4, "wikilink", "note", None, "ambiguous", None, None), (3, 4, "wikilink", "c/note", "nope", "resolved", 3, False), (4, 5, "wikilink", "index", None, "resolved", 4, None),
        (5, 4, "wikilink", "only", None, "unresolved", None, None), (6, 3, "markdown", "../b/note.md", None, "resolved", 2, None), (7, 3, "markdown", "note.md", None, "resolved", 3, None), (8, 3, "markdown", "https://x.org", None, "external", None, None),
        (9, 3, "markdown", "/Networks/CMTS.md", None, "resolved", 1, None), (10, 3, "markdown", "CMTS.md", None, "unresolved", None, None), (11, 1, "wikilink", None, "setup ", "resolved", 1, True), (12, 4, "embed", "Networks/CMTS.md", None, "resolved", 1, None), (13, 4, "wikilink", "", None, "unresolved", None, None),
    ]
    d = spark.createDataFrame(docs, "document_id long, vault_id string, path string")
    asked = spark.createDataFrame([m[:5] for m in made], "link_id long, document_id long, kind string, target string, heading string")
    sections = spark.createDataFrame([(1, "Setup"), (1, "Setup"), (3, "Other")], "document_id long, heading string")
    got = links.resolve_links(asked, d, sections)
    assert sorted((x.link_id, x.status, x.target_document_id, x.anchor_found) for x in got.collect()) == [(m[0], *m[5:]) for m in made]
    assert sorted((x.document_id, x.target_document_id) for x in links.links_to(asked, got).collect()) == sorted((m[1], m[6]) for m in made if m[5] == "resolved")
    names = {x.document_id: x.name for x in links.shortest_names(d).collect()}
    assert names == {1: "cmts", 2: "b/note", 3: "c/note", 4: "", 5: "c/index", 6: "only"} or names[4] in ("", None)


# --- cascade ---------------------------------------------------------------------------


def survivors(t, gone):
    """Everything recomputed from what is left."""
    chunks = {c for (c,) in t["chunks"]} - gone
    evidence = {e for e, c in t["evidence"] if c in chunks}
    had = {x for _, x, _ in t["mentions"]}
    live = {x for _, x, e in t["mentions"] if e in evidence}
    entities = {x for (x,) in t["entities"] if x in live or x not in had}
    return {
        "chunks": chunks, "evidence": evidence, "entities": entities, "mentions": {m for m, x, e in t["mentions"] if e in evidence and x in entities}, "aliases": {a for a, x in t["aliases"] if x in entities}, "candidates": {c for c, e in t["candidates"] if e in evidence},
        "assertions": {a for a, s, o, e in t["assertions"] if e in evidence and s in entities and o in entities}, "claims": {c for c, s, e in t["claims"] if e in evidence and (s is None or s in entities)},
    }


@pytest.mark.parametrize("seed", range(3))
def test_a_cascade_is_recomputation(spark, seed):
    r = random.Random(seed)
    n = 40
    x, e = lambda: f"x{r.randrange(15)}", lambda: f"e{r.randrange(60)}"
    t = {
        "chunks": [(f"c{i}",) for i in range(n)], "evidence": [(f"e{i}", f"c{r.randrange(n)}") for i in range(60)], "entities": [(f"x{i}",) for i in range(16)], "mentions": [(f"m{i}", x(), e()) for i in range(40)],
        "aliases": [(f"a{i}", x()) for i in range(20)], "candidates": [(f"k{i}", e()) for i in range(30)], "assertions": [(f"s{i}", x(), x(), e()) for i in range(40)], "claims": [(f"l{i}", r.choice([None, x()]), e()) for i in range(30)],
    }
    columns = {"chunks": "chunk_id", "evidence": "evidence_id, chunk_id", "entities": "entity_id", "mentions": "mention_id, entity_id, evidence_id", "aliases": "alias_id, entity_id", "candidates": "candidate_id, evidence_id", "assertions": "assertion_id, source_id, target_id, evidence_id", "claims": "claim_id, subject_id, evidence_id"}
    tables = {k: spark.createDataFrame(v, ", ".join(f"{c} string" for c in columns[k].split(", "))) for k, v in t.items()}
    supports = K.support(tables["mentions"])
    gone: set[str] = set()
    for _ in range(2):  # a second deletion goes on from what the first left
        now = set(r.sample([c for (c,) in t["chunks"] if c not in gone], 9))
        went, supports = K.cascade(tables, supports, spark.createDataFrame([(c,) for c in now], "chunk_id string"))
        tables = K.remaining(tables, went)
        gone |= now
        assert {k: {y[0] for y in df.select(K.KEYS[k]).collect()} for k, df in tables.items()} == survivors(t, gone)
    assert {y.entity_id: y.n for y in supports.collect()} == {y.entity_id: y.n for y in K.support(tables["mentions"]).collect()}


# --- snapshots -------------------------------------------------------------------------

ODD = 'q"uote \\ slash / \n\t\r\x01\x1f é 😀 \x7f \\u000B'


def test_snapshot_hash_is_the_models(spark):
    nodes = {"Vault": [{"id": "v", "name": ODD, "gks_managed": True, "ordinal": 3, "heading": None, "path": ["a", ODD]}], "Empty": []}
    edges = {"CONTAINS": [{"source_id": "v", "target_id": t, "properties": p} for t, p in (("a", {}), ("b", {"z": "1", "k": ODD}))]}
    schema = {"Vault": "id string, name string, gks_managed boolean, ordinal int, heading string, path array<string>", "Empty": "id string", "CONTAINS": "source_id string, target_id string, properties map<string, string>"}
    frames = lambda sets: {k: spark.createDataFrame([tuple(r.values()) for r in rows], schema[k]) for k, rows in sets.items()}
    text = json.dumps({"nodes": nodes, "relationships": edges}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert tuple(snapshots.snapshot_sha256(frames(nodes), frames(edges)).first()) == (3, sha256(text.encode()).hexdigest())
    with pytest.raises(ValueError, match="more than 2"):
        snapshots.snapshot_sha256(frames(nodes), frames(edges), 2)


def test_snapshot_hash_of_more_objects_than_a_projection_takes(spark):
    nodes = {"Empty": spark.createDataFrame([], "id string"), "N": spark.range(25_000).repartition(7).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"))}
    edges = {"A": spark.range(3).select(F.lit("n1").alias("source_id"), F.col("id").cast("string").alias("target_id")), "B": spark.createDataFrame([], "source_id string, target_id string")}
    want = {"nodes": {"Empty": [], "N": [{"id": x} for x in sorted(f"n{i}" for i in range(25_000))]}, "relationships": {"A": [{"source_id": "n1", "target_id": str(i)} for i in range(3)], "B": []}}
    text = json.dumps(want, sort_keys=True, separators=(",", ":"))
    assert tuple(snapshots.snapshot_sha256(nodes, edges, None).first()) == (25_003, sha256(text.encode()).hexdigest())
    none = {"Empty": nodes["Empty"]}
    assert tuple(snapshots.snapshot_sha256(none, {}).first()) == (0, sha256(b'{"nodes":{"Empty":[]},"relationships":{}}').hexdigest())


def test_the_snapshot_query_takes_any_number_of_suppliers(spark, tmp_path):
    from loomdex.queries import lifecycle

    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(str(tmp_path / "nation.parquet"))
    spark.range(10_001).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name"), (F.col("id") % 25).alias("s_nationkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    assert lifecycle.snapshot_model_hash(spark, str(tmp_path)).first().n_objects == 25 + 2 * 10_001


def test_one_changed_edge_rewrites_one_range(spark, tmp_path):
    make = lambda n, odd: spark.range(n).select(F.lit("r:E").alias("part"), F.col("id").cast("string").alias("id"), F.when(F.col("id") == 5, odd).otherwise("body").alias("body"))
    path = str(tmp_path / "g")
    assert len(snapshots.write_generation(make(2000, "x"), path, 64)) == 64
    assert snapshots.write_generation(make(2000, "x"), path, 64) == []
    assert len(snapshots.write_generation(make(2000, "y"), path, 64)) == 1
    assert len(snapshots.write_generation(make(2001, "y"), path, 64)) == 1
    assert snapshots.read_generation(spark, path).exceptAll(make(2001, "y")).isEmpty() and snapshots.read_generation(spark, path).count() == 2001
    assert snapshots.write_generation(make(3, "y"), path, 64) and snapshots.read_generation(spark, path).count() == 3
    tree = snapshots.leaves(snapshots.placed(make(50, "x")))
    assert snapshots.root(tree).first() == snapshots.root(snapshots.leaves(snapshots.placed(make(50, "x").repartition(7)))).first()


# --- streams ---------------------------------------------------------------------------


def test_scans_as_a_stream_restart(spark, tmp_path):
    scans = [[("a", "h1", False), ("b", "h2", False)], [("c", "h1", False), ("b", "h3", False), ("d", None, True)], [("c", "h1", False)], [("a", "h9", False), ("c", "h1", False), ("b", "h3", False)]]
    at, out, where = (str(tmp_path / x) for x in ("scans", "out", "checkpoint"))
    state_ = spark.createDataFrame([], stream.STATE)
    want = []
    for rows in scans:
        df = spark.createDataFrame(rows, "key string, hash string, failed boolean")
        changes = scan.diff(state_.where("lifecycle <> 'deleted'").select("key", "hash"), df)
        want.append(sorted(map(str, changes.collect())))
        state_ = spark.createDataFrame(scan.apply_changes(state_, changes).collect(), stream.STATE)
    for n, rows in enumerate(scans):
        spark.createDataFrame(rows, "key string, hash string, failed boolean").coalesce(1).write.mode("append").parquet(at)
        if n in (1, 3):
            stream.follow(spark, at, out, where).awaitTermination()
        if n == 1:  # the last batch's commit is lost, so it runs again
            shutil.rmtree(f"{where}/commits/1", ignore_errors=True)
            for f in (tmp_path / "checkpoint" / "commits").glob("*1*"):
                f.unlink()
    got = [sorted(map(str, spark.read.parquet(f"{out}/changes/batch={n}").collect())) for n in range(4)]
    assert got == want
    assert sorted(map(str, spark.read.parquet(f"{out}/states/batch=3").collect())) == sorted(map(str, state_.collect()))


def test_lease_timers_are_the_fold(spark, tmp_path):
    from datetime import datetime, timedelta

    r = random.Random(4)
    t0 = datetime(2024, 1, 1)
    log, n = [], 0
    for hour in range(3):
        for _ in range(40):
            n += 1
            log.append((r.randrange(12), n, t0 + timedelta(hours=hour, minutes=r.randrange(60), seconds=r.randrange(60)), r.choice(["queued", "running", "running", "running", "succeeded"])))
    last = (99, n + 1, t0 + timedelta(hours=9), "queued")  # brings the watermark on
    where, out = str(tmp_path / "log"), str(tmp_path / "out")
    schema = "job_id long, event_id long, ts timestamp, status string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where) if False else None
    parts = [log[:40], log[40:80], log[80:], [last]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(where)
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)
        q = leases.lease_transitions(rows, 3600, 5, "2 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {x.job_id: (x.status, x.attempts) for x in spark.read.parquet(out).groupBy("job_id").agg(F.max_by("status", F.struct("at", "attempts")).alias("status"), F.max("attempts").alias("attempts")).collect()}
    now = F.lit(t0 + timedelta(hours=7))
    want = {x.job_id: (x.status, x.attempts) for x in state.recover(state.job_states(spark.createDataFrame([*log, last], schema)).withColumn("lease_expires_at", F.col("updated_at") + F.expr("INTERVAL 1 HOUR")), now).collect()}
    assert got == want and {s for s, _ in want.values()} >= {"failed", "succeeded"}


# --- the typed graph --------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(2))
def test_typed_graph_is_the_models(spark, seed):
    from loomdex.operators.typed_graph import vault_graph

    r = random.Random(seed)
    pick = lambda p, n: f"{p}{r.randrange(n)}"
    t = {
        "vaults": ("vault_id name", [("v", "Vault"), ("w", "Other")]),
        "documents": ("document_id vault_id path title lifecycle current_version_id", [(f"d{i}", r.choice("vvw"), f"p/{i}.md", r.choice([None, 'T "q"']), r.choice(["active", "active", "deleted"]), f"n{11 - i}") for i in range(12)]),
        "versions": ("version_id document_id status content_sha256 parser_version chunker_version", [(f"n{11 - i}", f"d{i}", r.choice(["ready", "ready", "parsing"]), f"h{i}", "1", "2") for i in range(12)]),
        "sections": ("section_id version_id parent_id heading heading_path heading_level ordinal", [(f"s{i:02d}", pick("n", 12), r.choice([None, pick("s0", 9)]), r.choice([None, "H"]), ["a", f"é{i}"], r.randrange(3), i) for i in range(20)]),
        "chunks": ("chunk_id version_id section_id content_sha256 ordinal char_start char_end", [(f"c{i:02d}", pick("n", 12), pick("s0", 9), f"x{i}", i, i * 10, i * 10 + 9) for i in range(30)]),
        "links": ("link_id version_id link_kind resolution target_document_id", [(f"l{i}", pick("n", 12), "wikilink", r.choice(["resolved", "resolved", "unresolved"]), r.choice([None, pick("d", 12)])) for i in range(9)]),
        "entities": ("entity_id vault_id name normalized_name entity_type entity_subtype scope status", [(f"e{i}", r.choice("vvw"), f"E{i}", f"e{i}", "SYSTEM", r.choice([None, "X"]), "model", r.choice(["active", "active", "superseded"])) for i in range(9)]),
        "mentions": ("mention_id chunk_id entity_id surface_form status", [(f"m{i:02d}", pick("c0", 9), pick("e", 9), "f\n", r.choice(["active", "gone"])) for i in range(25)]),
        "assertions": ("assertion_id source_id target_id predicate assertion_kind review_status network_layer status evidence_id", [(f"a{i:02d}", pick("e", 9), pick("e", 9), "USES", "explicit", "accepted", r.choice([None, "layer_2"]), r.choice(["active", "active", "gone"]), pick("q0", 9)) for i in range(25)]),
        "claims": ("claim_id vault_id text assertion_kind review_status status evidence_id", [(f"k{i:02d}", r.choice("vw"), "c\\", "inferred", "pending", r.choice(["active", "gone"]), pick("q1", 9)) for i in range(15)]),
        "evidence": ("evidence_id chunk_id quote quote_sha256 char_start char_end", [(f"q{i:02d}", pick("c1", 9), "q", "z", i, i + 1) for i in range(20)]),
    }
    kinds = {"heading_path": "array<string>", "heading_level": "int", "ordinal": "int", "char_start": "int", "char_end": "int"}
    frames = {k: spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names.split())) for k, (names, rows) in t.items()}
    data = {k: sorted((dict(zip(names.split(), row)) for row in rows), key=lambda x: list(x.values())[0]) for k, (names, rows) in t.items()}
    docs = [x | {k: v for k, v in y.items() if k not in ("status", "document_id")} for x in data["documents"] for y in data["versions"] if x["vault_id"] == "v" and x["lifecycle"] == "active" and y["version_id"] == x["current_version_id"] and y["status"] == "ready"]
    ids, live = {x["document_id"] for x in docs}, {x["version_id"]: x["document_id"] for x in docs}
    secs, parts = ([x for x in data[k] if x["version_id"] in live] for k in ("sections", "chunks"))
    held = {x["chunk_id"] for x in parts}
    ents = [x for x in data["entities"] if x["vault_id"] == "v" and x["status"] == "active"]
    known = {x["entity_id"] for x in ents}
    ment = [x for x in data["mentions"] if x["status"] == "active" and x["entity_id"] in known and x["chunk_id"] in held]
    asse = [x for x in data["assertions"] if x["status"] == "active" and {x["source_id"], x["target_id"]} <= known]
    clai = [x for x in data["claims"] if x["status"] == "active" and x["vault_id"] == "v"]
    evid = [x for x in data["evidence"] if x["chunk_id"] in held and x["evidence_id"] in {y["evidence_id"] for y in asse + clai}]
    link = [x for x in data["links"] if x["resolution"] == "resolved" and x["version_id"] in live and x["target_document_id"] in ids]
    node = lambda rows, key, *pairs: [{"gks_managed": True, "vault_id": "v", "id": x[key], **{n: x[c] for n, c in (p.split(":") if ":" in p else (p, p) for p in pairs)}} for x in rows]
    edge = lambda rows, a, b, *props: [{"source_id": x[a], "target_id": x[b], "properties": {p: x[p] for p in props}} for x in rows]
    nodes = {
        "Vault": node([{"vault_id": "v", "name": "Vault"}], "vault_id", "name"), "Document": node(docs, "document_id", "relative_path:path", "title", "status:lifecycle"), "DocumentVersion": node(docs, "version_id", "document_id", "content_sha256", "parser_version", "chunker_version"),
        "Section": node(secs, "section_id", "heading", "heading_path", "heading_level", "ordinal"), "Chunk": node(parts, "chunk_id", "section_id", "content_sha256", "ordinal", "char_start", "char_end"), "Entity": node(ents, "entity_id", "canonical_name:name", "normalized_name", "entity_type", "entity_subtype", "scope", "status"),
        "RelationshipAssertion": node(asse, "assertion_id", "predicate", "assertion_kind", "review_status", "network_layer", "status"), "Claim": node(clai, "claim_id", "text", "assertion_kind", "review_status", "status"), "Evidence": node(evid, "evidence_id", "chunk_id", "quote", "quote_sha256", "char_start", "char_end"),
    }
    relationships = {
        "CONTAINS": edge([x | {"v": "v"} for x in docs], "v", "document_id"), "HAS_VERSION": edge(docs, "document_id", "version_id"), "HAS_SECTION": edge(secs, "version_id", "section_id"), "HAS_CHILD": edge([x for x in secs if x["parent_id"]], "parent_id", "section_id"), "HAS_CHUNK": edge(parts, "section_id", "chunk_id"),
        "LINKS_TO": edge([x | {"document_id": live[x["version_id"]]} for x in link], "document_id", "target_document_id", "link_id", "link_kind"), "MENTIONS": edge(ment, "chunk_id", "entity_id", "mention_id", "surface_form"), "SUBJECT": edge(asse, "assertion_id", "source_id"), "OBJECT": edge(asse, "assertion_id", "target_id"),
        "ENTITY_LINK": edge(asse, "source_id", "target_id", "assertion_id", "predicate", "review_status", "assertion_kind"), "ASSERTION_SUPPORTED_BY": edge(asse, "assertion_id", "evidence_id"), "CLAIM_SUPPORTED_BY": edge(clai, "claim_id", "evidence_id"), "LOCATED_IN": edge(evid, "evidence_id", "chunk_id"),
    }
    text = json.dumps({"nodes": nodes, "relationships": relationships}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    got = snapshots.snapshot_sha256(*vault_graph("v", **frames)).first()
    assert (got.n_objects, got.sha256) == (sum(map(len, [*nodes.values(), *relationships.values()])), sha256(text.encode()).hexdigest())
    assert got.n_objects > 40


def test_outbox_marks_the_projection(spark):
    from datetime import datetime, timedelta

    from loomdex.operators import outbox

    now, early = datetime(2024, 1, 2), datetime(2024, 1, 1)
    row = lambda i, status, op, chunk, attempts, lease=None: (i, status, op, 2, chunk, attempts, 3, None, None, lease, early + timedelta(minutes=i), None)
    box = spark.createDataFrame([row(1, "pending", "upsert", "a", 0), row(2, "pending", "delete", "b", 0), row(3, "processing", "upsert", "c", 2, early), row(4, "processing", "upsert", "d", 3, early), row(5, "processing", "upsert", "e", 1, now + timedelta(1)), row(6, "succeeded", "upsert", "f", 1), row(7, "pending", "upsert", "g", 0)], "id long, status string, operation string, generation long, chunk_id string, attempts long, max_attempts long, next_attempt_at timestamp, lease_owner string, lease_expires_at timestamp, created_at timestamp, error string")
    states = spark.createDataFrame([(c, 1, "pending") for c in "abcdefg"], "chunk_id string, generation long, status string")
    swept = outbox.exhaust(box, F.lit(now))
    assert {x.id: x.status for x in swept.collect()}[4] == "failed"
    after, mine = outbox.claim_batch(swept, "w", F.lit(now), 3, 60)
    assert [(x.id, x.attempts, x.lease_owner, x.lease_expires_at) for x in mine.orderBy("id").collect()] == [(1, 1, "w", now + timedelta(0, 60)), (2, 1, "w", now + timedelta(0, 60)), (3, 3, "w", now + timedelta(0, 60))]
    chunks = spark.createDataFrame([("a", "text")], "chunk_id string, text string")
    items = {x.id: (x.text, x.is_current) for x in outbox.work_items(mine, chunks, chunks).collect()}
    assert items == {1: ("text", True), 2: (None, False), 3: (None, False)}
    results = spark.createDataFrame([(1, True, None), (2, False, None), (3, True, "down"), (6, True, "late")], "id long, is_current boolean, error string")
    done, projected = outbox.mark(after, states, results, F.lit(now))
    assert {x.id: (x.status, x.error) for x in done.collect()} == {1: ("succeeded", None), 2: ("succeeded", None), 3: ("failed", "down"), 4: ("failed", "lease_expired"), 5: ("processing", None), 6: ("succeeded", None), 7: ("pending", None)}
    assert {x.chunk_id: (x.generation, x.status) for x in projected.collect() if x.chunk_id in "abc"} == {"a": (2, "current"), "b": (2, "deleted"), "c": (1, "failed")}
