"""URLs, neighbours, chats and the pipeline."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomdex.llm import ann, chat, queries, url_filter

from . import cases

URLS = [None, "", "no scheme", "http://EXAMPLE.org", "http://example.org/es/x?q", "https://a.example.org/en/17#t", "http://x.com/fr/1", "http://x.com/de/1", "ftp://b.com/de?x", "http://notexample.org/es/", "a://b://c.com/fr/", "http://É.com/DE/", "http://h.net?x/fr/", "http://u:p@k.net:80/z"]


def judge(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for _, r in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, "http://x.com/fr/2", None), (3, URLS[3], "y")], "page_id long, url string, bad string")
    outcomes = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (13, None), (12, 1)], "page_id long, bad int")
    got = url_filter.filter_urls(pages, outcomes, queries.URL_RULES).collect()
    assert len(got) == pages.count()
    verdicts = {r: v for v, r in queries.URL_RULES}
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule) == judge(URLS[r.page_id])
        assert r.verdict == verdicts[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert url_filter.filter_urls(pages.limit(0), outcomes, queries.URL_RULES).count() == 0
    assert url_filter.filter_urls(pages, outcomes.limit(0), []).where("verdict = 'block'").count() == 0


def test_reputation_shrinks_to_the_domain(spark):
    bad = [(f"h{i}.bad.net", 20, 19) for i in range(10)] + [(f"h{i}.good.org", 20, 0) for i in range(10)] + [("new.bad.net", 0, 0), ("new.good.org", 0, 0), ("one.good.org", 1, 1)]
    got = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(bad, "host string, n long, bad long")).collect()}
    assert got["new.bad.net"].mean > 0.7 and got["new.good.org"].mean < 0.1 and got["one.good.org"].lower < 0.4
    assert got["h1.bad.net"].lower > got["new.bad.net"].lower


def test_levels(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.example.com:80": ("example.com", "com"), "u@10.0.0.1:8080": ("10.0.0.1", ""), "[::1]:80": ("[::1]", ""), "localhost": ("localhost", "localhost"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r.host: (r.d, r.s) for r in df.select("host", *(c.alias(n) for c, n in zip(url_filter.levels(F.col("host")), "ds"))).collect()} == hosts


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_reputation_decides_both_ways(spark, table):
    got = {r.verdict for r in queries.op1_url_filter(spark, f"/root/testdata/{table}").where("rule IS NULL").select("verdict").distinct().collect()}
    assert got == {"allow", "block"}


def test_thousands_of_rules(spark):
    rules = [("block", f"h{i}.net/") for i in range(3000)]
    pages = spark.createDataFrame([(1, "http://a.h2999.net/x"), (2, "http://h3000.net/")], "page_id long, url string")
    which, verdict = url_filter.match_rule(url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url")), rules)
    assert [tuple(r) for r in pages.select("page_id", which.alias("r"), verdict.alias("v")).orderBy("page_id").collect()] == [(1, "h2999.net/", "block"), (2, None, None)]


def test_neighbours(spark):
    r = np.random.RandomState(0)
    x = r.randn(600, 16)
    x[100:250] = x[100]  # a vector that many rows share
    rows = [(i, [float(v) for v in y], "e") for i, y in enumerate(x)] + [(1000, None, ""), (1020, [0.0] * 16, ""), (1040, [float("nan")] * 16, ""), (1060, [None] + [1.0] * 15, ""), (1080, [1.0], ""), (None, [1.0] * 16, "")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string")
    got = {}
    for row in ann.nearest(v, v.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    assert set(got) == set(range(0, 600, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda f: (-f[1], f[0]))
        s = x @ x[q]
        best = [j for j in np.lexsort((np.arange(600), -s.round(9))) if j != q][:20]
        hit += len(set(best) & {f[1] for f in found})
        assert all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
    assert hit >= 0.9 * 20 * len(got)
    few = v.where("vec_id < 5 OR vec_id = 1000")
    assert ann.nearest(few, few.where("vec_id = 0"), 20).count() == 4
    assert ann.nearest(few.limit(0), few, 20).count() == 0


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, table):
    v = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in v], float), np.array([r.vec_id for r in v])
    got = {}
    for r in queries.op4_nearest(spark, f"/root/testdata/{table}").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[ids[i]] & set(ids[[j for j in np.lexsort((ids, -(x @ x[i]))) if j != i][:20]])) / 20 for i in np.flatnonzero(ids % 20 == 0)]
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize(("n", "seed"), [(600, 0), (2001, 1), (3700, 2), (3700, 3), (5000, 4), (10_000, 5), (50_000, 6)])
def test_recall_by_size(spark, n, seed):
    """``nearest`` itself on unit vectors that point everywhere, which is the hardest case for lists."""
    x = np.random.RandomState(seed).randn(n, 64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float64()))}))
    asked = np.arange(0, n, max(20, n // 200 // 20 * 20))
    got = {}
    for r in ann.nearest(v, v.where(F.col("vec_id").isin(asked.tolist())), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-s, axis=1, kind="stable")[:, :20]
    recall = np.mean([len(got[q] & set(b.tolist())) / 20 for q, b in zip(asked.tolist(), best)])
    print(n, seed, round(recall, 4))
    assert recall >= 0.9


def test_clusters_need_few_lists():
    r = np.random.RandomState(0)
    x = (r.randn(40, 32)[r.randint(40, size=4000)] * 4 + r.randn(4000, 32) * 0.3).astype(float)
    index = ann.Index(x, 63)
    assert index.probes(x, 20, 0.95) < 20


TOOLS = {"search": {"properties": {"q": {"type": "string"}, "n": {"type": "integer"}, "m": {"type": "string", "enum": ["a", "b"]}}, "required": ["q"]}}


def test_chat(spark):
    call = json.dumps({"content": "hm", "tool_calls": [{"id": "c1", "name": "search", "arguments": {"q": "x", "n": 3}}, {"id": "c2", "name": "search", "arguments": {"n": "many", "z": 1, "m": "c"}}, {"id": "c3", "name": "fly", "arguments": {}}]})
    rows = [
        (1, 0, "user", 'say "hi"'), (1, 1, "tool", json.dumps({"tool_call_id": "c1", "content": "early"})), (1, 2, "assistant", call), (1, 3, "tool", json.dumps({"tool_call_id": "c2", "content": "late"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "c9", "content": "?"})), (2, 0, "tool", json.dumps({"tool_call_id": "c1", "content": "other conversation"})),
        (3, 0, None, None), (None, None, "user", ""), (4, 0, "user", '{"tool_calls": broken'), (4, 0, "user", '{"tool_calls": broken'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("call_id", F.lit("x"))
    got = chat.format_chat(df, TOOLS).collect()
    assert len(got) == len(rows)
    first = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_step, r.turn))
    assert [r.turn for r in first] == [0, 2, 1, 3, 4]
    made = first[1]
    assert (made.n_calls, made.n_linked) == (3, 2)
    assert made.errors == "c2:enum:m,c2:missing:q,c2:type:n,c2:unknown:z,c3:unknown_tool"
    assert [r.link for r in first] == [None, None, "linked", "linked", "orphan"]
    assert [r.link for r in got if r.conv_id == 2] == ["orphan"]
    assert first[0].message == '{"content":"say \\"hi\\"","role":"user"}'
    assert json.loads(made.message)["tool_calls"][0] == {"arguments": {"n": 3, "q": "x"}, "id": "c1", "name": "search"}
    assert {r.message for r in got if r.conv_id == 3} == {"{}"}
    assert chat.format_chat(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "packing"]
    item = "what is the shortest way from the old harbour to the northern gate of the walled city on foot"
    rows = cases.documents() + [(500, "leak " + item, "en", "s", 1), (501, "key token = abcdefabcdefabcd ok", "en", "s", 1)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = cases.frame(spark, rows)
    columns = docs.columns
    kept = P.language(spark, docs, str(tmp_path))
    assert kept.columns == columns and sorted(map(str, [r[0] for r in kept.collect()])) == sorted(str(r[0]) for r in rows if any(map(str.isalpha, r[1] or "")))
    near = P.near_duplicates(spark, docs, str(tmp_path))
    ids = [r.doc_id for r in near.collect()]
    want = {i for i, _, c in cases.components([r for r in rows if r[0] is not None], 5, 80) if c == i}
    assert near.columns == columns and sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    clean = P.decontaminate(spark, docs, str(tmp_path))
    assert clean.columns == columns and clean.count() == len(rows) - 1 and clean.where("doc_id = 500").count() == 0
    safe = P.secrets(spark, docs, str(tmp_path))
    assert safe.columns == columns and safe.count() == len(rows)
    r = safe.where("doc_id = 501").first()
    assert r.text == "key [SECRET] ok" and r.n_chars == len(r.text)
    for stage in (P.language, P.near_duplicates, P.decontaminate, P.secrets, P.pack):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_run(spark):
    from corpus_pipeline import run

    got = run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "sequence_id"} <= set(got.columns) and got.count() > 100
