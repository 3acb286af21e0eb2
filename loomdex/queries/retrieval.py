"""Queries: lexical and vector search, fusion, routing, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.ids import upper_letters
from ..operators import postings as P
from ..operators import search as R
from ..operators.lineage import scratch
from ..plans import retrieve
from . import query
from .model import CHUNKS, CURRENT, MODEL, chunks, documents, table, versions
from ..operators import answers, evaluate, gates

QUESTION = "How the thathe or thntion and the tion of le vielle"
WORDS = ["thathe", "thntion", "tion", "of", "vielle"]
_TOKENS = "regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-záéíóöőúüű0-9]+')"
_WORDS = ", ".join(f"'{w}'" for w in WORDS)
_Q = "SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7"


def _question(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 7").select("embedding").first()[0]]


@query(f"""SELECT item_id, list_filter(list_distinct_ordered, lambda t: length(t) > 1 AND t NOT IN ({", ".join(repr(w) for w in text.STOP_WORDS)})) AS terms FROM (
    SELECT item_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS list_distinct_ordered FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark))""")
def query_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.query_terms(F.col("text")).alias("terms"))


_KEYWORD = f"""keyword_m AS (SELECT chunk_id, round(n * 0.1, 6) AS score FROM (SELECT chunk_id, len(list_filter({_TOKENS}, lambda t: t IN ({_WORDS}))) AS n FROM chunks_m) WHERE n > 0 ORDER BY n DESC, chunk_id LIMIT 20)"""


@query(f"WITH {CHUNKS}, {_KEYWORD} SELECT * FROM keyword_m")
def keyword_topk(spark, d):
    return R.keyword_topk(chunks(spark, d), QUESTION, 20).withColumn("score", F.round("score", 6))


_indexes: dict[tuple[str, str], str] = {}


def _index(spark, d):
    """The corpus's positional index, written once a session; a block holds the chunks of 64 documents."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _indexes:
        path = scratch(spark, "postings")
        P.write_postings(chunks(spark, d), path, 64, F.floor(F.col("chunk_id") / 6_400_000))
        _indexes[at] = path
    return P.Postings(spark, _indexes[at], 64)


@query(f"WITH {CHUNKS}, {_KEYWORD} SELECT * FROM keyword_m")
def keyword_from_postings(spark, d):
    return _index(spark, d).topk(QUESTION, 20).withColumn("score", F.round("score", 6))


_COVERS = f"""entries AS (SELECT chunk_id, pos, term FROM (SELECT chunk_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT chunk_id, {_TOKENS} AS t FROM chunks_m)) WHERE term IN ('the', 'and')),
    marked AS (SELECT *, row_number() OVER w AS r, max(CASE WHEN term = 'the' THEN pos END) OVER w AS x, max(CASE WHEN term = 'and' THEN pos END) OVER w AS y FROM entries WINDOW w AS (PARTITION BY chunk_id ORDER BY pos)),
    covers AS (SELECT chunk_id, least(x, y) AS first, min(pos) AS last, min(r) AS r FROM marked WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
    noisy AS (SELECT c.chunk_id, (c.last - c.first) - (c.r - m.r) AS noise FROM covers c JOIN marked m ON m.chunk_id = c.chunk_id AND m.pos = c.first),
    scored AS (SELECT chunk_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_sort(list(noise)), lambda n: 0.1::DOUBLE / (n + 1))), lambda s, x: s + x) AS score FROM noisy GROUP BY 1)"""


@query(f"WITH {CHUNKS}, {_COVERS} SELECT chunk_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, chunk_id LIMIT 10")
def keyword_fallback_and(spark, d):
    return R.keyword_topk(chunks(spark, d), "the and", 10).withColumn("score", F.round("score", 6))


@query(f"WITH {CHUNKS}, {_COVERS} SELECT chunk_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, chunk_id LIMIT 30")
def keyword_covers_from_postings(spark, d):
    return _index(spark, d).topk("the and", 30).withColumn("score", F.round("score", 6))


@query(f"""WITH {CHUNKS}, t AS (SELECT chunk_id, {_TOKENS} AS t FROM chunks_m), f AS (SELECT chunk_id, len(t) AS n, unnest([{_WORDS}]) AS w, t FROM t), c AS (SELECT chunk_id, n, w, len(list_filter(t, lambda x: x = w)) AS f FROM f),
    s AS (SELECT count(*)::DOUBLE AS n_all, avg(len(t)) AS mean FROM t), i AS (SELECT w, ln(1 + (any_value(n_all) - count(*) FILTER (f > 0) + 0.5) / (count(*) FILTER (f > 0) + 0.5)) AS idf FROM c, s GROUP BY w)
    SELECT chunk_id, round(sum(idf * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * n / mean))), 6) AS score FROM c JOIN i USING (w), s GROUP BY 1 HAVING score > 0 ORDER BY sum(idf * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * n / mean))) DESC, chunk_id LIMIT 20""")
def keyword_bm25(spark, d):
    return R.bm25_topk(chunks(spark, d), QUESTION, 20).withColumn("score", F.round("score", 6))


_COSINE = "round(list_cosine_similarity(embedding::DOUBLE[], q), 6)"


@query(f"SELECT vec_id, {_COSINE} AS score FROM embeddings, ({_Q}) ORDER BY score DESC, vec_id LIMIT 25")
def vector_topk(spark, d):
    return R.vector_topk(table(spark, d, "embeddings"), _question(spark, d), 25)


@query(f"SELECT vec_id, {_COSINE} AS score FROM embeddings, ({_Q}) WHERE label IN (1, 3) ORDER BY score DESC, vec_id LIMIT 25")
def vector_topk_filtered(spark, d):
    return R.vector_topk(table(spark, d, "embeddings"), _question(spark, d), 25, where=F.col("label").isin(1, 3))


@query(f"WITH h AS (SELECT vec_id, {_COSINE} AS score FROM embeddings, ({_Q}) ORDER BY score DESC, vec_id LIMIT 40) SELECT vec_id, vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') AS stale FROM h")
def vector_stale(spark, d):
    hits = R.vector_topk(table(spark, d, "embeddings"), _question(spark, d), 40)
    current = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return R.hydrate(hits, current, "vec_id").select("vec_id", "stale")


_TWO = f"""vectors_m AS (SELECT doc_id * 100000 AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings JOIN documents ON doc_id = vec_id),
    semantic_m AS (SELECT chunk_id, round(list_cosine_similarity(v, q), 6) AS score FROM vectors_m, ({_Q}) ORDER BY score DESC, chunk_id LIMIT 50),
    kw AS (SELECT chunk_id, n FROM (SELECT chunk_id, len(list_filter({_TOKENS}, lambda t: t IN ({_WORDS}))) AS n FROM current_m) WHERE n > 0 ORDER BY n DESC, chunk_id LIMIT 50),
    k AS (SELECT chunk_id, row_number() OVER (ORDER BY n DESC, chunk_id) AS r FROM kw),
    sl AS (SELECT s.chunk_id, s.score FROM semantic_m s WHERE chunk_id IN (SELECT chunk_id FROM current_m)), s AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM sl)"""


def _current(spark, d):
    return gates.current_chunks(chunks(spark, d), documents(spark, d), versions(spark, d))


def _vectors(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").join(docs, "vec_id").select((F.col("vec_id") * 100000).alias("chunk_id"), "embedding")


@query(f"""WITH {MODEL}, {CURRENT}, {_TWO} SELECT coalesce(k.chunk_id, s.chunk_id) AS id, round(coalesce(1.0::DOUBLE / (60 + k.r), 0) + coalesce(1.0::DOUBLE / (60 + s.r), 0), 12) AS score, k.r AS keyword_rank, s.r AS semantic_rank
    FROM k FULL JOIN s ON k.chunk_id = s.chunk_id ORDER BY score DESC, id LIMIT 10""")
def hybrid_retrieve(spark, d):
    return retrieve.hybrid(_current(spark, d), _vectors(spark, d), QUESTION, _question(spark, d))


@query(f"""WITH {MODEL}, {CURRENT}, {_TWO}, agreed AS (SELECT chunk_id FROM k WHERE chunk_id IN (SELECT chunk_id FROM sl WHERE score >= 0.85 * (SELECT max(score) FROM sl))), n AS (SELECT count(*) AS n FROM agreed),
    k2 AS (SELECT k.* FROM k, n WHERE n = 0 OR chunk_id IN (SELECT chunk_id FROM agreed)), s2 AS (SELECT s.* FROM s, n WHERE n = 0 OR chunk_id IN (SELECT chunk_id FROM agreed))
    SELECT coalesce(k.chunk_id, s.chunk_id) AS id, round(coalesce(1.0::DOUBLE / (60 + k.r), 0) + coalesce(1.0::DOUBLE / (60 + s.r), 0), 12) AS score, k.r AS keyword_rank, s.r AS semantic_rank
    FROM k2 k FULL JOIN s2 s ON k.chunk_id = s.chunk_id ORDER BY score DESC, id LIMIT 10""")
def consensus_gate(spark, d):
    return retrieve.hybrid(_current(spark, d), _vectors(spark, d), QUESTION, _question(spark, d), gate=True)


_FIVE = """ch AS (SELECT CASE l_linenumber % 5 WHEN 0 THEN 'claim' WHEN 1 THEN 'entity' WHEN 2 THEN 'graph' WHEN 3 THEN 'keyword' ELSE 'semantic' END AS channel, l_partkey AS id, l_orderkey % 97 + 1 AS rank FROM lineitem)"""


@query(f"WITH {_FIVE} SELECT id, round(" + " + ".join(f"coalesce(1.0::DOUBLE / (60 + min(rank) FILTER (channel = '{c}')), 0)" for c in R.CHANNELS) + ", 12) AS score FROM ch GROUP BY id")
def rrf_five_channel(spark, d):
    kind = F.col("l_linenumber") % 5
    channel = F.when(kind == 0, "claim").when(kind == 1, "entity").when(kind == 2, "graph").when(kind == 3, "keyword").otherwise("semantic")
    ranks = table(spark, d, "lineitem").select(channel.alias("channel"), F.col("l_partkey").alias("id"), (F.col("l_orderkey") % 97 + 1).alias("rank"))
    return R.reciprocal_rank_fusion(ranks).select("id", F.round("score", 12).alias("score"))


_ROUTED = """SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'keyword' WHEN 1 THEN 'semantic' ELSE 'hybrid' END AS strategy,
    CASE WHEN conv_id % 3 = 0 THEN string_split(text, ' ')[1] || ' ' || upper(string_split(text, ' ')[2]) ELSE text END AS q FROM conversations WHERE role = 'user'"""


@query(f"""SELECT conv_id, turn, CASE WHEN strategy IN ('keyword', 'semantic') THEN strategy WHEN cue THEN 'graph' WHEN len(t) BETWEEN 1 AND 4 AND special THEN 'entity' ELSE 'hybrid' END AS query_type FROM (
    SELECT *, len(list_filter(t, lambda x: (upper(x) = x AND lower(x) <> x) OR regexp_matches(x, '[0-9]') OR regexp_matches(x, '[_.:/-]'))) > 0 AS special FROM (
    SELECT conv_id, turn, strategy, regexp_extract_all(q, '[0-9A-Za-zÁÉÍÓÖŐÚÜŰáéíóöőúüű_.:/-]+') AS t, {" OR ".join(f"contains(replace(lower(q), 'ß', 'ss'), '{c}')" for c in R.GRAPH_CUES)} AS cue FROM ({_ROUTED})))""")
def planner_route(spark, d):
    words = F.split("text", " ")
    q = F.when(F.col("conv_id") % 3 == 0, F.concat(words[0], F.lit(" "), upper_letters(F.get(words, F.lit(1))))).otherwise(F.col("text"))
    strategy = F.when(F.col("conv_id") % 4 == 0, "keyword").when(F.col("conv_id") % 4 == 1, "semantic").otherwise("hybrid")
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", q.alias("q"), strategy.alias("strategy"))
    return rows.select("conv_id", "turn", R.plan_route(F.col("q"), F.col("strategy")).alias("r")).select("conv_id", "turn", F.col("r.query_type").alias("query_type"))


_SEED = "seeds AS (SELECT chunk_id, section_id, ordinal FROM chunks_m WHERE chunk_id % 1000003 % 41 = 0)"


def _seeds(spark, d):
    return chunks(spark, d).where("chunk_id % 1000003 % 41 = 0")


@query(f"WITH {CHUNKS}, {_SEED} SELECT DISTINCT c.chunk_id FROM chunks_m c JOIN seeds s ON c.section_id = s.section_id AND c.ordinal BETWEEN s.ordinal - 1 AND s.ordinal + 1 WHERE role = 'content_evidence' AND c.chunk_id NOT IN (SELECT chunk_id FROM seeds)")
def section_context(spark, d):
    return R.section_context(_seeds(spark, d), chunks(spark, d)).select("chunk_id")


@query(f"""WITH {CHUNKS}, few AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY section_id, ordinal) AS n FROM chunks_m),
    cum AS (SELECT chunk_id, sum(length(text)) OVER (ORDER BY section_id, ordinal) AS s FROM few WHERE n <= 5) SELECT chunk_id FROM cum WHERE s <= 6000""")
def document_context_budget(spark, d):
    return R.budget(chunks(spark, d), ["section_id", "ordinal"], 6000, 5, "section_id").select("chunk_id")


@query("SELECT page_id FROM pages WHERE regexp_matches(regexp_replace(lower(regexp_extract(url || '/' || CASE page_id % 4 WHEN 0 THEN 'index.md' WHEN 1 THEN 'my-index.md' WHEN 2 THEN 'reindex.md' ELSE 'a_index' END, '[^/]*$')), '[.][^.]*$', ''), '(^|[-_])index$')")
def navigation_documents(spark, d):
    name = F.when(F.col("page_id") % 4 == 0, "index.md").when(F.col("page_id") % 4 == 1, "my-index.md").when(F.col("page_id") % 4 == 2, "reindex.md").otherwise("a_index")
    return table(spark, d, "pages").where(R.is_navigation(F.concat("url", F.lit("/"), name))).select("page_id")


@query(f"""WITH {CHUNKS} SELECT chunk_id AS claim_id, n AS overlap, n / 5.0::DOUBLE AS score FROM (SELECT chunk_id, {" + ".join(f"contains(lower(text), '{w}')::BIGINT" for w in WORDS)} AS n FROM chunks_m) WHERE n >= 2 ORDER BY n DESC, chunk_id LIMIT 30""")
def claim_overlap(spark, d):
    return R.claim_overlap(chunks(spark, d).withColumnRenamed("chunk_id", "claim_id"), WORDS, 30)


@query("""SELECT s_suppkey AS entity_id, s_name AS name, 1.0::DOUBLE AS score FROM (SELECT * FROM supplier WHERE s_name ILIKE '%supplier%' OR s_name ILIKE '%000000001%' ORDER BY s_name, s_suppkey LIMIT 200)
    WHERE len(list_filter(regexp_extract_all(lower(s_name), '[a-z0-9]+'), lambda t: t NOT IN ('supplier', '000000001'))) = 0 ORDER BY s_name, s_suppkey LIMIT 10""")
def entity_seeds(spark, d):
    return R.entity_seeds(table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name")), ["supplier", "000000001"], 10)


@query("SELECT o_orderkey AS item_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey % 3 = 0) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def visibility_closure(spark, d):
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.collect_set("l_partkey").alias("source_ids"))
    return retrieve.visible(items, table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"))).select("item_id")


@query("SELECT count(*) > 50 AS truncated, least(count(*), 50) AS n FROM (SELECT 1 FROM orders WHERE o_totalprice > 200000 LIMIT 51)")
def truncated_flag(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 200000").transform(answers.limited, 50)


# --- evaluation --------------------------------------------------------------------
_RANKS = "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id % 9 + 1 END AS rank FROM labels"


@query(f"SELECT round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 12) AS recall, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END), 12) AS mrr FROM ({_RANKS})")
def recall_mrr(spark, d):
    ranks = table(spark, d, "labels").select(F.when(F.col("doc_id") % 4 != 3, F.col("doc_id") % 9 + 1).alias("rank"))
    return evaluate.recall_mrr(ranks).select(F.round("recall", 12).alias("recall"), F.round("mrr", 12).alias("mrr"))


@query("""SELECT user_id, nullif(list_position(list_filter(p, lambda x, i: list_position(p, x) = i), 'click'), 0)::INTEGER AS rank FROM (SELECT user_id, list(event_type ORDER BY ts, event_id) AS p FROM events GROUP BY 1)""")
def doc_rank(spark, d):
    lists = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("p"))
    return lists.select("user_id", evaluate.document_rank(F.col("p.event_type"), F.lit("click")).cast("int").alias("rank"))


@query("""SELECT event_type, p50, v[round_even((len(v) - 1) * 0.95, 0)::INT + 1] AS p95 FROM (SELECT event_type, median(value) AS p50, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)""")
def latency_percentiles(spark, d):
    return evaluate.latency_percentiles(table(spark, d, "events"), "value", "event_type")


@query("SELECT count(*) FILTER (quality = 1) AS valid, count(*) FILTER (quality = 0) AS invalid, count(*) FILTER (quality = 1)::DOUBLE / count(*) AS rate FROM labels")
def acceptance_rate(spark, d):
    return evaluate.acceptance(table(spark, d, "labels").select(F.when(F.col("quality") == 1, "valid").otherwise("invalid").alias("status")))
