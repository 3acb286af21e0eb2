"""Production queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

def tokenizer(name: str) -> str:
    """Path of a public vocabulary file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


SQL: dict[str, str] = {}


# The rules of the production query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _op1_sql() -> str:
    def case(then: int) -> str:
        ordered = sorted(URL_RULES, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1]))
        fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{(v, f'{h}/{p}')[then]}'" for v, (h, _, p) in ((v, r.partition("/")) for v, r in ordered)]
        return "CASE " + " ".join(fits) + " END"

    strength = lambda rows: f"""(SELECT (1 - rho) / rho FROM (SELECT CASE WHEN sum((n - 1) * up * (1 - up)) > 0  -- noqa: E731
        THEN least(0.99, greatest(0.01, (sum(n * (bad / n - up) * (bad / n - up)) - sum(up * (1 - up))) / sum((n - 1) * up * (1 - up)))) ELSE 0.5 END AS rho FROM {rows} WHERE n > 0))""".replace("  -- noqa: E731", "")
    from .url_filter import SUFFIXES, Z

    return f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        r AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
        o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
        h AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM r LEFT JOIN o USING (page_id) GROUP BY host),
        a AS (SELECT *, regexp_matches(name, '^\\d+([.]\\d+){{3}}$|^\\[') AS address, string_split(name, '.') AS parts FROM h),
        p AS (SELECT *, array_to_string(parts[-2:], '.') IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) AS two FROM a),
        l AS (SELECT host, n, bad, CASE WHEN address THEN name WHEN two THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
            CASE WHEN address THEN '' WHEN two THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix FROM p),
        z AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS base FROM l),
        d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM l GROUP BY ALL),
        su AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(base) AS up FROM d, z GROUP BY suffix),
        t AS (SELECT suffix, (bad + k * up) / (n + k) AS mean FROM su, (SELECT {strength("su")} AS k)),
        du AS (SELECT d.*, t.mean AS up FROM d JOIN t USING (suffix)),
        dm AS (SELECT domain, suffix, (bad + k * up) / (n + k) AS mean FROM du, (SELECT {strength("du")} AS k)),
        lu AS (SELECT l.host, l.n, l.bad, dm.mean AS up FROM l JOIN dm USING (domain, suffix)),
        lm AS (SELECT host, n, k, (bad + k * up) / (n + k) AS mean FROM lu, (SELECT {strength("lu")} AS k)),
        b AS (SELECT host, mean - {Z} * sqrt(mean * (1 - mean) / (n + k + 1)) AS lower FROM lm)
        SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(0)}, CASE WHEN lower > base THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN b USING (host), z"""


SQL["op1_url_filter"] = _op1_sql()


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SQL["op2_ngram_join"] = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
    steps AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, steps.b FROM r JOIN steps ON steps.a = r.b),
    same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list(g ORDER BY g)) AS class_id FROM s GROUP BY doc_id)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(same.class_id, w.doc_id) AS class_id, m.component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN same USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)"""

SQL["op3_substring_dedup"] = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    h AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(w[i:i + 34], ' ')) END AS h FROM x),
    d AS (SELECT doc_id, i, word, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS again FROM h),
    c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM d),
    k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
    SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    out = pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, scratch, write_token_files

    path = scratch(spark)
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


# Tools of the production query.
CHAT_TOOLS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "convert": {"properties": {"value": {"type": "number"}, "unit": {"type": "string", "enum": ["km", "mi", "kg", "lb"]}}, "required": ["value", "unit"]},
}


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chat

    return format_chat(table(spark, sf_dir, "conversations"), CHAT_TOOLS)


# No text of the table is a tool message, so in SQL every turn is plain; linking is tested on fixtures.
SQL["op7_chat_format"] = """SELECT conv_id, turn, role, turn AS order_turn, CAST(0 AS INTEGER) AS order_step, CAST(0 AS BIGINT) AS n_calls,
    CAST(0 AS BIGINT) AS n_linked, CAST(NULL AS VARCHAR) AS link, '' AS errors,
    CASE WHEN text IS NULL AND role IS NULL THEN '{}' WHEN text IS NULL THEN '{"role":' || to_json(role) || '}'
        WHEN role IS NULL THEN '{"content":' || to_json(text) || '}' ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' END AS message FROM conversations"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    trees = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    return identify(docs.select("doc_id", "text"), trees).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), runs=True)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE_RULES, find_secrets, spans_text

    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in BASE_RULES]
    base = spans_text(F.filter("spans", lambda s: s["kind"].isin(*BASE_RULES)))
    return out.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _op10_sql() -> str:
    from .secrets import BASE_RULES, RULES

    def spans(nth: int, kind: str, pattern: str, group: int, least: int) -> str:
        quoted = pattern.replace("'", "''")
        part = lambda i: f"regexp_extract_all(t, '(?s:(.*?))({quoted})', {i})"
        start = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0)"
        return f"""SELECT doc_id, {nth} AS nth, '{kind}' AS kind, unnest(list_transform(range(1, len(h) + 1), lambda i:
            {{'s': {start}, 'n': length(h[i]), 'v': length(v[i])}}), recursive := true) FROM (
            SELECT doc_id, {part(1)} AS g, {part(2)} AS h, {part(2 + group)} AS v FROM d WHERE regexp_matches(t, '{quoted}'))"""

    found = " UNION ALL ".join(f"SELECT * FROM ({spans(nth, kind, p, group, least)}) WHERE v >= {least}" for nth, (kind, (p, group, least)) in enumerate(RULES.items()))
    base = ", ".join(f"'{k}'" for k in BASE_RULES)
    one = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
        a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_RULES)},
            string_agg({one}, ',' ORDER BY s, nth) FILTER (kind IN ({base})) AS base, string_agg({one}, ',' ORDER BY s, nth) AS spans FROM f GROUP BY doc_id)
        SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN a USING (doc_id)"""


SQL["op10_secret_scan"] = _op10_sql()


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._common import settle
    from .spelling import observed_words, variant_groups, word_counts

    return variant_groups(settle(word_counts(observed_words(table(spark, sf_dir, "documents")))))


# The CRC-32 is folded over bytes by a table made of its polynomial; near words meet where one
# lacks the code point at i: two lack the same, or one is what the other lacks i of.
SQL["op12_spelling_variants"] = """WITH RECURSIVE bits AS (SELECT b, 0 AS k, b AS c FROM range(256) t(b)
        UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
    runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
    hexed AS (SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
    hashed AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) AS h FROM hexed, crc),
    seen AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
    w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM seen WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
    lack AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
    pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM lack a JOIN lack b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM lack a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM lack a JOIN w b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN (SELECT min(near) FROM pairs p WHERE p.word = w.word AND p.near_n = top) END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM w LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.next)
    SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import fill_in_middle, restore

    out = restore(fill_in_middle(table(spark, sf_dir, "documents"), rate=50, spm=80, seed=42))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL["op13_fill_in_middle"] = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS x FROM documents),
    h AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_ngram_join, op3_substring_dedup, op4_nearest, op5_packing, op6_token_files, op7_chat_format, op8_language_id, op9_decontamination, op10_secret_scan, op11_token_counts, op12_spelling_variants, op13_fill_in_middle, pipeline)}
