"""Secret scans by a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: which trigrams any
match must hold. ``trigram_index`` inverts the texts: a table of postings (trigram, row) for
the trigrams that the rules ask for. ``candidates`` intersects the lists that a rule's query
names, row by row, without reading a text again; only candidates are verified by their rule.
A rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

import re
from re import _parser as regex_parser  # the standard library's parse tree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import starts
from ._common import settle

# The base rules, by kind in the order in which spans of one start are listed.
# (regular expression, group that must be long, its least length)
BASE_RULES = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
# Further rules of this operator.
MORE_RULES = {
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}", 0, 1),
}
RULES = BASE_RULES | MORE_RULES
_MOST = 32  # strings that a stretch of a pattern is spelled out to

Query = frozenset  # of frozensets of trigrams: any of these sets must be held whole; empty: no demand


def _and(a: Query, b: Query) -> Query:
    if not a or not b:
        return a or b
    return frozenset(x | y for x in a for y in b) if len(a) * len(b) <= _MOST else min(a, b, key=len)


def _of(strings: set[str]) -> Query:
    if not strings or any(len(s) < 3 for s in strings):
        return frozenset()
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(tree) -> tuple[set[str] | None, Query]:
    """The exact strings of a parse tree if they are few, and the query of what it must hold."""
    held: set[str] = {""}  # what may stand directly before the next node
    query: Query = frozenset()
    exact = True
    for op, arg in tree:
        op = str(op)
        inner: set[str] | None = None
        asks: Query = frozenset()
        if op == "LITERAL":
            inner = {chr(arg).lower()}
        elif op == "SUBPATTERN":
            inner, asks = _walk(arg[3])
        elif op == "BRANCH":
            parts = [_walk(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                inner = set().union(*(p[0] for p in parts))
            else:
                queries = [p[1] if p[0] is None else _of(p[0]) for p in parts]
                asks = frozenset().union(*queries) if all(queries) else frozenset()
        elif op == "MAX_REPEAT":
            low, high, body = arg
            once, once_asks = _walk(body)
            if once is not None and high == 1:
                inner = once | {""}
            elif low >= 1:
                asks = once_asks if once is None else _of(once)
        elif op == "IN":
            kinds = {str(k) for k, _ in arg}
            if kinds == {"LITERAL"}:
                inner = {chr(v).lower() for _, v in arg}
        if inner is not None and len(inner) * len(held) <= _MOST:
            held = {a + b for a in held for b in inner}
            continue
        query = _and(query, _of(held))
        query = _and(query, asks if inner is None else _of(inner))
        held, exact = ({""} if inner is None else inner), False
    return (held, query) if exact else (None, _and(query, _of(held)))


def trigram_query(pattern: str) -> list[list[str]]:
    """Trigrams, in lower case, of which one of these lists must be in a text whole; empty: scan."""
    exact, query = _walk(regex_parser.parse(pattern))
    query = _of(exact) if exact is not None else query
    sets = [s for s in query if not any(o < s for o in query)]
    return sorted(sorted(s) for s in sets)


#: Candidate rows that are sent to every task (a row's key and its rules); more are joined by a shuffle.
MOST_BROADCAST = 100_000
_SPANS = "array<struct<start:int,nth:int,kind:string,end:int>>"


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def trigram_index(rows: DataFrame, grams: list[str], key: str, text: str) -> DataFrame:
    """Postings ``gram, key`` of the rows (by their ``key``): in which of them each trigram stands, in lower case.

    Null texts have none. A row key that comes again may come again in a list.
    """
    asked = f"array({', '.join(map(_quoted, grams))})" if grams else "cast(array() as array<string>)"
    held = F.expr(f"element_at(transform(array(lower(`{text}`)), t -> filter({asked}, g -> contains(t, g))), 1)")
    return rows.select(F.col(key).alias("key"), F.explode(held).alias("gram")).select("gram", "key")


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """``key, kinds``: the rules whose query the row's postings fulfil, one of its lists of trigrams being whole."""
    held = index.groupBy("key").agg(F.collect_set("gram").alias("grams"))
    test = lambda grams: f"size(array_except(array({', '.join(map(_quoted, grams))}), grams)) = 0"
    kinds = [f"CASE WHEN {' OR '.join(map(test, query))} THEN {_quoted(kind)} END" for kind, query in queries.items() if query]
    found = F.expr(f"array_compact(array({', '.join(kinds)}))") if kinds else F.array().cast("array<string>")
    return held.select("key", found.alias("kinds")).where("size(kinds) > 0")


def _matches(text: str, kind: str, nth: int, pattern: str, group: int, least: int) -> str:
    """SQL for the kept spans of a rule in a text, by gaps and hits of consecutive matches."""
    whole = re.sub(r"[\\']", lambda m: "\\" + m[0], rf"\G(?s:(.*?))({pattern})")  # \G: no new try behind the last match
    part = lambda i: f"transform(regexp_extract_all({text}, '{whole}', {i}), x -> length(x))"
    tested, size = (f", {part(2 + group)}", "`3`") if group else ("", "hit")
    spans = f"""transform(filter(arrays_zip({starts("zip_with(gap, hit, (x, y) -> x + y)")}, gap, hit{tested}), x -> x.{size} >= {least}),
        x -> named_struct('start', x.`0` + x.gap, 'nth', {nth}, 'kind', '{kind}', 'end', x.`0` + x.gap + x.hit))"""
    return f"flatten(transform(array({part(1)}), gap -> flatten(transform(array({part(2)}), hit -> {spans}))))"


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that none of ``columns`` has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def find_secrets(docs: DataFrame, rules: dict[str, tuple[str, int, int]] = RULES, text_col: str = "text") -> DataFrame:
    """``spans`` behind the columns of ``docs``: an array of (start, nth, kind, end) by start and the rules' order.

    Matches of each rule are leftmost and don't overlap; those whose tested group is too
    short are dropped after matching. Offsets are code points, the end exclusive. Null and
    empty texts have an empty array. Rows stay as they are, repeated ones too; a column
    named ``spans`` is replaced, other names don't matter. An empty table stays empty.

    A row's key is a hash of its columns; rows of one key share their postings, which can
    only add candidates. The postings and the candidates are narrow; candidates are checked
    in size and sent to every task, or joined with the rows by a shuffle of these where
    they are more than ``MOST_BROADCAST``.
    """
    queries = {kind: trigram_query(pattern) for kind, (pattern, _, _) in rules.items()}
    grams = sorted({g for q in queries.values() for s in q for g in s})
    columns = [c for c in docs.columns if c != "spans"]
    key, kinds, text = unused("row_key", docs.columns), unused("row_kinds", docs.columns), unused("row_text", docs.columns)
    hashed = [f.name for f in docs.schema if f.name != "spans" and "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = docs.select(*columns, F.xxhash64(*[F.col(f"`{c}`") for c in hashed]).alias(key))
    wanted = settle(candidates(trigram_index(rows, grams, key, text_col), queries))
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    rows = rows.join(wanted.select(F.col("key").alias(key), F.col("kinds").alias(kinds)), key, "left").withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    found = []
    for nth, (kind, (pattern, group, least)) in enumerate(rules.items()):
        # a run of one class has the same long matches when only long runs are looked for
        if group == 0 and least > 1 and (m := re.fullmatch(r"((?:\w*))(\[[^\]]+\])\+", pattern)):
            pattern = f"{m[1]}{m[2]}{{{least - len(m[1])},}}"
        verify = F.array_contains(kinds, kind) if queries[kind] else F.col(text).rlike(pattern)
        found.append(F.when(verify, F.expr(_matches(f"`{text}`", kind, nth, pattern, group, least))).otherwise(F.expr(f"cast(array() as {_SPANS})")))
    return rows.select(*columns, F.array_sort(F.concat(*found)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, rules: dict[str, tuple[str, int, int]] = RULES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span of its text replaced by ``mark``, overlaps by one."""
    spans = unused("found_spans", docs.columns)
    found = find_secrets(docs.withColumnRenamed("spans", own := unused("own_spans", docs.columns)), rules, text_col).withColumnRenamed("spans", spans)
    done = F.expr(f"""aggregate(`{spans}`, named_struct('at', 0, 'out', ''),
        (s, x) -> if(x.start >= s.at,
            named_struct('at', x.end, 'out', concat(s.out, substring(`{text_col}`, s.at + 1, x.start - s.at), {_quoted(mark)})),
            named_struct('at', greatest(s.at, x.end), 'out', s.out)),
        s -> concat(s.out, substring(`{text_col}`, s.at + 1, length(`{text_col}`) - s.at)))""")
    safe = found.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(F.col(text_col))).withColumnRenamed(own, "spans")
    return safe.select(*[F.col(f"`{c}`") for c in docs.columns])
