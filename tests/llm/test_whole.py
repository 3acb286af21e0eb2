"""Whole jobs: cases that an operator once did less for."""

import json
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomdex.llm import _tokens, chat, decontamination, packing, queries

from . import cases

MARKED = ["x <|endoftext|> y", "<|endoftext|>", "a<|startoftext|>b", "<|endoftext|>\n<|startoftext|>", "a,<|endoftext|>. B", "one  <|endoftext|>\n\n two", "<|ENDOFTEXT|> <|endoftext|", None, "", "plain, text"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_the_librarys(name):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(queries.tokenizer(name)), _tokens.Encoder.at(queries.tokenizer(name))
    texts = MARKED + [r[1] for r in cases.documents()] + MARKED
    for some in (texts, texts[:1], [None, ""]):
        ids, counts = e.encode(pa.array(some, pa.string()))
        ends = np.cumsum(counts)
        assert [ids[a:b].tolist() for a, b in zip(ends - counts, ends)] == [t.encode(x or "", add_special_tokens=False).ids for x in some]


def test_packing_keeps_added_tokens(spark):
    got = packing.pack_documents(cases.frame(spark, [(1, "x <|endoftext|> y", None, None, None)]), queries.tokenizer("byte_bpe_50k.json")).collect()
    assert [i for r in sorted(got, key=lambda r: r.start) for i in np.frombuffer(r.ids, "<u4")] == [87, 220, 50256, 331, 0]


ITEM = "A train leaves Boston at 60 miles per hour and reaches Chicago after 14 hours so how far did it travel before the driver rested at 60 miles"


def found(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = cases.frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = decontamination.find_contamination(docs, bench, runs=True).collect()
    kept = decontamination.drop_contaminated(docs, bench, runs=True).collect()
    assert {r.doc_id for r in kept} == set(range(len(texts))) - {r.doc_id for r in got}
    return sorted((r.doc_id, r.item_id, r.kind) for r in got)


def test_an_edited_value_leaves_the_rest_of_a_copy(spark):
    torn = ITEM.replace("at 60 miles per", "at 75 miles per")
    merged = ITEM.replace("60", "4").replace("14", "4")
    shape = "the sum of 3 and 5 is 8 and the sum of 5 and 3 is 8 too"
    other = "the sum of 1 and 2 is 3 and the sum of 4 and 7 is 11 too"
    assert found(spark, [ITEM, shape], ["x " + torn, "So: " + merged, other, "nothing like it", None]) == [(0, 0, "template"), (1, 0, "template")]


@pytest.mark.parametrize("seed", range(20))
def test_longest_stretch(seed):
    r = np.random.RandomState(seed)
    n = r.randint(1, 30)
    slots = [(k, 1, int(r.randint(4)), int(r.randint(3))) for k in range(n) if r.rand() < 0.5]
    best = (0, True)
    for a in range(n):
        for b in range(a + 1, n + 1):
            of = [s for s in slots if a <= s[0] < b]
            if len({(i, d) for _, _, i, d in of}) == len({i for _, _, i, _ in of}):
                best = max(best, (b - a, all(i == d for _, _, i, d in of)))
    assert decontamination._longest_stretch(n, slots) == best


def test_names_that_begin_sentences_and_passages_of_slots(spark):
    problem = "Tom has 3 apples. Anna has 5 apples. Tom gives 2 apples to Anna. Tom then buys 4 more. How many apples does Tom have?"
    renamed = problem.replace("Tom", "Bela").replace("Anna", "Eva").replace("3", "7").replace("5", "9").replace("4", "11")
    numbers = "1 1 2 3 5 8 13 21 34 55 89 144 233 377"
    title = "Who Wrote The Novel War And Peace In Russia Before Tolstoy Turned Fifty Years"
    texts = ["Intro. " + renamed, "list: " + numbers + " end", "list: 2 4 6 8 10 12 14 16 18 20 22 24 26 28", "see " + title + " ok", "see Was Wrote By Nobody And Never Read Since Anyone Knew His Name Or Face ok", "x " + problem, "Lisbon was where that long train had come from at 90 miles per hour"]
    inside = "it was said that Boston was where that long train had come from at 60 miles per hour"
    assert found(spark, [problem, numbers, title, inside], texts) == [(0, 0, "template"), (1, 1, "exact"), (3, 2, "exact"), (5, 0, "exact"), (6, 3, "template")]


TOOL = {"t": {"properties": {"s": {"type": "string"}, "i": {"type": "integer"}, "n": {"type": "number"}, "b": {"type": "boolean"}, "o": {"type": "object"}, "a": {"type": "array"}, "e": {"type": "string", "enum": ["k", 2]}}, "required": ["s"]}}


def test_chat_keeps_json_types(spark):
    good = {"s": "5", "i": 3, "n": 2.5, "b": True, "o": {"z": [1, "1"], "y": None}, "a": [], "e": "k"}
    bad = {"s": 5, "i": "5", "n": "2", "b": "true", "o": "{}", "a": "[]", "e": "2"}
    first = {"zeta": {"q": 1}, "content": None, "tool_calls": [{"id": "c1", "name": "t", "type": "function", "arguments": good}, {"id": "c2", "name": "t", "arguments": bad}, {"name": "t", "arguments": {"s": None, "i": 1.5}}]}
    mixed = {"tool_call_id": "c1", "content": "r", "tool_calls": [{"id": "c3", "name": "t", "arguments": {"i": 1}}]}
    twice = '{"tool_calls": [{"id": "c4", "name": "t", "arguments": {"s": "x"}}], "x": {"a": 1, "a": 2}}'
    texts = [json.dumps(first), json.dumps(mixed), json.dumps({"tool_call_id": "c3", "content": [1]}), "plain", twice]
    df = spark.createDataFrame([(1, i, "r", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = sorted(chat.format_chat(df, TOOL).collect(), key=lambda r: r.turn)
    written = lambda m: json.dumps({**m, "role": "r"}, sort_keys=True, separators=(",", ":"))
    assert [r.message for r in got[:4]] == [written(first), written(mixed), written(json.loads(texts[2])), '{"content":"plain","role":"r"}']
    assert got[0].errors == ":no_id,:type:i,:type:s," + ",".join(sorted(["c2:enum:e", *(f"c2:type:{k}" for k in "sinboa")]))
    assert [(r.n_calls, r.n_linked, r.link) for r in got] == [(3, 1, None), (1, 1, "linked"), (0, 0, "linked"), (0, 0, None), (1, 0, None)]
    assert [r.errors for r in got[1:]] == [":mixed,c3:missing:s", "", "", ":unreadable"]
    assert json.loads(got[4].message)["tool_calls"] == [{"id": "c4", "name": "t", "arguments": {"s": "x"}}]


def ordered(rows):
    """{(conv, turn): (order_turn, order_step, n_linked, link, errors)} of unique turns, by plain walks."""
    out = {}
    for conv in {c for c, *_ in rows}:
        own = {t: json.loads(x) for c, t, _, x in rows if c == conv}
        first, results, needs = {}, defaultdict(list), defaultdict(set)
        for t in sorted(own):
            for call in own[t].get("tool_calls", []):
                first.setdefault(call["id"], t)
            if "tool_call_id" in own[t]:
                results[own[t]["tool_call_id"]].append(t)
        for t, m in own.items():
            if m.get("tool_call_id") in first:
                needs[t].add(first[m["tool_call_id"]])
            for v in (v for call in m.get("tool_calls", []) for v in call["arguments"].values()):
                if v in first and first[v] != t:
                    needs[t].update(results.get(v) or [first[v]])
            needs[t].discard(t)

        def place(t, above=()):
            if t in above:
                return None
            found = [place(p, (*above, t)) for p in needs[t]]
            return None if None in found else max([(t, 0), *((a, b + 1) for a, b in found)])

        for t, m in own.items():
            at = place(t)
            link = None if "tool_call_id" not in m else "linked" if m["tool_call_id"] in first else "orphan"
            out[conv, t] = (*(at or (t, 0)), len({c["id"] for c in m.get("tool_calls", [])} & set(results)), link, "" if at else ":cycle")
    return out


def test_chat_links_and_orders_as_plain_walks_do(spark):
    r = np.random.RandomState(1)
    rows = []
    for conv in range(60):
        turns = r.permutation(8)
        for t in range(r.randint(2, 9)):
            pick = lambda: f"c{r.randint(5)}"
            m = {"tool_calls": [{"id": pick(), "name": "f", "arguments": {"x": pick() if r.rand() < 0.5 else "plain", "y": 1}}]} if r.rand() < 0.5 else {"tool_call_id": pick(), "content": "r"}
            rows.append((conv, int(turns[t]), "r", json.dumps(m)))
    want = ordered(rows)
    tool = {"f": {"properties": {"x": {"type": "string"}, "y": {"type": "integer"}}}}
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tool).collect()
    assert {(g.conv_id, g.turn): (g.order_turn, g.order_step, g.n_linked, g.link, g.errors) for g in got} == want and len(got) == len(rows)
    assert {w[4] for w in want.values()} == {"", ":cycle"} and max(w[1] for w in want.values()) > 2


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_is_brute_force(spark, tmp_path, labelled):
    from tokenizers import Tokenizer

    import corpus_pipeline

    item = "what is the shortest way from the old harbour to the northern gate of the walled city on foot"
    key = "key token = abcdefabcdefabcd ok"
    rows = cases.documents() + [(500, "leak " + item, "en", "s", 1), (501, key, "en", "s", 1), (502, "model reads <|endoftext|> here", None, "s", 1), (503, "12 34", "en", "s", 5), (504, "ж", None, "s", 1)]
    rows = [r if labelled else (r[0], r[1], None, *r[3:]) for r in rows]
    cases.frame(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    heads = {i for i, _, c in cases.components([r for r in kept if r[0] is not None], 5, 80) if i == c}
    kept = list({r[0]: r for r in kept if r[0] in heads}.values()) + [r for r in kept if r[0] is None]
    kept = [(i, "key [SECRET] ok" if t == key else t) for i, t, *_ in kept if item not in t]
    tool = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    want = Counter((i, tuple([*tool.encode(t, add_special_tokens=False).ids, 0])) for i, t in kept)
    parts = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        parts[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    got = Counter((i, tuple(x for _, ids in sorted(p) for x in ids)) for i, p in parts.items())
    assert got == want and len(want) > 40
