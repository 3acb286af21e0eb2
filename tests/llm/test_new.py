"""Token counts, spelling variants, fill-in-the-middle."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomdex.llm import fim, queries, spelling, token_count

from . import cases

HARD = ["", None, "a  b", " a", "a ", "a \n b", "it's 'll 's don't", "日本 語\n 中", "a b c   d", "é ñ́ á b", "\n", " ", "a\x1cb c", "x <|endoftext|> y", "<|endoftext|>", "<|endof", "text|> z", "a <|endoftext|>  <|endoftext|>\n", "　a　b 　", "w\u0085 z \u0085q \x1c r", "﻿ a", "z" * 5000, "   x", "q é ½ — 中"]


def rows():
    return [(1000 + i, t, None, None, None) for i, t in enumerate(HARD)] + cases.documents()


@pytest.mark.parametrize("frequent", [token_count.FREQUENT, 20, 0])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("remember", [token_count.REMEMBER, 0])
def test_token_counts_are_the_librarys(spark, monkeypatch, frequent, name, remember):
    from tokenizers import Tokenizer

    if remember == 0:  # a worker that forgets after every run; workers import the module, so its class is what they are sent
        splitter = token_count.Splitter(queries.tokenizer(name))
        monkeypatch.setattr(token_count, "REMEMBER", 0)
        for _ in range(2):
            texts = pa.array([t for _, t, *_ in rows()], pa.string())
            text, token, times = splitter.frequencies(texts)
            got = np.bincount(text, times * np.array([splitter.pieces(t) for t in splitter.names])[token], len(texts)).astype(int)
            tool = Tokenizer.from_file(queries.tokenizer(name))
            assert got.tolist() == [len(tool.encode(x or "", add_special_tokens=False).ids) for x in texts.to_pylist()] and splitter.full
            splitter.forget()
        return
    t = Tokenizer.from_file(queries.tokenizer(name))
    ids = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    want = Counter((i, len((x or "").encode()), ids(x), ids(x) > 100) for i, x, *_ in rows())
    got = token_count.count_tokens(cases.frame(spark, rows()), queries.tokenizer(name), limit=100, frequent=frequent)
    assert Counter(map(tuple, got.collect())) == want and got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {w[3] for w in want} == {True, False}


def test_each_pre_token_is_counted_once(spark):
    words = token_count.dictionary(cases.frame(spark), queries.tokenizer("byte_bpe_50k.json")).collect()
    assert len({w.token for w in words}) == len(words) and max(w.n for w in words) > 100
    assert token_count.count_tokens(cases.frame(spark, []), queries.tokenizer("byte_bpe_50k.json")).count() == 0


def spelled(docs, drop_every=31):
    """{word: n} of documents, by a plain loop."""
    out = Counter()
    for i, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run if h % drop_every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= ratio * n else None, n, len(near))
    result = set()
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result.add((w, form, root, n, k, counts.get(form)))
    return result


def test_observed_words(spark):
    docs = [(1, "Wörterbuch WÖRTERBUCH ÀÉÎ×÷ wörterbuch", None, None, None), (None, "nothing nothing", None, None, None), (2, None, None, None, None), (3, "", None, None, None), *[(i, "spelling-variants of Spelling", None, None, None) for i in range(4, 60)]]
    got = {r.word: r.n for r in spelling.word_counts(spelling.observed_words(cases.frame(spark, docs))).collect()}
    assert got == spelled(docs) and any(len(w) == 7 for w in got)
    assert spelling.word_counts(spelling.observed_words(cases.frame(spark, []))).count() == 0


@pytest.mark.parametrize("limit", [256, 4, 1])
@pytest.mark.parametrize("run", [4 << 20, 500])
def test_variants_are_brute_force(spark, monkeypatch, limit, run):
    monkeypatch.setattr(spelling, "RANGE", limit)
    monkeypatch.setattr(spelling, "RUN", run)
    r = np.random.RandomState(3)
    bases = ["aaaaaaa", "abababab", "programming", "naïveté", "x", "ab", "", "é" * 9, "z" * 300] + ["".join(r.choice(list("abc"), r.randint(7, 10))) for _ in range(25)]
    counts = {}
    for b in bases:
        counts[b] = int(r.choice([2, 20, 200, 2000]))
        for _ in range(8):
            i, c = r.randint(len(b) + 1), r.choice(list("abz"))
            counts.setdefault([b[:i] + c + b[i:], b[:i] + b[i + 1 :], b[:i] + c + b[i + 1 :]][r.randint(3)], int(r.choice([2, 3, 20])))
    counts |= {"abcdefgh": 2000, "abcdefg": 100, "abcdef": 3}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("m", F.lit(1))
    got = spelling.variant_groups(df.select("word", "n"), ratio=10).collect()
    assert len(got) == len(counts) and set(map(tuple, got)) == grouped(counts)
    assert sum(g.form is not None and g.root != g.form for g in got) > 0


def test_a_long_chain_of_forms(spark):
    words = {"a" * (7 + k): 2 * 10**k for k in range(9)}
    got = spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {g.root for g in got} == {"a" * 15} and spelling.variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0


def test_no_range_is_left_long(spark):
    r = np.random.RandomState(0)
    words = {"common" + "".join(r.choice(list("abcdefgh"), 8)) + "ending" for _ in range(3000)}
    sizes = [x["count"] for x in spelling.ranges(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).groupBy(*spelling.KEY).count().collect()]
    assert max(sizes) <= spelling.RANGE


UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def filled(doc_id, text):
    """(id, n, form, prefix characters, middle characters, output) by lists of units."""
    text = text or ""
    u = UNIT.findall(text)
    assert "".join(u) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(u), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [256, 2, 1])
def test_fill_in_middle_by_lists(spark, monkeypatch, size):
    monkeypatch.setattr(fim, "LEAF", size)
    docs = rows() + [(2000 + i, t, None, None, None) for i, t in enumerate(["a <P> b", "x<S>", "<M>", "a<", "<S b M> c", " lead  and trail \n", "　 é　", "<<<>>> < S > P> <P"] * 6)]
    made = fim.fill_in_middle(cases.frame(spark, docs))
    got = fim.restore(made).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter(filled(i, t) for i, t, *_ in docs)
    assert Counter((r.doc_id, r.restored) for r in got) == Counter((i, t or "") for i, t, *_ in docs)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(cases.frame(spark, [])).count() == 0
    clash = made.withColumn("restored", F.lit(1)).withColumn("n", F.lit("x"))
    assert fim.restore(clash).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]


def test_rope_splits_anywhere():
    text = " a bb  ccc\té\n".encode() * 40
    ends = np.array([m.end() for m in re.finditer(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)])
    for leaf in (1, 3, 256):
        fim.LEAF = leaf
        rope = fim.build(text, ends)
        assert rope.units == len(ends) and rope.chars == len(text.decode())
        for k in range(len(ends) + 1):
            a, b = fim.split(rope, k)
            assert (a.units, b.units) == (k, len(ends) - k) and fim.write(a) + fim.write(b) == text
        for k in range(0, rope.chars + 1, 7):
            a, b = fim.split(rope, k, by_chars=True)
            assert fim.write(a).decode() == text.decode()[:k] and a.chars + b.chars == rope.chars
    fim.LEAF = 256


@pytest.mark.parametrize("table", ["sf0.001"])
def test_new_queries_on_tables(spark, table):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet").collect()
    got = queries.op13_fill_in_middle(spark, f"/root/testdata/{table}").collect()
    assert {(r.doc_id, r.restored_sha256) for r in got} == {(d.doc_id, hashlib.sha256((d.text or "").encode()).hexdigest()) for d in docs}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    got = queries.op11_token_counts(spark, f"/root/testdata/{table}").collect()
    assert {(r.doc_id, r.n_tokens) for r in got} == {(d.doc_id, len(t.encode(d.text or "", add_special_tokens=False).ids)) for d in docs}
