"""Documents that hold every awkward case, and plain Python versions of what the operators must find."""

import random
import re

BASE = "the quick brown fox jumps over the lazy dog while seven wizards mix strange potions in quiet towers near a cold river and nobody ever asks them why they do so".split()


def documents(seed=0):
    """(doc_id, text, lang, source, n_chars): nulls in any column, empty and long texts, copies, near copies, ties, repeated rows."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    make = lambda n: [r.choice(words) for _ in range(n)]
    rows, n = [], 0

    def put(text, lang="en", source="s", id_=True):
        nonlocal n
        rows.append((n if id_ else None, text, lang, source, len(text) if text else None))
        n += 1

    for t in (None, "", " \t\n", "...", "é", "one", "One  TWO", "one two three", "a b c d", "A b c d", "x " * 5):
        put(t)
    passage = make(60)
    for k in range(30):
        put(" ".join(make(r.randint(1, 80))) + ("\n" + " ".join(passage) if k % 3 == 0 else ""), r.choice(["en", "de", None]), r.choice(["hot", None]))
    base = make(120)
    for k in range(25):  # near copies and exact copies
        w = list(base)
        for _ in range(k % 7):
            w[r.randrange(len(w))] = r.choice(words)
        put(" ".join(w), "de")
    for size in (5, 6, 7, 8, 12, 13, 14, 15, 20):  # small sets, one word more or less
        w = make(size + 3)
        put(" ".join(w))
        put(" ".join([*w, "tail"]))
        put(" ".join(w[:-1]))
    put(" ".join(make(20_000)))
    put("z" * 50_000 + " " + " ".join(passage) + " " + " ".join(passage))
    put("same id, null", id_=False)
    rows += [rows[12], rows[12], rows[40]]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, extra=True):
    """With extra columns named as the operators' own are."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(7) for c in ("chunk", "n", "class", "payload", "score", "spans", "kind")}) if extra else df


def words(text, lower=False):
    b = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0d]+", b.lower() if lower else b)


def shingles(text, k):
    w = words(text, True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, percent):
    """(set size, smallest reachable id) of each (id, text)."""
    sets = [(i, shingles(t, k)) for i, t, *_ in rows if i is not None]
    low = {i: i for i, _ in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                low[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def stripped(rows, width):
    """(id, words, removed, kept text) by looking at every window."""
    seen, streams = {}, [(i, words(t)) for i, t, *_ in rows]
    for _, w in streams:
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for i, w in streams:
        gone = set()
        for p in range(len(w) - width + 1):
            if seen[tuple(w[p : p + width])] > 1:
                gone.update(range(p, p + width))
        out.append((-1 if i is None else i, len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode()))
    return sorted(out)
