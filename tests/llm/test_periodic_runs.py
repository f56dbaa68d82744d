"""Runs found by the grammar, against trying every period at every place."""

import random

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import periodic_runs
from barloom.llm.periodic_runs import Grammar, collapsed, found_runs, strongest


def plain(words):
    """(start, length, period) of all runs."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in out.items())


def some_words(draw):
    size, n = draw.choice([1, 2, 3, 50]), draw.choice([0, 1, 3, 5, 6, 7, 20, 60, 150])
    words = [draw.randrange(size) for _ in range(n)]
    if n and draw.random() < 0.6:
        a = draw.randrange(n)
        p = 1 + draw.randrange(max(1, (n - a) // 3))
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return [b"%d" % w for w in words * draw.choice([1, 1, 1, 4, 9])]


def test_runs_equal_brute_force(monkeypatch):
    monkeypatch.setattr(periodic_runs, "POINTS", 50)
    draw = random.Random(7)
    for _ in range(150):
        texts = [some_words(draw) for _ in range(draw.randint(0, 6))]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        found = found_runs(periodic_runs._codes(texts, int(sizes.sum())), sizes)
        want = [(k, *run) for k, words in enumerate(texts) for run in plain(words)]
        assert [tuple(row) for row in found.tolist()] == want


def test_agreement_of_any_two_places():
    draw = random.Random(2)
    for _ in range(20):
        codes = np.array([draw.randrange(3) for _ in range(draw.randint(2, 200))])
        a, b = (np.array([draw.randrange(len(codes)) for _ in range(100)]) for _ in "ab")
        grammar = Grammar(codes)

        def common(x, y, step):
            n = 0
            while 0 <= x < len(codes) and 0 <= y < len(codes) and codes[x] == codes[y]:
                x, y, n = x + step, y + step, n + 1
            return n

        differ = a != b
        a, b = a[differ], b[differ]
        assert grammar.agreed(a, b).tolist() == [common(x, y, 1) for x, y in zip(a, b)]
        back = grammar.mirrored().agreed(len(codes) - 1 - a, len(codes) - 1 - b)
        assert back.tolist() == [common(x, y, -1) for x, y in zip(a, b)]


def test_texts_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK_BYTES", 100)
    texts = [
        (1, "a b a b a b a b c"), (2, None), (3, ""), (3, " \t\n"), (None, "é é é é é é x"),
        (4, "one two three"), (5, "x " * 40000 + "y"), (6, "p q r " * 5 + "z " + "p q r " * 5),
        (7, "a b a b a b a b c"),
    ]
    schema = "doc_id long, text string, runs int, key string, said string"
    docs = spark.createDataFrame([(i, t, 1, "k", "s") for i, t in texts], schema).repartition(2)
    found = collapsed(docs)
    assert found.columns == ["doc_id", "key", "said", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed)
                  for r in found.collect()), key=repr)
    want = []
    for i, text in texts:
        words = (text or "").split()
        runs = plain(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i or 0, len(words), runs, kept))
    assert got == sorted(want, key=repr)
    assert collapsed(docs.limit(0)).count() == 0
    best = {r.doc_id: r.best for r in found.select("doc_id", strongest(F.col("runs")).alias("best")).collect()}
    assert tuple(best[6]) == (0, 15, 3) and best[4] is None
