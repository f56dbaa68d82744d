"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from barloom.llm import lexical_search
from barloom.llm.lexical_search import Terms, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, best):
    said = [(i, Counter(terms(t))) for i, t in docs]
    said = [(i, c) for i, c in said if c]
    n_docs, total = len(said), sum(sum(c.values()) for _, c in said)
    df = Counter(w for _, c in said for w in c)
    out = []
    for item in {i for i, _ in items}:
        asked = Counter(w for i, t in items if i == item for w in terms(t))
        scores = []
        for i, counts in said:
            m = 100 - 25 + (25 * sum(counts.values()) * n_docs) // total
            score = 0
            for w, often in asked.items():
                if tf := counts[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += often * weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=repr)


def corpus(n, seed=3):
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 40))) for _ in range(n)]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(n, None), (n + 1, ""), (n + 2, "w1 W1; w2é été"), (None, texts[5]), (3, texts[3])]
    docs.append((n + 3, "w7 " * 30000 + "Endword"))
    items = [(k, " ".join(draw.choices(words, k=12))) for k in range(8)]
    items += [(8, "été w2é W2É"), (9, None), (10, "..."), (11, "nowhere"), (None, "w1 w1 w9"),
              (12, "w3"), (12, "w4 endword")]
    return docs, items


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_ranks_equal_full_scoring(spark, monkeypatch, block_bytes):
    docs, items = corpus(300)
    monkeypatch.setattr(lexical_search, "BLOCK_ROWS", 16)
    monkeypatch.setattr(lexical_search, "SHARD_ROWS", 100)
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, "
                                  "score int, rank int").repartition(3)  # fmt: skip
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = ranked_search(table, asked, block_bytes=block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(found) == plain(docs, items, 20)


def test_equal_scores_by_id(spark):
    docs = [(i, "same words here") for i in range(50, 0, -1)] + [(99, "other")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([("q", "same")], "item_id string, text string")
    assert [(r["rank"], r.doc_id) for r in ranked_search(table, asked, best=5).orderBy("rank").collect()] \
        == [(i, i) for i in range(1, 6)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(docs.limit(0), asked).count() == 0
    assert ranked_search(docs, asked.limit(0)).count() == 0


def test_matches_are_verified_by_bytes():
    data = np.frombuffer(b"Alpha betas", dtype=np.uint8)
    known = Terms([b"alpha", b"betas"])
    assert known.found(data, np.array([0, 11]))[2].tolist() == [0, 1]
    # as if each hash belonged to the other term
    known.order = known.order[::-1]
    assert len(known.found(data, np.array([0, 11]))[2]) == 0
