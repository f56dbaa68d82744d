"""Benchmark windows in documents, against a plain scan."""

import re

import pytest
from pyspark.sql import functions as F

from barloom.llm.decontamination import contamination, decontaminated, hit_places

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, file string, row int, gram string, spans string"

LONG = "Alpha beta, gamma delta! epsilon zeta eta theta iota kappa lambda mu."
ITEMS = [
    (1, LONG),
    (2, "short ITEM here"),
    (2, "another part of item two"),
    (3, " .,! "),
    (4, None),
    (None, "nameless été words"),
    (10, "beta gamma delta epsilon zeta eta theta iota kappa lambda"),
]
TEXTS = [
    (1, "x " + LONG + " y"),
    (2, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa. lambda mu, and short item here"),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (4, None),
    (5, ""),
    (5, "short item here short item here, short? item; here"),
    (None, "Another part of item two; nameless Été words, nameless été words"),
    (7, "word " * 3000 + LONG.replace(" ", "\n") + " tail" * 3000),
    (8, "shortitem here"),
]


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(text, items):
    words = WORD.findall(small(text))
    hit, names = set(), set()
    for item, said in items:
        ws = WORD.findall(small(said))
        n = min(10, len(ws))
        for p in range(len(ws) - n + 1 if n else 0):
            for q in range(len(words) - n + 1):
                if words[q : q + n] == ws[p : p + n]:
                    hit.update(range(q, q + n))
                    names.add("" if item is None else str(item))
    return len(words), sorted(hit), sorted(names)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "f", 1, "g", "s") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [1 << 30, 200])
def test_hits_equal_plain_scan(docs, items, block_bytes):
    found = contamination(docs, items, block_bytes=block_bytes)
    found = found.withColumn("hit", F.array_sort(hit_places(F.col("spans"))))
    got = sorted(((r.id or 0, r.n_words, r.hit, r["items"]) for r in found.collect()), key=repr)
    want = sorted(((i or 0, *plain(t, ITEMS)) for i, t in TEXTS), key=repr)
    assert got == want


def test_spans_or_documents_go(docs, items):
    kept = decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    texts = {(r.doc_id, r.text) for r in kept.collect()}
    assert (1, "x. y") in texts and (4, None) in texts and (8, "shortitem here") in texts
    assert (2, ", and") in texts and (3, TEXTS[2][1]) in texts
    whole = decontaminated(docs, items, remove="documents")
    assert sorted(r.doc_id for r in whole.collect()) == [3, 4, 5, 8]
    with pytest.raises(ValueError):
        decontaminated(docs, items, remove="words")


def test_empty_tables(docs, items):
    assert contamination(docs.limit(0), items).count() == 0
    rows = contamination(docs, items.limit(0)).collect()
    assert len(rows) == len(TEXTS) and not any(r.spans or r["items"] for r in rows)
    assert decontaminated(docs, items.where("item_id = 3")).count() == len(TEXTS)
