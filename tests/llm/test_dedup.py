"""Exact, substring and near duplicates against brute force."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from barloom.llm import ngram_join
from barloom.llm.components import components
from barloom.llm.exact_dedup import dedup_decisions, drop_copies
from barloom.llm.ngram_join import depth_for, keep_one_each, similar_documents
from barloom.llm.substring_dedup import ANCHOR, COVER, PERIOD, remove_repeats

TABLE = "doc_id long, text string"


def texts(seed, n):
    """Short texts that share passages, with edits."""
    pick = random.Random(seed)
    passages = [[f"w{pick.randrange(40)}" for _ in range(pick.choice([3, 16, 60]))] for _ in range(8)]
    rows = []
    for i in range(n):
        body = []
        for _ in range(pick.randrange(4)):
            words = list(pick.choice(passages))[pick.randrange(4) :]
            if words and pick.random() < 0.4:
                words[pick.randrange(len(words))] = f"x{pick.randrange(9)}"
            body += words
        rows.append((3 * i + 1, pick.choice([" ", "\n", " \t"]).join(body)))
    return [*rows, (0, None), (2, ""), (5, " \n"), (6, "é")]


@pytest.fixture(scope="module")
def documents(spark):
    rows = texts(4, 160)
    return rows, spark.createDataFrame(rows, TABLE)


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    assert ANCHOR == 7


def test_exact_copies(documents):
    rows, docs = documents
    got = {r.doc_id: (r.keep_id, r.group_size) for r in dedup_decisions(docs).collect()}
    assert got == brute.copies(rows)


def test_equal_digests_of_unequal_texts_stay_apart(documents):
    rows, docs = documents

    def weak(text):
        return F.pmod(F.length(text), F.lit(3)).cast("string")

    decided = dedup_decisions(docs, digest=weak, files_per_batch=2).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in decided} == brute.copies(rows)
    assert all(r.kept == (r.keep_id == r.doc_id) for r in decided)


def test_exact_odd_rows(spark):
    rows = [(None, "a b", "p"), (2, "a  b", "q"), (2, "a\tb", "q"), (7, None, None), (9, "", "z")]
    docs = spark.createDataFrame(rows, TABLE + ", digest string")
    kept = sorted(tuple(r) for r in drop_copies(docs).collect())
    assert len(kept) == 2
    assert kept[0][0] == 2 and kept[1] == (7, None, None)
    assert drop_copies(docs.limit(0)).count() == 0
    assert dedup_decisions(docs.limit(0)).count() == 0


def test_a_large_group_of_copies_is_compared_in_replicas(spark):
    docs = spark.range(700).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 7 < 6, "same").otherwise("own").alias("text")
    )
    sizes = {r.group_size for r in dedup_decisions(docs).collect()}
    assert sizes == {600, 100}


def test_substrings(documents):
    rows, docs = documents
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in remove_repeats(docs).collect()}
    want = brute.repeats(rows)
    assert sum(n for _, n, _ in want.values()) > 0
    assert got == want


def test_substring_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    rows = [(1, passage, 0), (1, passage, 0), (None, passage, 1), (None, "a " + passage, 1), (3, None, 2)]
    docs = spark.createDataFrame(rows, TABLE + ", place int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in remove_repeats(docs).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 3, 0), (True, 0, 13), (True, 0, 13)]
    assert remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [512, 8])
def test_similar_documents(documents, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows, docs = documents
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in similar_documents(docs).collect()}
    want = brute.similar(rows)
    assert sum(n for _, _, n in want.values()) > 0
    assert got == want


def test_one_of_each_class_stays(documents):
    rows, docs = documents
    kept = sorted(r.doc_id for r in keep_one_each(docs).collect())
    assert kept == sorted({c for c, _, _ in brute.similar(rows).values()})


def test_similar_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 2), (1, "z y", 3), (None, None, 4)]
    docs = spark.createDataFrame(rows, TABLE + ", class int")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in similar_documents(docs).collect())
    assert got == [(-1, -1, 0), (-1, 1, 2), (1, 1, 0), (1, 1, 2), (1, 1, 2)]
    assert sorted(r["class"] for r in keep_one_each(docs).collect()) in ([2, 3, 4],)
    assert similar_documents(docs.limit(0)).count() == 0


def test_length_of_prefixes_meets_the_recall():
    depth = depth_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**depth) ** ngram_join.TREES >= 0.9999
    assert 1 - (1 - 0.8 ** (depth + 1)) ** ngram_join.TREES < 0.9999


def test_hub_chain_and_loops_become_stars(spark, monkeypatch):
    monkeypatch.setattr("barloom.llm.components.PARTS", 4)
    hub = [(1000, i) for i in range(1001, 1400)] + [(i, 1000) for i in range(900, 950)]
    chain = [(i, i + 1) for i in range(20)]
    loops = [(5000, 5000), (6001, 6000), (6000, 6001)]
    found = components(spark.createDataFrame(hub + chain + loops, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {
        *[(i, 900) for i in (*range(901, 950), *range(1000, 1400))],
        *[(i, 0) for i in range(1, 21)],
        (6001, 6000),
    }


def test_repeated_and_null_ids_of_the_ngram_join(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"{base} x{i % 3}") for i in range(40)] + [(7, f"{base} y")] * 30
    docs = spark.createDataFrame([*rows, (8, "alone here")], "doc_id long, text string")
    found = similar_documents(docs).groupBy("doc_id", "class_id", "n_links", "n_texts").count()
    assert sorted((tuple(r) for r in found.collect()), key=str) == [
        (7, 7, 69, 4, 30), (8, 8, 0, 1, 1), (None, 7, 69, 4, 40),
    ]
