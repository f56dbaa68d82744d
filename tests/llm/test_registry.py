"""Registered text queries against their SQL twins, and the pipeline against brute force."""

import hashlib
import os

import brute
import duckdb
import pytest
from check_oracle import normalize
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import registry
from barloom.llm.chat_format import format_replies
from barloom.llm.registry import ORACLES, QUERIES
from barloom.llm.toxicity import scored, train

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "documents pages labels conversations benchmark".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return found


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, connection, name):
    df = QUERIES[name](spark, SF)
    cursor = connection.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = normalize(cursor.fetchall(), names)
    assert normalize([tuple(r) for r in df.collect()], df.columns) == want
    assert sorted(df.columns) == sorted(names)


def test_wrong_loss_mask_shows_in_op1(spark, monkeypatch):
    def shifted(*args, **kinds):
        move = "transform(loss_spans, s -> named_struct('start', s.start + 1, 'length', s.length))"
        return format_replies(*args, **kinds).withColumn("loss_spans", F.expr(move))

    right = {r.conv_id: r.loss_sha256 for r in QUERIES["op1_chat_format"](spark, SF).collect()}
    monkeypatch.setattr(registry, "format_replies", shifted)
    wrong = {r.conv_id: r.loss_sha256 for r in QUERIES["op1_chat_format"](spark, SF).collect()}
    assert wrong[-1] != right[-1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, name):
    """These have no SQL; test_text and test_dedup compare their operators with brute force."""
    kind = "pages" if name.startswith("op9") else "documents"
    key = "page_id" if kind == "pages" else "doc_id"
    rows = QUERIES[name](spark, SF).select(key).collect()
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{kind}.parquet").select(key).collect()}
    assert {r[0] for r in rows} == ids


def test_tokens_of_queries_equal_the_library(spark):
    library = Tokenizer.from_file(registry.VOCABULARY)
    library.no_padding()
    library.no_truncation()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, counts = {}, {}
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(said))
        counts[r.doc_id] = (len((r.text or "").encode()), len(ids), len(ids) > 2048)
    got = QUERIES["op5_bpe"](spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
    got = QUERIES["op8_token_counts"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == counts


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{number}"
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        ids = sorted(r.doc_id for r in after.select("doc_id").collect())
        rows = list(before.items())
        if name == "toxicity":
            model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = [r.doc_id for r in scored(docs, model).where("score < 0.5").collect()]
            assert ids == sorted(want)
        elif name == "exact_dedup":
            assert ids == sorted({first for first, _ in brute.copies(rows).values()})
        elif name == "near_dedup":
            assert ids == sorted({first for first, _, _ in brute.similar(rows).values()})
        elif name == "mixing":
            assert set(ids) == set(before)
        else:
            library = Tokenizer.from_file(registry.VOCABULARY)
            assert ids == sorted(r.doc_id for r in docs.select("doc_id").collect())
            for r in after.collect():
                assert r.ids == library.encode(before[r.doc_id] or "", add_special_tokens=False).ids
            break
        assert after.columns == columns
        before = {i: before[i] for i in ids}
        docs = after
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
