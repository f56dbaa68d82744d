"""From raw documents to training tokens: five stages, each written before the next begins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.base import free_name, stored, table
from barloom.llm.bpe import encoded
from barloom.llm.exact_dedup import drop_copies
from barloom.llm.mixing import Mixture, mixed
from barloom.llm.ngram_join import keep_one_each
from barloom.llm.toxicity import scored, train

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Scores from here on are toxic.
TOXIC = 0.5
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: No source is gone through more than twice, and every document at least once.
MIXTURE = Mixture(entropy=0.95, max_repeats=2.0, budget=None)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labels of the corpus, calls toxic go."""
    model = stored(train(docs, table(spark, sf_dir, "labels")), "toxicity-model")
    score = free_name(docs.columns, "score")
    rated = scored(docs, model, score=score)
    return rated.where(F.col(score) < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word similarity the one with the smallest id stays."""
    return keep_one_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources come again until the sources are mixed by their weights."""
    return mixed(docs, MIXTURE)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text that they decode to."""
    return encoded(docs, VOCABULARY, keep_text=False).withColumn(
        "n_tokens", F.size("ids").cast("long")
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("bpe", tokens),
]

#: Trained weights and vocabulary merges have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
