"""Mixing sources to target weights by temperature.

A source with token share p gets a weight proportional to p ** exponent. The exponent lies between
0 (all sources alike) and 1 (as they come) and is bisected, several levels per Spark job, over the
table of shares. The weights become token budgets, and a budget becomes whole and partial epochs of
the source's documents: hashed into blocks, blocks in an order permuted per epoch, documents
permuted inside a block. A partial epoch ends inside one block.

Defined cases: every document counts as one token at least, so empty texts and sources of empty
texts take part; a null source is a source of its own; repeated rows are drawn each for itself
(rows alike in id and text together); with one source or an empty table the exponent is 1; other
columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.base import SPACES, key_of, stored, text_of

#: Points per job: five levels of bisection at once, six jobs bring the exponent to 2 ** -30.
POINTS, ROUNDS = 31, 6
#: Expected documents per block.
BLOCK_DOCS = 2048
#: Salts of the join that tells each document its source's number of blocks.
SALTS = 16


@dataclass(frozen=True)
class Mixture:
    """``entropy`` is the target as a part of the highest possible entropy, ln(sources).

    ``max_repeats`` bounds how often any source is gone through and wins over the
    entropy. ``budget`` is the number of tokens wanted; None means as many as it
    takes for the largest source to be gone through once, so that no document is
    left out.
    """

    entropy: float = 0.95
    max_repeats: float = 2.0
    budget: int | None = None
    seed: int = 17


def word_count(text: Column) -> Column:
    """Words of a text, one at least."""
    trimmed = F.regexp_replace(text, rf"\A{SPACES}|{SPACES}\z", "")
    return F.size(F.split(trimmed, SPACES)).cast("long")


def _bisected(shares: DataFrame, holds: Callable[[float, float, float], bool]) -> float:
    """Smallest exponent in [0, 1] at which ``holds(exponent, sum, log_sum)``, 1 if none is."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / (POINTS + 1) for i in range(POINTS + 2)]
        powers = [F.exp(F.lit(a) * F.col("log_share")) for a in points]
        sums = shares.agg(
            *[F.sum(x) for x in powers], *[F.sum(x * F.col("log_share")) for x in powers]
        ).first()
        n = len(points)
        good = [holds(a, sums[i], sums[n + i]) for i, a in enumerate(points)]
        if good[0]:
            return points[0]
        first = next((i for i, g in enumerate(good) if g), n - 1)
        low, high = points[first - 1], points[first]
    return high


def fit_exponent(sources: DataFrame, mixture: Mixture) -> tuple[float, float]:
    """Exponent and token budget for a table (source, n_tokens, n_docs).

    A derived budget isn't rounded, or the largest source would miss its one
    epoch by a part of a token.
    """
    n, total, most, least = sources.agg(
        F.count(F.lit(1)), F.sum("n_tokens"), F.max("n_tokens"), F.min("n_tokens")
    ).first()
    if n == 0:
        return 1.0, 0
    if n == 1:
        return 1.0, total if mixture.budget is None else mixture.budget
    shares = sources.select(F.log(F.col("n_tokens") / F.lit(float(total))).alias("log_share"))
    log_most, log_least = math.log(most / total), math.log(least / total)

    def budget_over_total(exponent: float, powers: float) -> float:
        if mixture.budget is not None:
            return mixture.budget / total
        return math.exp((1 - exponent) * log_most) * powers

    def few_repeats(exponent: float, powers: float, _: float) -> bool:
        repeats = budget_over_total(exponent, powers) * math.exp((exponent - 1) * log_least) / powers
        return repeats <= mixture.max_repeats

    def too_even(exponent: float, powers: float, logs: float) -> bool:
        return math.log(powers) - exponent * logs / powers <= mixture.entropy * math.log(n)

    exponent = max(_bisected(shares, few_repeats), _bisected(shares, too_even))
    if mixture.budget is not None:
        return exponent, mixture.budget
    powers = shares.agg(F.sum(F.exp(F.lit(exponent) * F.col("log_share")))).first()[0]
    return exponent, total * budget_over_total(exponent, powers)


def _prepared(docs: DataFrame, key: str, text: str, source: str, mixture: Mixture) -> DataFrame:
    """The columns of the documents as ``doc``, with source, tokens and a hash of their own."""
    words = text_of(F.col(f"`{text}`"))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        key_of(F.col(f"`{source}`")).alias("source"),
        F.xxhash64(F.lit(mixture.seed), key_of(F.col(f"`{key}`")), words).alias("own"),
        word_count(words).alias("n_tokens"),
    )


def _blocked(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the block of each document; a source has a block per BLOCK_DOCS documents."""
    sizes = sources.select(
        "source",
        F.ceil(F.col("n_docs") / F.lit(BLOCK_DOCS)).alias("n_blocks"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    return (
        rows.withColumn("salt", F.pmod("own", F.lit(SALTS)).cast("int"))
        .join(sizes, ["source", "salt"])
        .withColumn("block", F.pmod(F.xxhash64("own", F.lit(1)), F.col("n_blocks")))
        .drop("salt", "n_blocks")
    )


def _order(mixture: Mixture, epoch: Column, *of: str) -> Column:
    return F.xxhash64(F.lit(mixture.seed), epoch.cast("long"), *of)


def _plan(slim: DataFrame, sources: DataFrame, mixture: Mixture) -> DataFrame:
    """(source, block, whole, part, cut, weight): epochs taken of each block.

    ``whole`` epochs are complete. In the partial one a block is taken up to the
    document whose order hash is ``cut`` (all of it where ``cut`` is null), if
    ``part`` says so.
    """
    exponent, budget = fit_exponent(sources, mixture)
    total = sources.agg(F.sum("n_tokens")).first()[0] or 0
    share = F.col("n_tokens") / F.lit(float(total or 1))
    power = F.exp(F.lit(exponent) * F.log(share))
    powers = sources.agg(F.sum(power)).first()[0] or 1.0
    weighted = sources.select(
        "source",
        (power / F.lit(powers)).alias("weight"),
        F.col("n_tokens").alias("source_tokens"),
    )
    # a hair is added so that a whole number of epochs stays whole
    wanted = F.floor(F.col("weight") * F.lit(float(budget)) + F.lit(1e-6) * F.col("source_tokens"))
    weighted = weighted.withColumn("wanted", wanted).select(
        "source", "weight",
        F.expr("wanted div source_tokens").alias("whole"),
        F.expr("wanted % source_tokens").alias("rest"),
    )
    blocks = slim.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    blocks = blocks.join(weighted, "source").withColumn(
        "block_order", _order(mixture, F.col("whole"), "source", "block")
    )
    before = (
        Window.partitionBy("source")
        .orderBy("block_order", "block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = blocks.withColumn(
        "start", F.coalesce(F.sum("block_tokens").over(before), F.lit(0))
    ).withColumn("part", F.col("start") < F.col("rest"))
    blocks = stored(blocks, "mixing-blocks")
    last = blocks.where("part AND start + block_tokens > rest")
    inside = slim.join(
        last.select("source", "block", "whole", (F.col("rest") - F.col("start")).alias("left")),
        ["source", "block"],
    ).withColumn("doc_order", _order(mixture, F.col("whole"), "own"))
    earlier = (
        Window.partitionBy("source", "block")
        .orderBy("doc_order")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    cuts = (
        inside.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
        .where("start < left")
        .groupBy("source", "block")
        .agg(F.max("doc_order").alias("cut"))
    )
    return blocks.join(cuts, ["source", "block"], "left").select(
        "source", "block", "whole", "part", "cut", "weight"
    )


def _drawn(docs: DataFrame, key: str, text: str, source: str, mixture: Mixture) -> DataFrame:
    rows = _prepared(docs, key, text, source, mixture)
    slim = stored(rows.select("source", "own", "n_tokens"), "mixing-rows")
    sources = stored(
        slim.groupBy("source").agg(
            F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs")
        ),
        "mixing-sources",
    )
    plan = stored(_plan(_blocked(slim, sources), sources, mixture), "mixing-plan")
    ends_before = F.coalesce(_order(mixture, F.col("whole"), "own") > F.col("cut"), F.lit(False))
    epochs = F.col("whole") + (F.col("part") & ~ends_before).cast("long")
    drawn = _blocked(rows, sources).join(plan, ["source", "block"])
    return (
        drawn.withColumn("epochs", epochs)
        .where("epochs > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    )


def mixed(
    docs: DataFrame,
    mixture: Mixture = Mixture(),
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The documents, all columns, each as often as it is drawn."""
    return _drawn(docs, key, text, source, mixture).select("doc.*")


def mixing_draws(
    docs: DataFrame,
    mixture: Mixture = Mixture(),
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per draw: id, source, tokens, weight of the source, epoch, block and order.

    Reading the draws by (epoch, block_order, doc_order) mixes the sources' blocks.
    """
    drawn = _drawn(docs, key, text, source, mixture)
    return drawn.select(
        F.col(f"doc.`{key}`").alias(key),
        F.col(f"doc.`{source}`").alias(source),
        "n_tokens", "weight", "epoch", "block",
        _order(mixture, F.col("epoch"), "source", "block").alias("block_order"),
        _order(mixture, F.col("epoch"), "own").alias("doc_order"),
    )
