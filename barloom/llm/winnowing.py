"""Document fingerprints by winnowing.

A text is cut into pieces: words, and words longer than PIECE code points every PIECE of them. Grams
of GRAM neighbouring pieces get a cyclic-polynomial rolling hash, made by doubling (a pair from two
pieces, a gram from two pairs). Of every WINDOW neighbouring grams the one with the smallest hash is
chosen, the rightmost of equal ones, and its position is kept: any passage of GRAM + WINDOW - 1
pieces that starts and ends with whole words of two texts gives both a common fingerprint.

All of it is array expressions on the row; nothing is shuffled. Defined cases: a null text is the
empty text, which has no fingerprints; a text of fewer than GRAM pieces is one gram, one of fewer
than WINDOW grams one window; two texts without fingerprints are alike (1); equal texts have equal
fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.base import text_of

PIECE = 12
GRAM = 4
WINDOW = 8
#: Neighbours are looked up in groups of 2 ** ID_BITS ids, groups in 2 ** GROUP_BITS per upper group.
ID_BITS, GROUP_BITS = 9, 12

_LAST = (1 << 31) - 1


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _neighbours(name: str, apart: int, combine) -> Column:
    """``combine`` over all elements that stand ``apart`` places from each other."""
    x = F.col(name)
    n = F.greatest(F.size(x) - apart, F.lit(0))
    return F.zip_with(F.slice(x, 1, n), F.slice(x, 1 + apart, n), combine)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``, an array of (hash, position) in order of position.

    Steps are columns of their own, so that no array is computed twice.
    """
    kept = df.columns
    pieces = F.regexp_extract_all(
        text_of(text), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0)
    )
    df = df.withColumn("_pieces", pieces)
    df = df.withColumn("_hashes", F.transform("_pieces", lambda p: F.xxhash64(p)))
    df = df.withColumn(
        "_pairs", _neighbours("_hashes", 1, lambda a, b: _rotated(a, 1).bitwiseXOR(b))
    )
    grams = _neighbours("_pairs", 2, lambda a, b: _rotated(a, 2).bitwiseXOR(b))
    few = F.array(F.xxhash64(F.array_join("_pieces", " ")))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(
        "_grams",
        F.when(F.size("_pieces") >= GRAM, grams)
        .when(F.size("_pieces") > 0, few)
        .otherwise(none),
    )
    # smaller hash first, then the greater position
    ranked = F.transform(
        "_grams",
        lambda g, i: F.shiftleft(F.shiftrightunsigned(g, 32), 31).bitwiseOR(
            F.lit(_LAST).cast("long") - i
        ),
    )
    df = df.withColumn("_least1", ranked)
    reach = 1
    while reach < WINDOW:
        df = df.withColumn(f"_least{2 * reach}", _neighbours(f"_least{reach}", reach, lambda a, b: F.least(a, b)))
        reach *= 2
    chosen = F.when(
        F.size("_grams") >= WINDOW, F.array_distinct(f"_least{WINDOW}")
    ).when(F.size("_grams") > 0, F.array(F.array_min("_least1"))).otherwise(none)
    df = df.withColumn("_chosen", chosen)

    def placed(x: Column) -> Column:
        position = (F.lit(_LAST).cast("long") - x.bitwiseAND(F.lit(_LAST).cast("long"))).cast("int")
        return F.struct(
            F.element_at("_grams", position + 1).alias("hash"), position.alias("position")
        )

    return df.withColumn(name, F.transform("_chosen", placed)).select(*kept, name)


def likeness(a: str | Column, b: str | Column) -> Column:
    """Twice the common hashes over all hashes of two fingerprints (0 to 1)."""
    a, b = (F.array_distinct(F.col(f"{x}.hash") if isinstance(x, str) else x) for x in (a, b))
    both = F.size(F.array_intersect(a, b)) * F.lit(2.0)
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b)))


def as_text(fingerprint: str) -> Column:
    return F.array_join(F.col(f"{fingerprint}.hash").cast("array<string>"), " ")


def _following(groups: DataFrame) -> DataFrame:
    """(part, next_part): the next lower group number that occurs; after the lowest, the highest."""
    groups = groups.withColumn("upper", F.shiftright("part", GROUP_BITS))
    inside = Window.partitionBy("upper").orderBy(F.desc("part"))
    uppers = groups.groupBy("upper").agg(F.max("part").alias("top"))
    # one row per 2 ** (ID_BITS + GROUP_BITS) ids
    below = Window.orderBy(F.desc("upper"))
    whole = Window.orderBy(F.desc("upper")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    uppers = uppers.select(
        "upper", F.coalesce(F.lead("top").over(below), F.max("top").over(whole)).alias("outside")
    )
    return groups.withColumn("inside", F.lead("part").over(inside)).join(uppers, "upper").select(
        "part", F.coalesce("inside", "outside").alias("next_part")
    )


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, print, next_id, next_text, next_print), next in descending order of an integer id.

    The texts are shuffled once, by groups of neighbouring ids; only the first
    document of each group is needed elsewhere, by the group before. After the
    last document comes the first. A null id is the lowest; repeated ids follow
    each other.
    """
    id_ = F.col(f"`{key}`").cast("long")
    order_key = F.coalesce(id_, F.lit(-(1 << 63)))
    # never null, so that no filter on it parts the two readers of the one exchange
    part = F.shiftright(order_key, ID_BITS)
    rows = docs.select(
        part.alias("part"), order_key.alias("place"), id_.alias("id"),
        text_of(F.col(f"`{text}`")).alias("text"),
    )
    order = Window.partitionBy("part").orderBy(F.desc("place"), "text")
    first = F.lag(F.lit(1)).over(order).isNull()
    last = F.lead(F.lit(1)).over(order).isNull()
    after = [F.lead(c).over(order).alias(f"next_{c}") for c in ("id", "text")]
    inner = with_fingerprint(rows.select("*", last.alias("last"), *after), "text", "print")
    inner = inner.withColumn("next_print", F.lead("print").over(order))
    heads = with_fingerprint(rows.withColumn("first", first).where("first"), "text", "print")
    heads = heads.select(
        F.col("part").alias("next_part"), F.struct("id", "text", "print").alias("head")
    )
    heads = _following(docs.select(part.alias("part")).distinct()).join(heads, "next_part")
    joined = inner.join(heads.drop("next_part"), "part", "left")
    return joined.select(
        "id", "text", "print",
        *[
            F.when(F.col("last"), F.col(f"head.{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}")
            for c in ("id", "text", "print")
        ],
    )


def spliced(text: Column, other: Column) -> Column:
    """The last half of the text replaced by as much of the beginning of the other."""
    half = F.floor(F.length(text) / F.lit(2)).cast("int")
    return F.concat(
        F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half)
    )


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint against its spliced text and against the next document."""
    found = with_next(docs, key, text).withColumn(
        "edited", spliced(F.col("text"), F.col("next_text"))
    ).drop("next_text")
    found = with_fingerprint(found, "edited", "edited_print")
    return found.select(
        F.col("id").alias(key),
        F.length("text").cast("long").alias("n_chars"),
        "edited", "print", "edited_print",
        likeness("print", "edited_print").alias("near_edited"),
        likeness("print", "next_print").alias("near_next"),
        "next_id",
    )
