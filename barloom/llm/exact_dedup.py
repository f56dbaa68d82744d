"""Exact deduplication with streaming state.

Keyed state on disk (RocksDB, checkpointed to the shared folder, without expiry) keeps per digest
the smallest document id, the locator of that document's content and a row count. A row whose
digest was seen more than once is a hit; its whole text is compared with the text of the row the
state points at, so the result depends on bytes, not on the digest.

Defined cases: a null text is the empty text; a null id sorts after all others; rows repeated with
one id are told apart by their place, the first place stays; an empty table gives no rows; other
columns, whatever their names, are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.base import SPACES, scratch_path, stored, text_of

#: Session settings while the stream runs. Without the second, every state partition reserves some
#: megabytes of disk that small states never fill.
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Files of the ledger that one micro-batch takes.
FILES_PER_BATCH = 1000
#: Copies compared with one replica of the kept text.
COPIES_PER_REPLICA = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def located(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Id, text and place (file, row) of every row, with all columns of the row as ``doc``.

    Rows read straight from files are located where they lie. Anything else is
    written to the shared folder first, which makes their places lasting.
    """
    try:
        places = docs.select("_metadata.file_path", "_metadata.row_index")
        assert len(places.columns) == 2
    except AnalysisException:
        docs = stored(docs, "documents")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(f"`{key}`").alias("id"),
        text_of(F.col(f"`{text}`")).alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def _streamed_groups(ledger: DataFrame, ledger_path: str, files_per_batch: int) -> DataFrame:
    """First row and number of rows per digest, kept as streaming state."""
    spark = ledger.sparkSession
    changes = scratch_path(spark, "exact-groups")
    found = (
        spark.readStream.schema(ledger.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(ledger_path)
        .groupBy("digest")
        .agg(
            F.min(F.struct(F.isnull("id").alias("no_id"), "id", "file", "row")).alias("first"),
            F.count(F.lit(1)).alias("n"),
        )
    )

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    schema = found.schema
    spark.createDataFrame([], schema).write.parquet(f"{changes}/batch=-1")
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        (
            found.writeStream.outputMode("update")
            .option("checkpointLocation", scratch_path(spark, "exact-state"))
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
            .awaitTermination()
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    # a digest is written again whenever it changes: ids only fall, counts only rise
    return (
        spark.read.schema(schema)
        .parquet(f"{changes}/batch=*")
        .groupBy("digest")
        .agg(F.min("first").alias("first"), F.max("n").alias("n"))
    )


def _decided(
    rows: DataFrame, digest: Callable[[Column], Column], files_per_batch: int
) -> DataFrame:
    """(id, file, row, digest, first, n, kept) of every row."""
    spark = rows.sparkSession
    path = scratch_path(spark, "exact-ledger")
    slim = rows.select("id", "file", "row", digest(normalised(F.col("text"))).alias("digest"))
    slim.write.parquet(path)
    ledger = spark.read.schema(slim.schema).parquet(path)
    groups = stored(_streamed_groups(ledger, path, files_per_batch), "exact-groups-last")
    is_first = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    repeated = groups.where("n > 1")
    hits = ledger.join(repeated, "digest").select(
        "digest", "file", "row", "n", is_first.alias("is_first")
    )
    texts = stored(
        rows.select("id", "file", "row", "text").join(hits, ["file", "row"]), "exact-hits"
    )
    replicas = F.ceil(F.col("n") / F.lit(COPIES_PER_REPLICA)).cast("int")
    kept = texts.where("is_first").select(
        "digest",
        F.explode(F.sequence(F.lit(0), replicas - 1)).alias("replica"),
        normalised(F.col("text")).alias("kept_text"),
    )
    other = (
        texts.where("NOT is_first")
        .withColumn("replica", F.pmod(F.xxhash64("file", "row"), replicas).cast("int"))
        .join(kept, ["digest", "replica"])
        .where(normalised(F.col("text")) != F.col("kept_text"))
    )
    # rows that share a digest but not the text are grouped by the text itself
    other = stored(
        other.select("digest", "id", "file", "row", normalised(F.col("text")).alias("text")),
        "exact-other",
    )
    regrouped = other.groupBy("text").agg(
        F.min(F.struct(F.isnull("id").alias("no_id"), "id", "file", "row")).alias("own_first"),
        F.count(F.lit(1)).alias("own_n"),
    )
    own = other.join(regrouped, "text").select("file", "row", "own_first", "own_n")
    fewer = other.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    return (
        ledger.join(groups, "digest")
        .join(fewer, "digest", "left")
        .join(own, ["file", "row"], "left")
        .withColumn("first", F.coalesce("own_first", "first"))
        .withColumn("n", F.coalesce("own_n", F.col("n") - F.coalesce("lost", F.lit(0))))
        .select("id", "file", "row", "digest", "first", "n", is_first.alias("kept"))
    )


def dedup_decisions(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """One row per document: its id, the id that stays, the size of its group, whether it stays."""
    decided = _decided(located(docs, key, text), digest, files_per_batch)
    return decided.select(
        F.col("id").alias(key),
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        "kept",
        F.col("digest").alias("text_digest"),
    )


def drop_copies(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """The documents, all columns, without the copies."""
    rows = located(docs, key, text)
    gone = _decided(rows, digest, files_per_batch).where("NOT kept").select("file", "row")
    return rows.join(gone, ["file", "row"], "left_anti").select("doc.*")
