"""Exact deduplication as a stateful stream.

A stream of landed rows, in several micro-batches, feeds an aggregation keyed by content digest. Its state lives in RocksDB, on disk,
has no watermark and so never expires; for each digest it holds the row that stays (stable identifier and content locator) and the
number of rows seen. Rows that hit a digest seen before are compared with the kept row's full bytes, so that a digest collision
never merges different texts. That is done once, after the stream: a row that stays may still change with every batch, and comparing in
each batch would read the kept texts as many times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import files_of, join_hot, materialise, new_path, note, scratch, text_or_empty

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Runs of white space other than one blank: replacing these alone gives the same text as replacing all runs.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Micro-batches that the landed rows make up at least, if there are as many rows.
BATCHES = 4
#: Row locators of hits are sent to all tasks up to this many (two longs each); beyond it the texts are shuffled.
BROADCAST_HITS = 1_000_000
#: Rows that are compared with one copy of a kept row's bytes.
COMPARED = 256


def normalised(text: str | Column) -> Column:
    """The text with each run of white space replaced by one blank; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), RUNS, " ")


def sha256_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed_state(records: DataFrame) -> DataFrame:
    """The stateful operator on a stream (or batch) of (digest, id, rid, locator) rows.

    One row per digest: ``first``, the smallest identifier's row (null identifiers last, then the
    smallest locator), and ``group_size``. Without a watermark, nothing ever leaves the state.
    """
    return records.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid", "locator")).alias("first"),
        F.count(F.lit(1)).alias("group_size"),
    )


def land(rows: DataFrame, path: str, batches: int = BATCHES) -> None:
    """Write the table that the stream reads, in at least as many files as there are to be batches, without a shuffle."""
    rows.write.option("compression", "zstd").option("maxRecordsPerFile", max(1, rows.count() // batches)).parquet(path)


def run_stream(spark: SparkSession, landed: str, schema, records, batches: int = BATCHES, name: str = "dedup") -> DataFrame:
    """Run the stream over the table at ``landed``, made into records by ``records``, and return the last state of each digest."""
    out, log = new_path(spark, f"{name}-state"), new_path(spark, f"{name}-log")
    note(out), note(log)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={number}")

    own = spark.newSession()  # the state store's settings hold for this stream alone
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    share = max(1, files_of(spark, landed) // batches)
    state = keyed_state(records(own.readStream.schema(schema).option("maxFilesPerTrigger", share).parquet(landed)))
    query = state.writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields)
    if not query.lastProgress:  # no rows at all
        return spark.createDataFrame([], kinds)
    found = spark.read.schema(f"{kinds}, batch long").parquet(out)
    return found.groupBy("digest").agg(F.max_by(F.struct("first", "group_size"), "batch").alias("last")).select("digest", "last.*")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest, carry: bool = False, batches: int = BATCHES) -> DataFrame:
    """One row per document: ``row`` (the input's columns, all with ``carry``, else identifier and text),
    ``rid``, ``digest``, ``keep_id``, ``group_size`` and ``kept``.

    Of equal normalised texts the row with the smallest identifier stays (null identifiers last; of rows that
    repeat an identifier the first landed). Null text counts as empty. An empty table gives no rows. The
    input's columns stay inside ``row``, so their names can't clash.
    """
    with scratch(docs.sparkSession):
        return _assign(docs, id_col, text_col, digest, carry, batches)


def _assign(docs: DataFrame, id_col: str, text_col: str, digest, carry: bool, batches: int) -> DataFrame:
    spark = docs.sparkSession
    columns = docs.columns if carry else list(dict.fromkeys([id_col, text_col]))
    path = new_path(spark, "dedup-landed")
    note(path, keep=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), digest(normalised(text_col)).alias("digest"), F.monotonically_increasing_id().alias("rid"))
    land(rows, path, batches)
    landed = spark.read.schema(rows.schema).parquet(path)
    own_id, own_text = F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")
    state = run_stream(spark, path, rows.schema, lambda r: r.select("digest", own_id.alias("id"), "rid", F.struct(F.octet_length(text_or_empty(own_text)).alias("n_bytes"), "rid").alias("locator")), batches)
    state = materialise(state.select("digest", F.col("first.id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), "group_size", F.col("group_size").alias("times")), "dedup-last")
    keyed = materialise(join_hot(landed.select("rid", "digest"), state, "digest", "times", landed.count()), "dedup-keyed", keep=True)
    hits = keyed.where("group_size > 1").select("rid", "keep_rid", "group_size")
    side = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
    # a large group's kept bytes meet its hits in several tasks
    parts = F.ceil(F.col("group_size") / COMPARED)
    texts = landed.select("rid", normalised(own_text).alias("content")).join(side, "rid").withColumn("parts", parts)
    kept = texts.where("rid = keep_rid").select("keep_rid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("content").alias("kept_content"))
    asked = texts.where("rid <> keep_rid").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    differ = materialise(asked.join(kept, ["keep_rid", "part"]).where("content <> kept_content").select("rid", "keep_rid", "content").join(keyed.select("rid", "digest"), "rid"), "dedup-collisions")
    if not differ.isEmpty():
        keyed = materialise(_split_collisions(keyed, differ, landed.select("rid", own_id.alias("id"))), "dedup-split", keep=True)
    return landed.select(*(["row"] if carry else [own_id.alias("id")]), "rid").join(keyed, "rid").withColumn("kept", F.col("rid") == F.col("keep_rid"))


def _split_collisions(keyed: DataFrame, differ: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose bytes differ from their digest's kept row form groups of their own, by full content."""
    own = differ.join(ids, "rid")
    groups = own.groupBy("digest", "content").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("first"), F.count(F.lit(1)).alias("size"))
    moved = own.select("rid", "digest", "content").join(groups, ["digest", "content"]).select("rid", F.col("first.id").alias("new_id"), F.col("first.rid").alias("new_rid"), "size")
    left = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    return (
        keyed.join(moved, "rid", "left")
        .join(left, "digest", "left")
        .select(
            "rid", "digest",
            F.when(F.col("new_rid").isNull(), F.col("keep_id")).otherwise(F.col("new_id")).alias("keep_id"),
            F.coalesce("new_rid", "keep_rid").alias("keep_rid"),
            F.coalesce("size", F.col("group_size") - F.coalesce("gone", F.lit(0))).alias("group_size"),
        )
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The report: one row per document with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    return assign(docs, id_col, text_col).select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with the input's own columns."""
    return assign(docs, id_col, text_col, carry=True).where("kept").select("row.*")
