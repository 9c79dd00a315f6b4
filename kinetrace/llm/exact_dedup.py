"""Exact dedup by a stateful stream.

Rows stream through a keyed state kept on disk (RocksDB) that never expires. For each digest the state holds the
stable identifier of the row that stays, a content locator (file and row of that text) and the number of rows. Each
digest that met more than one row is a hit, and the full bytes of all its texts are compared; texts that only share a
digest are told apart by their bytes.

Texts are equal when identical after each run of ASCII white space is replaced by one space; null counts as empty.
Of equal texts the row with the smallest doc_id stays; a null doc_id counts as larger than any other; of rows that
repeat the same doc_id and text, one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WHITE, documents, fresh_path, small_or_shuffled, stored, text_of

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = (1 << 63) - 1


def normalised(df: DataFrame) -> Column:
    return F.regexp_replace(text_of(df), WHITE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def digest_state(stream: DataFrame, checkpoint: str) -> None:
    """Run every row of a stream (digest, ord, rid, file) through the keyed state at checkpoint, then stop.

    Started again with the same checkpoint it goes on where it stopped, with all earlier digests known.
    """
    kept = F.min(F.struct("ord", "rid", "file")).alias("first")
    query = (
        stream.groupBy("digest").agg(kept, F.count(F.lit(1)).alias("n"))
        .writeStream.format("noop").outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, first, n) as the state on disk holds it."""
    state = spark.read.format("statestore").load(checkpoint)
    first, n = state.schema["value"].dataType.names
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.{first}").alias("first"), F.col(f"value.{n}").alias("n"))


def exact_dedup(docs: DataFrame, digest=sha256, files_per_batch: int = 1000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    text = normalised(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"].cast("long").alias("doc_id"), digest(text).alias("digest"), sha256(text).alias("sha"), F.input_file_name().alias("file"))
    digests = stored(rows.withColumn("ord", F.coalesce("doc_id", F.lit(LAST))), "digests")
    checkpoint, own = fresh_path(spark, "dedup-state"), spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # Stores preallocate no files: those would hold megabytes of disk for each partition.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "200")
    source = digests.inputFiles()
    if not source:
        return _labelled(digests, digests.select("digest", F.struct("ord", "rid", "file").alias("first"), F.lit(1).cast("long").alias("n")))
    stream = own.readStream.schema(digests.schema).option("maxFilesPerTrigger", files_per_batch).parquet(source[0].rpartition("/")[0])
    digest_state(stream.select("digest", "ord", "rid", "file"), checkpoint)
    state = stored(read_state(spark, checkpoint), "dedup-kept")
    mixed = _mixed(docs, state, digest)
    rows = mixed.count()
    if not rows:
        return _labelled(digests, state)
    side = small_or_shuffled(mixed, rows)
    apart = _labelled(digests.join(side, "digest", "left_anti"), state)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), digest(text).alias("digest"), sha256(text).alias("sha"), text.alias("text")).join(side, "digest", "left_semi")
    # With texts whose digests clash, the bytes themselves are the key.
    own_rows = digests.join(side, "digest", "left_semi").select("rid", "doc_id", "ord", "sha", "digest")
    sets = own_rows.join(texts.select("digest", "sha", "text").distinct(), ["digest", "sha"])
    of = sets.groupBy("digest", "text").agg(F.min(F.struct("ord", "rid")).alias("first"), F.count(F.lit(1)).alias("n"))
    return apart.unionByName(_columns(sets.join(of, ["digest", "text"])))


def _mixed(docs: DataFrame, state: DataFrame, digest) -> DataFrame:
    """Digests whose texts differ: of the texts of each hit, smallest and largest must be the same bytes."""
    hits = state.where("n > 1").select("digest")
    text = normalised(docs)
    seen = docs.select(digest(text).alias("digest"), text.alias("text")).join(small_or_shuffled(hits), "digest", "left_semi")
    return seen.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("digest")


def _labelled(digests: DataFrame, state: DataFrame) -> DataFrame:
    return _columns(digests.select("rid", "doc_id", "sha", "digest").join(state, "digest"))


def _columns(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.when(F.col("first.ord") < LAST, F.col("first.ord")).alias("keep_id"), F.col("n").cast("long").alias("group_size"), (F.col("rid") == F.col("first.rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each set of equal texts."""
    found = exact_dedup(docs)
    key = ["__kt_id", "__kt_sha"]
    gone = stored(_gone(found, key), "dedup-gone")
    marked = docs.select("*", docs["doc_id"].cast("long").alias(key[0]), sha256(normalised(docs)).alias(key[1]))
    whole = gone.where("not both").select(*key)
    rest = marked.join(small_or_shuffled(whole), _null_safe(marked, whole, key), "left_anti")
    again = gone.where("both").select(*key)
    if again.isEmpty():
        return rest.drop(*key)
    side = small_or_shuffled(again)
    once = rest.join(side, _null_safe(rest, again, key), "left_semi").dropDuplicates(key)
    return rest.join(side, _null_safe(rest, again, key), "left_anti").unionByName(once).drop(*key)


def _null_safe(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    return a[key[0]].eqNullSafe(b[key[0]]) & (a[key[1]] == b[key[1]])


def _gone(found: DataFrame, key: list[str]) -> DataFrame:
    """Keys (doc_id, digest) of dropped rows; both: a row of the same key stays, so one of the rows must remain."""
    by = found.groupBy(F.col("doc_id").alias(key[0]), F.col("text_sha256").alias(key[1]))
    return by.agg(F.max("kept").alias("both"), F.min("kept").alias("all_kept")).where("not all_kept").drop("all_kept")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
