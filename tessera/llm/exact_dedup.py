"""Exact deduplication with stateful streaming.

The stream reads rows of digest, stable identifier and content locator, and keeps a keyed state in an
on-disk store (RocksDB) that never expires: for each digest the row that stays (its batch, identifier and
tag, which locate its content) and the number of rows. What has changed in a trigger goes to a table beside
the state; the least row and the largest count of a digest are its last. On hits (digests of two rows or
more) the full normalised bytes are compared with those of the row that stays. Rows that differ, two texts
under one digest, are grouped by the bytes themselves.

With a state path the state, its digests and the texts that stay live on there: a later call brings a new
batch, which is deduplicated against all earlier ones. A text that an earlier batch has brought stays its
row, whatever the identifiers, as it has been passed on already. Without one the state ends with the call.

All of it is DataFrame operations. Partial aggregation comes before the state, so a digest that a third of
all rows share reaches it as one row a task; only digests that are hit are joined with the rows, by
broadcast while they are few, else by a join that splits skewed keys.

Defined results: null text is the empty text; a run of ASCII white space counts as one space and is not
trimmed; of equal texts the row of the smallest doc_id stays (a null doc_id is largest, and of repeated
rows of that doc_id all but one go); doc_id may be of any type that has an order; an empty table gives an
empty table; other columns are ignored by `exact_groups` and kept by `exact_dedup`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tessera.llm.common import WS_CLASS, few, scratch, staged, swept, text_or_empty

#: Settings of the on-disk state while the stream runs: changes are checkpointed rather than whole stores, and
#: stores take no disk in advance, as there can be many small ones.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(col), WS_CLASS + "+", " ")


def batches_at(spark: SparkSession, root: str) -> int:
    """How many batches a state has taken in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/digests")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return len(files.listStatus(path)) if files.exists(path) else 0


def keyed_state(spark: SparkSession, root: str, kinds: T.StructType, files_per_trigger: int) -> DataFrame:
    """digest, keep, copies: the state after a stream over the digests at `root` that it has not yet read."""
    old = {key: spark.conf.get(key, None) for key in STORE}
    for key, value in STORE.items():
        spark.conf.set(key, value)
    try:
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{root}/digests/*")
        state = stream.groupBy("digest").agg(F.min("row_key").alias("keep"), F.count(F.lit(1)).alias("copies"))
        query = (
            state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{root}/state")
            .foreachBatch(lambda changed, trigger: changed.write.mode("overwrite").parquet(f"{root}/changed/trigger={trigger}")).start()
        )
        query.awaitTermination()
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = T.StructType([kinds["digest"], T.StructField("keep", kinds["row_key"].dataType), T.StructField("copies", T.LongType())])
    changed = spark.read.schema(out).parquet(f"{root}/changed/*")
    return changed.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("copies").alias("copies"))


def exact_groups(docs: DataFrame, digest_bits: int = 256, files_per_trigger: int = 100_000, state_path: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, those that go included. With a state path
    rows of earlier batches count in group_size and can be those that stay.

    digest_bits below 256 cuts the state's key short; results stay the same, as hits are compared."""
    spark, text = docs.sparkSession, normalised()
    root = (state_path or f"{scratch(spark)}/tessera/stream-{uuid.uuid4().hex}").rstrip("/")
    batch = batches_at(spark, root)
    if not state_path:
        swept(spark, root)
    rows = docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    # repeated rows of one doc_id are told apart by a tag
    key = F.struct(F.lit(batch).alias("batch"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.uuid().alias("tag"))
    table = staged(rows.select("doc_id", "text_sha256", F.substring("text_sha256", 1, digest_bits // 4).alias("digest"), key.alias("row_key")), "digests")
    kinds = T.StructType([table.schema["digest"], table.schema["row_key"]])
    table.select("digest", "row_key").write.parquet(f"{root}/digests/batch={batch}")
    state = keyed_state(spark, root, kinds, files_per_trigger) if table.take(1) else table.select("digest", F.col("row_key").alias("keep"), F.lit(1).cast("long").alias("copies"))
    # a digest of one row has that row alone; the others are hits
    hits = staged(state.filter("copies > 1").select(F.col("digest").alias("hit"), "keep", "copies"), "hits")
    out = table.join(few(hits, 256), F.col("digest") == F.col("hit"), "left").drop("hit")
    out = out.withColumns({"keep": F.coalesce("keep", "row_key"), "copies": F.coalesce("copies", F.lit(1).cast("long"))})
    hit_rows = staged(out.filter("copies > 1"), "hit-rows")
    bodies = _bodies(docs, hit_rows, text)
    if batch:  # texts of earlier batches that stay
        earlier = spark.read.schema(T.StructType([kinds["digest"], *bodies.schema.fields[1:]])).parquet(f"{root}/content/*")
        bodies = bodies.unionByName(earlier.join(few(hits.select(F.col("hit").alias("digest")), 128), "digest", "left_semi"))
    # equal bytes have one smallest and largest value; comparing both is comparing all rows
    clash = bodies.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most")).filter("least != most").select("digest")
    clash = staged(clash, "clashes")
    if clash.take(1):
        same = W.partitionBy("digest", "text_sha256")
        apart = hit_rows.join(clash, "digest", "left_semi").select("doc_id", "text_sha256", "digest", "row_key")
        older = bodies.join(clash, "digest", "left_semi").filter(F.col("row_key.batch") < batch).select("doc_id", "text_sha256", "digest", "row_key")
        apart = apart.unionByName(older).withColumns({"keep": F.min("row_key").over(same), "copies": F.count(F.lit(1)).over(same)}).filter(F.col("row_key.batch") == batch)
        out = out.join(clash, "digest", "left_anti").unionByName(apart.select(*out.columns))
    if state_path:
        new = staged(out.filter(F.col("row_key") == F.col("keep")).select(F.col("row_key.id").alias("new_id"), F.col("text_sha256").alias("new_sha"), "digest", "row_key"), "new")
        full = docs.select("doc_id", text.alias("body"), F.sha2(text.cast("binary"), 256).alias("text_sha256")).distinct()
        full = full.join(new, F.col("doc_id").eqNullSafe(F.col("new_id")) & (F.col("text_sha256") == F.col("new_sha")))
        full.select("digest", "doc_id", "text_sha256", "row_key", "body").write.parquet(f"{root}/content/batch={batch}")
    return out.select("doc_id", F.col("keep.id").alias("keep_id"), F.col("copies").alias("group_size"), (F.col("row_key") == F.col("keep")).alias("kept"), "text_sha256")


def _bodies(docs: DataFrame, hit_rows: DataFrame, text: Column) -> DataFrame:
    """digest, doc_id, text_sha256, row_key, body of the rows that are hit, read again by their identifiers."""
    wanted = hit_rows.select(F.col("doc_id").alias("m_id"), F.col("text_sha256").alias("m_sha"), "digest", "row_key").dropDuplicates(["m_id", "m_sha"])
    members = docs.join(few(wanted.select("m_id").distinct()), F.col("doc_id").eqNullSafe(F.col("m_id")), "left_semi").select("doc_id", text.alias("body"))
    members = members.withColumn("text_sha256", F.sha2(F.col("body").cast("binary"), 256))
    found = members.join(few(wanted, 256), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_sha256") == F.col("m_sha")))
    return found.select("digest", "doc_id", "text_sha256", "row_key", "body")


def exact_dedup(docs: DataFrame, state_path: str | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    columns = docs.columns
    groups = exact_groups(docs, state_path=state_path)
    repeated = bool(docs.groupBy("doc_id").count().filter("count > 1").take(1))
    gone = groups.groupBy("doc_id", "text_sha256") if repeated else groups
    gone = gone.agg(F.max("kept").alias("kept")) if repeated else gone
    gone = staged(gone.filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id"))
    if not repeated:
        return docs.join(few(gone.select("gone_id")), same, "left_anti").select(*columns)
    rows = docs.withColumn("row_sha", F.sha2(normalised().cast("binary"), 256)).join(few(gone, 192), same & (F.col("row_sha") == F.col("gone_sha")), "left_anti")
    order = W.partitionBy("doc_id", "row_sha").orderBy(F.xxhash64(*[F.col(c).cast("string") for c in columns]))
    return rows.withColumn("row_of_id", F.row_number().over(order)).filter("row_of_id = 1").select(*columns)
