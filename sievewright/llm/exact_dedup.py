"""Exact dedup by stateful streaming: keyed state on disk, without expiry, and a full-byte check of every hit.

One stream turns documents into keys (digest of the normalised text, identifier, and the locator: file and row), which
a file sink keeps. A second stream folds the keys into a RocksDB-backed aggregation by digest. For each digest the state
retains the stable identifier and the locator of the row that stays, and the size of the group; texts never enter
it. Both streams have their checkpoint in one folder: a later run over a grown table reads the new files only and goes
on from the state that is there, and a restart after a failure does the same.

A hit is a row whose digest occurs more than once. The texts of hits alone are fetched again, by their locators, and
rows collapse by (digest, bytes) map-side before they are shuffled, so a group of any size costs one row a task. Digests
under which several texts meet are decided again by the bytes themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_folder

#: The characters `[\x20\x09-\x0D]` that equality ignores.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Locators of hits that are broadcast at most (8 bytes each); more of them are joined by a shuffle. The rows fetched are the same.
HITS_BROADCAST = 1 << 19
#: Groups that are broadcast at most: those with more than one row in so many.
GREAT_GROUPS = 20_000


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _grouped(keys: DataFrame, *by: str) -> DataFrame:
    """The row that stays, the least by (code points downward, null identifier, identifier, locator), and the size of the group."""
    rank = F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    return keys.groupBy(*by).agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.length(F.coalesce(text, F.lit(""))).alias("n"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.sha2(squeezed(text), 256).alias("sha"),
    )


def _to_the_end(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest_hex: int = 64, state_dir: str | None = None, hits_broadcast: int = HITS_BROADCAST) -> DataFrame:
    """One row per document of the Parquet table at `path`: doc_id, keep_id, group_size, kept, text_sha256, and where the kept row lies (keep_file, keep_row).

    Texts are equal when identical without white space. Null is empty, and empty texts are equal to each other. Of
    equal texts the row with the most code points stays, then the smallest doc_id. A repeated row counts in its group
    and is kept if its doc_id is. Ids may be of any type that has an order; a null doc_id loses against any other. Other
    columns are never read, whatever their names. An empty table gives no rows.

    state_dir: the folder of keys and state, shared by driver and executors. A table may grow by further files between
    runs with the same folder, which then go on from its state; files that were read mustn't change. By default each
    run has a folder of its own below spark.checkpoint.dir. digest_hex: hex digits of the digest used as the key (the
    result doesn't depend on it; tests shorten it to force collisions).
    """
    batch = spark.read.parquet(path)
    session = spark.newSession()
    for key, value in {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition reserves MB of disk
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }.items():
        session.conf.set(key, value)
    folder = state_dir or shared_folder(spark, "exact-dedup")
    sources = _keyed(batch, id_col, text_col)
    arriving = _keyed(session.readStream.schema(batch.schema).parquet(_as_glob(path)), id_col, text_col)
    _to_the_end(arriving.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/keys"), f"{folder}/keys-checkpoint")
    if not _exists(spark, f"{folder}/keys"):  # a table without files
        return _decided(sources.join(_grouped(sources, "sha"), "sha"))

    digest = F.substring("sha", 1, digest_hex).alias("digest")
    known = session.readStream.schema(sources.schema).parquet(f"{folder}/keys").select("*", digest)
    state = _grouped(known, "digest")
    _to_the_end(state.writeStream.format("noop").outputMode("update"), f"{folder}/state")
    keys = spark.read.schema(sources.schema).parquet(f"{folder}/keys").select("*", digest)
    if not _exists(spark, f"{folder}/state/state/0"):  # files without rows
        return _decided(keys.join(_grouped(keys, "digest"), "digest"))
    # read once: tasks that read one partition of the state at a time wait for each other
    rows = _with_group(keys, materialize(_read_state(spark, f"{folder}/state"), "exact-groups"))

    hits = rows.filter("group_size > 1").select(F.xxhash64("file", "row").alias("hit"))
    at = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("hit")
    texts = batch.select(at, squeezed(F.col(f"`{text_col}`")).alias("norm"), F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("n"), F.col(f"`{id_col}`").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    fetched = texts.join(F.broadcast(hits) if hits.count() <= hits_broadcast else hits, "hit", "left_semi").withColumn("sha", F.sha2("norm", 256)).select("*", digest)
    several = fetched.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("c")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    if several.isEmpty():
        return _decided(rows)
    clear = rows.join(several, "digest", "left_anti").select("doc_id", "sha", "best", "group_size")
    mixed = fetched.join(several, "digest", "left_semi")
    again = mixed.join(_grouped(mixed, "digest", "norm"), ["digest", "norm"]).select("doc_id", "sha", "best", "group_size")
    return _decided(clear.unionByName(again))


def _as_glob(path: str) -> str:
    """A pattern that only `path` matches: a stream takes a single file by a pattern alone."""
    return f"{path[:-1]}[{path[-1]}]"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The groups as the stream left them on disk."""
    stored = spark.read.format("statestore").load(checkpoint)
    fields = stored.schema["value"].dataType.names
    return stored.select(F.col("key").getField(stored.schema["key"].dataType.names[0]).alias("digest"), F.col("value").getField(fields[0]).alias("best"), F.col("value").getField(fields[1]).alias("group_size"))


def _with_group(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """Each key with its group. Great groups are broadcast, GREAT_GROUPS of them at most, so no key of the shuffle is hot."""
    limit = max(1000, keys.count() // GREAT_GROUPS)
    great, small = groups.filter(F.col("group_size") > limit), groups.filter(F.col("group_size") <= limit)
    rest = keys.join(F.broadcast(great.select("digest")), "digest", "left_anti")
    return rest.join(small, "digest").unionByName(keys.join(F.broadcast(great), "digest"))


def _decided(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("best.file").alias("keep_file"),
        F.col("best.row").alias("keep_row"),
    )
