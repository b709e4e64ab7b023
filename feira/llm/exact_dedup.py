"""Exact dedup with a log-structured merge index, in DataFrame operations only.

Every task's documents are a memtable: their digests are sorted where they are,
without a shuffle, and flushed as runs of at most so many rows, whose Parquet files
carry min/max statistics and Bloom filters on the digest. Compaction merges all runs
of an index into one, sorted by digest, with a single identifier and a count for
each; it is an index again, to which later runs can be flushed. Digests with more
than one document are hits, and each hit is verified on the bytes: the smallest and
the largest text of its group must be the same string. A hit that fails (a digest
collision) is settled by grouping on the text itself.

The documents' own digests are read from the runs, so texts are hashed once, and
again only where a hit may have to be verified. No step gathers a group: compaction
and verification are partial aggregates, and a digest with a third of all rows is
broadcast to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, join_hot, materialize, new_path, with_columns

RUN = "digest binary, keep_id long, n long"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and its SHA-256 as 32 bytes."""
    d = with_columns(docs, {"doc_id": "long", "text": "string"})
    d = d.withColumn("text", F.coalesce("text", F.lit("")))
    return d.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _write_run(rows: DataFrame, index: str, memtable_rows: int) -> None:
    (rows.sortWithinPartitions("digest").write.mode("append")
     .option("maxRecordsPerFile", str(memtable_rows))
     .option("parquet.bloom.filter.enabled#digest", "true")
     .option("parquet.bloom.filter.expected.ndv#digest", str(memtable_rows))
     .option("parquet.bloom.filter.adaptive.enabled", "true").parquet(index))


def flush(docs: DataFrame, index: str, memtable_rows: int = 1_000_000) -> str:
    """Append the documents' digests to the index as sorted runs of at most
    memtable_rows rows, as many as the rows need."""
    _write_run(digests(docs).select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")), index, memtable_rows)
    return index


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """All rows of all runs: digest, keep_id, n."""
    return spark.read.schema(RUN).parquet(index)


def compact(spark: SparkSession, index: str, memtable_rows: int = 1_000_000) -> str:
    """Merge all runs of an index into a new one, with one row for each digest: the
    largest identifier and the sum of counts. Its folder is returned."""
    merged = read_index(spark, index).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    to = new_path(spark, "lsm")
    _write_run(merged, to, memtable_rows)
    return to


def lookup(spark: SparkSession, index: str, digest: bytes) -> DataFrame:
    """What the runs have of one digest; row groups are skipped by statistics and filters."""
    return read_index(spark, index).filter(F.col("digest") == F.lit(bytearray(digest)))


def verify(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests among the hits whose documents are not all the same bytes (none,
    unless the digest collides)."""
    texts = digests(docs).join(F.broadcast(hits.select("digest")) if _small(hits) else hits.select("digest"), "digest", "left_semi")
    ends = texts.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    return ends.filter("lo <> hi").select("digest")


def _small(hits: DataFrame, rows: int = 100_000) -> bool:
    """Hits are broadcast only when counted to be few (32 bytes each)."""
    return hits.count() <= rows


def exact_dedup(docs: DataFrame, memtable_rows: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts (no normalisation; null counts as empty) form a group, of which
    the largest doc_id stays. Rows that repeat a doc_id and text are one group:
    each such row is returned and all rows of the kept id have kept = true. A
    null doc_id never wins against a number; a group of null ids has keep_id null
    and kept false. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    index = flush(docs, new_path(spark, "lsm"), memtable_rows)
    hits = read_index(spark, compact(spark, index, memtable_rows)).filter("n > 1").withColumnRenamed("n", "group_size")
    collided = materialize(verify(docs, hits), "collided")
    slim = read_index(spark, index).select(F.col("keep_id").alias("doc_id"), "digest")
    if not collided.isEmpty():
        bad = digests(docs).join(collided, "digest", "left_semi")
        exact = bad.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = bad.join(exact, ["digest", "text"]).select("digest", "doc_id", "keep_id", "group_size")
        slim, hits = slim.join(collided, "digest", "left_anti"), hits.join(collided, "digest", "left_anti")
    hot = F.col("group_size") > max(1.0, slim.count() / HOT_KEYS)
    slim = join_hot(slim, hits, "digest", hot, "left")
    if not collided.isEmpty():
        slim = slim.unionByName(apart)
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return slim.select(
        "doc_id", keep.alias("keep_id"), size.alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
