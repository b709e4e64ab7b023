"""A training corpus from raw documents: STAGES, each written as Parquet and read
again as the next one's documents. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm import bpe, exact_dedup, langid, minhash, mixing
from feira.llm.common import materialize, new_path
from feira.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """The documents with a key of their own in each row, written once: ids may be
    null or repeated, so decisions are taken and applied by row. mark orders the
    texts of one id. Zstandard, as this is one more copy of the texts on disk."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, f"{name}-rows")
    d = docs.select(*COLUMNS).withColumn("mark", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    d.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(d.schema).parquet(path)


def by_row(rows: DataFrame) -> DataFrame:
    """What an operator sees: the row key in the place of the id."""
    return rows.select(F.col("row").alias("doc_id"), "text")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows that stay. The keys that go are written first, so Spark knows their
    true size and moves no text if they are few."""
    dropped = materialize(dropped, "dropped")
    return rows.join(dropped, "row", "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those of none (`und`) go."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"), 4, 2)))
    # the rows themselves go through the operator, so nothing is joined back
    types = dict(docs.select(*COLUMNS).dtypes)
    carry = {c: types[c] for c in COLUMNS if c != "doc_id"}
    return langid.predict(docs, model, carry).filter(F.col("lang_pred") != langid.UND).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row: that with the largest id (null ids come last), of
    rows of one id the largest by the other columns."""
    rows = keyed(docs, "exact")
    groups = (exact_dedup.exact_dedup(by_row(rows)).filter("group_size > 1")
              .select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group")))
    groups = materialize(groups.join(rows.drop("text", "mark"), "row"), "exact-groups")
    best = groups.groupBy("group").agg(F.max(F.struct("doc_id", "lang", "source", "n_chars", "row")).alias("best"))
    return without(rows, groups.select("row").join(best.select("best.row"), "row", "left_anti"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (of five-word shingles, 0.8 or more
    alike): that with the smallest id (null ids come last), of rows of one id the
    smallest by text hash and the other columns."""
    rows = keyed(docs, "near")
    groups = minhash.near_dedup(by_row(rows)).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    groups = materialize(groups.join(rows.drop("text"), "row"), "near-groups")
    best = groups.groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "lang", "source", "n_chars", "row")).alias("best"))
    return without(rows, groups.select("row").join(best.select("best.row"), "row", "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes (none to two); documents
    without a word, which no target can count, are left as they are. Rows that agree
    in id, source and text (none, after exact) get the same number of copies; null ids take part."""
    same = ("doc_id", "source", "size", "u")
    copies = mixing.mix(docs).groupBy(*same).agg(F.min("copies").alias("copies"))
    copies = copies.withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int")).filter("copies > 0")
    d = docs.select(*COLUMNS).withColumns({"size": mixing.word_count(F.col("text")), "u": mixing.uniform(F.col("doc_id"), F.col("text"))}).alias("d")
    on = F.expr(" and ".join(f"d.{c} <=> m.{c}" for c in same))
    return (d.join(copies.alias("m"), on).select(*(f"d.{c}" for c in COLUMNS), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
            .select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of ids and decoded text."""
    return bpe.bpe(docs, vocabulary(), keep_ids=False)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("bpe", encode)]

#: The first, third and last stage can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
