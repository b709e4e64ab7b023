"""What the operators of this subpackage share: the shared work folder, written
tables that cut lineage, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word definition, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a local one is
    made only where the setting is absent and Spark runs on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="feira-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/feira-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back. This cuts the
    lineage: a lost executor costs a re-read, never a recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the wanted columns, cast; one that is missing is null. Other columns,
    whatever their names, are left behind."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[
        (F.col(f"`{have[c]}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()
    ])


def join_hot(rows: DataFrame, table: DataFrame, key: str, hot: Column, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row per key. The table's rows that are hot
    (which the caller proves to be a few thousand at most) are broadcast, so the many
    rows of such a key stay where they are; all others are shuffled."""
    near = rows.join(F.broadcast(table.filter(hot).withColumn("hot", F.lit(True))), key, "left")
    far = near.filter("hot is null").select(*rows.columns).join(table.filter(~hot), key, how)
    return near.filter("hot").drop("hot").unionByName(far)


#: A key is hot if it has more than this part of all rows; so no more are hot.
HOT_KEYS = 2000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long edges -> (id, component) with the smallest id reachable.

    Alternating large-star and small-star steps; both move edges only, so no
    group of neighbours is ever gathered: the smallest neighbour comes from a
    partially aggregated minimum, written as a table, and a join. An edge is handled
    at its smaller end, which in a large group is one node; as both sides of that
    join are read as they are, Spark broadcasts the minima or splits the edges of
    such a node. The number of rounds grows with the logarithm of the longest chain
    (60 are enough for any table). Self-loops and nulls are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = materialize(e.filter("a <> b").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        least = materialize(e.groupBy("a").agg(F.min("b").alias("m")), "least")
        large = (e.join(least.withColumnRenamed("a", "b"), "b", "left")
                 .select("a", F.coalesce("m", "b").alias("b")).distinct())
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        e = materialize(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("connected components did not settle")
    return (e.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct())


def slices(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in slices that end at a space, of about `size` bytes; a word is never
    cut. A text of any length is so split into words a slice at a time."""
    at = 0
    while len(text) - at > size:
        end = text.find(b" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def arrow_schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])
