"""Incremental jobs on Structured Streaming; each has a batch twin among the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions import text as T
from ..plans import price_store
from ..sources import versions
from ..sources.versions import Change

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_upsert_prices(spark: SparkSession, source: str, schema, root: str, checkpoint: str, unit: str = "day") -> None:
    """Take all new files under source into the versioned prices and history (see
    plans/price_store.py), a commit for each micro-batch. A batch that is repeated after
    a failure changes nothing if it was committed, and is done whole if not."""
    def upsert(batch: DataFrame, number: int) -> None:
        price_store.store_prices(batch.sparkSession, root, batch, ("stream_upsert_prices", number), unit)

    (spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


class _Streak(StatefulProcessor):
    """Failures of a store since its last success. State: the last success and how many
    failures after it are settled (too old for a success before them to come); the
    failures that are not settled, one by one. Timers: when the watermark passes open
    failures they are settled; a store without a run for `forget` days is forgotten."""

    OK = "started_at timestamp, id long, settled int, newest timestamp"
    OPEN = "started_at timestamp, id long"

    def __init__(self, threshold: int, forget: int):
        self.threshold, self.forget = threshold, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ok, self.open = handle.getValueState("ok", self.OK), handle.getListState("open", self.OPEN)

    def _load(self) -> tuple[tuple, int, pd.Timestamp | None, list[tuple]]:
        at, id_, settled, newest = self.ok.get() if self.ok.exists() else (None, None, 0, None)
        return (pd.Timestamp.min if at is None else at, -1 if id_ is None else id_), settled, newest, list(self.open.get()) if self.open.exists() else []

    def _save(self, ok: tuple, settled: int, newest, failures: list[tuple]) -> None:
        self.ok.update((*(ok if ok[0] != pd.Timestamp.min else (None, None)), settled, newest))
        if failures:
            self.open.put(failures)
        else:
            self.open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ok, settled, newest, failures = self._load()
        for pdf in rows:
            for at, id_, good, counts in pdf[["started_at", "id", "good", "counts"]].itertuples(index=False):
                newest = at if newest is None else max(newest, at)
                if good and (at, id_) > ok:
                    ok, settled = (at, id_), 0  # settled failures are older than any run still to come
                elif counts:
                    failures.append((at, id_))
        failures = [x for x in failures if x > ok]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        # runs of any older time are late, and dropped before they get here
        if failures:
            self.handle.registerTimer(int(min(failures)[0].timestamp() * 1000) + 1)
        self.handle.registerTimer(int(newest.timestamp() * 1000) + self.forget * 86_400_000)
        self._save(ok, settled, newest, failures)
        streak = settled + len(failures)
        yield pd.DataFrame({"store_name": [key[0]], "streak": [streak], "disabled": [streak >= self.threshold]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ok, settled, newest, failures = self._load()
        past = timerValues.getCurrentWatermarkInMs()
        if newest is not None and newest.timestamp() * 1000 + self.forget * 86_400_000 <= past:
            self.ok.clear()
            self.open.clear()
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        else:
            old = [x for x in failures if x[0].timestamp() * 1000 < past]
            failures = [x for x in failures if x[0].timestamp() * 1000 >= past]
            if failures:
                self.handle.registerTimer(int(min(failures)[0].timestamp() * 1000) + 1)
            self._save(ok, settled + len(old), newest, failures)
        return iter(())

    def close(self) -> None:
        pass


def stream_failure_streak(logs: DataFrame, threshold: int = 3, late: str = "30 days", forget: int = 365) -> DataFrame:
    """A stream of runs (id, store_name, status, reason, started_at) -> store_name,
    streak, disabled: failures since the last success, whatever the order in which runs
    come, if none comes more than `late` behind the newest (those are dropped).
    Transient errors neither count nor end a streak. A store is forgotten `forget` days
    after its last run. State is kept in RocksDB, which this sets in the session."""
    logs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    fail = F.coalesce(F.col("status").isin("error", "failed"), F.lit(False))
    x = logs.filter("store_name is not null and started_at is not null").withColumn("started_at", F.col("started_at").cast("timestamp")).withWatermark("started_at", late).select(
        "store_name", "started_at", F.coalesce("id", F.lit(0)).cast("long").alias("id"), (~fail).alias("good"), (fail & ~T.is_transient(T.classify_error(F.col("reason")))).alias("counts"))
    kind = dict(x.dtypes)["store_name"]
    out = StructType.fromDDL(f"store_name {kind}, streak int, disabled boolean")
    return x.groupBy("store_name").transformWithStateInPandas(_Streak(threshold, forget), out, "Update", "EventTime")


def run_to_table(updates: DataFrame, root: str, name: str, checkpoint: str) -> None:
    """Take what is there of a stream of updates (one row a key in each batch) into a
    versioned table keyed by the first column: a commit of the changed rows a batch."""
    keys = (updates.columns[0],)

    def put(batch: DataFrame, number: int) -> None:
        versions.commit(batch.sparkSession, root, {name: Change(batch, keys=keys, unit="all")}, (f"stream {name}", number))

    updates.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_queue(spark: SparkSession, source: str, schema, output: str, checkpoint: str) -> None:
    """Turn new pending rows under source into processed ones, once each."""
    done = (spark.readStream.schema(schema).parquet(source).filter("status = 'pending'")
            .withColumn("status", F.lit("processed")))
    done.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_errors(logs: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Errors by store and window of a stream with a watermark."""
    e = logs.filter(F.col("status").isin("error", "failed")).withWatermark("started_at", late)
    return e.groupBy(F.window("started_at", f"{minutes} minutes"), "store_name").agg(F.count("*").alias("errors"))
