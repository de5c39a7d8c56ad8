"""Streaming homes of crawl state: pacing slots, retry timers, robots cache, frontier dedup.

Keyed state lives in ``transformWithStateInPandas`` (RocksDB state store); the handlers of one
domain see its requests in arrival order within a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.url import normalize_url
from ..shipping import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pacer(StatefulProcessor):
    """Rows (domain, seq, arrive, delay, pause_until) to (domain, seq, start, waited).

    State: the next free slot and until when the domain rests. Idle state goes by time to live.
    """

    ttl_ms: int | None = 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        kwargs = {"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}
        self.free = handle.getValueState("free", "v double", **kwargs)
        self.rest = handle.getValueState("rest", "v double", **kwargs)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        free = self.free.get()[0] if self.free.exists() else float("-inf")
        rest = self.rest.get()[0] if self.rest.exists() else float("-inf")
        batch = pd.concat(list(rows)).sort_values("seq")
        out = []
        for r in batch.itertuples():
            start = max(r.arrive, free, rest)
            free = start + r.delay
            out.append((key[0], r.seq, start, start - r.arrive))
            if not pd.isna(r.pause_until):
                rest = max(rest, r.pause_until)
        self.free.update((free,))
        self.rest.update((rest,))
        yield pd.DataFrame(out, columns=["domain", "seq", "start", "waited"])

    def close(self) -> None:
        pass


class RetryTimers(StatefulProcessor):
    """Rows (url, delay_ms) are given back as (url, attempt) when their time has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getValueState("attempts", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for batch in rows:
            for delay in batch["delay_ms"]:
                self.handle.registerTimer(int(now + delay))
        n = self.attempts.get()[0] if self.attempts.exists() else 0
        self.attempts.update((n + 1,))
        yield pd.DataFrame({"url": pd.Series(dtype=str), "attempt": pd.Series(dtype="int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"url": [key[0]], "attempt": [self.attempts.get()[0]]})

    def close(self) -> None:
        pass


class RobotsCache(StatefulProcessor):
    """Per origin the last robots text for an hour: rows (origin, url, body) to (url, body).

    A row with a body refreshes the cache; one without gets what is cached.
    """

    ttl_ms = 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.body = handle.getValueState("body", "v string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        fresh = batch["body"].dropna()
        if len(fresh):
            self.body.update((fresh.iloc[-1],))
        body = self.body.get()[0] if self.body.exists() else None
        asked = batch[batch["url"].notna()]
        yield pd.DataFrame({"url": asked["url"], "body": [body] * len(asked)}, columns=["url", "body"])

    def close(self) -> None:
        pass


def _stateful(df: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")


def paced(requests: DataFrame) -> DataFrame:
    return _stateful(requests, "domain", Pacer(), "domain string, seq long, start double, waited double")


def retried(failures: DataFrame) -> DataFrame:
    return _stateful(failures, "url", RetryTimers(), "url string, attempt int")


def with_robots(rows: DataFrame) -> DataFrame:
    return _stateful(rows, "origin", RobotsCache(), "url string, body string")


def new_urls(found: DataFrame) -> DataFrame:
    """Streaming first-wins frontier: each (job_id, normalized_url) passes once. State is unbounded
    by design; ``withWatermark`` + ``dropDuplicatesWithinWatermark`` bounds it where that will do."""
    rows = found.withColumn("normalized_url", normalize_url("url")).where("normalized_url is not null")
    return rows.dropDuplicates(["job_id", "normalized_url"])


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: event-time counts with a watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", length), "event_type").count()
