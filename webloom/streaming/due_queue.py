"""Retries that wait: a queue of due times per domain, in keyed state with event-time timers.

A domain's items go out one at a time, earliest due first (ties by id, then attempt): an item starts at
the later of its due time and when the domain is free; the domain is free ``delay`` seconds later, or
after the pause that the answer asks for. A failed attempt comes back as a new item that is due after
its back-off, until its retries are used up.

State is the time when the domain is free and, per slot of ``SLOT`` seconds, the items due in it. A
timer fires when the watermark has passed a slot: no earlier item can come any more, so the slot's
items are final, and the schedule does not depend on how rows were dealt over micro-batches. A timer
reads the slots that are over, and no others.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship
from .crawl_stream import ROCKSDB

#: Seconds that a slot spans.
SLOT = 600
#: Rows that the queue reads: ``fails`` attempts fail, and each of them pauses the domain for ``pause``
#: seconds (0: not at all).
ITEMS = "domain string, id long, ts timestamp, due double, fails int, pause double"
STARTS = "domain string, id long, attempt int, due double, start double, failed boolean"


class DueQueue(StatefulProcessor):
    def __init__(self, delay: float, base: float, most: float, retries: int):
        self.delay, self.base, self.most, self.retries = delay, base, most, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.free = handle.getValueState("free", "v double")
        self.slots = handle.getMapState("slots", "slot long", "items string")

    def _add(self, items: list[tuple]) -> None:
        by: dict[int, list] = {}
        for item in items:
            by.setdefault(int(item[0] // SLOT), []).append(item)
        for slot, more in by.items():
            held = json.loads(self.slots.getValue((slot,))[0]) if self.slots.containsKey((slot,)) else []
            if not held:
                self.handle.registerTimer((slot + 1) * SLOT * 1000)
            self.slots.updateValue((slot,), (json.dumps(held + more),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self._add([(float(r.due), int(r.id), 0, int(r.fails), float(r.pause)) for r in batch.itertuples()])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = timerValues.getCurrentWatermarkInMs() // (SLOT * 1000)  # slots below this one are over
        free = self.free.get()[0] if self.free.exists() else float("-inf")
        ready, out, later = sorted(k[0] for k in self.slots.keys() if k[0] < over), [], []
        heap: list[tuple] = []
        while ready or heap:
            if ready and (not heap or ready[0] <= heap[0][0] // SLOT):
                slot = ready.pop(0)
                for item in json.loads(self.slots.getValue((slot,))[0]):
                    heapq.heappush(heap, tuple(item))
                self.slots.removeKey((slot,))
                continue
            due, id_, attempt, fails, pause = heapq.heappop(heap)
            start, failed = max(due, free), attempt < fails
            free = start + max(self.delay, pause if failed else 0.0)
            out.append((key[0], id_, attempt, due, start, failed))
            if failed and attempt < self.retries:
                again = (start + min(self.most, self.base * 2.0**attempt), id_, attempt + 1, fails, pause)
                if again[0] // SLOT < over:
                    heapq.heappush(heap, again)
                else:
                    later.append(again)
        self.free.update((free,))
        self._add(later)
        yield pd.DataFrame(out, columns=["domain", "id", "attempt", "due", "start", "failed"])

    def close(self) -> None:
        pass


def due_schedule(items: DataFrame, delay: float = 1.0, base: float = 1.0, most: float = 60.0, retries: int = 2, late: str = "0 seconds") -> DataFrame:
    """The stream ``items`` (ITEMS; due is never before ts) as starts (STARTS), in order per domain."""
    ship(items.sparkSession)
    items.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = items.withWatermark("ts", late).groupBy("domain")
    return rows.transformWithStateInPandas(statefulProcessor=DueQueue(delay, base, most, retries), outputStructType=STARTS, outputMode="Append", timeMode="EventTime")


def whole_schedule(items: DataFrame, folder: str, **options) -> DataFrame:
    """The schedule of a table of items: run as one stream that ends, over files in ``folder``."""
    spark = items.sparkSession
    end = items.agg((F.max("ts") + F.expr("INTERVAL 3650 DAYS")).alias("ts"))
    last = end.select(F.lit("").alias("domain"), F.lit(-1).cast("long").alias("id"), "ts", F.lit(0.0).alias("due"), F.lit(0).alias("fails"), F.lit(0.0).alias("pause"))
    items.select("domain", "id", "ts", "due", "fails", "pause").unionByName(last.where("ts is not null")).write.parquet(f"{folder}/items")
    stream = due_schedule(spark.readStream.schema(ITEMS).parquet(f"{folder}/items"), **options).where("id >= 0")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/starts").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(STARTS).parquet(f"{folder}/starts")
