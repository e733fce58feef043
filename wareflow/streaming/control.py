"""Streaming counterparts of the failure rate, the adaptive cap and the quota ledger, and the event sink.

State is per stage (its last outcomes, its cap) and per tenant and day (admitted products).  With ``kept_ms`` a day's state
goes when nothing has changed it for so long, so that state stays small however long a stream runs; such a query
keeps making micro-batches, so it is run with an available-now or a processing-time trigger.  Rows of one trigger are put in order by time and key before they change the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wareflow.plans.control import COOLDOWN, HARD, MIN_SAMPLE, QUOTA, SOFT, WINDOW, next_cap


class _Rates(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "outcomes array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        kept = list(self.last.get()[0]) if self.last.exists() else []
        n, rates = [], []
        for failed in pdf["failed"]:
            kept = [*kept, int(failed)][-WINDOW:]
            n.append(len(kept))
            rates.append(sum(kept) / len(kept) if len(kept) >= MIN_SAMPLE else None)
        self.last.update((kept,))
        yield pd.DataFrame({"event_id": pdf["event_id"], "stage": key[0], "n": n, "fail_rate": pd.Series(rates, index=pdf.index, dtype="float64")})

    def close(self) -> None:
        pass


def fail_rates(events: DataFrame) -> DataFrame:
    """Rates of a stream of signals (event_id, ts, stage, failed), one row a signal."""
    schema = "event_id long, stage long, n long, fail_rate double"
    return events.groupBy("stage").transformWithStateInPandas(_Rates(), schema, outputMode="Append", timeMode="None")


class _Caps(StatefulProcessor):
    """A stage's last outcomes, how many it has had, its cap, and whether the first jump is done."""

    def __init__(self, first: int, low: int, high: int, cooldown: int):
        self.first, self.low, self.high, self.cooldown = first, low, high, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stage", "outcomes array<int>, seq bigint, cap bigint, jumped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        kept, seq, cap, jumped = [], 0, self.first, False
        if self.state.exists():
            kept, seq, cap, jumped = self.state.get()
            kept = list(kept)
        offset, made = -(-MIN_SAMPLE // self.cooldown) - 1, []
        for failed in pdf["failed"]:
            kept, seq = [*kept, int(failed)][-WINDOW:], seq + 1
            if seq % self.cooldown == 0 and len(kept) >= MIN_SAMPLE:
                rate = sum(kept) / len(kept)
                cap, jumped = next_cap(cap, jumped, 2 if rate > HARD else 1 if rate >= SOFT else 0, self.low, self.high)
                made.append((key[0], seq // self.cooldown - offset, seq, rate, cap))
        self.state.update((kept, seq, cap, jumped))
        yield pd.DataFrame(made, columns=["stage", "decision", "seq", "fail_rate", "cap"])

    def close(self) -> None:
        pass


def caps(events: DataFrame, first: int = 8, low: int = 1, high: int = 64, cooldown: int = COOLDOWN) -> DataFrame:
    """(stage, decision, seq, fail_rate, cap): the decisions on a stream of signals (event_id, ts, stage, failed), as they fall.

    They are those of ``control.cap_path``.  ``control.LiveCaps`` takes them in ``foreachBatch`` and says what holds now.
    """
    schema = f"stage {dict(events.dtypes)['stage']}, decision long, seq long, fail_rate double, cap long"
    return events.groupBy("stage").transformWithStateInPandas(_Caps(first, low, high, cooldown), schema, outputMode="Append", timeMode="None")


class _Ledger(StatefulProcessor):
    def __init__(self, limit: int, kept_ms: int | None):
        self.limit, self.kept_ms = limit, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("day", "admitted array<bigint>, denied bigint, refunded bigint", ttlDurationMs=self.kept_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values(["ts", "key"])
        admitted, denied, refunded = (set(), 0, 0)
        if self.state.exists():
            before = self.state.get()
            admitted, denied, refunded = set(before[0]), before[1], before[2]
        for product, refund in zip(pdf["product"], pdf["refund"], strict=True):
            if refund and product in admitted:
                admitted.discard(product)
                refunded += 1
            elif not refund and product not in admitted:
                if len(admitted) < self.limit:
                    admitted.add(int(product))
                else:
                    denied += 1
        self.state.update((sorted(admitted), denied, refunded))
        yield pd.DataFrame({"tenant": [key[0]], "quota_day": [key[1]], "used": [len(admitted)], "denied": [denied], "refunded": [refunded]})

    def close(self) -> None:
        pass


def ledger(operations: DataFrame, limit: int = QUOTA, kept_ms: int | None = None) -> DataFrame:
    """The ledger of a stream of operations (tenant, quota_day as text, ts, key, product, refund), a row a change."""
    schema = "tenant long, quota_day string, used long, denied long, refunded long"
    return operations.groupBy("tenant", "quota_day").transformWithStateInPandas(_Ledger(limit, kept_ms), schema, outputMode="Update", timeMode="ProcessingTime" if kept_ms else "None")


def emit(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of events as JSON lines."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).start()


def finish(*queries: StreamingQuery) -> None:
    """Waits until all that has arrived is written, then stops: nothing is lost when the process ends."""
    for q in queries:
        q.processAllAvailable()
    for q in queries:
        q.stop()


def usage(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events and their sum by hour and kind; rows later than ``late`` are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
