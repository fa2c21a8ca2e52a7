"""What a cache with a time to live would have answered, as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphlore.streaming.events import drain

OUTCOME = "key string, at bigint, outcome string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Cache(StatefulProcessor):
    """State of a key: when its value was stored, in microseconds. A timer ends it."""

    def __init__(self, live: int):
        self.live = live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "at bigint")

    def _timer(self, stored: int) -> int:
        return -(-(stored + self.live) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self.stored.get()[0] if self.stored.exists() else None
        before, out = now, []
        # only times are held: those of one key in one micro-batch
        for at in sorted(t for frame in rows for t in frame["at"].tolist()):
            if now is not None and at < now + self.live:
                out.append((at, "hit"))
                continue
            if now is not None:
                out.append((now + self.live, "expired"))
            now = at
            out.append((at, "miss"))
        if now != before:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.stored.update((now,))
            self.handle.registerTimer(self._timer(now))
        yield pd.DataFrame([(str(key[0]), *x) for x in out], columns=["key", "at", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stored = self.stored.get()[0]
        self.stored.clear()
        yield pd.DataFrame([(str(key[0]), stored + self.live, "expired")], columns=["key", "at", "outcome"])

    def close(self) -> None:
        pass


def answered(requests: DataFrame, key: str, live_seconds: int, late: str = "10 minutes") -> DataFrame:
    """key, at, outcome of a stream of requests (``key``, ``ts``): hit or miss for each, and expired where a stored value ends.

    A miss stores a value that answers for ``live_seconds``. It expires at the
    next miss, or when the watermark, ``late`` behind the latest request, has
    passed its end. A request before the one that stored the value is a hit.
    Requests without a key share the key that is null's text.
    """
    timed = requests.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), F.col("ts").cast("timestamp").alias("ts")).filter(F.col("ts").isNotNull())
    timed = timed.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    made = timed.groupBy("k").transformWithStateInPandas(_Cache(live_seconds * 1_000_000), outputStructType=OUTCOME, outputMode="append", timeMode="eventTime")
    return made.select("key", F.timestamp_micros("at").cast("timestamp_ntz").alias("at"), "outcome")


def replay(requests: DataFrame, key: str, live_seconds: int, late: str = "10 minutes") -> DataFrame:
    """:func:`answered` run over all there is; its state lives in RocksDB on the executors' disks, with snapshots in the shared folder."""
    conf = requests.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:
        return drain(answered(requests, key, live_seconds, late), "cache")
    finally:
        conf.set(PROVIDER, before)
