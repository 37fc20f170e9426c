"""Streams with state by key: re-scans that keep what is known of unchanged files, and a cache whose entries expire.

Both are transformWithState processors, so their state is in the state store (RocksDB), dealt by key and restored from the
checkpoint; no micro-batch reads a table of everything that came before.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _prepare(spark: SparkSession) -> None:
    """RocksDB for the state; processors travel as a whole, as the runner that Spark starts beside the driver imports no files
    that were added to the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Rescan(StatefulProcessor):
    """The state of a path: its version and what is known of it. Rows come in the order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "version double, known string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        old = self.known.get() if self.known.exists() else None
        out = []
        for seq, version, tags, found in zip(batch["seq"], batch["version"], batch["tags"], batch["known"]):
            found = None if pd.isna(found) else found
            version = None if pd.isna(version) else float(version)
            if old is None:
                state = "added"
            elif version is not None and old[0] == version:
                state, found = "kept", found if found is not None else old[1]
            else:
                state = "replaced"
            old = (version, found)
            out.append((key[0], seq, version, tags, found, state))
        self.known.update(old)
        yield pd.DataFrame(out, columns=["path", "seq", "version", "tags", "known", "state"])

    def close(self) -> None:
        pass


def rescanned(scans: DataFrame) -> DataFrame:
    """path, seq, version, tags, known and state (added, kept or replaced) of every scanned row of a stream.

    scans: path, seq, version, tags and known (what this scan itself knows; may be null). A row of an unchanged version
    keeps what was known of its path, and its tags are the new ones; another version, or none, starts anew. Rows of a path
    are taken in the order of seq within a micro-batch, so the output doesn't depend on how a stream is cut into them, as
    long as they come in that order. A null path is left out.
    """
    _prepare(scans.sparkSession)
    rows = scans.where("path IS NOT NULL").select("path", F.col("seq").cast("long"), F.col("version").cast("double"), "tags", "known")
    return rows.groupBy("path").transformWithStateInPandas(Rescan(), "path string, seq long, version double, tags string, known string, state string", "Append", "None")


class Expiring(StatefulProcessor):
    """The state of a key: when it was put, its value, and whether that is null. A timer clears it once its time is over."""

    def __init__(self, ttl_s: float) -> None:
        self.ttl_ms = round(ttl_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "created long, value string, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch["at"] = batch["ts"].astype("datetime64[ms]").astype("int64")
        batch = batch.sort_values(["at", "seq"], kind="stable")
        old = self.held.get() if self.held.exists() else None
        was, out = old, []
        for seq, op, value, at in zip(batch["seq"], batch["op"], batch["value"], batch["at"]):
            value = None if pd.isna(value) else value
            if op == "put":
                if old is None or (at, seq) >= (old[0], old[2]):
                    old = (int(at), value, int(seq))
                continue
            live = old is not None and old[0] <= at and at - old[0] <= self.ttl_ms
            answer = "miss" if old is None or old[0] > at else "expired" if not live else "null" if old[1] is None else "hit"
            out.append((key[0], seq, answer, old[1] if live else None))
        if old is not None and old != was:
            self.held.update(old)
            if was is not None:
                self.handle.deleteTimer(was[0] + self.ttl_ms + 1)
            self.handle.registerTimer(old[0] + self.ttl_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "seq", "answer", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def cached(requests: DataFrame, ttl_s: float, late: str = "0 seconds") -> DataFrame:
    """key, seq, answer and value of every "get" of a stream of requests (key, seq, op, value, ts; op is put or get).

    answer: hit, or null for a cached null, where the last put is at most ttl_s old; expired where it is older and its state
    still there, miss where there is none. Requests of a key are answered in the order of ts, then seq, within a micro-batch.
    Those that come later than the watermark (late behind the newest ts) are dropped. Once it passes a put's end its state
    is cleared, after which a get is a miss; so the state holds live keys only.
    """
    _prepare(requests.sparkSession)
    rows = requests.where("key IS NOT NULL").select("key", F.col("seq").cast("long"), "op", "value", "ts").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Expiring(ttl_s), "key string, seq long, answer string, value string", "Append", "EventTime")
