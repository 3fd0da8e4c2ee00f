"""Streams: counts in event-time windows, sessions, and snapshots that arrive as files."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.materialize import shared_folder


def window_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n, total) per tumbling window; rows later than `late` behind the greatest time seen are left out."""
    return (
        stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), key, "n", "total")
    )


def session_counts(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n): a session ends where `gap` passes without a row."""
    return (
        stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
    )


def run_available(spark: SparkSession, result: DataFrame, name: str, keys: list[str], root: str | None = None) -> DataFrame:
    """Takes in all files there are, then ends. Each batch's changed rows are written to the shared folder under its
    number (a batch done again writes the same folder), and the last row of each key is read back.
    With a lasting `root`, a later call goes on from where this one ended."""
    root = root or f"{shared_folder(spark)}/cladeframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    write: Callable[[DataFrame, int], None] = lambda df, k: df.write.mode("overwrite").parquet(f"{root}/rows/batch={k}")
    q = result.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{root}/rows")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*keys, "x.*")


class _Versions(StatefulProcessor):
    """Of one key: the hashes of its rows in the last snapshot, with their numbers, and that snapshot's time."""

    def __init__(self, at: str, h: str):
        self.at, self.h = at, h

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "h string", "n long")
        self.last = handle.getValueState("last", "at long")

    def _told(self, key: tuple, at: int, old: Counter, new: Counter) -> list[tuple]:
        same = (old & new).total()
        lost, found = old.total() - same, new.total() - same
        changed = min(lost, found)
        ops = {"same": same, "chg": changed, "gone": lost - changed, "new": found - changed}
        return [(*key, pd.Timestamp(at, unit="ms"), op, n) for op, n in ops.items() if n]

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows)

    def _old(self) -> Counter:
        return Counter({k[0]: v[0] for k, v in self.held.iterator()})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        snapshots: dict[int, Counter] = {}
        for part in rows:
            for at, h in zip(part[self.at], part[self.h]):
                snapshots.setdefault(int(pd.Timestamp(at).value // 10**6), Counter())[h] += 1
        old, out, seen = self._old(), [], timerValues.getCurrentWatermarkInMs()
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None and seen > last:  # a snapshot went by without the key
            out, old = self._told(key, seen, old, Counter()), Counter()
        if last is not None:
            self.handle.deleteTimer(last + 1)
        for at in sorted(snapshots):
            out += self._told(key, at, old, snapshots[at])
            old = snapshots[at]
        self.held.clear()
        for h, n in old.items():
            self.held.updateValue((h,), (n,))
        self.last.update((at,))
        self.handle.registerTimer(at + 1)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._told(key, timerValues.getCurrentWatermarkInMs(), self._old(), Counter())
        self.held.clear()
        self.last.clear()
        yield from self._frame(out)

    def close(self) -> None:
        pass


#: Where transformWithState keeps its state.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def snapshot_operations(stream: DataFrame, keys: list[str], at: str, h: str) -> DataFrame:
    """(*keys, at, op, n): what each arriving snapshot makes of each key's rows, n of them the same, changed, gone or new, as
    snapshot_diff pairs them. A snapshot is all rows of one time `at`, and comes in one batch, later ones in later batches.

    A key is held with the hashes `h` of its rows alone, and each key by itself. One that a snapshot lacks is told of as
    gone once the watermark shows that snapshot's time. Null keys and hashes are empty ones."""
    own = stream.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], F.col(at).cast("timestamp").alias(at), F.coalesce(F.col(h).cast("string"), F.lit("")).alias(h))
    shape = ", ".join([*[f"`{k}` string" for k in keys], f"`{at}` timestamp", "op string", "n long"])
    return own.withWatermark(at, "0 seconds").groupBy(*keys).transformWithStateInPandas(_Versions(at, h), shape, "Append", "eventTime")
