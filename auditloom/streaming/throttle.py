"""The login throttle over a stream of attempts.

``login_failures`` keeps the exact rule of ``operators.attempts.login_failures`` in
state: failures of the last quarter of an hour since the last success.  A second of a
key is settled once the watermark has passed it, so rows may come late and in any
order, up to the lateness allowed; what comes later still is dropped.  The state of a
key is counts by second: at most those of the lateness and of the window, however
many attempts there are.  ``failing_keys`` is the coarser view of sliding windows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.attempts import MOST_FAILURES, WINDOW_SECONDS

LATE = "5 minutes"
#: State with timers needs this store (a fixed name); set by whoever makes the session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def failing_keys(attempts: DataFrame, seconds: int = WINDOW_SECONDS, slide: int = 60, most: int = MOST_FAILURES, late: str = LATE) -> DataFrame:
    """key, window start and end, failures of keys with at least ``most`` failures in a window (attempts: key, ts, failed)."""
    window = F.window("ts", f"{seconds} seconds", f"{slide} seconds")
    counted = attempts.where("failed").withWatermark("ts", late).groupBy("key", window.alias("w")).agg(F.count(F.lit(1)).alias("failures"))
    return counted.where(F.col("failures") >= most).select("key", F.col("w.start").alias("from"), F.col("w.end").alias("to"), "failures")


class _Throttle(StatefulProcessor):
    """Per key: attempts by second that are not settled, and failures by second since the last success."""

    def __init__(self, seconds: int, most: int):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "failed long, passed long")
        self.failures = handle.getMapState("failures", "at long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen: dict[int, list[int]] = {}
        for row in rows:
            seen.setdefault(row["at"], [0, 0])[0 if row["failed"] else 1] += 1
        for at, (failed, passed) in seen.items():
            if self.waiting.containsKey((at,)):
                before = self.waiting.getValue((at,))
                failed, passed = failed + before[0], passed + before[1]
            else:
                self.handle.registerTimer((at + 1) * 1000)  # its last row is due just before
            self.waiting.updateValue((at,), (failed, passed))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs() // 1000
        for at in sorted(k[0] for k in self.waiting.keys() if k[0] < due):
            failed, passed = self.waiting.getValue((at,))
            self.waiting.removeKey((at,))
            held = {k[0]: v[0] for k, v in self.failures.iterator()}
            kept = {} if passed else {t: n for t, n in held.items() if t >= at - self.seconds}  # a success starts the count anew
            for gone in held.keys() - kept.keys():
                self.failures.removeKey((gone,))
            if failed:
                kept[at] = failed
                self.failures.updateValue((at,), (failed,))
            count = sum(kept.values())
            yield Row(key=key[0], at=at, attempts=failed + passed, failures=count, locked=count >= self.most)

    def close(self) -> None:
        pass


def login_failures(attempts: DataFrame, seconds: int = WINDOW_SECONDS, most: int = MOST_FAILURES, late: str = LATE) -> DataFrame:
    """key, at (epoch second), attempts, failures, locked: a row for each second of a key with attempts, in append mode (attempts: key string, ts, failed)."""
    rows = attempts.withWatermark("ts", late).select(F.col("key").cast("string").alias("key"), "ts", F.unix_seconds("ts").alias("at"), F.coalesce("failed", F.lit(False)).alias("failed"))
    out = "key string, at long, attempts long, failures long, locked boolean"
    return rows.groupBy("key").transformWithState(_Throttle(seconds, most), out, "Append", "EventTime")
