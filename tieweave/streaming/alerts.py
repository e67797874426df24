"""Alerts from a stream of ties: a company that gives to a party and wins public contracts.

State is kept for each company: the newest gift and the newest contract, and whether it was
told of. When one half lands and the other half is no older (or newer) than ``expiry``, the loop is closed
and one alert goes out, once for each company. A half is forgotten when the stream's watermark is
past its date by ``expiry``, as nothing that may still come can close a loop with it, so the
state holds companies with a recent half, and a flag for those that were told of.

A stream that is started again goes on from its checkpoint; rows that land again change nothing,
as their company is flagged or their halves are the same. Rows later than the watermark are dropped.
Rows with a null company, date or kind are left out. A company's rows of one batch are sorted
in one task, so the size of a batch (``maxFilesPerTrigger``) bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TIES = "tie_id string, company_id string, kind string, at timestamp"
GIFT, CONTRACT = "DONATED_TO", "CONTRACTED_WITH"
CLOSED = "company_id string, closed_us long, tie_id string, other_id string, kind string"
ALERTS = "company_id string, closed_at timestamp, tie_id string, other_id string, kind string"
EXPIRY_DAYS = 180
#: Fixed value: Spark's provider of state that keeps timers and several states for each key.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS = 86_400_000


class ClosingLoops(StatefulProcessor):
    """Keeps the newest half of each kind; says once when the other half is there."""

    def __init__(self, expiry_days: int = EXPIRY_DAYS) -> None:
        self.expiry = expiry_days * _DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.halves = {k: handle.getValueState(f"newest_{k.lower()}", "tie_id string, at long") for k in (GIFT, CONTRACT)}
        self.told = handle.getValueState("told", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        if self.told.exists():
            return
        newest = {k: tuple(half) for k, s in self.halves.items() if (half := s.get()) is not None}
        changed = set()
        for us, tie_id, kind in sorted(((r.us, r.tie_id, r.kind) for r in rows), key=lambda x: (x[0] // 1000, x[1] is None, x[1] or "")):
            ms = us // 1000
            other = newest.get(CONTRACT if kind == GIFT else GIFT)
            if other and abs(ms - other[1]) <= self.expiry:
                self.told.update((ms,))
                for half in self.halves.values():
                    half.clear()
                yield Row(company_id=key[0], closed_us=max(us, other[1] * 1000), tie_id=tie_id, other_id=other[0], kind=kind)
                return
            if kind not in newest or (ms, tie_id) > newest[kind][::-1]:
                newest[kind] = (tie_id, ms)
                changed.add(kind)
        for kind in changed:
            self.halves[kind].update(newest[kind])
            self.handle.registerTimer(newest[kind][1] + self.expiry + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs()
        for half in self.halves.values():
            if half.exists() and half.get()[1] + self.expiry < now:
                half.clear()
        return iter(())

    def close(self) -> None:
        pass


def landed(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Ties as they land below ``path`` as Parquet, ``files`` at a time."""
    return spark.readStream.schema(TIES).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(path)


def closing_loops(stream: DataFrame, late: str = "30 days", expiry_days: int = EXPIRY_DAYS) -> DataFrame:
    """(company_id, closed_at, tie_id, other_id, kind): one row when a company's second half lands. stream: TIES.

    tie_id and kind are of the half that closed the loop, other_id is the newest of the other kind before it.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    sound = stream.where(F.col("company_id").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(GIFT, CONTRACT)).withWatermark("at", late)
    # As rows, as a frame and an Arrow batch for each alert cost more than all the rest. Times are numbers there, so no time zone matters.
    ties = sound.withColumn("us", F.unix_micros("at"))
    closed = ties.groupBy("company_id").transformWithState(ClosingLoops(expiry_days), outputStructType=CLOSED, outputMode="Append", timeMode="EventTime")
    return closed.select("company_id", F.timestamp_micros("closed_us").alias("closed_at"), "tie_id", "other_id", "kind")
