"""Circuit breaker over a stream of outcomes, and its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window


def tripped(rows: DataFrame, key: str, order: list[str], failures: int = 5, seconds: int = 60) -> DataFrame:
    """Adds `tripped`: whether so many failures (`bad`) lie in the last seconds up to here, none before a success (`good`) counted.

    order[0] is the time, to the microsecond: a failure just over `seconds` ago doesn't count.
    """
    run = F.count_if(F.col("good")).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    recent = Window.partitionBy(key, "__run").orderBy("__at").rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("__run", run).withColumn("__at", F.unix_micros(F.col(order[0]).cast("timestamp"))).withColumn("tripped", F.count_if(F.col("bad")).over(recent) >= failures).drop("__run", "__at")


class Breaker(StatefulProcessor):
    """For transformWithStateInPandas: keeps the recent failures of a key, emits (key, at, open) when the breaker opens or shuts.

    A success clears it; `limited` opens it at once; `pause` seconds after it opened a timer shuts it.
    """

    def __init__(self, failures: int = 5, seconds: int = 60, pause: int = 300):
        self.failures, self.seconds, self.pause = failures, seconds, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at long")
        self.opened = handle.getValueState("opened", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failed = [r[0] for r in self.recent.get()]
        is_open, out = self.opened.exists(), []
        for at, status in sorted((int(a), s) for df in rows for a, s in zip(df["at"], df["status"], strict=True)):
            if status == "ok":
                failed = []
                if is_open:
                    is_open = False
                    out.append((key[0], at, False))
                continue
            failed = [x for x in failed if x > at - self.seconds] + [at]
            if not is_open and (status == "limited" or len(failed) >= self.failures):
                is_open = True
                self.opened.update((at,))
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.pause)
                out.append((key[0], at, True))
        if not is_open and self.opened.exists():
            self.opened.clear()
        self.recent.put([(x,) for x in failed]) if failed else self.recent.clear()
        yield pd.DataFrame(out, columns=["key", "at", "open"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.opened.exists():
            self.opened.clear()
            self.recent.clear()
            yield pd.DataFrame([(key[0], expiredTimerInfo.getExpiryTimeInMs() // 1000, False)], columns=["key", "at", "open"])

    def close(self) -> None:
        pass


def breaker_stream(rows: DataFrame, **limits) -> DataFrame:
    """rows: key string, at long (seconds), status string (ok, failed, limited). Needs the RocksDB state store."""
    return rows.groupBy("key").transformWithStateInPandas(Breaker(**limits), "key string, at long, open boolean", "Update", "ProcessingTime")
