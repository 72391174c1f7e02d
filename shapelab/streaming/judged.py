"""How well a learned distance agrees with the answers that arrive, kept as state by dataset.

A dataset may have a third of all rows, so that its state is dealt over SLOTS keys by triplet: each keeps three sums,
nothing that grows. What a slot says are partial sums, and `totals` adds the latest of each.

Defined results: of a triplet that comes again within the time that rows may be late, the first row to arrive counts;
rows with a null dataset are one dataset of their own, rows with a null time, distance or answer don't count; a tie is B, as
everywhere. A slot that gets nothing for `idle` says its last sums with `final` and is forgotten; what arrives for it
later begins anew, under another `born`, and adds up with what was said before. A restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLOTS = 64
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = "dataset string, slot int, born long, n long, right long, separation double, final boolean"


class _Sums(StatefulProcessor):
    """n, right and separation (the sum of the distances' differences) of one slot."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "born long, last long, n long, right long, separation double")

    def _row(self, key, state, final: bool) -> pd.DataFrame:  # noqa: ANN001
        born, _, n, right, separation = state
        return pd.DataFrame({"dataset": [key[0]], "slot": [key[1]], "born": [born], "n": [n], "right": [right], "separation": [separation], "final": [final]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        old = tuple(self.sums.get()) if self.sums.exists() else None
        n, right, separation, last = (old[2], old[3], old[4], old[1]) if old else (0, 0, 0.0, 0)
        for part in rows:
            n, right, separation = n + len(part), right + int(part["hit"].sum()), separation + float(part["gap"].sum())
            last = max(last, int(part["at"].max()))
        state = (old[0] if old else last, last, n, right, separation)
        self.sums.update(state)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.sums.exists():
            state = tuple(self.sums.get())
            self.sums.clear()
            yield self._row(key, state, True)

    def close(self) -> None:
        pass


def judged(triplets: DataFrame, late: str = "1 hour", idle_ms: int = 86_400_000, slots: int = SLOTS) -> DataFrame:
    """A streaming table (dataset, ts, t, d_ab, d_ac, answer) to partial sums by dataset and slot, a row for each slot that got rows.

    Repeats are found by Spark before the state is asked; the session's state store has to be STORE. Append mode."""
    given = F.col("ts").isNotNull() & F.col("d_ab").isNotNull() & F.col("d_ac").isNotNull() & F.col("answer").isNotNull()
    rows = triplets.where(given).withWatermark("ts", late).dropDuplicatesWithinWatermark(["dataset", "t"])
    says = F.when(F.round("d_ab", 9) <= F.round("d_ac", 9), 1).otherwise(2)
    rows = rows.select("ts", "dataset", F.pmod(F.xxhash64("t"), F.lit(slots)).cast("int").alias("slot"), (says == F.col("answer")).cast("int").alias("hit"), F.abs(F.col("d_ab") - F.col("d_ac")).alias("gap"), F.unix_millis("ts").alias("at"))
    return rows.groupBy("dataset", "slot").transformWithStateInPandas(_Sums(idle_ms), _ROW, "Append", "EventTime")


def totals(said: DataFrame) -> DataFrame:
    """(dataset, n, accuracy, separation) from all rows that `judged` has said: sums only grow, so that the largest n is the latest."""
    last = said.groupBy("dataset", "slot", "born").agg(F.max(F.struct("n", "right", "separation")).alias("x"))
    sums = last.groupBy("dataset").agg(*[F.sum(f"x.{c}").alias(c) for c in ("n", "right", "separation")])
    return sums.select("dataset", "n", (F.col("right") / F.col("n")).alias("accuracy"), (F.col("separation") / F.col("n")).alias("separation"))
