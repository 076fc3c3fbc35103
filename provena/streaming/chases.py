"""Chases for missing documents as timers in event time (J08) behind a state machine.

Moves (chase_id, at, move) come in any order within the watermark's delay: ``ask`` opens a chase, ``answer`` and
``cancel`` end it. While it is open a timer runs: ``WAIT`` days after the request the first reminder is due, the next
ones as long after each other, then it is escalated, and ``LATE`` days after the request it is given up. A move that the
state doesn't allow changes nothing and goes to the side output. Timers and states live in RocksDB and survive
restarts. :func:`chase_timeline` is the same for a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Days (fixed values of this engine): between steps, and until a chase is given up; reminders before it escalates.
WAIT, LATE, REMINDERS = 6, 30, 2
#: What a move does in a state; other moves are illegal.
MOVES = {("none", "ask"): "open", ("open", "answer"): "answered", ("open", "cancel"): "cancelled", ("escalated", "answer"): "answered", ("escalated", "cancel"): "cancelled", ("given_up", "ask"): "open"}
OUTPUT = "chase_id string, at timestamp, step string, state string, reminders int, legal boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = 86_400_000


def next_due(asked_ms: int, reminders: int, escalated: bool) -> int:
    """When the next step of an unanswered chase is due."""
    return asked_ms + _DAY * (LATE if escalated else WAIT * (reminders + 1))


class Chase(StatefulProcessor):
    """One chase: a value of its state, a list of its steps, and one timer for its next step."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, asked bigint, reminders int, due bigint")
        self.steps = handle.getListState("steps", "at bigint, step string")

    def _get(self) -> tuple[str, int, int, int]:
        held = self.now.get() if self.now.exists() else None
        return tuple(held) if held is not None else ("none", 0, 0, 0)

    def _put(self, state: str, asked: int, reminders: int, due: int) -> None:
        before = self._get()[3]
        if before and before != due:
            self.handle.deleteTimer(before)
        if due and before != due:
            self.handle.registerTimer(due)
        self.now.update((state, asked, reminders, due))

    def _rows(self, key, made: list[tuple]) -> pd.DataFrame:
        for at, step, _, _, legal in made:
            if legal:
                self.steps.appendValue((at, step))
        when = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)
        return pd.DataFrame({"chase_id": [key[0]] * len(made), "at": pd.to_datetime([when(m[0]) for m in made]), "step": [m[1] for m in made], "state": [m[2] for m in made], "reminders": pd.array([m[3] for m in made], "int32"), "legal": [m[4] for m in made]})

    def _due_step(self) -> tuple:
        """Take the step that is due now."""
        state, asked, reminders, due = self._get()
        if state == "escalated":
            self._put("given_up", asked, reminders, 0)
            return due, "give_up", "given_up", reminders, True
        if reminders < REMINDERS:
            self._put("open", asked, reminders + 1, next_due(asked, reminders + 1, False))
            return due, "remind", "open", reminders + 1, True
        self._put("escalated", asked, reminders, next_due(asked, reminders, True))
        return due, "escalate", "escalated", reminders, True

    def _passed(self, timerValues) -> list[tuple]:  # noqa: N803
        """Take all steps that the watermark has passed: a timer set for a time before it fires in no later batch for sure."""
        made = []
        while 0 < self._get()[3] <= timerValues.getCurrentWatermarkInMs():
            made.append(self._due_step())
        return made

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        made = self._passed(timerValues)  # rows come before the timers of their batch
        moves = sorted((int(m.at_ms), m.move) for frame in rows for m in frame.itertuples(index=False))
        for at, move in moves:
            state, asked, reminders, _ = self._get()
            to = MOVES.get((state, move))
            if to is None or (asked and at < asked):
                made.append((at, move, state, reminders, False))
            elif to == "open":
                self._put("open", at, 0, next_due(at, 0, False))
                made.append((at, move, "open", 0, True))
            else:
                self._put(to, asked, reminders, 0)
                made.append((at, move, to, reminders, True))
        if made:
            yield self._rows(key, made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        made = self._passed(timerValues)
        if made:
            yield self._rows(key, made)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keep stream states in RocksDB, which timers and list states need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def chases(moves: DataFrame, delay: str = "1 day") -> DataFrame:
    """The steps of streamed moves (chase_id, at, move), legal ones and others (``legal`` false: the side output)."""
    rows = moves.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy("chase_id").transformWithStateInPandas(statefulProcessor=Chase(), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime")


def chase_timeline(chases: DataFrame, until: Column) -> DataFrame:
    """(chase_id, at, step): all steps up to the day ``until`` of chases (chase_id, asked_on, answered_on or null).

    Reminders, escalation and giving up stand at their days unless the answer came on or before that day.
    """
    due = [*[("remind", WAIT * (n + 1)) for n in range(REMINDERS)], ("escalate", WAIT * (REMINDERS + 1)), ("give_up", LATE)]
    plan = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(d).alias("days")) for s, d in due])
    open_ = F.filter(F.transform(plan, lambda p: F.struct(p["step"].alias("step"), F.date_add("asked_on", p["days"]).alias("at"))), lambda p: F.col("answered_on").isNull() | (p["at"] < F.col("answered_on")))
    given_up = F.date_add("asked_on", LATE)
    answer = F.when(F.col("answered_on").isNotNull() & (F.col("answered_on") <= given_up), F.array(F.struct(F.lit("answer").alias("step"), F.col("answered_on").alias("at")))).otherwise(F.array())
    steps = F.concat(F.array(F.struct(F.lit("ask").alias("step"), F.col("asked_on").alias("at"))), open_, answer)
    return chases.select("chase_id", F.explode(steps).alias("s")).select("chase_id", "s.at", "s.step").where(F.col("at") <= until)
