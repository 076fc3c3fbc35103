"""Streams (J01-J06, J08, J12-J14, A03, A32): windows with late data, idempotent intake, keyed states with timers.

Event times must be TIMESTAMP (a watermark refuses TIMESTAMP_NTZ). State is kept for each key in Spark's state store
and bounded by watermarks or timeouts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once_each(events: DataFrame, keys: Sequence[str], ts: str, delay: str = "5 days") -> DataFrame:
    """Deliveries repeated within ``delay`` count once."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def settled_windows(events: DataFrame, ts: str, keys: Sequence[str], amount: str, *, size: str = "1 day", settle: str = "5 days") -> DataFrame:
    """Totals of tumbling windows, given out once the settle time has passed after a window's end."""
    sums = events.withWatermark(ts, settle).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.sum(amount).cast("decimal(28,2)").alias("amount"))
    return sums.select(F.col("window.start").alias("started"), F.col("window.end").alias("ended"), *keys, "n", "amount")


def session_minutes(events: DataFrame, ts: str, user: str, *, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions and their active minutes, rounded up."""
    by = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n_events"), F.min(ts).alias("started"), F.max(ts).alias("ended"))
    seconds = F.col("ended").cast("double") - F.col("started").cast("double")
    return by.select(user, "started", "ended", "n_events", F.ceil(F.floor(seconds) / 60).cast("bigint").alias("active_minutes"))


def too_many_attempts(events: DataFrame, ts: str, key: str, *, most: int = 10, length: str = "15 minutes", slide: str = "1 minute", delay: str = "15 minutes") -> DataFrame:
    """Sliding windows with more attempts than allowed."""
    counts = events.withWatermark(ts, delay).groupBy(F.window(ts, length, slide), key).agg(F.count("*").alias("attempts"))
    return counts.where(F.col("attempts") > most).select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "attempts")


def unannounced(polled: DataFrame, announced: DataFrame, key: str, polled_at: str, announced_at: str, *, grace: str = "10 minutes") -> DataFrame:
    """Polled items that no push announced within the grace time: the sign of lost notifications."""
    a, b = polled.withWatermark(polled_at, grace), announced.withColumnRenamed(key, "__key").withWatermark(announced_at, grace)
    close = (F.col(key) == F.col("__key")) & F.col(announced_at).between(F.col(polled_at) - F.expr(f"INTERVAL {grace}"), F.col(polled_at) + F.expr(f"INTERVAL {grace}"))
    return a.join(b, close, "leftOuter").where(F.col(announced_at).isNull()).drop("__key", announced_at)


def append_batches(stream: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None, then: Callable[[DataFrame, int], None] | None = None):
    """Every micro-batch is written once under its number, so that a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if then:
            then(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keyed_state(events: DataFrame, key: str, step: Callable[[pd.DataFrame, tuple | None], tuple[tuple | None, list[tuple]]], output: str, state: str, *, timeout_ms: int | None = None, expire: Callable[[tuple, tuple], list[tuple]] | None = None) -> DataFrame:
    """A fold over each key's events that lives on between micro-batches.

    ``step`` takes the batch's rows of one key and its state, and returns the new state (None forgets it) and rows to
    give out. ``expire`` gives rows for a key whose processing-time timer ran out.
    """
    names = [c.split()[0] for c in output.split(", ")]

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            rows = expire(k, held.get) if expire else []
            held.remove()
        else:
            rows, now = [], held.get if held.exists else None
            for frame in frames:
                now, made = step(frame, now)
                rows += made
            if now is None:
                if held.exists:
                    held.remove()
            else:
                held.update(now)
                if timeout_ms:
                    held.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(rows, columns=names)

    timer = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return events.groupBy(key).applyInPandasWithState(run, output, state, "append", timer)


#: The stages of an item in order, and its side states (fixed values of this engine).
STAGES = ("received", "read", "understood", "matched", "verified", "closed")
SIDE_STATES = ("needs_review", "blocked")
QUALITY = ("green", "amber", "red")


def legal_step(current: str | None, to: str) -> bool:
    """Forward by one stage, into a side state, or out of a side state to any stage but closed."""
    if current is None:
        return to == STAGES[0]
    if current == STAGES[-1]:
        return False
    if to in SIDE_STATES:
        return current not in SIDE_STATES
    if current in SIDE_STATES:
        return to in STAGES[:-1]
    return to in STAGES and STAGES.index(to) == STAGES.index(current) + 1


def item_states(moves: DataFrame) -> DataFrame:
    """Moves (item_id, seq, to_stage, quality) through the state machine; quality can only get worse.

    Gives out every move with the state after it; an illegal one has ``accepted`` false and changes nothing, as has
    one whose number is not above the last.
    """

    def step(frame: pd.DataFrame, now: tuple | None):
        stage, quality, last = now or (None, 0, 0)
        out = []
        for m in frame.sort_values("seq").itertuples(index=False):
            ok = m.seq > last and legal_step(stage, m.to_stage)
            if ok:
                stage, quality, last = m.to_stage, max(quality, QUALITY.index(m.quality)), int(m.seq)
            out.append((m.item_id, int(m.seq), m.to_stage, stage, QUALITY[quality], ok))
        return (None if stage is None else (stage, quality, last)), out

    return keyed_state(moves, "item_id", step, "item_id string, seq bigint, to_stage string, stage string, quality string, accepted boolean", "stage string, quality int, last bigint")


def assembled(pages: DataFrame) -> DataFrame:
    """Captures (capture_id, page, of_pages, sha256) given out once all pages have come; repeats are ignored."""

    def step(frame: pd.DataFrame, now: tuple | None):
        have = dict(zip(now[0], now[1], strict=True)) if now else {}
        of = now[2] if now else 0
        for p in frame.itertuples(index=False):
            have.setdefault(int(p.page), p.sha256)
            of = max(of, int(p.of_pages))
        if len(have) >= of:
            return None, [(frame["capture_id"].iloc[0], of, [have[k] for k in sorted(have)])]
        return (list(have), list(have.values()), of), []

    return keyed_state(pages, "capture_id", step, "capture_id string, of_pages int, hashes array<string>", "pages array<int>, hashes array<string>, of_pages int")


def chase_steps(asked_on: Column, answered_on: Column, reminders: Column, today: Column, *, wait: int = 6, most: int = 2, late: int = 30) -> Column:
    """What a chase for a missing document does on a day: done, wait, remind, escalate or give_up.

    The first reminder goes out ``wait`` days after the request and the next ones as long after each other; after the
    last the chase escalates, and beyond ``late`` days it is given up.
    """
    age = F.datediff(today, asked_on)
    return F.when(answered_on.isNotNull() & (answered_on <= today), "done").when(age > late, "give_up").when(age < wait * (reminders + 1), "wait").when(reminders < most, "remind").otherwise("escalate")
