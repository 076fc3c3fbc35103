"""Snapshots, replay and chases: batch forms against plain folds, streams over restarts."""

import json
import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from provena.storage import write_table
from provena.streaming import chases as C
from provena.streaming import snapshots as S

LOG = "tenant string, seq bigint, key string, amount decimal(18,2), body string"


def log_rows(n=400, tenants=5, seed=3):
    r = random.Random(seed)
    last = dict.fromkeys(range(tenants), 0)
    out = []
    for _ in range(n):
        t = r.choice([0, 0, *range(tenants)])
        last[t] += 1
        out.append((f"t{t}", last[t], r.choice("abc"), f"{r.randrange(-500, 500)}.25", r.choice([None, "x", "y" * r.randrange(5)])))
    return out


def frame(spark, rows):
    from decimal import Decimal as D

    return spark.createDataFrame([(t, s, k, D(a), b) for t, s, k, a, b in rows], LOG)


def told(state):
    return {(r.tenant, r.key): tuple(r[c] for c in S.STATE[2:]) for r in state.select(*S.STATE).collect()}


def plain(rows):
    """n, amount, first_seq, last_seq, last_body by a loop over the events in order."""
    from decimal import Decimal as D

    out = {}
    for t, s, k, a, b in sorted(rows, key=lambda r: r[1]):
        n, total, first, _, _ = out.get((t, k), (0, D(0), s, None, None))
        out[t, k] = (n + 1, total + D(a), first, s, b)
    return out


@pytest.mark.parametrize("every", [1, 7, 50, 10_000])
def test_resumed_state_equals_replay(spark, every):
    rows = log_rows()
    log = frame(spark, rows).repartition(3)
    shots = write_table(S.snapshots(log, every), "shots")
    resumed, replayed = S.resume(shots, log), S.fold(log)
    assert told(resumed) == told(replayed)
    assert {k: v[:5] for k, v in told(replayed).items()} == plain(rows)
    assert all(r.same for r in S.compare_states(resumed, replayed).collect())
    lengths = {}
    for t, s, *_ in rows:
        lengths[t] = max(s, lengths.get(t, 0))
    assert {r.tenant: r.upto for r in S.newest(shots).collect()} == {t: n // every * every for t, n in lengths.items() if n >= every}
    at = spark.createDataFrame([("t0", every)], "tenant string, upto bigint")
    if lengths["t0"] >= every:
        early = {k: v[:5] for k, v in told(S.state_at(shots, at)).items()}
        assert early == plain([r for r in rows if r[0] == "t0" and r[1] <= every])


def test_any_edit_changes_the_proof(spark):
    rows = log_rows(60, 2)
    good = S.fold(frame(spark, rows))
    k = next(i for i, r in enumerate(rows) if r[0] == "t0")
    edits = {
        "edited": [*rows[:k], (*rows[k][:4], "other"), *rows[k + 1 :]],
        "dropped": rows[:k] + rows[k + 1 :],
        "repeated": [*rows, rows[k]],
        "renumbered": [(t, {1: 2, 2: 1}.get(s, s), *x) if t == "t0" else (t, s, *x) for t, s, *x in rows],
    }
    proof = lambda state: {r.tenant: r.p for r in state.groupBy("tenant").agg(F.sum("proof").alias("p")).collect()}
    want = proof(good)
    assert proof(S.fold(frame(spark, rows[::-1]))) == want
    for name, changed in edits.items():
        got = proof(S.fold(frame(spark, changed)))
        assert got["t0"] != want["t0"] and got["t1"] == want["t1"], name
        assert {r.tenant: r.same for r in S.compare_states(good, S.fold(frame(spark, changed))).collect()} == {"t0": False, "t1": True}
    assert S.fold(frame(spark, [])).count() == 0 and S.snapshots(frame(spark, []), 5).count() == 0


class Landing:
    """A folder of JSON files that a stream reads one by one."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0
        (path / "in").mkdir()

    def land(self, rows):
        f = self.path / "in" / f"{self.n:03d}.json"
        f.write_text("\n".join(json.dumps(dict(zip([c.split()[0] for c in self.schema.split(", ")], r, strict=True)), default=str) for r in rows))
        os.utime(f, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.path / "in"))


def test_streamed_state_over_a_restart(spark, tmp_path):
    rows = log_rows(90, 3)
    landing = Landing(spark, tmp_path, LOG)
    table = S.StateTable(spark, f"file://{tmp_path}/state")
    assert table.read() is None
    for a, b in ((0, 20), (20, 45)):
        landing.land(rows[a:b])
    table.follow(landing.stream(), str(tmp_path / "ck")).awaitTermination()
    landing.land(rows[45:])
    table.follow(landing.stream(), str(tmp_path / "ck")).awaitTermination()
    assert told(table.read()) == told(S.fold(frame(spark, rows)))
    assert len(table.versions()) == 2
    table.update(frame(spark, rows[45:]), table.versions()[-1])  # the last batch once more
    assert told(table.read()) == told(S.fold(frame(spark, rows)))


DAY0 = datetime(2024, 1, 1)
MOVE = "chase_id string, at timestamp, move string"


def move(i, days, what):
    return i, (DAY0 + timedelta(days=days)).isoformat(), what


def test_timers_fire_over_a_restart(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    C.use_rocksdb(spark)
    try:
        landing = Landing(spark, tmp_path, MOVE)

        def run():
            q = C.chases(landing.stream(), "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination()
            out = spark.read.schema(C.OUTPUT).parquet(str(tmp_path / "out")).collect()
            return sorted(((r.chase_id, (r.at - DAY0).total_seconds() / 86400, r.step, r.state, r.reminders, r.legal) for r in out), key=str)

        landing.land([move("a", 0, "ask"), move("b", 0, "ask"), move("c", 0.5, "answer")])
        landing.land([move("clock", 7, "tick")])
        first = run()
        assert ("a", 6, "remind", "open", 1, True) in first and ("b", 6, "remind", "open", 1, True) in first
        assert ("c", 0.5, "answer", "none", 0, False) in first
        landing.land([move("b", 8, "answer"), move("b", 8.5, "answer"), move("a", 8, "ask")])
        landing.land([move("clock", 13, "tick")])
        landing.land([move("clock", 19, "tick")])
        landing.land([move("clock", 40, "tick")])
        landing.land([move("a", 41, "ask"), move("clock", 60, "tick")])
        landing.land([move("clock", 61, "tick")])
        got = [r for r in run() if r[0] != "clock"]
        a = [r[1:5] for r in got if r[0] == "a" and r[5]]
        assert sorted(a) == [(0, "ask", "open", 0), (6, "remind", "open", 1), (12, "remind", "open", 2), (18, "escalate", "escalated", 2), (30, "give_up", "given_up", 2), (41, "ask", "open", 0), (47, "remind", "open", 1), (53, "remind", "open", 2), (59, "escalate", "escalated", 2)]
        b = [r[1:] for r in got if r[0] == "b"]
        assert sorted(b) == [(0, "ask", "open", 0, True), (6, "remind", "open", 1, True), (8, "answer", "answered", 1, True), (8.5, "answer", "answered", 1, False)]
        assert [r for r in got if r[0] == "a" and not r[5]] == [("a", 8, "ask", "open", 1, False)]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_timeline_of_a_table(spark):
    d = date(2024, 1, 1)
    rows = [("a", d, None), ("b", d, d + timedelta(12)), ("c", d, d + timedelta(31)), ("d", d, d)]
    got = C.chase_timeline(spark.createDataFrame(rows, "chase_id string, asked_on date, answered_on date"), F.lit("2024-02-29").cast("date")).collect()
    of = lambda i: sorted(((r.at - d).days, r.step) for r in got if r.chase_id == i)
    whole = [(0, "ask"), (6, "remind"), (12, "remind"), (18, "escalate"), (30, "give_up")]
    assert of("a") == of("c") == whole
    assert of("b") == [(0, "ask"), (6, "remind"), (12, "answer")] and of("d") == [(0, "answer"), (0, "ask")]
