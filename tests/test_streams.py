"""Streams, started over small files: late rows, repeats, restarts, timers, state."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from provena.streaming import states as A
from provena.streaming import streams as X

START = datetime(2024, 1, 1)


@pytest.fixture
def landing(spark, tmp_path):
    """A folder of JSON files, read as a stream: land(rows) adds one, drain(df, mode) runs to the end and returns all rows."""
    (tmp_path / "in").mkdir()
    names = iter(range(1000))

    class Landing:
        def land(self, *rows):
            n = next(names)
            path = tmp_path / "in" / f"{n:03d}.json"
            path.write_text("\n".join(json.dumps(r, default=str) for r in rows))
            os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken in the order of their times

        def stream(self, schema):
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

        def drain(self, df, mode="append", name="q"):
            q = df.writeStream.format("parquet" if mode == "append" else "memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state"))
            q = (q.option("path", str(tmp_path / f"{name}-out")) if mode == "append" else q).trigger(availableNow=True).start()
            q.awaitTermination()
            return spark.read.schema(df.schema).parquet(str(tmp_path / f"{name}-out")).collect()

    return Landing()


def at(minutes):
    return (START + timedelta(minutes=minutes)).isoformat()


EVENT = "id string, user string, ts timestamp, amount decimal(18,2)"


def event(i, minutes, user="u", amount="1.00"):
    return {"id": i, "user": user, "ts": at(minutes), "amount": amount}


def test_repeats_count_once_over_a_restart(landing):
    landing.land(event("a", 0), event("a", 0), event("b", 1))
    out = X.once_each(landing.stream(EVENT), ["id"], "ts", "1 hour")
    assert sorted(r.id for r in landing.drain(out)) == ["a", "b"]
    landing.land(event("b", 1), event("c", 2))
    assert sorted(r.id for r in landing.drain(X.once_each(landing.stream(EVENT), ["id"], "ts", "1 hour"))) == ["a", "b", "c"]


def test_windows_settle_after_their_time(landing):
    day = 24 * 60
    landing.land(event("a", 0), event("b", 60))
    landing.land(event("c", 3 * day))
    landing.land(event("late", 120))  # within the settle time
    landing.land(event("d", 8 * day))
    landing.land(event("d2", 8 * day))  # a watermark drops rows from the batch after the next on
    landing.land(event("lost", 180), event("e", 9 * day))
    got = landing.drain(X.settled_windows(landing.stream(EVENT), "ts", ["user"], "amount", size="1 day", settle="5 days"))
    assert [(r.started.day, r.n) for r in sorted(got, key=lambda r: r.started)] == [(1, 3), (4, 1)][: len(got)] and got[0].n == 3


def test_sessions_and_attempts(landing):
    landing.land(*[event(str(i), i * 10) for i in range(4)], event("x", 300), *[event(f"f{i}", 400 + i, "v") for i in range(12)])
    landing.land(event("end", 3000), event("end2", 3000, "v"))
    landing.land(event("end3", 6000))
    sessions = landing.drain(X.session_minutes(landing.stream(EVENT), "ts", "user"), name="sessions")
    assert {(r.user, r.n_events, r.active_minutes) for r in sessions} >= {("u", 4, 30), ("u", 1, 0), ("v", 12, 11)}
    tries = landing.drain(X.too_many_attempts(landing.stream(EVENT), "ts", "user"), name="tries")
    assert {r.user for r in tries} == {"v"} and max(r.attempts for r in tries) == 12


def test_polled_items_that_nobody_announced(spark, tmp_path):
    def folder(name, *rows):
        (tmp_path / name).mkdir()
        for n, batch in enumerate(rows):
            (tmp_path / name / f"{n}.json").write_text("\n".join(json.dumps(r) for r in batch))

    folder("polled", [{"k": "a", "polled_at": at(0)}, {"k": "b", "polled_at": at(1)}], [{"k": "z", "polled_at": at(600)}], [{"k": "zz", "polled_at": at(1200)}])
    folder("pushed", [{"k": "a", "announced_at": at(2)}], [{"k": "z", "announced_at": at(600)}], [{"k": "zz", "announced_at": at(1200)}])
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))
    out = X.unannounced(read("polled", "k string, polled_at timestamp"), read("pushed", "k string, announced_at timestamp"), "k", "polled_at", "announced_at")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["b"]


def test_batches_are_written_once(spark, landing, tmp_path):
    landing.land(event("a", 0))
    landing.land(event("b", 1))
    seen = []
    for _ in range(2):
        X.append_batches(landing.stream(EVENT), str(tmp_path / "sink"), str(tmp_path / "sink-state"), then=lambda batch, n: seen.append(n)).awaitTermination()
    assert seen == [0, 1] and sorted(r.id for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == ["a", "b"]


def test_items_move_through_their_stages(landing):
    move = lambda seq, to, quality="green": {"item_id": "i", "seq": seq, "to_stage": to, "quality": quality}
    landing.land(move(1, "received"), move(2, "matched"), move(3, "read", "amber"))
    landing.land(move(3, "understood"), move(4, "blocked"), move(5, "understood"), move(6, "closed"))
    got = landing.drain(X.item_states(landing.stream("item_id string, seq bigint, to_stage string, quality string")))
    assert [(r.seq, r.stage, r.quality, r.accepted) for r in sorted(got, key=lambda r: (r.seq, r.to_stage))] == [
        (1, "received", "green", True),
        (2, "received", "green", False),
        (3, "read", "amber", True),
        (3, "read", "amber", False),
        (4, "blocked", "amber", True),
        (5, "understood", "amber", True),
        (6, "understood", "amber", False),
    ]


def test_captures_wait_for_all_pages(landing):
    page = lambda c, n, of: {"capture_id": c, "page": n, "of_pages": of, "sha256": f"{c}{n}"}
    landing.land(page("a", 2, 2), page("b", 1, 3))
    landing.land(page("a", 1, 2), page("b", 1, 3), page("b", 3, 3))
    got = landing.drain(X.assembled(landing.stream("capture_id string, page int, of_pages int, sha256 string")))
    assert [(r.capture_id, r.hashes) for r in got] == [("a", ["a1", "a2"])]


def test_chases_and_jobs_and_health(spark):
    d = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    none = F.lit(None).cast("date")
    said = spark.range(1).select(*[X.chase_steps(d(0), done, F.lit(r), d(n)) for done, r, n in ((d(3), 0, 4), (none, 0, 5), (none, 0, 6), (none, 1, 12), (none, 2, 18), (none, 2, 31))]).first()
    assert list(said) == ["done", "wait", "remind", "remind", "escalate", "give_up"]
    ts = lambda h: F.lit("2024-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {h} HOURS")
    health = spark.range(1).select(*[A.health(x, ts(100)) for x in (ts(99), ts(60), ts(1), F.lit(None).cast("timestamp"))]).first()
    assert list(health) == ["healthy", "stale", "broken", "never"]
    jobs = spark.range(1).select(A.backoff_minutes(F.lit(1)), A.backoff_minutes(F.lit(9)), A.job_state(F.lit(False), F.lit(5), ts(0), ts(0)), A.job_state(F.lit(False), F.lit(1), ts(0), ts(1)), A.job_state(F.lit(False), F.lit(1), ts(0), ts(0)), A.job_state(F.lit(True), F.lit(9), ts(0), ts(0))).first()
    assert list(jobs) == [1, 60, "dead", "retry", "leased", "done"]
    plan = spark.createDataFrame([("export", -2), ("check", -7), ("send", 2)], "step string, offset int")
    progress = spark.createDataFrame([("c", "2024-01-31", ["check"])], "key string, close_on string, done array<string>").withColumn("close_on", F.to_date("close_on"))
    due = A.due_steps(progress, plan, F.lit("2024-01-30").cast("date")).collect()
    assert [(r.step, r.late) for r in due] == [("export", True)]
