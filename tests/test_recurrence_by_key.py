"""Recurring series: a key's days are listed once, and nothing multiplies, joins or sorts them afterwards."""

from datetime import date, timedelta

from provena.operators.windows import recurring_series


def test_days_are_not_multiplied(spark):
    weekly = [date(2020, 1, 6) + timedelta(7 * i) for i in range(8)]
    daily = [date(2015, 1, 1) + timedelta(i) for i in range(1500)]
    rows = [("weekly", x) for x in weekly + weekly[:3]] + [("weekly and a null", x) for x in [*weekly, None]] + [("daily", x) for x in daily] + [("null", None), (None, weekly[0]), (None, weekly[1])]
    out = recurring_series(spark.createDataFrame(rows, "k string, day date"), "k", "day")
    got = {r.k: (r.cadence, r.n, r.on_cycle, r.share, r.anchor, r.season, r.last_seen, r.next_expected) for r in out.collect()}
    fits = ("weekly", 8, 8, 1.0, 0, None, weekly[-1], weekly[-1] + timedelta(7))
    none = lambda n, last: (None, n, None, None, None, None, last, None)
    assert got == {"weekly": fits, "weekly and a null": (fits[0], 9, *fits[2:]), "daily": none(1500, daily[-1]), "null": none(1, None), None: none(2, weekly[1])}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any(node in line for line in plan.split("\n") for node in ("Join", "Window", "Generate"))
