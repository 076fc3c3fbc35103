"""Runs of days that meet targets by equal sums, and subset searches of many keys in one call."""

from datetime import date, timedelta
from decimal import Decimal as D

from provena.operators import matching as M
from provena.operators import windows as N


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_day_runs_broadcast_nothing_and_ignore_rows_without_a_day(spark):
    d = lambda n: date(2024, 1, 1) + timedelta(n)
    bought = spark.createDataFrame([("a", d(0), D("2.00")), ("a", d(5), D("3.00")), ("a", d(63), D("4.00")), ("a", None, D("7.00"))], "k string, d date, x decimal(18,2)")
    asked = spark.createDataFrame([(1, "a", d(62), D("5.00")), (2, "a", d(63), D("5.00")), (3, "a", d(63), D("7.00")), (4, "a", d(4), D("5.00"))], "id int, k string, d date, x decimal(18,2)")
    out = N.day_window_matches(bought, asked, "k", "d", "x", "id")
    got = {r.id: (r.first_day, r.last_day, r.n_days, r.ambiguous) for r in out.collect()}
    assert got == {1: (d(0), d(5), 2, False), 2: (None,) * 4, 3: (d(5), d(63), 2, False), 4: (None,) * 4}
    assert "Broadcast" not in plan_of(out)


def test_subset_search_takes_many_keys_in_one_call(spark):
    rows = [(k, D(6), k * 10 + i, D(i)) for k in [*range(300), None] if k is not None for i in (1, 2, 3, 4, 5)] + [(None, D(3), 1, D(1)), (None, D(3), 2, D(2))]
    df = spark.createDataFrame(rows, "k int, goal decimal(18,2), item int, amount decimal(18,2)")
    out = M.subset_sums(df, "k", "goal", "item", "amount")
    got: dict = {}
    for r in out.collect():
        got.setdefault(r.k, set()).add(tuple(r["items"]))
    assert got == {**{k: {(k * 10 + 1, k * 10 + 5), (k * 10 + 2, k * 10 + 4), (k * 10 + 1, k * 10 + 2, k * 10 + 3)} for k in range(300)}, None: {(1, 2)}}
    assert "MapInPandas" not in plan_of(out)
