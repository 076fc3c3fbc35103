"""Pairs near in amount are scored in whole cents: same results as in decimals, and no decimal or string is compared for a pair."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from provena.operators import matching as M
from provena.plans import matching_queries as Q


@pytest.mark.parametrize("looks", [2, 3, 4])
def test_scores_in_cents_equal_those_in_decimals(spark, looks):
    r = random.Random(5)
    due = [Decimal(x).scaleb(-2) for x in (0, 1, 199, 5000, 19999, 20000, 40800, 100000, 250000, 300001, -20000)] + [Decimal(r.randrange(100, 400000)).scaleb(-2) for _ in range(30)]
    near = lambda x: min(max(Decimal("2.00"), round(abs(x) * Decimal("0.01"), 2)), Decimal("25.00"))
    steps = lambda x: [Decimal(k).scaleb(-2) for k in (0, 1, 2, 148, 149, 150, 151, 152)] + [near(x) * k / 4 + Decimal(c).scaleb(-2) for k in (1, 2, 4) for c in (-1, 0, 1)]
    paid = [round(x + sign * s, 2) for x in due for s in steps(x) for sign in (1, -1)]
    start = date(2024, 1, 1)
    left = spark.createDataFrame([(i, x, start + timedelta(i % 90), i % 3) for i, x in enumerate(paid)], "a int, paid decimal(18,2), p date, party int")
    right = spark.createDataFrame([(i, x, start + timedelta(10), i % 3) for i, x in enumerate(due)], "b int, due decimal(18,2), d date, other int")
    score = lambda pairs, **more: M.score_pairs(pairs, paid="paid", due="due", paid_on="p", issued_on="d", same_supplier=F.col("party") == F.col("other"), **more)
    for quoted in ({}, {"quoted": F.col("a") % 2 == 0}):
        want = score(M.band_join(left, right, "paid", "due"), **quoted)
        got = score(M.band_join(left, right, "paid", "due", looks=looks, cents=True), **quoted)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count() > 500 and want.select("status").distinct().count() == 3


def test_a_candidate_pair_costs_whole_numbers_only(spark, sf):
    plan = Q.match_scored_candidates(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Join Inner")[0] + plan.split("Join Inner")[-2].split("Project")[-1]
    assert "decimal" not in above and " IN " not in above
    # a payment is copied for two buckets of twice the largest tolerance, not for three
    looks = [line for line in plan.split("\n") if "explode(array(" in line]
    assert looks and all("5000" in line for line in looks)
