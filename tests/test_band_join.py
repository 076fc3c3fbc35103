"""Pairs near in amount: bounds in whole cents give the pairs that the tolerance gives, and are what a pair is held to."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from provena.operators import matching as M


def tolerance(due):
    return min(max(Decimal("2.00"), (abs(due) * Decimal("0.01")).quantize(Decimal("0.01"), ROUND_HALF_UP)), Decimal("25.00"))


@pytest.mark.parametrize("kind", ["decimal(18,2)", "decimal(12,1)", "decimal(38,3)"])
def test_pairs_near_in_amount_are_held_to_bounds(spark, kind):
    r = random.Random(10)
    places = Decimal(1).scaleb(-int(kind[-2]))
    near = lambda x: [x, x + tolerance(x), x - tolerance(x), x + tolerance(x) + places, x - tolerance(x) - places]
    due = [Decimal(r.randrange(-400000, 400000)).scaleb(-2).quantize(places) for _ in range(60)] + [Decimal(0), Decimal("2500.0"), Decimal("-25.0"), Decimal("199.9"), None]
    paid = [x.quantize(places) for d in due if d is not None for x in near(d)] + [None]
    left = spark.createDataFrame(list(enumerate(paid)), f"a int, paid {kind}")
    right = spark.createDataFrame(list(enumerate(due)), f"b int, due {kind}")
    out = M.band_join(left, right, "paid", "due")
    assert out.columns == ["a", "paid", "b", "due"]
    want = sorted((a, x, b, y) for a, x in enumerate(paid) for b, y in enumerate(due) if x is not None and y is not None and abs(x - y) <= tolerance(y))
    assert sorted(map(tuple, out.collect())) == want
    if kind != "decimal(38,3)":
        join = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line)
        assert "__low" in join and "__high" in join and "abs(" not in join
