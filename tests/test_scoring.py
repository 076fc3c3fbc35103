from datetime import date as d
from decimal import Decimal as D

import pytest

from provena.operators import scoring as S

DAY = d(2024, 5, 10)
BASE = {"paid": D("-100.00"), "paid_currency": "EUR", "due": D("-100.00"), "due_currency": "EUR", "paid_on": DAY, "issued_on": DAY, "relation": "same"}
FX = {**BASE, "paid": D("-92.00"), "due_currency": "USD"}
SCHEMA = "case int, " + ", ".join(f"{n} {k}" for n, k in S.COLUMNS.items())

#: changes to the base pair -> status, points, rejection, grade
CASES = [
    (BASE, "exact", 70, None, "green"),
    ({**BASE, "relation": "same_vat", "number_quoted": True, "reference_quoted": True, "due_on": DAY}, "exact", 100, None, "green"),
    ({**BASE, "fee": D("1.50"), "paid": D("-101.50")}, "adjusted", 70, None, "green"),
    ({**BASE, "paid": D("-100.40")}, "near", 50, None, "amber"),
    ({**BASE, "paid": D("-101.00")}, "near", 42, None, "amber"),
    ({**BASE, "paid": D("-102.00")}, "near", 36, None, "amber"),
    ({**BASE, "paid": D("-102.01")}, "mismatch", 25, "amounts differ", "amber"),
    ({**BASE, "paid": D("-40.00")}, "partial", 45, "partial payment without a reference", "amber"),
    ({**BASE, "paid": D("-40.00"), "number_quoted": True}, "partial", 70, None, "amber"),
    ({**BASE, "paid": D("100.00")}, "mismatch", 25, "amounts differ", "amber"),
    ({**BASE, "due": D("0.00")}, "mismatch", 25, "amounts differ", "amber"),
    ({**BASE, "relation": "different"}, "exact", 15, "different supplier", "amber"),
    ({**BASE, "relation": "different_name"}, "exact", 40, None, "amber"),
    ({**BASE, "relation": None}, "exact", 55, None, "amber"),
    ({**BASE, "relation": None, "same_iban": True}, "exact", 70, None, "green"),
    ({**BASE, "same_iban": False}, "exact", 60, None, "red"),
    ({**BASE, "document_quality": "red"}, "exact", 70, None, "red"),
    ({**BASE, "document_quality": "amber"}, "exact", 70, None, "amber"),
    ({**BASE, "same_card": False, "number_quoted": True}, "exact", 90, None, "amber"),
    ({**BASE, "paid_on": d(2024, 8, 1)}, "exact", 60, "outside the date window", "amber"),
    ({**BASE, "paid_on": d(2024, 2, 1)}, "exact", 60, "outside the date window", "amber"),
    ({**BASE, "paid_on": d(2024, 2, 1), "deposit": True}, "exact", 63, None, "amber"),
    ({**BASE, "paid_on": d(2024, 6, 1), "fits_history": True, "due_on": d(2024, 6, 3)}, "exact", 73, None, "green"),
    ({**BASE, "issued_on": None, "paid_on": d(2024, 5, 20), "due_on": DAY}, "exact", 66, None, "amber"),
    # the bank states the original amount
    ({**FX, "original": D("100.00"), "original_currency": "USD", "stated_rate": D("0.92")}, "adjusted", 70, None, "green"),
    ({**FX, "original": D("100.00"), "original_currency": "USD", "stated_rate": D("0.90")}, "near", 50, None, "amber"),
    ({**FX, "original": D("100.00"), "original_currency": "USD", "stated_rate": D("0.50")}, "mismatch", 25, "amounts differ", "amber"),
    ({**FX, "original": D("100.00"), "original_currency": "USD", "stated_rate": D("1.0869565217"), "stated_in_text": True}, "adjusted", 70, None, "green"),
    ({**FX, "original": D("100.00"), "original_currency": "USD", "stated_in_text": True}, "near", 50, None, "amber"),
    ({**FX, "original": D("100.00"), "original_currency": "USD", "stated_in_text": True, "reference_rate": D("0.80")}, "mismatch", 25, "amounts differ", "amber"),
    ({**FX, "original": D("100.00"), "original_currency": "USD", "reference_rate": D("0.91")}, "adjusted", 70, None, "green"),
    ({**FX, "original": D("100.00"), "original_currency": "USD", "reference_rate": D("0.80")}, "near", 42, None, "amber"),
    ({**FX, "original": D("60.00"), "original_currency": "USD"}, "partial", 45, "partial payment without a reference", "amber"),
    # a reference rate only, or nothing
    ({**FX, "reference_rate": D("0.91")}, "near", 50, None, "amber"),
    ({**FX, "reference_rate": D("0.895")}, "near", 42, None, "amber"),
    ({**FX, "reference_rate": D("0.80")}, "mismatch", 25, "amounts differ", "amber"),
    (FX, "mismatch", 25, "amounts differ", "amber"),
]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(k, *[c[0].get(n) for n in S.COLUMNS]) for k, c in enumerate(CASES)]
    return {r.case: r for r in S.score_in_full(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(scored, k):
    r = scored[k]
    assert (r.status, r.points, r.rejection, r.grade) == CASES[k][1:]
    assert r.points == max(0, min(100, sum(f.points for f in r.factors)))


def test_costs_and_missing_columns(spark, scored):
    at = {k: scored[k] for k, c in enumerate(CASES)}
    by_reference = next(k for k, c in enumerate(CASES) if c[0].get("reference_rate") == D("0.91") and "original" not in c[0])
    assert at[by_reference].cost == D("1.00") and at[by_reference].covered == D("-100.00")
    few = spark.createDataFrame([(D("-5.00"), "EUR", D("-5.00"), "EUR")], "paid decimal(18,2), paid_currency string, due decimal(18,2), due_currency string")
    r = S.score_in_full(few).first()
    assert (r.status, r.points, r.grade) == ("exact", 45, "amber")
