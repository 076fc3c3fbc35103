from datetime import date as d
from decimal import Decimal as D

from provena.operators import ledger as L

ON = d(2024, 5, 1)


def told(df):
    return {r.line: (str(r.amount), r.direction, r.company, r.kind, r.pending) for r in df.collect()}


def test_cash_purchases(spark):
    docs = [(1, ON, "-5.00", "EUR", "a", "closed", True), (2, ON, "6.00", "EUR", None, "needs_owner", True), (3, ON, "7.00", "EUR", None, "closed", True), (4, ON, "8.00", "EUR", "a", "reading", True), (5, ON, "9.00", "EUR", "a", "closed", False), (6, ON, "9.00", "EUR", "a", "closed", True), (7, ON, "9.00", "EUR", "a", "closed", True), (8, ON, None, "EUR", "a", "closed", True)]
    df = spark.createDataFrame([(i, on, D(g) if g else None, *x) for i, on, g, *x in docs], "document int, on date, gross decimal(18,2), currency string, company string, stage string, paid_in_cash boolean")
    one = lambda i: spark.createDataFrame([(i,)], "document int")
    assert told(L.cash_purchases(df, one(6), one(7))) == {"1": ("5.00", "out", "a", "cost", False), "2": ("6.00", "out", None, "cost", True)}


def test_claims_tills_and_desk(spark):
    claims = spark.createDataFrame([(k, 10 + k, ON, D("3.00"), "EUR", "a", s) for k, s in enumerate(["waiting", "approved", "paid", "declined"])], "claim int, document int, on date, amount decimal(18,2), currency string, company string, status string")
    assert {k: v[3] for k, v in told(L.expense_claims(claims)).items()} == {"claim:0": "claim_waiting", "claim:1": "cost", "claim:2": "cost"}
    days = spark.createDataFrame([(1, ON, D("4.00"), "EUR", "a", True), (2, ON, D("0.00"), "EUR", "a", True), (3, ON, D("4.00"), "EUR", "a", False)], "document int, on date, cash decimal(18,2), currency string, company string, usable boolean")
    assert told(L.till_cash(days)) == {"1:cash": ("4.00", "in", "a", "till_cash", False)}
    desk = spark.createDataFrame([(1, ON, D("4.00"), "a", True, "paid"), (2, ON, D("4.00"), None, True, "paid"), (3, ON, D("4.00"), "a", False, "paid"), (4, ON, D("4.00"), "a", True, "open")], "document int, on date, amount decimal(18,2), company string, cash boolean, status string")
    assert list(told(L.desk_receipts(desk))) == ["desk:1"]


def test_payouts_and_clashes(spark):
    payouts = spark.createDataFrame([("p1", ON, "a", False), ("p2", ON, "a", False), ("p3", ON, "b", True)], "line string, on date, company string, pending boolean")
    reports = spark.createDataFrame([("p1", 1, "EUR", D("10.00"), D("0.50"), True), ("p2", 2, "EUR", D("10.00"), D("0.50"), False), ("p3", 3, "EUR", D("10.00"), D("0.00"), True)], "line string, document int, currency string, gross_sales decimal(18,2), fees decimal(18,2), settled boolean")
    rows = L.settled_payouts(payouts, reports)
    assert told(rows) == {"p1:sales": ("10.00", "in", "a", "sales", False), "p1:fees": ("0.50", "out", "a", "platform_fee", False), "p3:sales": ("10.00", "in", "b", "sales", True)}
    whole = L.whole_ledger(payouts=rows, again=rows.where("line = 'p1:fees'"))
    assert [tuple(r) for r in L.clashes(whole).collect()] == [("p1:fees", 2)] and {r.source for r in whole.collect()} == {"payouts", "again"}
