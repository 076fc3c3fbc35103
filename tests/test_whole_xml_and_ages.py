"""Invoices read with one parse, ages to the microsecond, payouts without pairs of a whole provider."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal as D

from pyspark.sql import functions as F

from provena.operators import links as L
from provena.sources import files as R
from provena.streaming import states as S


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_broken_invoice_is_reported_and_stops_nothing(spark):
    good = "<x:Invoice><x:ID/><x:ID> A1 </x:ID><x:LegalMonetaryTotal/><x:LegalMonetaryTotal><x:TaxExclusiveAmount currencyID='EUR'>1.5</x:TaxExclusiveAmount></x:LegalMonetaryTotal></x:Invoice>"
    rows = spark.createDataFrame([(1, good), (2, "<Invoice><ID>1</Invoice>")], "id int, xml string")
    out = R.einvoice_fields(rows, "xml")
    got = {r.id: (r.problem, r.doc_type, r.invoice_number, r.net_amount) for r in out.collect()}
    assert got == {1: (None, "invoice", None, D("1.50")), 2: ("malformed", None, None, None)}
    assert "xpath" not in plan_of(out)


def test_lines_of_whole_wrapped_and_broken_invoices(spark):
    line = lambda n: f"<c:InvoiceLine><c:ID>{n}</c:ID><c:Item><c:Name>a &amp; b</c:Name></c:Item></c:InvoiceLine>"
    both = "<CreditNoteLine><ID>9</ID></CreditNoteLine>"
    rows = spark.createDataFrame([(1, f"<Invoice>{line(1)}{line(2)}</Invoice>"), (2, f"<E><Invoice>{line(3)}</Invoice></E>"), (3, f"<Invoice>{line(4)}<x>"), (4, f"<I>{both}{line(5)}</I>"), (5, "<Invoice/>"), (6, None)], "id int, xml string")
    out = R.einvoice_lines(rows, "xml", ["id"])
    assert sorted((r.id, r.line, r.line_id, r.description) for r in out.collect()) == [(1, 1, "1", "a & b"), (1, 2, "2", "a & b"), (2, 1, "3", "a & b"), (3, 1, "4", "a & b"), (4, 1, "9", None), (4, 2, "5", "a & b")]
    assert "xpath" not in plan_of(out)


def test_a_limit_passed_by_less_than_a_second_is_passed(spark):
    now = datetime(2024, 1, 31)
    ts = lambda t: F.lit(t.isoformat(" ")).cast("timestamp_ntz")
    ago = lambda **k: ts(now - timedelta(**k))
    job = lambda at: S.job_state(F.lit(False), F.lit(1), at, ts(now))
    little = {"microseconds": 1}
    got = spark.range(1).select(job(ago(minutes=10)), job(ago(minutes=10, **little)), S.health(ago(hours=36), ts(now)), S.health(ago(hours=36, **little), ts(now)), S.health(ago(days=4), ts(now)), S.health(ago(days=4, **little), ts(now))).first()
    assert list(got) == ["leased", "retry", "healthy", "stale", "stale", "broken"]


def all_pairs(paid, reports):
    """The steps over every pair, as the SQL has them."""
    fits = [(p, r, (p[3] - r[3]).days) for p in paid for r in reports if p[2] == r[2] and (p[1] is None or r[1] is None or p[1] == r[1]) and -3 <= (p[3] - r[3]).days <= 10]
    out, used_p, used_r = [], set(), set()
    for step, keep in ((1, lambda p, r: p[4] == r[4] and p[5] == str(r[0])), (2, lambda p, r: p[4] == r[4]), (3, lambda p, r: p[5] == str(r[0])), (4, lambda p, r: True)):
        left = [(p[0], r[0], g) for p, r, g in fits if keep(p, r) and p[0] not in used_p and r[0] not in used_r]
        n = lambda i, v: sum(x[i] == v for x in left)  # noqa: B023, E731
        told = [(a, b, n(0, a) + n(1, b) == 2, g) for a, b, g in left]
        if step > 2:
            told = [t for t in told if t[2] and (step == 3 or -1 <= t[3] <= 4)]
        out += [(a, b, "differs" if step > 2 else "settled" if alone else "ambiguous", step) for a, b, alone, _ in told]
        used_p |= {t[0] for t in told}
        used_r |= {t[1] for t in told}
    return sorted(out)


def test_payouts_equal_all_pairs_and_make_none(spark):
    r = random.Random(4)
    day = lambda: date(2023, 12, 20) + timedelta(r.randrange(150))
    who = lambda: r.choice(["x", "y", "z", "w", None])
    reports = [(100 + i, who(), r.choice(["EUR", "USD"]), day(), D(r.randrange(1, 15))) for i in range(50)]
    paid = []
    for i in range(60):
        t = r.choice(reports)
        close = r.random() < 0.6
        paid.append((i, t[1] if close else who(), t[2], t[3] + timedelta(r.randrange(-5, 13)) if close else day(), t[4] if r.random() < 0.4 else D(r.randrange(1, 15)), str(t[0]) if r.random() < 0.2 else None))
    want = all_pairs(paid, reports)
    assert {s for *_, s in want} == {1, 2, 3, 4}
    p = spark.createDataFrame(paid, "pay_id int, provider string, currency string, booked_on date, amount decimal(18,2), quoted string")
    q = spark.createDataFrame(reports, "report_id int, provider string, currency string, paid_on date, net decimal(18,2)")
    assert sorted((x.pay_id, x.report_id, x.outcome, x.step) for x in L.match_payouts(p, q).collect()) == want
