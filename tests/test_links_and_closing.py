"""Links and closing operators against brute force, where their queries have no SQL."""

import random
from datetime import date, timedelta
from decimal import Decimal as D

from pyspark.sql import functions as F

from provena.functions import normalise as N
from provena.functions import wording as X
from provena.operators import closing as C
from provena.operators import links as L
from provena.operators import matching as M


def test_candidates_are_ranked_with_their_lead(spark):
    rows = spark.createDataFrame([(1, "a", 80), (1, "b", 78), (1, "c", 10), (2, "a", 90), (2, "b", 80), (3, "a", 50)], "pay int, doc string, points int")
    got = {(r.pay, r.doc): (r.place, r.lead, r.ambiguous) for r in L.rank_in_group(rows, ["pay"], [F.col("points").desc(), F.col("doc")], "points").collect()}
    assert got == {(1, "a"): (1, 2, True), (1, "b"): (2, 2, True), (1, "c"): (3, 2, True), (2, "a"): (1, 10, False), (2, "b"): (2, 10, False), (3, "a"): (1, None, False)}


def test_greedy_pairs_against_one_pass(spark):
    r = random.Random(5)
    pairs = {(r.randrange(40), r.randrange(40)): r.randrange(6) for _ in range(300)}
    want, left, right = set(), set(), set()
    for (a, b), p in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a)
            right.add(b)
    df = spark.createDataFrame([(a, b, p) for (a, b), p in pairs.items()], "a int, b int, p int")
    assert {(x.a, x.b) for x in M.greedy_one_to_one(df, "a", "b", [("p", False)]).collect()} == want
    assert M.greedy_one_to_one(df.limit(0), "a", "b", [("p", False)]).count() == 0


def test_inverse_and_cross_rates(spark):
    rates = spark.createDataFrame([("EUR", "USD", date(2024, 1, 1), D("1.25")), ("GBP", "EUR", date(2024, 1, 1), D("1.25"))], "base string, quote string, day date, rate decimal(20,10)")
    rows = spark.createDataFrame([(1, "USD", "EUR", date(2024, 1, 8)), (2, "USD", "GBP", date(2024, 1, 3)), (3, "USD", "EUR", date(2024, 1, 9)), (4, "EUR", "EUR", date(2020, 1, 1)), (5, "GBP", "EUR", date(2024, 1, 1))], "id int, b string, q string, on date").withColumn("x", F.lit("10.00").cast("decimal(18,2)"))
    assert {r.id: r.out for r in L.convert(rows, rates, "x", "b", "q", "on", "out").collect()} == {1: D("8.00"), 2: D("6.40"), 3: None, 4: D("10.00"), 5: D("12.50")}


def test_uniqueness_in_two_windows(spark):
    paid = spark.createDataFrame([(1, "a", D("5.00"), 0), (2, "a", D("5.00"), 50), (3, "b", D("7.00"), 0), (4, "c", D("1.00"), 30)], "pay int, party string, amount decimal(18,2), on int")
    back = spark.createDataFrame([(10, "a", D("5.00"), 10), (11, "a", D("5.00"), 58), (12, "b", D("7.00"), 5), (13, "b", D("7.00"), 6), (14, "c", D("1.00"), 70)], "ret int, party string, amount decimal(18,2), back int")
    got = L.unique_within(paid, back, ["party", "amount"], "pay", "ret", F.col("back") - F.col("on"), [(0, 60), (0, 14)])
    assert sorted((r.pay, r.ret, r.window) for r in got.collect()) == [(1, 10, 2), (2, 11, 2), (4, 14, 1)]


def test_payouts_with_rivals_are_ambiguous(spark):
    d = lambda n: date(2024, 1, 1) + timedelta(n)
    kinds = "provider string, currency string"
    paid = spark.createDataFrame([(1, "x", "EUR", d(1), D("5.00"), None), (2, "x", "EUR", d(2), D("5.00"), None), (3, "y", "EUR", d(1), D("9.00"), "30"), (4, "z", "EUR", d(2), D("1.00"), None)], f"pay_id int, {kinds}, booked_on date, amount decimal(18,2), quoted string")
    reports = spark.createDataFrame([(10, "x", "EUR", d(0), D("5.00")), (30, "y", "EUR", d(0), D("8.00")), (40, "z", "EUR", d(0), D("2.00"))], f"report_id int, {kinds}, paid_on date, net decimal(18,2)")
    got = sorted((r.pay_id, r.report_id, r.outcome, r.step) for r in L.match_payouts(paid, reports).collect())
    assert got == [(1, 10, "ambiguous", 2), (2, 10, "ambiguous", 2), (3, 30, "differs", 3), (4, 40, "differs", 4)]


def test_deposits_take_the_oldest_days(spark):
    r = random.Random(8)
    d = lambda n: date(2024, 1, 1) + timedelta(n)
    days = [("t", d(n), D(r.randrange(1, 40))) for n in range(60)]
    deposits = [("t", i, d(r.randrange(70)), D(r.randrange(5, 300))) for i in range(25)]
    cash, want = {x[1]: x[2] for x in days}, []
    for _, i, on, amount in sorted(deposits, key=lambda x: (x[2], x[1])):
        usable = [k for k in sorted(cash) if 0 <= (on - k).days <= 21 and cash[k] > 0]
        if sum(cash[k] for k in usable) >= amount:
            for k in usable:
                take = min(cash[k], amount)
                if take:
                    want.append((i, k, take))
                cash[k] -= take
                amount -= take
    got = M.fifo_deposits(spark.createDataFrame(days, "k string, day date, cash decimal(18,2)"), spark.createDataFrame(deposits, "k string, id int, day date, amount decimal(18,2)"), "k")
    assert sorted((x.id, x.day, x.taken) for x in got.collect()) == sorted(want)


def test_receipts_pay_back_costs(spark):
    cost, receipt = lambda n, x: ("c", n, n, D(x), True, False), lambda n, x, says=False: ("c", n, n, D(x), False, says)
    rows = [receipt(0, 5), cost(1, 10), cost(2, 20), cost(3, 7), receipt(4, 11), receipt(5, 7), receipt(6, 12, True), receipt(7, 18), receipt(8, 3)]
    df = spark.createDataFrame(rows, "client string, at int, id int, amount decimal(18,2), is_cost boolean, says_so boolean")
    # 5: nothing due; 11: no sum of it; 7: a single cost; 12 says so: the oldest; 18: all that is left; 3: nothing due
    assert [(r.id, r.paid) for r in C.recharge_receipts(df).orderBy("id").collect()] == [(5, D("7.00")), (6, D("12.00")), (7, D("18.00"))]


def test_redaction_is_undone(spark):
    mark = "\u200b"
    texts = [
        "mail a.b@x.com and a.b@x.com, card 4111 1111 1111 1111", "PT50000201231234567890154 [[0]] [[", "", None, "b@x.com ab@x.com",
        "[[[0]] a@b.co", f"[{mark}[ a@b.co [{mark}{mark}", f"{mark}[a@b.co[[0]][", "4111 1111 1111 1112 is no card, +351 912 345 678 a phone",
        "DE89370400440532013000 GB00WEST12345698765432 0002 0123 12345678901 54", "a@b.co" * 300, "[" * 50,
    ]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.redact("t").alias("r"), X.restore(X.redact("t")["text"], X.redact("t")["tokens"]).alias("back")).collect()
    assert [r.back for r in got] == [t or "" for t in texts]
    assert got[0].r.text == "mail [[0]] and [[0]], card [[1]]" and got[0].r.tokens == ["a.b@x.com", "4111 1111 1111 1111"]
    assert got[4].r.text == "[[0]] [[1]]" and got[0].r.kinds == ["email", "card"]
    assert got[8].r.kinds == ["phone"] and got[8].r.tokens == ["+351 912 345 678"]
    assert got[9].r.kinds == ["iban", "bank_account"]


def test_redaction_leaves_only_values_out(spark, sf):
    """Against positions found by Python, on every document."""
    import re

    from provena.functions.checks import ACCOUNT, CARD, EMAIL, IBAN, PHONE

    pattern = re.compile(f"{EMAIL}|{IBAN}|{PHONE}|{ACCOUNT}|{CARD}", re.ASCII)

    def luhn(d):
        return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def good(v):
        d = re.sub("[^0-9]", "", v)
        if "@" in v or v[0] == "+":
            return "@" in v or 9 <= len(d) <= 15
        if v[:2].isalpha():
            return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
        return int(d) % 97 == 1 if len(d) == 21 else luhn(d)

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", X.redact("text").alias("r")).collect()
    assert any(r.r.tokens for r in docs)
    for r in docs:
        want = list(dict.fromkeys(m.group() for m in pattern.finditer(r.text or "") if good(m.group())))
        assert r.r.tokens == want
        assert not any(v in r.r.text for v in want)


def test_statement_takes_every_payment_once(spark):
    from datetime import date as d

    lines = spark.createDataFrame([("p", k, None, d(2024, 1, 10 + k), D("10.00"), True) for k in range(3)], "party string, row int, number string, on date, amount decimal(18,2), is_payment boolean")
    none = spark.createDataFrame([], "party string, number string, id int, amount decimal(18,2), on date")
    paid = spark.createDataFrame([("p", 70 + k, D("10.00"), d(2024, 1, 10)) for k in range(2)], "party string, id int, amount decimal(18,2), on date")
    got = {r.row: (r.outcome, r.ours) for r in L.check_statement(lines, none, paid).collect()}
    assert got == {0: ("paid", 70), 1: ("paid", 71), 2: ("not_found", None)}


def test_owner_time_alone_has_its_row(spark):
    acts = spark.createDataFrame([("a", "2024-01", "chased", "system", 1, 1)], "entity string, month string, kind string, actor string, subject int, id int")
    time = spark.createDataFrame([("b", "2024-01", 61), (None, "2024-01", 60)], "entity string, month string, seconds int")
    assert sorted(map(tuple, C.month_summary(acts, time).collect())) == [("a", "2024-01", 0, 1, 0, 1), ("b", "2024-01", 0, 0, 0, 3)]


def test_dates_by_their_pieces(spark):
    from datetime import date as d

    cases = {
        "Wednesday, 3rd of May 2023": [d(2023, 5, 3)], "sat 1/2/24 9:05pm": [d(2024, 2, 1), d(2024, 1, 2)], "2024-02-30": [], "2024-02-29T10:00:00+01:00": [d(2024, 2, 29)],
        "1.2/2024": [], "31/04/2024": [], "13/01/2024": [d(2024, 1, 13)], "20240229": [d(2024, 2, 29)], "5 de março de 2024": [d(2024, 3, 5)], "mar 5, 2024": [d(2024, 3, 5)],
        "hello 5 may 2024": [], "5 may": [], "": [], "12 2024 may": [], "2024 5 6": [], "5-Okt-24": [d(2024, 10, 5)], "01/01/1850": [],
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", N.date_readings("t").alias("r"), N.date_readings("t", day_first=True).alias("f")).collect()
    assert {r.t: r.r for r in got} == cases
    assert all(r.f == cases[r.t][:1] for r in got)


def test_hmac_and_digests(spark):
    import hashlib
    import hmac

    got = spark.range(1).select(N.hmac_sha256(b"key", F.lit("mé")), N.hmac_sha256(b"k" * 100, F.lit("x"))).first()
    assert list(got) == [hmac.new(k, m.encode(), hashlib.sha256).hexdigest() for k, m in ((b"key", "mé"), (b"k" * 100, "x"))]
    rows = spark.range(50)
    digest = lambda df: df.agg(N.state_digest("id").alias("d")).first().d
    assert digest(rows) == digest(rows.orderBy(F.col("id").desc())) != digest(rows.where("id > 0"))


def test_product_keys_and_verdicts(spark):
    got = spark.range(1).select(X.product_key(F.lit("Azeite Virgem 1,5 L")), X.product_key(F.lit("virgem azeite 6x33cl")), N.easter(F.lit(2024)), N.counterparty_key(F.lit("PAYPAL *ADOBE 402-935-9800")), N.counterparty_key(F.lit("Hazel Tree, Lda.")), N.counterparty_key(F.lit("S.A."))).first()
    assert list(got) == ["azeite virgem", "azeite virgem", date(2024, 3, 31), "adobe", "hazel tree", "sa"]


def test_neighbours_in_blocks_of_queries(spark):
    r = random.Random(6)
    rows = [(i, [r.random() - 0.5 for _ in range(4)]) for i in range(60)] + [(100, [0.0] * 4), (101, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    key = lambda d: sorted(map(tuple, d.collect()))
    got = key(M.cosine_top_k(df, df.where("id % 5 = 0"), "id", "v", 3))
    assert got == key(M.cosine_top_k(df, df.where("id % 5 = 0"), "id", "v", 3, block=4))
    assert len(got) == 36 and not {100, 101} & {x for row in got for x in row[:2]}
