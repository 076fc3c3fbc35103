import random
from datetime import date, datetime
from decimal import Decimal as D
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from provena.operators import aggregates as A
from provena.operators import chain as H
from provena.operators import duplicates as U
from provena.operators import graph as G
from provena.operators import matching as M
from provena.operators import selection as S
from provena.operators import windows as N


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_largest_remainder_is_exact_and_first_largest_takes_the_rest(spark):
    df = spark.createDataFrame([(1, 1, D("100.00"), D("1.00")), (1, 2, D("100.00"), D("1.00")), (1, 3, D("100.00"), D("1.00")), (2, 1, D("0.05"), D("0.00")), (2, 2, D("0.05"), D("0.00"))], "g int, i int, whole decimal(18,2), w decimal(18,2)")
    out = A.largest_remainder(df, "whole", "g", F.col("w"), [F.col("i")])
    assert rows(out.select("g", "i", "share")) == [(1, 1, D("33.34")), (1, 2, D("33.33")), (1, 3, D("33.33")), (2, 1, D("0.05")), (2, 2, D("0.00"))]


def test_median_of_even_counts_and_zero_mad(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 10.0), (2, 5.0), (2, 5.0)], "k int, x double")
    out = {(r.k, r.x): (r.median, r.mad, r.z) for r in A.median_mad(df, ["k"], "x").collect()}
    assert out[(1, 1.0)][0] == 2.5
    assert out[(2, 5.0)] == (5.0, 0.0, None)


def test_rates_round_against_us(spark):
    df = spark.createDataFrame([(2, 3, 0)], "a int, b int, z int")
    r = df.select(A.floor_share(F.col("a"), F.col("b")).alias("f"), A.ceil_share(F.col("a"), F.col("b")).alias("c"), A.floor_share(F.col("a"), F.col("z")).alias("n"), A.percent_closed(F.lit(999), F.lit(1000)).alias("p")).first()
    assert (r.f, r.c, r.n, r.p) == (66.6, 66.7, None, 99)


def test_price_regimes_compare_with_the_first_of_a_run(spark):
    days = [date(2024, 1, i + 1) for i in range(6)]
    # each step is under 0.5 %, but the sum of them is not
    values = [100.0, 100.4, 100.8, 101.2, 101.3, 110.0]
    df = spark.createDataFrame([("a", d, v, "t") for d, v in zip(days, values, strict=True)], "k string, day date, v double, tie string")
    r = N.price_regimes(df, "k", "day", "v", "tie").first()
    assert (r.runs, r.level, r.previous, r.changed_on) == (3, 110.0, 100.8, days[5])


def test_recurring_series(spark):
    monthly = [(1, date(2024, m, 5)) for m in range(1, 9)]
    noise = [(2, date(2024, 1, 1)), (2, date(2024, 1, 9)), (2, date(2024, 3, 30)), (2, date(2024, 9, 2))]
    out = {r.k: r for r in N.recurring_series(spark.createDataFrame(monthly + noise, "k int, day date"), "k", "day").collect()}
    assert out[1].cadence == "monthly"
    assert abs((out[1].next_expected - date(2024, 9, 5)).days) <= 2
    assert out[2].cadence is None


def test_next_expected_counts_from_the_anchor(spark):
    df = spark.createDataFrame([(date(2024, 1, 31), 1, date(2024, 3, 1)), (date(2024, 1, 31), 1, date(2024, 2, 29)), (date(2023, 6, 15), 3, date(2024, 1, 1))], "last date, m int, today date")
    got = [r.x for r in df.select(N.next_expected(F.col("last"), F.col("m"), F.col("today")).alias("x")).collect()]
    assert got == [date(2024, 3, 31), date(2024, 2, 29), date(2024, 3, 15)]


def test_reset_balance(spark):
    df = spark.createDataFrame([("a", 1, D("5.00"), False), ("a", 2, D("100.00"), True), ("a", 3, D("-30.00"), False)], "k string, n int, x decimal(18,2), c boolean")
    assert rows(N.reset_balance(df, ["k"], [F.col("n")], F.col("x"), F.col("c")).select("n", "balance")) == [(1, D("5.00")), (2, D("100.00")), (3, D("70.00"))]


def test_merge_intervals_and_gaps(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    df = spark.createDataFrame([("u", at(1), at(3)), ("u", at(2), at(4)), ("u", at(4), at(5)), ("u", at(8), at(9))], "k string, s timestamp, e timestamp")
    merged = N.merge_intervals(df, ["k"], "s", "e")
    assert rows(merged.select("s", "e", "n")) == [(at(1), at(5), 3), (at(8), at(9), 1)]
    assert rows(N.gaps_of(merged, ["k"], "s", "e")) == [("u", at(5), at(8))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_against_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = sorted((n, find(n)) for n in root if any(n in e and e[0] != e[1] for e in edges))
    assert rows(G.connected_components(spark.createDataFrame(edges, "u long, v long"))) == want
    # a long chain and nothing at all
    chain = spark.range(200).selectExpr("id AS u", "id + 1 AS v")
    assert {x[1] for x in rows(G.connected_components(chain))} == {0}
    assert G.connected_components(chain.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_is_the_global_greedy(spark, seed):
    r = random.Random(seed)
    pairs = {(r.randrange(20), r.randrange(20)): r.randrange(5) for _ in range(80)}
    data = [(a, b, p) for (a, b), p in pairs.items()]
    used_a, used_b, want = set(), set(), []
    for a, b, p in sorted(data, key=lambda x: (-x[2], x[0], x[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.append((a, b, p))
    r.shuffle(data)
    df = spark.createDataFrame(data, "a int, b int, p int")
    assert rows(M.greedy_one_to_one(df, "a", "b", [("p", False)])) == sorted(want)


def test_subset_sums_are_all_and_only_the_exact_ones(spark):
    r = random.Random(5)
    amounts = [D(r.randrange(100, 900)) / 100 for _ in range(9)]
    goal = sum(amounts[1:4])
    df = spark.createDataFrame([(1, goal, i, a) for i, a in enumerate(amounts)], "k int, goal decimal(18,2), item int, amount decimal(18,2)")
    got = {tuple(x[1]) for x in M.subset_sums(df, "k", "goal", "item", "amount", most=4).collect()}
    want = {c for n in range(2, 5) for c in combinations(range(9), n) if sum(amounts[i] for i in c) == goal}
    assert got == want
    many = spark.createDataFrame([(1, D("30.00"), i, D("1.00")) for i in range(25)], "k int, goal decimal(18,2), item int, amount decimal(18,2)")
    only = M.subset_sums(many, "k", "goal", "item", "amount").collect()
    assert [(x[1], x.capped) for x in only] == [(None, True)]


def test_as_of_and_nearest(spark):
    rates = spark.createDataFrame([("U", date(2024, 1, 1), D("1.1")), ("U", date(2024, 1, 5), D("1.2"))], "c string, rd date, rate decimal(20,10)")
    asked = spark.createDataFrame([(i, "U", date(2024, 1, d)) for i, d in enumerate((4, 5, 12, 13))], "i int, c string, d date")
    out = [r.rate and float(r.rate) for r in M.as_of(asked, rates, ["c"], "d", "rd", "rate").orderBy("i").collect()]
    assert out == [1.1, 1.2, 1.2, None]


def test_fifo_is_all_or_nothing_within_its_window(spark):
    days = spark.createDataFrame([("s", date(2024, 1, d), D("50.00")) for d in (1, 2, 3)], "k string, day date, cash decimal(18,2)")
    deposits = spark.createDataFrame([("s", 1, date(2024, 1, 3), D("120.00")), ("s", 2, date(2024, 1, 4), D("100.00")), ("s", 3, date(2024, 3, 1), D("30.00"))], "k string, id int, day date, amount decimal(18,2)")
    out = M.fifo_deposits(days, deposits, "k")
    assert rows(out.groupBy("id").agg(F.sum("taken"))) == [(1, D("120.00"))]


def test_rules_conflict_and_newest(spark):
    hits = spark.createDataFrame([(1, "f", "x", 2, 1), (1, "f", "y", 2, 2), (1, "g", "x", 1, 1), (1, "g", "z", 2, 2), (2, "f", "x", 2, 1), (2, "f", "x", 2, 9)], "s int, field string, value string, rank int, id int")
    out = M.decide_by_rules(hits, "s", "field", "value", [F.col("rank").desc()], [F.col("id").desc()])
    assert rows(out.select("s", "field", F.coalesce("value", F.lit("-")), "id", "conflict")) == [(1, "f", "-", 2, True), (1, "g", "z", 2, False), (2, "f", "x", 9, False)]


def test_scores_and_grades(spark):
    df = spark.createDataFrame([(1, D("100.00"), D("100.00"), date(2024, 1, 2), date(2024, 1, 1), True), (2, D("101.50"), D("100.00"), date(2024, 1, 2), date(2024, 1, 1), True), (3, D("40.00"), D("100.00"), date(2024, 1, 2), date(2024, 1, 1), True), (4, D("100.00"), D("100.00"), date(2024, 1, 2), date(2024, 1, 1), False)], "i int, a decimal(18,2), g decimal(18,2), p date, d date, same boolean")
    out = M.score_pairs(df, paid="a", due="g", paid_on="p", issued_on="d", same_supplier=F.col("same"))
    assert rows(out.select("i", "status", "points", "viable", "grade")) == [(1, "exact", 75, True, "green"), (2, "adjusted", 75, True, "amber"), (3, "partial", 50, False, "red"), (4, "exact", 15, False, "red")]


def test_shingle_overlap_against_brute_force(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(30)}" for _ in range(30)]
    texts = []
    for _ in range(25):
        t = list(base)
        for _ in range(r.randrange(12)):
            t[r.randrange(len(t))] = f"w{r.randrange(30)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    want = {(a, b) for a, b in combinations(sorted(first.values()), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert {(x.a, x.b) for x in U.shingle_overlap(df, "id", "text").collect()} == want


def test_chain_finds_each_kind_of_damage(spark):
    df = spark.createDataFrame([("t", i, f"body {i}") for i in range(1, 6)], "tenant string, seq bigint, body string")
    log = H.build_chain(df, "tenant", "seq", "body")
    last = log.where("seq = 5").select("tenant", F.col("seq").alias("last_seq"), F.col("hash").alias("last_hash"))
    check = lambda rows_: tuple(H.verify_chain(rows_, "tenant", "seq", "body", last).select("first_bad", "problem", "intact").first())
    assert check(log) == (None, None, True)
    assert check(log.withColumn("body", F.when(F.col("seq") == 3, F.lit("x")).otherwise(F.col("body")))) == (3, "edited", False)
    assert check(log.where("seq != 2")) == (3, "gap", False)
    assert check(log.where("seq < 5")) == (5, "cut_off", False)


def test_selection(spark):
    o = spark.createDataFrame([(1, date(2024, 1, 1), []), (2, date(2024, 1, 20), []), (3, date(2024, 3, 1), []), (4, date(2024, 1, 3), ["e"])], "id int, due_on date, evidence array<string>")
    assert rows(S.due_soon(o, F.lit(date(2024, 1, 10))).select("id", "late")) == [(1, True), (2, False), (4, True)]
    assert rows(S.open_at(o, F.lit(date(2024, 1, 5))).select("id")) == [(1,), (2,)]
    d = spark.createDataFrame([("invoice", {"number": "1", "gross": None})], "t string, f map<string,string>")
    assert d.select(S.missing_fields(F.col("t"), F.col("f"), {"invoice": ["number", "gross", "date"]}, [])).first()[0] == ["date", "gross"]
    p = spark.createDataFrame([(1, "1111", "a"), (2, None, "a"), (3, "2222", "b")], "id int, card_last4 string, account_id string")
    cards = spark.createDataFrame([("1111", "c1"), ("2222", "c2"), ("2222", "c3")], "card_last4 string, card_source string")
    accounts = spark.createDataFrame([("a", "A"), ("b", "B")], "account_id string, account_source string")
    assert rows(S.source_of(p, cards, accounts).select("id", "source")) == [(1, "c1"), (2, "A"), (3, "B")]


def test_greedy_pairs_along_a_chain_need_few_rounds(spark, monkeypatch):
    """Pairs that decide each other one after another, beside random ones, against one run through the order."""
    import random

    from provena.storage import Scratch

    r = random.Random(8)
    pairs = {(k, k): 2 * k for k in range(60)} | {(k + 1, k): 2 * k + 1 for k in range(60)}
    pairs |= {(1000 + r.randrange(40), 1000 + r.randrange(40)): 1000 + k for k in range(300)}
    rows = [(a, b, float(p)) for (a, b), p in pairs.items()]
    r.shuffle(rows)

    def brute():
        used, out = set(), set()
        for a, b, _ in sorted(rows, key=lambda x: (x[2], x[0], x[1])):
            if ("l", a) not in used and ("r", b) not in used:
                used |= {("l", a), ("r", b)}
                out.add((a, b))
        return out

    writes = []
    plain = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, label: writes.append(label) or plain(self, df, label))
    df = spark.createDataFrame(rows, "a int, b int, p double")
    got = M.greedy_one_to_one(df, "a", "b", [("p", True)])
    assert {(x.a, x.b) for x in got.collect()} == brute() and writes.count("pairs") < 10
    monkeypatch.setattr(M, "COMPONENT_PAIRS", 5)  # large ones go on by rounds
    few = df.where("a < 12 OR a >= 1000")
    rows[:] = [x for x in rows if x[0] < 12 or x[0] >= 1000]
    assert {(x.a, x.b) for x in M.greedy_one_to_one(few, "a", "b", [("p", True)]).collect()} == brute()


def test_shingle_overlap_shuffles_a_shingle_once(spark, tmp_path):
    """Sets are made again where they are needed: neither they nor the words of a text are written or cut twice in a step."""
    texts = [(i, " ".join(f"w{k % 50}" for k in range(i, i + 40))) for i in range(30)] + [(90, None), (91, "two words"), (92, " ".join(f"w{k % 50}" for k in range(3, 43)))]
    df = spark.createDataFrame(texts, "id int, text string")
    told = {r.id: (r.class_id, r.n_copies) for r in U.shingle_classes(df, "id", "text").collect()}
    assert told == {i: (3 if i == 92 else i, int(i in (3, 92))) for i in [*range(30), 92]}
    members, classes = U._shingle_classes(df, "id", "text", 3)
    assert "s" not in members.columns + classes.columns
    plan = U._shingle_sets(df, "id", "text", 3).select(F.explode_outer("s").alias("g")).where("g IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
