"""Operators against brute force where an earlier form left part of the job out."""

import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal as D
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from provena.functions.text import name_similarity
from provena.operators.folds import fold_groups
from provena.operators import matching as M
from provena.operators import windows as N
from provena.plans import registry
from provena.plans.bind import doc_line

registry.load()


@pytest.mark.parametrize("seed", [1, 2])
def test_best_names_against_all_pairs(spark, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 6))) for _ in range(25)]
    names = {" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(120)} | {"acme", "the acme", "the acmee", "zz"}
    for name in sorted(names)[:80]:
        for _ in range(r.randint(1, 3)):
            at = r.randrange(len(name) + 1)
            name = name[:at] + r.choice(["", "x", "a"]) + name[at + r.randint(0, 1) :]
        names.add(" ".join(name.split()))
    names.discard("")
    a = spark.createDataFrame([(n,) for n in sorted(names)], "a string")
    b = a.withColumnRenamed("a", "b")
    scored = a.crossJoin(b).where("a != b").select("a", "b", F.round(name_similarity("a", "b"), 6).alias("s")).collect()
    want = {}
    for n in names:
        ranked = sorted(((-x.s, x.b) for x in scored if x.a == n and x.s >= 0.84))
        top, second = (ranked + [(None, None)] * 2)[:2]
        s, t = -top[0] if top[0] else None, -second[0] if second[0] else None
        want[n] = (top[1], s, t, s is not None and s >= 0.86 and (t is None or s - t >= 0.02))
    got = {x.a: (x.b, x.similarity, x.runner_up, x.accepted) for x in M.best_names(a, b, "a", "a", "b", "b", others=True).collect()}
    assert got == want
    assert sum(x[0] is not None and x[0][0] != n[0] for n, x in want.items()) > 3


def test_day_windows_of_any_length_meet_their_target(spark):
    r = random.Random(3)
    start = date(2024, 1, 1)
    bought = [(k, start + timedelta(days=r.randrange(120)), D(r.randrange(-100, 400)) / 100) for k in (1, 2) for _ in range(110)]
    bought += [(3, start + timedelta(days=2 * i), D("1.00")) for i in range(40)]
    targets = [(i, r.choice((1, 2)), start + timedelta(days=r.randrange(140)), D(r.randrange(50, 9000)) / 100) for i in range(300)]
    targets += [(900, 3, start + timedelta(days=78), D("32.00")), (901, 3, start + timedelta(days=78), D("33.00"))]
    totals = {}
    for k, d, x in bought:
        totals[k, d] = totals.get((k, d), 0) + x
    want = []
    for i, k, until, goal in targets:
        days = [d for d in sorted(d for a, d in totals if a == k) if until - timedelta(days=62) <= d <= until]
        runs = [(days[a], days[b], b - a + 1) for a in range(len(days)) for b in range(a, len(days)) if sum(totals[k, d] for d in days[a : b + 1]) == goal]
        want += [(i, *run, len(runs) > 1) for run in runs] or [(i, None, None, None, None)]
    assert max(x[3] or 0 for x in want) > 30
    kinds = "k int, d date, x decimal(18,2)"
    out = N.day_window_matches(spark.createDataFrame(bought, kinds), spark.createDataFrame(targets, f"id int, {kinds}"), "k", "d", "x", "id")
    got = [tuple(x) for x in out.select("id", "first_day", "last_day", "n_days", "ambiguous").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_subset_sums_of_up_to_six_lines(spark, sf):
    lines = duckdb.sql(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_suppkey * 1000000 + l_partkey AS item, min(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM '{sf}/lineitem.parquet' GROUP BY ALL ORDER BY 1, 2").fetchall()
    docs = defaultdict(list)
    for k, item, q in lines:
        docs[k].append((item, q))
    got = {x.doc: x for x in registry.QUERIES["subset_sum_matches_all"](spark, sf).collect()}
    large = 0
    for k, items in docs.items():
        goal = max(q for _, q in items)
        want = {"+".join(str(i) for i, _ in c) for n in range(2, 7) for c in combinations(items, n) if sum(q for _, q in c) == goal} if len(items) <= 20 else None
        large += any(x.count("+") > 2 for x in want or ())
        if want is not None and len(want) < 8:
            assert (set(got[k].sets.split()) == want and not got[k].capped) if want else k not in got
        else:
            assert got[k].capped
    assert large


def test_subset_search_ended_by_a_bound_is_returned_as_capped(spark):
    many = [(1, D("2.00"), i, D("1.00")) for i in range(9)] + [(2, D("30.00"), i, D("1.00")) for i in range(25)] + [(3, D("3.00"), i, D(i + 1)) for i in range(2)]
    df = spark.createDataFrame(many, "k int, goal decimal(18,2), item int, amount decimal(18,2)")
    got = {x.k: (x.n_sets, x.capped) for x in M.subset_rows(M.subset_sums(df, "k", "goal", "item", "amount"), "k").collect()}
    assert got == {1: (8, True), 2: (0, True), 3: (1, False)}


def test_fold_sees_whole_groups_after_a_join(spark, sf):
    lines = doc_line(spark, sf.replace("sf0.001", "sf0.1")).groupBy("doc", (F.col("line") * 1000 + F.col("supplier")).alias("item")).agg(F.min("qty").alias("qty"))
    rows = lines.join(lines.groupBy("doc").agg(F.max("qty").alias("goal")), "doc")
    n = rows.select("doc").distinct().count()
    folded = fold_groups(rows, ["doc"], ["item"], lambda g: [(g["item"].is_monotonic_increasing,)], "ordered boolean")
    assert folded.groupBy().agg(F.count("*"), F.count_distinct("doc"), F.every("ordered")).first()[:] == (n, n, True)


def test_subset_sums_are_exact_and_nearest_first(spark):
    from decimal import Decimal as D

    big = [("a", i, D(x), D("90071992547409.93"), 0) for i, x in ((1, "90071992547409.91"), (2, "0.02"), (3, "0.03"))]
    # the two that fit are the nearest in time, behind forty smaller ids
    far = [("b", i, D("7.00"), D("5.00"), 50) for i in range(40)] + [("b", 100, D("2.00"), D("5.00"), 1), ("b", 101, D("3.00"), D("5.00"), 2)]
    df = spark.createDataFrame(big + far, "k string, item int, amount decimal(20,2), goal decimal(20,2), days int")
    got = {r.k: r["items"] for r in M.subset_sums(df, "k", "goal", "item", "amount", near="days").collect()}
    assert got == {"a": [1, 2], "b": [100, 101]}
    assert all(r["items"] is None for r in M.subset_sums(df.where("k = 'b'"), "k", "goal", "item", "amount").collect())


def test_price_summary_deals_a_line_once(spark, sf):
    from provena.plans.money_queries import price_summary

    plan = price_summary(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 1
