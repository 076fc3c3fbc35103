import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from provena.llm.common import write_table
from provena.llm.mixing import find_exponent, mix_sources, mixing_weights, shuffle_key


def sources(spark, tokens):
    total = sum(tokens)
    return write_table(spark.createDataFrame([(i, t, t / total) for i, t in enumerate(tokens)], "of int, tokens long, share double"), "t")


def entropy(tokens, a):
    w = [t**a for t in tokens if t]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)


@pytest.mark.parametrize("tokens", [[900, 50, 50], [1, 10, 100, 1000], [5, 5, 5], [7]])
def test_exponent_meets_the_entropy(spark, tokens):
    target = 0.95 * math.log(len(tokens))
    a = find_exponent(sources(spark, tokens), target, None, 1.0)
    assert 0 <= a <= 1
    assert entropy(tokens, a) >= target - 1e-5
    assert a == 1.0 or entropy(tokens, a + 1e-4) < target


def test_exponent_meets_the_repetition_limit(spark):
    tokens = [10_000, 10]
    epochs = lambda a: (10**a / (10_000**a + 10**a)) * 10_010 / 10
    a = find_exponent(sources(spark, tokens), math.log(2), 4.0, 1.0)
    assert epochs(a) <= 4.0 + 1e-3 and epochs(a - 1e-3) > 4.0


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(900)] + [(1000 + i, "w " * 3, f"s{i % 4}") for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_budgets(skewed, block_rows):
    got = mix_sources(skewed, block_rows=block_rows).collect()
    weights = {r["of"]: r for r in mixing_weights(skewed.withColumn("tokens", F.regexp_count("text", F.lit("w")).cast("long"))).collect()}
    assert abs(sum(w.weight for w in weights.values()) - 1) < 1e-6
    drawn, epochs = defaultdict(int), defaultdict(list)
    for r in got:
        drawn[r.source] += r.tokens
        epochs[r.source, r.epoch].append(r.doc_id)
    for s, w in weights.items():
        assert w.budget - 7 * max(1, w.rows // block_rows + 1) <= drawn[s] <= w.budget
        assert drawn[s] > 0.97 * w.budget
        for e in range(1, w.full + 1):
            assert len(epochs[s, e]) == len(set(epochs[s, e])) == w.rows
    assert max(w.full for w in weights.values()) <= 4
    order = lambda e: [r.doc_id for r in sorted((r for r in got if r.source == "s1" and r.epoch == e), key=lambda r: (r.block, r.shuffle_key))]
    if len(order(2)) == len(order(1)):
        assert order(1) != order(2)


def test_the_last_part_is_the_start_of_the_permutation(skewed):
    got = mix_sources(skewed, block_rows=64)
    big = {r.doc_id for r in got.where("source = 'big'").collect()}
    full = mix_sources(skewed, block_rows=64, target_share=None, max_epochs=None).where("source = 'big'").collect()
    ranked = [r.doc_id for r in sorted(full, key=lambda r: (r.block, r.shuffle_key))]
    assert len(ranked) == 900
    assert set(ranked[: len(big) - 1]) <= big


def test_result_does_not_depend_on_partitions(skewed):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(mix_sources(skewed)) == key(mix_sources(skewed.repartition(1)))


def test_odd_rows(odd, none):
    got = mix_sources(odd)
    assert got.columns == [*odd.columns, "tokens", "epoch", "block", "shuffle_key"]
    twice = got.where("doc_id = 2").groupBy("epoch").count().collect()
    assert all(r["count"] == 2 for r in twice)
    assert mix_sources(none).collect() == []
    assert mix_sources(odd.where("text IS NULL OR text = ''")).collect() == []
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString().replace("Scan ExistingRDD", ""))


@pytest.mark.parametrize(("target", "limit", "share", "block_rows"), [(0.95, 4.0, 1.0, 4096), (0.9, None, 0.6, 16), (1.0, 3.0, 1.7, 50)])
def test_rows_against_brute_force(spark, skewed, target, limit, share, block_rows):
    docs = skewed.unionByName(spark.createDataFrame([(5, "w w", "big"), (5, "w w", "big"), (7, None, "s1"), (8, "w", None), (9, "", "void")], skewed.schema))
    rows = [(r.doc_id, r.source, r.text, len((r.text or "").split())) for r in docs.collect()]
    size, held = defaultdict(int), defaultdict(list)
    for r in rows:
        size[r[1]] += r[3]
        held[r[1]].append(r)
    total, some = sum(size.values()), [t for t in size.values() if t]
    most = lambda a: max(share * (t / total) ** (a - 1) / sum((x / total) ** a for x in some) for t in some)
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(some, mid) >= target * math.log(len(some)) - 1e-12 else (low, mid)
    a = low
    if limit is not None and most(a) > limit:
        high = 1.0
        for _ in range(60):
            mid = (a + high) / 2
            a, high = (a, mid) if most(mid) <= limit else (mid, high)
        a = high
    plan = {r["of"]: r for r in mixing_weights(docs.withColumn("tokens", F.regexp_count(F.coalesce("text", F.lit("")), F.lit("w")).cast("long")), target_share=target, max_epochs=limit, budget_share=share).collect()}
    most_epochs = F.explode(F.sequence(F.lit(1), F.lit(max(w.full for w in plan.values()) + 1))).alias("e")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    keys = docs.select("doc_id", "text", text_hash.alias("h"), most_epochs).distinct().withColumn("u", shuffle_key(17, F.col("e"), F.col("doc_id").cast("string"), F.col("h")))
    places = {(r.doc_id, r.text, r.e): (r.u, str(r.doc_id), r.h) for r in keys.collect()}
    want = []
    for s, mine in held.items():
        weight = size[s] ** a / sum(t**a for t in some) if size[s] else 0
        assert abs(plan[s].weight - weight) < 1e-5
        full, rest = divmod(plan[s].budget, size[s]) if size[s] else (0, 0)
        assert abs(plan[s].budget - weight * int(total * share)) <= 1 + 1e-5 * total
        blocks = max(1, math.ceil(len(mine) / block_rows))
        key = lambda r, e: (places[r[0], r[2], e][0] % blocks, *places[r[0], r[2], e])  # noqa: E731, B023
        for e in range(1, full + 1):
            want += [(r[0], s, r[2], e, key(r, e)[0], key(r, e)[1]) for r in mine]
        ranked = sorted(mine, key=lambda r: key(r, full + 1))  # noqa: B023
        for r in ranked:
            if rest and sum(x[3] for x in ranked if key(x, full + 1) <= key(r, full + 1)) <= rest:
                want.append((r[0], s, r[2], full + 1, key(r, full + 1)[0], key(r, full + 1)[1]))
    got = mix_sources(docs, target_share=target, max_epochs=limit, budget_share=share, block_rows=block_rows)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.source, r.text, r.epoch, r.block, r.shuffle_key)) for r in got.collect())


def test_clashing_columns_and_limits_out_of_reach(odd, skewed):
    clash = odd.withColumns({c: F.lit(1) for c in ("of", "t", "t_id", "t_of", "t_a", "u", "b", "run", "left", "sum", "rest", "__full")})
    got = mix_sources(clash)
    assert got.columns == [*[c for c in clash.columns if c != "__full"], "tokens", "epoch", "block", "shuffle_key"]
    assert got.count() == mix_sources(odd).count() and got.where("of = 1 AND t_id = 1").count() == got.count()
    with pytest.raises(ValueError):
        mix_sources(skewed, max_epochs=2.0, budget_share=3.0)
    with pytest.raises(ValueError):
        mix_sources(skewed, target_share=1.5)
