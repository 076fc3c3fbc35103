import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from provena.operators import matching as M
from provena.operators import vectors as V


def exact(rows, asked, k):
    """(query, rank, found, cosine) by comparing everything with everything."""
    size = {i: np.linalg.norm(v) for i, v in rows}
    unit = {i: np.array(v, float) / size[i] for i, v in rows if size[i] > 0}
    out = []
    for q in asked:
        if q in unit:
            near = sorted((-round(float(unit[q] @ u), 6), i) for i, u in unit.items() if i != q)[:k]
            out += [(q, n + 1, i, -c) for n, (c, i) in enumerate(near)]
    return out


def test_every_cell_probed_is_exact_search(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 6)]) for i in range(500)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)] + [(2000, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    index = V.VectorIndex.build(df, "id", "v", k=4, probes=10**6)
    assert index.rows.agg(F.max(F.size("ids"))).first()[0] == 5  # of 301 equal rows
    got = sorted(map(tuple, index.search(df.where("id % 7 = 0"), "id", "v").collect()))
    want = sorted(exact(rows, [i for i, _ in rows if i % 7 == 0], 4))
    assert [(q, n, c) for q, n, _, c in got] == [(q, n, c) for q, n, _, c in want]
    assert sum(a[2] != b[2] for a, b in zip(got, want, strict=True)) <= len(want) // 50  # ties that rounding makes
    assert not any(q == f for q, _, f, _ in got) and 2000 not in {q for q, *_ in got}


def test_recall_on_clusters_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 64)
    monkeypatch.setattr(V, "QUERY_ROWS", 16)
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 24))
    # one region holds a third of all rows
    own = np.where(r.random(3000) < 0.33, 0, r.integers(0, 40, 3000))
    rows = [(i, [float(x) for x in centres[c] + 0.25 * r.normal(size=24)]) for i, c in enumerate(own)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    asked = df.where("id % 50 = 0")
    index = V.VectorIndex.build(df, "id", "v")
    assert index.probes < len(index.centroids) / 2
    assert index.rows.groupBy("cell", "block").count().agg(F.max("count")).first()[0] < 200
    found = index.search(asked, "id", "v")
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert index.rows.agg(F.sum(F.size("ids"))).first()[0] == len(rows)
    recall = V.recall_of(found, M.cosine_top_k(df, asked, "id", "v", 5))
    print("recall at 5 on clusters:", recall, "probes", index.probes, "of", len(index.centroids))
    assert recall >= 0.9 and found.select("query_id").distinct().count() == 60


def test_recall_on_the_table(spark, sf):
    e = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    asked = e.where("vec_id % 50 = 0")
    index = V.VectorIndex.build(e, "vec_id", "embedding")
    recall = V.recall_of(index.search(asked, "vec_id", "embedding"), M.cosine_top_k(e, asked, "vec_id", "embedding", 5))
    print("recall at 5 on embeddings:", recall, "probes", index.probes, "of", len(index.centroids))
    assert recall >= 0.9


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [2.0, 0.1]), (6, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = V.VectorIndex.build(df, "id", "v", k=2, probes=99)
    got = sorted(map(tuple, index.search(df, "id", "v", k=2).select("query_id", "found_id").collect()), key=str)
    assert (1, 5) in got and (5, 1) in got and (1, 1) not in got and not any(q in (2, 3, 4) for q, _ in got)
    assert V.VectorIndex.build(df.where("id = 3"), "id", "v") is None


def test_exact_neighbours_meet_in_matrix_products(spark, monkeypatch):
    monkeypatch.setattr(V.NearestRows, "SLICE_ROWS", 7)
    monkeypatch.setattr(V.NearestRows, "HELD", 20)
    r = random.Random(8)
    rows = [(i, [r.choice([-1.0, 0.5, 1.0]) for _ in range(3)]) for i in range(150)] + [(300 + i, [1.0, 1.0, 1.0]) for i in range(90)]
    odd = [(900, [0.0] * 3), (901, None), (902, []), (903, [None, 1.0, 1.0]), (904, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "id int, v array<double>").repartition(3)
    found = M.cosine_top_k(df, df.where("id % 10 = 0"), "id", "v", 4)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / norm(a) / norm(b), 6)
    want = {q: sorted((-cosine(v, x), i) for i, x in rows if i != q)[:4] for q, v in rows if q % 10 == 0}
    got: dict = {}
    for x in found.orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((-x.cosine, x.found_id))
    assert got == want
    # of rows with one cosine the smallest ids are held, in any number of them
    near = V.NearestRows(np.array([[1.0, 0.0]]), 3)
    for at in range(0, 5000, 100):
        near.add(pa.array(range(5000 - at, 4900 - at, -1)), np.tile([1.0, 0.0], (100, 1)))
        assert near.n <= 40
    assert sorted(near.result()[1].tolist()) == [1, 2, 3]
