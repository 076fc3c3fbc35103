import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from provena.llm import tiered_search
from provena.llm.tiered_search import RESULT, TieredIndex, ranked_search, terms_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id string, text string"


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """item_id, rank, doc_id, score of (id, text) rows on both sides."""
    held = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n_docs, total = len(held), sum(h[2] for h in held)
    df, out = Counter(t for h in held for t in h[1]), []
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    for item, text in items:
        asked = Counter(words(text))
        scored = []
        for i, own, n in held:
            m = 25 + (75 * n * n_docs) // total
            score = sum(c * weight[t] * ((10**9 * own[t]) // (1000 * own[t] + 8 * m)) for t, c in asked.items() if t in own)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def told(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_terms():
    for text in ["", "Ab-c9_D é.É 日本語\x00x\x7fy", "a" * 9 + "\n\tB", "{}[]^`@/:;0Z"]:
        assert [t.decode() for t in terms_of(text.encode())] == words(text)


def zipf(r, n):
    return " ".join(f"w{min(int(r.paretovariate(0.7)), 400)}" for _ in range(n))


@pytest.mark.parametrize("shares", [(), (0.5,), (0.1, 0.3), (0.05, 0.1, 0.2, 0.2)])
def test_against_brute_force(spark, shares):
    r = random.Random(11)
    docs = [(i, zipf(r, r.choice([3, 40, 40, 300]))) for i in range(400)] + [(1000 + i, "common words here w1 w2") for i in range(60)]
    items = [(f"i{k}", zipf(r, r.choice([1, 5, 30]))) for k in range(25)] + [("rare", "w397 w399 w390"), ("twice", "w1 w1 common"), ("twice", "w3"), ("none", "zzz"), ("null", None)]
    docs.append((2000, "w397 w399 w390 " * 3))
    out = ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, ITEMS), shares=shares)
    assert out.columns == RESULT
    assert told(out) == brute(docs, items)


def test_items_are_proved_early_or_fall_through(spark):
    r = random.Random(5)
    docs = [(i, zipf(r, 60)) for i in range(300)] + [(1000 + i, "alpha beta gamma delta " + zipf(r, 20)) for i in range(10)]
    items = [("sharp", "alpha beta gamma delta"), ("dull", "w1 w2 w3 w4 w5 w6")]
    out = ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()
    tier = {x.item_id: x.tier for x in out}
    assert tier["sharp"] < 2 and tier["dull"] == 2
    assert sorted(((x.item_id, x.rank, x.doc_id, x.score) for x in out), key=str) == brute(docs, items)


def test_blocks_and_batches(spark, monkeypatch):
    r = random.Random(6)
    docs = [(i, zipf(r, 50)) for i in range(120)]
    items = [(f"i{k}", zipf(r, 12)) for k in range(20)]
    monkeypatch.setattr(tiered_search, "BLOCK_ITEMS", 6)
    monkeypatch.setattr(tiered_search, "INDEX_TERMS", 200)
    monkeypatch.setattr(tiered_search, "SCORE_ROWS", 7)
    got = ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, ITEMS), k=3)
    assert told(got) == brute(docs, items, 3)
    monkeypatch.setattr(tiered_search, "INDEX_TERMS", 3)
    with pytest.raises(ValueError, match="an index takes"):
        ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("x", "a b c d e")], ITEMS))


def test_odd_rows(spark, odd, odd_rows, none):
    docs = [(r[0], r[1]) for r in odd_rows]
    items = [("a", odd_rows[0][1][:200]), ("b", None), (None, "one two three"), ("c", ""), ("d", "日本語 emoji"), ("a", "line number")]
    asked = spark.createDataFrame([(1, *i) for i in items], f"rank int, {ITEMS}")
    assert told(ranked_search(odd, asked)) == brute(docs, items)
    assert told(ranked_search(none, asked)) == [] and told(ranked_search(odd, asked.limit(0))) == []


def test_index_holds_every_posting(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [words(r.text) for r in docs.select("text").collect()]
    vocabulary = sorted({t.encode() for w in rows[:20] for t in w})
    index = TieredIndex.build(docs, vocabulary)
    size = lambda j: index.rows.agg(F.sum(F.size(f"t{j}"))).first()[0]
    sizes = [size(j) for j in range(index.tiers)]
    known = {v.decode() for v in vocabulary}
    assert sum(sizes) == sum(len(known & set(w)) for w in rows) and sizes[0] < sizes[2]
    top = index.rows.select(F.explode("c0").alias("c")).agg(F.min("c")).first()[0]
    low = index.rows.select(F.explode("c1").alias("c")).agg(F.max("c")).first()[0]
    assert low < top and index.bounds[0].max() == low and not index.bounds[-1].any()
