import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from provena.llm.near_duplicates import choose_prefixes, climb, keep_one_of_each_group, linked, near_duplicates


def shingles(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    """rows: distinct (id, text) -> {id: (group, class, copies, links, shingles)}"""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    links = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 5 * threshold * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    copies = {i: [j for j in sets if sets[j] == sets[i] and sets[i]] or [i] for i in sets}
    return {i: (find(i), min(copies[i]), len(copies[i]) - 1, links[i], len(sets[i])) for i in sets}


def mutated(r, words, k):
    w = list(words)
    for _ in range(k):
        w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
    return " ".join(w)


def result(df):
    return {r.doc_id: (r.group_id, r.class_id, r.n_copies, r.n_links, r.n_shingles) for r in df.collect()}


@pytest.mark.parametrize("block", [256, 7])
def test_groups_of_copies_and_near_copies(spark, block):
    r = random.Random(2)
    texts = []
    for _ in range(6):
        base = [f"w{r.randrange(400)}" for _ in range(r.randrange(60, 200))]
        texts += [" ".join(base)] * r.randrange(1, 6)
        texts += [mutated(r, base, r.randrange(0, 6)) for _ in range(18)]
    texts += [" ".join(f"w{r.randrange(400)}" for _ in range(80)) for _ in range(30)] + ["", "a b", "a b", "a b c d e"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(near_duplicates(df, block=block)) == brute(rows)


def test_odd_rows(odd, none):
    got = near_duplicates(odd)
    assert got.columns == ["doc_id", "group_id", "class_id", "n_copies", "n_links", "n_shingles"]
    out = result(got)
    assert None not in out and got.count() == len(out)
    assert out[1][:3] == (1, 1, 1) and out[2][:3] == (1, 1, 1)
    assert out[4] == (4, 4, 0, 0, 0) and out[5] == (5, 5, 0, 0, 0)
    assert out[7][0] == out[8][0] == 7 and out[8][3] == 1
    assert result(near_duplicates(none)) == {}
    kept = keep_one_of_each_group(odd, got)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 2 not in ids and 8 not in ids and ids.count(None) == 2 and {1, 7, 4, 5} <= set(ids)


def test_threshold_is_met_exactly():
    a = np.arange(0, 9, dtype=np.uint64)
    b = np.arange(1, 10, dtype=np.uint64)  # 8 of 10
    c = np.arange(2, 11, dtype=np.uint64)  # 7 of 11 with a
    assert linked([a], [b, c], 0.8).tolist() == [[True, False]]


def missed(lengths, threshold=0.8):
    return np.prod([1 - threshold**k for k in lengths])


def test_prefixes_are_shortened_to_the_target_recall():
    usual = climb({}, 0.8, 32, 8, 5, 0.9999)
    assert missed(usual) <= 1e-4 < missed([k + 1 for k in usual]) and set(usual) == {6, 7}
    assert missed(usual) > 0.5e-4  # no further than needed
    assert climb({}, 0.8, 32, 8, 5, 0.5) == [8] * 32
    # crowded trees keep long prefixes where the others suffice, and are entered where they don't
    some = climb({t: 6 for t in range(12)}, 0.8, 32, 8, 5, 0.9999)
    assert missed(some) <= 1e-4 and set(some[:12]) == {7} and min(some[12:]) == 5
    every = climb({t: 8 for t in range(32)}, 0.8, 32, 8, 5, 0.9999)
    assert missed(every) <= 1e-4
    assert climb({}, 0.8, 4, 8, 5, 0.9999) == [5] * 4


def test_classes_use_prefixes_of_their_own(spark):
    rows = [(i, t, [1000 + t, 2000 + t, 3000 + t, 4000 + t + i]) for i in (1, 2) for t in range(32)] + [(3, t, [9, 9, 9, 9]) for t in range(32)]
    nodes = [(5 + j, 1000 * (j + 1) + t, 100 if t < 12 and j < 2 else 2, 1) for t in range(32) for j in range(3)]
    m = spark.createDataFrame(rows, "id long, tree int, keys array<long>")
    n = spark.createDataFrame(nodes, "length int, key long, n long, low long")
    got = choose_prefixes(m, n, threshold=0.8, trees=32, depth=8, floor=5, recall=0.9999, crowd=64).collect()
    lengths = {i: [r.length for r in sorted(got, key=lambda r: r.tree) if r.id == i] for i in (1, 2, 3)}
    assert lengths[1] == lengths[2] == climb({t: 6 for t in range(12)}, 0.8, 32, 8, 5, 0.9999)
    assert lengths[3] == climb({}, 0.8, 32, 8, 5, 0.9999) != lengths[1]
    assert all(r.key == dict(((i, t), k) for i, t, k in rows)[r.id, r.tree][r.length - 5] for r in got)


def test_crowded_forest_against_all_pairs(spark):
    r = random.Random(4)
    page = [f"p{i}" for i in range(60)]
    texts = [" ".join(page + [f"w{r.randrange(200)}" for _ in range(r.randrange(0, 40))]) for _ in range(150)]
    texts += [mutated(r, page * 2, r.randrange(0, 12)) for _ in range(60)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(near_duplicates(df, block=16, crowd=8)) == brute(rows)


def thue_morse(n):
    s = "a"
    for _ in range(n):
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_of_regular_structure_differ(spark):
    a = thue_morse(10)
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, a + " x"), (4, " ".join(a)), (5, " ".join(b)), (6, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df)) == brute(rows)
