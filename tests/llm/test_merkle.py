import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from provena.llm import merkle
from provena.llm.merkle import TOP, Forest, build_manifest, digest_of, proofs, row_digest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(values):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def levels(nodes):
    """All levels of a tree over its leaves."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest_of(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def brute(rows, altered=lambda row: None):
    """(id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), altered(row)))
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    grown = [levels([x[2] for x in sorted(trees[k])]) for k in keys]
    top, out = levels([g[-1][0] for g in grown]), []
    for t, (key, tree) in enumerate(zip(keys, grown, strict=True)):
        for i, (known, doc, own, other) in enumerate(sorted(trees[key], key=lambda x: x[:3])):
            siblings, folded = [], other or own
            for at, path in ((i, tree), (t, top)):
                for level in path[:-1]:
                    run = level[at - at % 8 : at - at % 8 + 8]
                    left, right = run[: at % 8], run[at % 8 + 1 :]
                    siblings += left + right
                    folded = digest_of(*left, folded, *right)
                    at //= 8
            out.append((doc if known else None, own, tree[-1][0], top[-1][0], digest_of(*siblings), folded, folded == top[-1][0]))
    return out


def ordered(rows):
    return sorted(rows, key=str)


def told(df):
    return ordered(tuple(r) for r in df.collect())


def tampered(row):
    return leaf([*row[:4], None if row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])]) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 else None


@pytest.mark.parametrize("sizes", [(1,), (8,), (9,), (1, 1), (65, 0, 512, 513), (5000, 1, 64, 7, 3, 8, 2, 1, 100)])
def test_trees_of_all_sizes(spark, sizes):
    rows = [(i * 1000 + t, "s", None if t == 1 else f"l{t}", i, f"Text {i} {t}") for t, n in enumerate(sizes) for i in range(n)]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, row_digest(*[F.lower("text") if c == "text" else F.col(c) for c in COLUMNS]))
    got = told(proofs(build_manifest(docs, COLUMNS, altered=altered)))
    assert got == ordered(brute(rows, tampered))
    assert {r[-1] for r in got} == ({True, False} if any(map(tampered, rows)) and not all(map(tampered, rows)) else {not any(map(tampered, rows))})


def test_many_rounds_and_partitions(spark, monkeypatch):
    rows = [(i, None, "ab"[i % 3 == 0], None, None if i % 5 else "") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    monkeypatch.setattr(merkle, "FAN_IN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        manifest = build_manifest(docs, COLUMNS)
        assert told(proofs(manifest)) == ordered(brute(rows))
        want = {r[2] for r in brute(rows)}
        assert {r.subroot for r in manifest.subroots().collect()} == want
        assert sorted(r.leaves for r in manifest.subroots().collect()) == [1000, 2000]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(spark, odd, odd_rows, none):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows]
    got = told(proofs(build_manifest(odd, COLUMNS)))
    assert got == ordered(brute(rows)) and all(r[-1] for r in got)
    nothing = build_manifest(none, COLUMNS)
    assert nothing.root is None and told(proofs(nothing)) == []


def test_a_changed_row_changes_its_path_only(spark):
    rows = [(i, "s", "en" if i % 2 else "de", 1, f"t{i}") for i in range(700)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = build_manifest(spark.createDataFrame(rows, schema), COLUMNS)
    rows[31] = (31, "s", "en", 1, "other")
    two = build_manifest(spark.createDataFrame(rows, schema), COLUMNS)
    a, b = ({(r.key): r.subroot for r in m.subroots().collect()} for m in (one, two))
    assert one.root != two.root and a["de"] == b["de"] and a["en"] != b["en"]


def test_forest_is_associative():
    leaves = [(t, 0, i, n, digest_of(str(t), str(i))) for t, n in enumerate((70, 9, 1)) for i in range(n)]
    want = levels([levels([x[4] for x in leaves if x[0] == t])[-1][0] for t in range(3)])[-1][0]
    for seed in range(5):
        r = random.Random(seed)
        r.shuffle(leaves)
        parts = [[] for _ in range(9)]
        for x in leaves:
            parts[r.randrange(9)].append(x)
        roots = []
        while len(parts) > 1 or roots == []:
            r.shuffle(parts)
            merged = []
            for k in range(0, len(parts), 2):
                f = Forest(3)
                for node in [n for p in parts[k : k + 2] for n in p]:
                    f.add(*node)
                rows = list(f.flush(0))
                roots += [n for kind, _, ns in rows if kind == "root" for n in ns]
                merged.append([n for kind, _, ns in rows if kind == "open" for n in ns])
            parts = merged
            if not any(parts):
                break
        assert [x[4] for x in roots if x[0] == TOP] == [want] and len(roots) == 4
