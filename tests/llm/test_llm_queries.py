"""The registered queries against DuckDB where SQL expresses them; the pipeline stage by stage."""

import random

import corpus_pipeline
import pytest
from parity import compare, connect

import __spark_entry__
from provena.llm import queries as Q
from provena.llm.common import write_table
from provena.llm.mixing import mix_sources
from provena.llm.near_duplicates import near_duplicates


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_rows_as_sql(spark, sf, con, name):
    compare(Q.QUERIES[name](spark, sf), con, Q.ORACLES[name])


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in Q.QUERIES}
    assert "pipeline" in names and set(Q.QUERIES) <= set(names)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, sf)
        rows = after.collect()
        assert rows, name
        if k < 4:
            assert after.dtypes == docs.dtypes
            assert all(r.n_chars == len(r.text) for r in rows)
            ids = [r.doc_id for r in rows]
            assert len(ids) == len(set(ids))
            before = spark.createDataFrame(rows, docs.schema)
        if name == "ngram_jaccard_join":
            left = near_duplicates(after)
            assert left.where("n_links > 0 AND n_shingles > 0").count() == 0
    assert set(docs.columns) < set(after.columns)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, rows))


def test_pipeline_on_odd_rows(spark, sf, odd, none):
    for docs in (odd.drop("n_words"), none.drop("n_words")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            assert out.count() >= 0
            if k < 4:
                assert out.columns == docs.columns


def brute_stages(spark, rows, items):
    """The rows (doc_id, text, lang, source, n_chars) that each of the first four stages keeps, by the brute forms of the operators."""
    from test_line_dedup import brute as brute_lines
    from test_near_duplicates import brute as brute_groups
    from test_text_operators import brute_hits, brute_quality

    rest, out = {r[0]: r[2:] for r in rows}, []
    keep = lambda texts: out.append([(i, t, *rest[i][:2], len(t)) for i, t in texts.items()]) or texts
    texts = keep({q[0]: q[-1] for q in brute_quality(rows, 30, 0.03) if q[-2]})
    told = brute_lines([(i, t, *rest[i]) for i, t in texts.items()])
    texts = keep({q[0]: q[1] for q in told if q[1].strip(" \t\n\x0b\f\r") or q[1] == texts[q[0]]})
    groups = brute_groups(list(texts.items()))
    texts = keep({i: t for i, t in texts.items() if groups[i][0] == i})
    flagged = {h[0] for h in brute_hits(list(texts.items()), items) if h[-1]}
    keep({i: t for i, t in texts.items() if i not in flagged})
    return out


def stage_rows(spark, docs, sf, stages=4):
    out = []
    for _, stage in corpus_pipeline.STAGES[:stages]:
        docs = write_table(stage(spark, docs, sf), "test-stage")
        out.append(sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()))
    return out


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute_stages(spark, rows, items)
    assert stage_rows(spark, docs, sf) == [sorted(w) for w in want]
    assert len(rows) > len(want[0]) > len(want[1]) and len(want[2]) > len(want[3])
    assert all(r[1].strip() for r in want[1])
    mixed = mix_sources(spark.createDataFrame(want[-1], "doc_id long, text string, lang string, source string, n_chars long"))
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, got.select(mixed.columns).collect())) == sorted(map(str, mixed.collect()))


def test_every_stage_of_the_pipeline_removes_what_is_planted(spark, sf):
    """Near copies that differ in the last word of every line, exact copies, a benchmark passage, a text of repeats."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    line = lambda n=30: [word() for _ in range(n)]
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    base = [[line(90), line(90)] for _ in range(12)]
    text = lambda lines: "\n".join(" ".join(x) for x in lines)
    near = [[[*x[:89], word()] for x in doc] for doc in base]
    rows = [(k, text(b)) for k, b in enumerate(base)] + [(100 + k, text(b)) for k, b in enumerate(near)] + [(200 + k, text(b)) for k, b in enumerate(base[:3])]
    rows += [(300, text([line(), line()]) + "\n" + items[0][1] + " " + items[1][1]), (301, " ".join(["same words again"] * 60)), (302, "short")]
    docs = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in rows]
    want = brute_stages(spark, docs, items)
    got = stage_rows(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), sf)
    assert got == [sorted(w) for w in want]
    ids = [{x[0] for x in g} for g in got]
    assert {x[0] for x in docs} - ids[0] == {301, 302} and ids[0] - ids[1] == {200, 201, 202}
    assert ids[1] - ids[2] == {100 + k for k in range(12)} and ids[2] - ids[3] == {300} and ids[3] == set(range(12))
