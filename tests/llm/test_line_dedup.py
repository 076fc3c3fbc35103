import string

from pyspark.sql import functions as F

from provena.llm.line_dedup import LineRuns, dedup_lines, line_hashes

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, min_chars=10):
    top = (1 << 63) - 1
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    owner = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            k = key(line)
            if len(k) >= min_chars:
                owner[k] = min(owner.get(k, top), top if r[0] is None else r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), r[0] if r[0] is not None else top) == (top if r[0] is None else r[0])]
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_odd_rows(odd, odd_rows):
    for batches, fanout in ((1, 2), (4, 2), (7, 3)):
        got = dedup_lines(odd, batches=batches, fanout=fanout)
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute(odd_rows)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]


def test_clashing_names_and_empty(odd, none):
    clash = odd.withColumns({"N_LINES": F.lit("x"), "n_dropped": F.lit(None)})
    assert dedup_lines(clash).columns == [*odd.columns, "n_lines", "n_dropped"]
    assert dedup_lines(none).collect() == []


def test_levels_are_compacted(spark):
    runs = LineRuns(spark, fanout=2)
    for k in range(5):
        claims = spark.range(k * 5, k * 5 + 10).selectExpr("id AS h1", "id AS h2", f"{k}L AS owner", f"{k}L AS last")
        fresh = runs.add(claims).where("fresh").count()
        assert fresh == (10 if k == 0 else 5)
    assert sum(len(x) for x in runs.levels) < 5
    held = {r.h1: r.held for run in runs.runs() for r in run.collect()}
    assert held == {i: max(0, (i - 5) // 5) if i >= 10 else 0 for i in range(30)}
    runs.forget()


def test_a_run_is_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = LineRuns(spark)
        claims = spark.range(100).selectExpr("id AS h1", "id AS h2", "1L AS owner", "1L AS last")
        runs.add(claims)
        run = runs.runs()[0]
        plan = claims.groupBy("h1", "h2").agg(F.min("owner")).join(run, ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        runs.forget()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_runs_go_on_in_later_calls(spark):
    rows = [(i, "\n".join(f"line number {(i * k) % 17} of the text" for k in range(1, 6))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.text for r in dedup_lines(df, batches=1).collect()}
    runs, got = LineRuns(spark, fanout=2), {}
    for low in (0, 7, 15, 22):
        high = {0: 7, 7: 15, 15: 22, 22: 30}[low]
        got |= {r.doc_id: r.text for r in dedup_lines(df.where(f"doc_id >= {low} AND doc_id < {high}"), batches=2, runs=runs).collect()}
        later = LineRuns.restored(spark, runs.state())
        runs.forget()
        runs = later
    assert got == whole
    runs.forget()


def test_batches_are_filtered_in_the_scan(spark):
    df = spark.createDataFrame([(i, f"line number {i} of all") for i in range(40)], "doc_id long, text string")
    lines = line_hashes(df.withColumns({"__rank": F.col("doc_id"), "__text": F.col("text"), "__a": F.lit(1), "__b": F.lit(2)}), 10)
    plan = lines.where(F.col("__rank") >= 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(__rank,5)" in plan
