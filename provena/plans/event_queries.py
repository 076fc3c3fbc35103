"""Named queries over bank lines, events, texts and pages: series, balances, intervals, chains, scalars (F, I, J)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import checks as K
from provena.functions import money as Y
from provena.functions import web as B
from provena.functions.text import best_marker
from provena.operators import aggregates as A
from provena.operators import chain as H
from provena.operators import matching as M
from provena.operators import selection as S
from provena.operators import windows as N
from provena.plans.bind import DOC, TX, doc, table, tx, with_ctes
from provena.plans.registry import query
from provena.storage import write_table

BANDS = "CASE WHEN g BETWEEN 6 AND 8 THEN 'weekly' WHEN g BETWEEN 26 AND 35 THEN 'monthly' WHEN g BETWEEN 84 AND 98 THEN 'quarterly' WHEN g BETWEEN 355 AND 376 THEN 'yearly' END"


@query(with_ctes(DOC) + f""",
d AS (SELECT DISTINCT party, issue_date FROM doc),
g AS (SELECT party, date_diff('day', lag(issue_date) OVER (PARTITION BY party ORDER BY issue_date), issue_date) AS gap FROM d),
m AS (SELECT party, median(CAST(gap AS DOUBLE)) AS g, count(*) AS n_gaps FROM g WHERE gap IS NOT NULL GROUP BY party),
b AS (SELECT m.*, {BANDS} AS band FROM m),
i AS (SELECT b.party, count(*) FILTER ({BANDS.replace('g BETWEEN', 'gap BETWEEN')} = band) AS n_inside FROM b JOIN g ON g.party = b.party AND gap IS NOT NULL GROUP BY b.party)
SELECT party, g AS median_gap, n_gaps, n_inside, CASE WHEN n_gaps + 1 >= 3 AND n_inside * 3 >= n_gaps * 2 THEN band END AS cadence FROM b JOIN i USING (party)""")
def cadence_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Median gap of each party and the cadence that it keeps."""
    return N.cadence(doc(spark, sf), ["party"], "issue_date")


@query()
def recurring_series(spark: SparkSession, sf: str) -> DataFrame:
    """the period that each party's invoices follow, if any."""
    return N.recurring_series(doc(spark, sf), "party", "issue_date")


@query(with_ctes(DOC) + """,
l AS (SELECT party, max(issue_date) AS last_seen, CASE WHEN party % 3 = 0 THEN 1 WHEN party % 3 = 1 THEN 3 ELSE 12 END AS months FROM doc GROUP BY party),
e AS (SELECT party, last_seen, months, (SELECT min(CAST(last_seen + to_months(CAST(k * months AS INTEGER)) AS DATE)) FROM range(1, 121) r(k) WHERE last_seen + to_months(CAST(k * months AS INTEGER)) >= DATE '2001-08-01') AS expected FROM l)
SELECT party, last_seen, CAST(months AS BIGINT) AS months, expected, last_seen + to_months(CAST(months AS INTEGER)) < DATE '2001-08-01' AS overdue FROM e""")
def next_expected_overdue(spark: SparkSession, sf: str) -> DataFrame:
    """the next arrival of a series, in whole months from its last one, and whether one was due already."""
    months = F.when(F.col("party") % 3 == 0, 1).when(F.col("party") % 3 == 1, 3).otherwise(12)
    today = F.lit(date(2001, 8, 1))
    last = doc(spark, sf).groupBy("party").agg(F.max("issue_date").alias("last_seen")).withColumn("months", months.cast("bigint"))
    return last.withColumns({"expected": N.next_expected(F.col("last_seen"), F.col("months"), today), "overdue": F.add_months("last_seen", F.col("months").cast("int")) < today})


@query(with_ctes(DOC) + """,
m AS (SELECT party, month(issue_date) AS m, count(*) AS n FROM doc GROUP BY ALL),
s AS (SELECT party, list_sort(list(m)) AS season FROM (SELECT *, row_number() OVER (PARTITION BY party ORDER BY n DESC, m) AS nth FROM m) WHERE nth <= 4 GROUP BY party),
l AS (SELECT party, max(issue_date) AS last_seen FROM doc GROUP BY party),
e AS (SELECT party, (SELECT min(CAST(last_seen + to_months(CAST(k AS INTEGER)) AS DATE)) FROM range(1, 121) r(k) WHERE CAST(last_seen + to_months(CAST(k AS INTEGER)) AS DATE) >= DATE '2001-08-01' AND list_contains(season, month(last_seen + to_months(CAST(k AS INTEGER))))) AS expected FROM l JOIN s USING (party))
SELECT party, last_seen, array_to_string(season, ',') AS season, expected FROM l JOIN s USING (party) JOIN e USING (party)""")
def next_in_season(spark: SparkSession, sf: str) -> DataFrame:
    """the next arrival of each party within its season, the (up to) four months in which most of its invoices lie."""
    from pyspark.sql import Window as W

    months = doc(spark, sf).groupBy("party", F.month("issue_date").alias("m")).agg(F.count("*").alias("n"))
    best = months.withColumn("nth", F.row_number().over(W.partitionBy("party").orderBy(F.col("n").desc(), "m"))).where("nth <= 4")
    season = best.groupBy("party").agg(F.array_sort(F.collect_list("m")).alias("months"))
    last = doc(spark, sf).groupBy("party").agg(F.max("issue_date").alias("last_seen")).join(season, "party")
    return last.select("party", "last_seen", F.array_join(F.col("months").cast("array<string>"), ",").alias("season"), N.next_in_season(F.col("last_seen"), F.col("months"), F.lit(date(2001, 8, 1))).alias("expected"))


@query(with_ctes(TX) + """,
d AS (SELECT account, kind, booked_on, CAST(round(abs(amount), 0) AS BIGINT) AS units, count(*) AS n FROM tx GROUP BY ALL),
g AS (SELECT *, date_diff('day', lag(booked_on) OVER (PARTITION BY account, kind ORDER BY booked_on, units), booked_on) AS gap FROM d)
SELECT account, kind, count(DISTINCT units) AS amounts, min(gap) AS low, max(gap) AS high, count(DISTINCT units) = 1 AS same_amount FROM g GROUP BY account, kind""")
def payer_series_same_amount(spark: SparkSession, sf: str) -> DataFrame:
    """payers with one amount, and the bounds of the days between their payments."""
    from pyspark.sql import Window as W

    units = F.round(F.abs("amount"), 0).cast("bigint")
    d = tx(spark, sf).groupBy("account", "kind", "booked_on", units.alias("units")).agg(F.count("*").alias("n"))
    w = W.partitionBy("account", "kind").orderBy("booked_on", "units")
    gap = F.datediff("booked_on", F.lag("booked_on").over(w)).cast("bigint")
    agg = d.withColumn("gap", gap).groupBy("account", "kind").agg(F.count_distinct("units").alias("amounts"), F.min("gap").alias("low"), F.max("gap").alias("high"))
    return agg.withColumn("same_amount", F.col("amounts") == 1)


@query(with_ctes(TX) + """,
r AS (SELECT *, count(*) FILTER (kind = 'signup') OVER (PARTITION BY account ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM tx)
SELECT id, account, kind, amount, CAST(sum(amount) OVER (PARTITION BY account, run ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS DECIMAL(28,2)) AS balance FROM r""")
def cash_box_balance(spark: SparkSession, sf: str) -> DataFrame:
    """A running balance that each count (a signup here) replaces."""
    out = N.reset_balance(tx(spark, sf), ["account"], [F.col("ts"), F.col("id")], F.col("amount"), F.col("kind") == "signup")
    return out.select("id", "account", "kind", "amount", "balance")


@query(with_ctes(TX) + """
SELECT id, account, amount, CAST(sum(amount) OVER (PARTITION BY account ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS DECIMAL(28,2)) AS balance FROM tx""")
def running_balance_check(spark: SparkSession, sf: str) -> DataFrame:
    """F16: each account's balance after every line."""
    return N.running_balance(tx(spark, sf), ["account"], [F.col("ts"), F.col("id")], "amount").select("id", "account", "amount", "balance")


@query(with_ctes(TX) + """,
a AS (SELECT account, id AS taken_id, CAST(sum(amount) OVER w - amount AS DECIMAL(28,2)) AS lo, CAST(sum(amount) OVER w AS DECIMAL(28,2)) AS hi FROM tx WHERE kind = 'click' WINDOW w AS (PARTITION BY account ORDER BY ts, id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT account, id AS deposit_id, CAST(sum(-amount) OVER w + amount AS DECIMAL(28,2)) AS lo, CAST(sum(-amount) OVER w AS DECIMAL(28,2)) AS hi FROM tx WHERE kind = 'purchase' WINDOW w AS (PARTITION BY account ORDER BY ts, id ROWS UNBOUNDED PRECEDING))
SELECT a.account, taken_id, deposit_id, CAST(least(a.hi, b.hi) - greatest(a.lo, b.lo) AS DECIMAL(28,2)) AS allocated FROM a JOIN b ON a.account = b.account AND a.lo < b.hi AND b.lo < a.hi""")
def fifo_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """Takings go to deposits first in, first out, as overlapping running totals."""
    t = tx(spark, sf)
    order = [F.col("ts"), F.col("id")]
    ins = t.where("kind = 'click'").withColumn("taken_id", F.col("id"))
    outs = t.where("kind = 'purchase'").withColumns({"deposit_id": F.col("id"), "amount": (-F.col("amount")).cast("decimal(18,2)")})
    return M.fifo_overlap(ins, outs, "account", order, order, id_in="taken_id", id_out="deposit_id", amount="amount")


@query(with_ctes(TX) + """,
d AS (SELECT account, booked_on, CAST(sum(amount) AS DECIMAL(28,2)) AS total FROM tx WHERE kind = 'purchase' GROUP BY ALL),
c AS (SELECT *, sum(total) OVER (PARTITION BY account ORDER BY booked_on) AS cum, row_number() OVER (PARTITION BY account ORDER BY booked_on) AS rn FROM d)
SELECT a.account, a.booked_on AS first_day, b.booked_on AS last_day, b.rn - a.rn + 1 AS n_days, CAST(b.cum - a.cum + a.total AS DECIMAL(28,2)) AS amount
FROM c a JOIN c b ON a.account = b.account AND b.rn BETWEEN a.rn AND a.rn + 6""")
def day_window_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Exact sums of every run of up to seven days with purchases."""
    return N.day_windows(tx(spark, sf).where("kind = 'purchase'"), "account", "booked_on", "amount")


@query(with_ctes(TX) + """,
d AS (SELECT account, booked_on, -sum(amount) AS total FROM tx WHERE kind = 'purchase' GROUP BY account, booked_on),
c AS (SELECT *, sum(total) OVER (PARTITION BY account ORDER BY booked_on) AS cum, row_number() OVER (PARTITION BY account ORDER BY booked_on) AS rn FROM d),
w AS (SELECT a.account, a.booked_on AS first_day, b.booked_on AS last_day, b.cum - a.cum + a.total AS total, b.rn - a.rn + 1 AS n_days FROM c a JOIN c b ON a.account = b.account AND b.booked_on >= a.booked_on),
h AS (SELECT t.id, first_day, last_day, n_days, count(*) OVER (PARTITION BY t.id) > 1 AS ambiguous FROM tx t JOIN w ON t.account = w.account AND t.amount = w.total AND last_day <= t.booked_on AND first_day >= t.booked_on - 62 WHERE t.amount > 0)
SELECT t.id, t.account, t.booked_on, t.amount, first_day, last_day, n_days, ambiguous FROM tx t LEFT JOIN h ON t.id = h.id WHERE t.amount > 0""")
def day_window_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of days, of any length, whose purchases sum to a later or same day's money in, within 62 days."""
    t = tx(spark, sf)
    spent = t.where("kind = 'purchase'").withColumn("amount", (-F.col("amount")).cast("decimal(18,2)"))
    return N.day_window_matches(spent, t.where("amount > 0").select("id", "account", "booked_on", "amount"), "account", "booked_on", "amount", "id")


@query("""
SELECT user_id, min(ts) FILTER (event_type = 'signup') AS signup_at, min(ts) FILTER (event_type = 'view') AS view_at, min(ts) FILTER (event_type = 'purchase') AS purchase_at,
       CASE WHEN min(ts) FILTER (event_type = 'view') >= min(ts) FILTER (event_type = 'signup') THEN CAST(floor(floor((epoch_us(min(ts) FILTER (event_type = 'view')) - epoch_us(min(ts) FILTER (event_type = 'signup'))) / 1e6) / 60) AS BIGINT) END AS view_minutes,
       CASE WHEN min(ts) FILTER (event_type = 'purchase') >= min(ts) FILTER (event_type = 'signup') THEN CAST(floor(floor((epoch_us(min(ts) FILTER (event_type = 'purchase')) - epoch_us(min(ts) FILTER (event_type = 'signup'))) / 1e6) / 60) AS BIGINT) END AS purchase_minutes
FROM events GROUP BY user_id""")
def activation_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """First signup, view and purchase of each user and the minutes in between."""
    return A.funnel(table(spark, sf, "events"), "user_id", "event_type", "ts", ["signup", "view", "purchase"])


@query("""
WITH i AS (SELECT user_id, ts AS started, ts + INTERVAL 2 HOUR AS ended FROM events),
r AS (SELECT *, CASE WHEN started > max(ended) OVER (PARTITION BY user_id ORDER BY started, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR max(ended) OVER (PARTITION BY user_id ORDER BY started, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL THEN 1 ELSE 0 END AS new FROM i),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY started, ended ROWS UNBOUNDED PRECEDING) AS island FROM r),
m AS (SELECT user_id, island, min(started) AS started, max(ended) AS ended, count(*) AS n FROM s GROUP BY user_id, island)
SELECT user_id, started, ended, n, lead(started) OVER (PARTITION BY user_id ORDER BY started) AS next_started FROM m""")
def gaps_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Merged activity intervals of two hours, and where the gap after each ends."""
    from pyspark.sql import Window as W

    rows = table(spark, sf, "events").select("user_id", F.col("ts").alias("started"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("ended"))
    merged = N.merge_intervals(rows, ["user_id"], "started", "ended")
    return merged.withColumn("next_started", F.lead("started").over(W.partitionBy("user_id").orderBy("started")))


@query(with_ctes(TX) + """,
d AS (SELECT account, booked_on, lead(booked_on) OVER (PARTITION BY account ORDER BY booked_on) AS nxt FROM (SELECT DISTINCT account, booked_on FROM tx)),
c AS (SELECT account, max(booked_on) AS coverage_end FROM tx GROUP BY account),
p AS (SELECT * FROM (VALUES (DATE '2024-01-01', DATE '2024-01-08'), (DATE '2024-01-08', DATE '2024-01-15'), (DATE '2024-01-15', DATE '2024-01-22'), (DATE '2024-01-22', DATE '2024-01-29')) v(period_start, period_end))
SELECT c.account, period_start, period_end, period_end + 5 <= coverage_end AND NOT EXISTS (
  SELECT 1 FROM d WHERE d.account = c.account AND date_diff('day', booked_on, nxt) > 2 AND booked_on + 1 < period_end AND period_start < nxt) AS covered
FROM c, p""")
def coverage_predicate(spark: SparkSession, sf: str) -> DataFrame:
    """Weeks that were read to their end plus five days, without a known gap (more than two silent days)."""
    from pyspark.sql import Window as W

    days = tx(spark, sf).select("account", "booked_on").distinct()
    nxt = F.lead("booked_on").over(W.partitionBy("account").orderBy("booked_on"))
    gap = F.when(F.datediff("nxt", "booked_on") > 2, F.struct(F.date_add("booked_on", 1).alias("start"), F.col("nxt").alias("end")))
    read = days.withColumn("nxt", nxt).groupBy("account").agg(F.max("booked_on").alias("coverage_end"), F.collect_list(gap).alias("gaps"))
    weeks = F.explode(F.sequence(F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 22)), F.expr("INTERVAL 7 DAYS")))
    rows = read.select("*", weeks.alias("period_start")).withColumn("period_end", F.date_add("period_start", 7))
    return rows.select("account", "period_start", "period_end", S.period_covered(F.col("coverage_end"), F.col("gaps"), F.col("period_start"), F.col("period_end"), 5).alias("covered"))


@query("""
WITH p AS (SELECT user_id, ts, floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6) AS pause FROM events),
s AS (SELECT *, sum(CASE WHEN pause IS NULL OR pause >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM p)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n_events, CAST(ceil(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) / 60) AS BIGINT) AS active_minutes FROM s GROUP BY user_id, n""")
def session_active_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with pauses under 30 minutes, in whole minutes rounded up."""
    return N.sessions(table(spark, sf, "events"), "user_id", "ts")


@query("""
SELECT 'hour' AS grain, date_trunc('hour', ts) AS started, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount FROM events GROUP BY ALL
UNION ALL SELECT 'day', CAST(date_trunc('day', ts) AS TIMESTAMP), event_type, count(*), CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) FROM events GROUP BY ALL
UNION ALL SELECT 'month', CAST(date_trunc('month', ts) AS TIMESTAMP), event_type, count(*), CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) FROM events GROUP BY ALL""")
def tumbling_month_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly, daily and monthly windows of events."""
    e = table(spark, sf, "events").withColumn("amount", F.col("value").cast("decimal(18,2)"))
    sums = [F.count("*").alias("n"), A.total("amount").alias("amount")]
    parts = [e.groupBy(F.window("ts", size), "event_type").agg(*sums).select(F.lit(grain).alias("grain"), F.col("window.start").alias("started"), "event_type", "n", "amount") for grain, size in (("hour", "1 hour"), ("day", "1 day"))]
    months = e.groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("started"), "event_type").agg(*sums).select(F.lit("month").alias("grain"), "started", "event_type", "n", "amount")
    return parts[0].unionByName(parts[1]).unionByName(months)


@query("""
WITH w AS (SELECT event_type, unnest(generate_series(date_trunc('minute', ts) - INTERVAL 14 MINUTE, date_trunc('minute', ts), INTERVAL 1 MINUTE)) AS window_start FROM events)
SELECT event_type, window_start, window_start + INTERVAL 15 MINUTE AS window_end, count(*) AS attempts FROM w GROUP BY event_type, window_start HAVING count(*) > 4""")
def sliding_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """More than four events of a type within fifteen minutes, by the minute."""
    return N.sliding_counts(table(spark, sf, "events"), ["event_type"], "ts").where("attempts > 4")


@query()
def event_chain_verify(spark: SparkSession, sf: str) -> DataFrame:
    """A hash chain of each user's events, checked as it is and with edited, lost and cut-off entries."""
    e = table(spark, sf, "events")
    from pyspark.sql import Window as W

    numbered = e.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("seq"), F.to_json(F.struct("event_type", F.col("value").cast("decimal(18,2)").cast("string").alias("value"))).alias("body"))
    log = write_table(H.build_chain(numbered, "user_id", "seq", "body"), "event-chain")
    last = log.groupBy("user_id").agg(F.max(F.struct("seq", "hash")).alias("l")).select("user_id", F.col("l.seq").alias("last_seq"), F.col("l.hash").alias("last_hash"))
    kinds = {
        "intact": log,
        "edited": log.withColumn("body", F.when(F.col("seq") == 3, F.lit("{}")).otherwise(F.col("body"))),
        "lost": log.where("seq != 2"),
        "cut_off": log.join(last.select("user_id", "last_seq"), "user_id").where("seq < last_seq").drop("last_seq"),
    }
    out = None
    for kind, rows in kinds.items():
        got = H.verify_chain(rows, "user_id", "seq", "body", last).withColumn("copy", F.lit(kind))
        out = got if out is None else out.unionByName(got)
    return out


LEGAL = [("signup", "view"), ("view", "view"), ("view", "click"), ("click", "click"), ("click", "view"), ("click", "purchase"), ("view", "purchase"), ("purchase", "view"), ("purchase", "purchase"), ("error", "error")]


@query(f"""
WITH s AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events)
SELECT from_state, to_state, count(*) AS n, (from_state || '>' || to_state) IN ({', '.join(f"'{a}>{b}'" for a, b in LEGAL)}) AS legal FROM s WHERE from_state IS NOT NULL GROUP BY from_state, to_state""")
def stage_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Which stage follows which, how often, and whether it may."""
    return H.step_counts(N.transitions(table(spark, sf, "events"), "user_id", "event_type", [F.col("ts"), F.col("event_id")]), LEGAL)


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def json_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Typed values at JSON paths."""
    return table(spark, sf, "events").select("event_id", B.json_at("props", "$.k", "bigint").alias("k"), B.json_at("props", "$.missing", "string").alias("missing"))


@query("""
SELECT user_id, day, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM (SELECT *, CAST(ts AS DATE) AS day FROM events) GROUP BY user_id, day, event_type""")
def event_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of each user, day and type."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("user_id", "day", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(r"""
WITH h AS (SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host, url FROM pages),
l AS (SELECT *, string_split(host, '.') AS l FROM h)
SELECT page_id, CASE WHEN host <> '' THEN host END AS host,
       CASE WHEN host = '' THEN NULL WHEN len(l) < 2 THEN host WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ('co', 'com', 'org', 'net', 'gov', 'ac') THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
       CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) END AS page FROM l""")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Host, registrable domain and a query value."""
    p = table(spark, sf, "pages").withColumn("host", B.host("url"))
    return p.select("page_id", "host", B.registrable_domain("host").alias("domain"), B.query_value("url", "page").alias("page"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))::BIGINT AS emails, len(regexp_extract_all(text, '\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b'))::BIGINT AS ibans,
       len(regexp_extract_all(text, '\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b'))::BIGINT AS card_like FROM documents""")
def pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    """E-mail addresses, IBAN-like texts and card-like digits of each text."""
    return table(spark, sf, "documents").select("doc_id", K.count_matches("text", K.EMAIL).alias("emails"), K.count_matches("text", K.IBAN).alias("ibans"), K.count_matches("text", K.CARD).alias("card_like"))


MARKERS = {"de": ["der", "und", "die", "nicht", "ein"], "en": ["the", "and", "of", "to", "is"], "es": ["el", "de", "que", "y", "los"], "fr": ["le", "et", "les", "des", "une"]}


def _marker_sql() -> str:
    folded = r"list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '\s+', ' ', 'g')), '[^a-z0-9]+'), lambda x: x <> ''))"
    counts = ", ".join(f"len(list_intersect(t, [{', '.join(repr(w) for w in ws)}])) AS {k}" for k, ws in MARKERS.items())
    top = f"greatest({', '.join(MARKERS)})"
    ties = " + ".join(f"CAST({k} = top AS INT)" for k in MARKERS)
    label = " ".join(f"WHEN {k} = top THEN '{k}'" for k in MARKERS)
    return f"WITH w AS (SELECT doc_id, {folded} AS t FROM documents), c AS (SELECT doc_id, {counts} FROM w), g AS (SELECT *, {top} AS top FROM c) SELECT doc_id, CASE WHEN top >= 1 AND {ties} = 1 THEN CASE {label} END END AS language FROM g"


@query(_marker_sql())
def language_markers(spark: SparkSession, sf: str) -> DataFrame:
    """The language with most distinct marker words; ties stay open."""
    return table(spark, sf, "documents").select("doc_id", best_marker("text", MARKERS).alias("language"))


@query("""
WITH d AS (SELECT c_custkey AS id, lpad(CAST(c_custkey * 7919 + 1000003 AS VARCHAR), 16, '4') AS digits FROM customer),
s AS (SELECT id, digits, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CAST(digits[17 - i] AS INT) ELSE CASE WHEN CAST(digits[17 - i] AS INT) * 2 > 9 THEN CAST(digits[17 - i] AS INT) * 2 - 9 ELSE CAST(digits[17 - i] AS INT) * 2 END END)) AS total FROM d)
SELECT id, digits, total % 10 = 0 AS luhn, CAST(CAST(digits AS HUGEINT) % 97 AS BIGINT) AS remainder FROM s""")
def check_digits(spark: SparkSession, sf: str) -> DataFrame:
    """Luhn and mod 97 of sixteen-digit numbers."""
    digits = F.lpad((F.col("c_custkey") * 7919 + 1000003).cast("string"), 16, "4")
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), digits.alias("digits"))
    return d.select("id", "digits", K.luhn_ok("digits").alias("luhn"), K.mod97("digits").cast("bigint").alias("remainder"))


@query("""
WITH o AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS g FROM orders)
SELECT id, CASE id % 7 WHEN 6 THEN 0 ELSE 1 END::BIGINT AS n_readings, CASE WHEN id % 7 IN (2, 4) THEN CAST(-g AS DECIMAL(18,2)) WHEN id % 7 = 5 THEN CAST(floor(g) AS DECIMAL(18,2)) WHEN id % 7 = 6 THEN NULL ELSE g END AS amount FROM o""")
def amount_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's total written in seven ways (marks, brackets, signs, currency, no amount) and what it may mean."""
    k, g = F.col("o_orderkey") % 7, F.col("o_totalprice").cast("decimal(18,2)")
    marked, comma = F.format_number(g, 2), F.translate(F.format_number(g, 2), ",.", ".,")
    written = (
        F.when(k == 0, marked)
        .when(k == 1, F.concat(F.lit("EUR "), comma))
        .when(k == 2, F.concat(F.lit("("), comma, F.lit(")")))
        .when(k == 3, F.concat(F.replace(g.cast("string"), F.lit("."), F.lit(",")), F.lit(" €")))
        .when(k == 4, F.concat(g.cast("string"), F.lit("-")))
        .when(k == 5, F.format_number(F.floor(g), 0))
        .otherwise(F.concat(F.lit("no. "), "o_orderkey", F.lit("/x1.2.3")))
    )
    found = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), Y.amount_readings(written).alias("r"))
    return found.select("id", F.size("r").cast("bigint").alias("n_readings"), F.get("r", F.lit(0)).alias("amount"))


@query()
def html_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Characters and words of each page's visible text, anchors and title."""
    from provena.sources.texts import read_pages

    p = read_pages(table(spark, sf, "pages"))
    return p.select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.regexp_count("text", F.lit(r"\S+")).cast("bigint").alias("n_words"), F.size("anchors").cast("bigint").alias("n_anchors"), "title")


@query()
def link_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's best link by points, then address."""
    from provena.sources.texts import link_scores, read_pages

    links = link_scores(read_pages(table(spark, sf, "pages").select("page_id", "html")).select("page_id", F.inline("anchors")))
    return S.top_per_group(links, ["page_id"], [F.col("points").desc(), F.col("href"), F.col("label")], 1).select("page_id", "href", "label", "points")


@query("""
SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n_events, count(DISTINCT event_type) AS n_types, CAST(max(ts) AS TIMESTAMP) AS last_seen,
       CASE WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts)) > 4 * 86400000000 THEN 'broken' WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts)) > 36 * 3600000000 THEN 'stale' ELSE 'healthy' END AS health
FROM events GROUP BY ALL""".replace("date_trunc('day', ts) AS day", "CAST(ts AS DATE) AS day"))
def source_health(spark: SparkSession, sf: str) -> DataFrame:
    """How fresh each source is: stale after 36 hours, broken after four days."""
    from provena.streaming.states import health

    e = table(spark, sf, "events")
    days = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n_events"), F.count_distinct("event_type").alias("n_types"), F.max("ts").alias("last_seen"))
    return days.withColumn("health", health(F.col("last_seen"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")))


@query("""
SELECT event_id AS job, 1 + event_id % 6 AS attempts, least(60, CAST(pow(2, event_id % 6) AS BIGINT)) AS wait_minutes,
       CASE WHEN event_type = 'purchase' THEN 'done' WHEN 1 + event_id % 6 >= 5 THEN 'dead' WHEN epoch_us(TIMESTAMP '2024-01-15 00:00:00') > epoch_us(ts) + 600000000 THEN 'retry' ELSE 'leased' END AS state
FROM events""")
def job_states(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts, waiting time and state of jobs: leases of ten minutes, five attempts."""
    from provena.streaming.states import backoff_minutes, job_state

    e = table(spark, sf, "events").withColumn("attempts", 1 + F.col("event_id") % 6)
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return e.select(F.col("event_id").alias("job"), "attempts", backoff_minutes(F.col("attempts")).alias("wait_minutes"), job_state(F.col("event_type") == "purchase", F.col("attempts"), F.col("ts"), now).alias("state"))
