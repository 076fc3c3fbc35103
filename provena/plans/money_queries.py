"""Named queries over invoices and their lines: selection, totals, groupings, splits, prices (C, E, F, I15)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.functions.dates import month_key
from provena.operators import aggregates as A
from provena.operators import selection as S
from provena.operators import windows as N
from provena.plans.bind import DOC, DOC_LINE, doc, doc_line, money, table, with_ctes
from provena.plans.registry import query

LINE_ORDER = ["on_day", "doc", "line", "supplier", "product"]


@query(with_ctes(DOC) + """
SELECT party, strftime(issue_date, '%Y-%m') AS month, CAST(sum(gross) AS DECIMAL(28,2)) AS amount, count(*) AS n
FROM doc GROUP BY ALL ORDER BY party, month""")
def spend_by_party_month(spark: SparkSession, sf: str) -> DataFrame:
    """Money out by supplier and month."""
    rows = doc(spark, sf).groupBy("party", month_key("issue_date").alias("month")).agg(A.total("gross").alias("amount"), F.count("*").alias("n"))
    return rows.orderBy("party", "month")


@query(with_ctes(DOC) + """
SELECT id, party, issue_date, gross, category FROM doc
WHERE issue_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND party % 10 = 3 AND category IN ('1-URGENT', '2-HIGH')
UNION ALL
SELECT id, party, issue_date, gross, category FROM doc WHERE abs(abs(gross) - 112946.26) <= 0.005""")
def ledger_select_filters(spark: SparkSession, sf: str) -> DataFrame:
    """By days, parties and category, and by an amount give or take half a cent."""
    d = doc(spark, sf).select("id", "party", "issue_date", "gross", "category")
    some = S.select_ledger(d, start=date(1996, 1, 1), end=date(1998, 12, 31), categories=["1-URGENT", "2-HIGH"]).where("party % 10 = 3")
    return some.unionByName(S.select_ledger(d, amount="112946.26"))


@query(r"""
SELECT doc_id, lang, source, n_chars FROM documents
WHERE contains(trim(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '\s+', ' ', 'g')), 'tion')
  AND contains(trim(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '\s+', ' ', 'g')), 'the')
ORDER BY doc_id DESC""")
def document_search(spark: SparkSession, sf: str) -> DataFrame:
    """All words contained, newest first."""
    return S.search_documents(table(spark, sf, "documents"), ["tion", "the"]).select("doc_id", "lang", "source", "n_chars").orderBy(F.col("doc_id").desc())


BUCKETS = """CASE WHEN doc_type = 'partial' AND gross < 50000 THEN 'held'
         WHEN doc_type = 'partial' THEN 'waiting'
         WHEN category = '5-LOW' THEN 'left_out'
         WHEN doc_type = 'open' THEN 'pending' ELSE 'counted' END"""


@query(with_ctes(DOC) + f"""
SELECT {BUCKETS} AS bucket, CAST(sum(gross) AS DECIMAL(28,2)) AS amount, count(*) AS n FROM doc GROUP BY 1""")
def money_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Every row falls into the first bucket that fits."""
    partial = F.col("doc_type") == "partial"
    bucket = A.first_bucket(("held", partial & (F.col("gross") < 50000)), ("waiting", partial), ("left_out", F.col("category") == "5-LOW"), ("pending", F.col("doc_type") == "open"), otherwise="counted")
    return doc(spark, sf).groupBy(bucket.alias("bucket")).agg(A.total("gross").alias("amount"), F.count("*").alias("n"))


@query(with_ctes(DOC) + """
SELECT category, CAST(coalesce(sum(gross) FILTER (issue_date >= DATE '1997-01-01'), 0) AS DECIMAL(28,2)) AS amount,
       CAST(coalesce(sum(gross) FILTER (issue_date < DATE '1997-01-01'), 0) AS DECIMAL(28,2)) AS previous,
       CAST(coalesce(sum(gross) FILTER (issue_date >= DATE '1997-01-01'), 0) - coalesce(sum(gross) FILTER (issue_date < DATE '1997-01-01'), 0) AS DECIMAL(28,2)) AS change
FROM doc WHERE issue_date >= DATE '1996-01-01' AND issue_date < DATE '1998-01-01' GROUP BY category""")
def money_compare_previous(spark: SparkSession, sf: str) -> DataFrame:
    """A year against the one before, in one pass."""
    now = F.col("issue_date") >= F.lit(date(1997, 1, 1))
    d = doc(spark, sf).where((F.col("issue_date") >= F.lit(date(1996, 1, 1))) & (F.col("issue_date") < F.lit(date(1998, 1, 1))))
    agg = d.groupBy("category").agg(A.total(F.when(now, F.col("gross"))).alias("amount"), A.total(F.when(~now, F.col("gross"))).alias("previous"))
    return agg.withColumn("change", (F.col("amount") - F.col("previous")).cast(A.MONEY))


@query(with_ctes(DOC) + """
SELECT n_nationkey AS company, category, strftime(issue_date, '%Y-%m') AS month, CAST(sum(gross) AS DECIMAL(28,2)) AS amount, count(*) AS n,
       CAST(grouping(n_nationkey) * 4 + grouping(category) * 2 + grouping(strftime(issue_date, '%Y-%m')) AS BIGINT) AS grouping_id
FROM doc JOIN customer ON party = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY GROUPING SETS ((n_nationkey), (category), (strftime(issue_date, '%Y-%m')), ())""")
def group_rows_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows by company, by category, by month and in all, in one pass."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    rows = doc(spark, sf).join(c, F.col("party") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("company"), "category", month_key("issue_date").alias("month"), "gross")
    return A.by_groups(rows, "gross", [["company"], ["category"], ["month"], []], ["company", "category", "month"])


@query("""
SELECT r_name AS region, n_name AS nation, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS balance, count(*) AS n,
       CAST(grouping(r_name) * 2 + grouping(n_name) AS BIGINT) AS grouping_id
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def entity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Balances of companies rolled up to their regions."""
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(A.total(money("c_acctbal")).alias("balance"), F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("grouping_id"))


@query(with_ctes(DOC) + """
SELECT doc_type, category, CAST(sum(gross) AS DECIMAL(28,2)) AS amount, count(*) AS n, CAST(grouping(doc_type) * 2 + grouping(category) AS BIGINT) AS grouping_id
FROM doc GROUP BY CUBE (doc_type, category)""")
def category_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination of status and category."""
    return doc(spark, sf).cube("doc_type", "category").agg(A.total("gross").alias("amount"), F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("grouping_id"))


@query(with_ctes(DOC_LINE) + """
SELECT vat_rate, flag, CAST(sum(s * net) AS DECIMAL(28,2)) AS net, CAST(sum(s * tax) AS DECIMAL(28,2)) AS tax, CAST(sum(s * net + s * tax) AS DECIMAL(28,2)) AS gross, count(*) AS n
FROM (SELECT *, CASE WHEN flag = 'R' THEN -1 ELSE 1 END AS s, CAST(round(net * vat_rate, 2) AS DECIMAL(18,2)) AS tax FROM doc_line) GROUP BY vat_rate, flag""")
def vat_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Net, tax and gross by rate; returned lines count against."""
    return A.vat_summary(doc_line(spark, sf), ["vat_rate", "flag"], F.when(F.col("flag") == "R", -1).otherwise(1))


@query(with_ctes(DOC_LINE) + """,
h AS (SELECT doc, CAST(sum(net) AS DECIMAL(28,2)) + CASE WHEN doc % 11 = 0 THEN 1.00 ELSE 0.00 END AS stated FROM doc_line GROUP BY doc)
SELECT doc, CAST(stated AS DECIMAL(28,2)) AS stated, CAST(sum(net) AS DECIMAL(28,2)) AS lines_total, count(*) AS n_lines,
       CAST(sum(net) - stated AS DECIMAL(28,2)) AS diff, abs(sum(net) - stated) <= count(*) * 0.01 AS ok
FROM doc_line JOIN h USING (doc) GROUP BY doc, stated""")
def lines_reconcile_to_header(spark: SparkSession, sf: str) -> DataFrame:
    """Lines against the header's total (derived, with every eleventh header off by one)."""
    lines = doc_line(spark, sf)
    off = F.when(F.col("doc") % 11 == 0, F.lit("1.00")).otherwise(F.lit("0.00")).cast("decimal(18,2)")
    headers = lines.groupBy("doc").agg(F.sum("net").alias("sum")).select("doc", (F.col("sum") + off).alias("header"))
    return A.lines_against_header(lines, headers, "doc", "net", "header")


@query(with_ctes(DOC_LINE) + """
SELECT doc, CAST(sum(listed) AS DECIMAL(28,2)) AS gross_sales, CAST(sum(listed - net) AS DECIMAL(28,2)) AS fees,
       CAST(sum(CAST(round(net * vat_rate, 2) AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS tax,
       CAST(sum(listed) - sum(listed - net) + sum(CAST(round(net * vat_rate, 2) AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS computed,
       CAST(sum(net + CAST(round(net * vat_rate, 2) AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS stated,
       sum(listed) - sum(listed - net) + sum(CAST(round(net * vat_rate, 2) AS DECIMAL(18,2))) = sum(net + CAST(round(net * vat_rate, 2) AS DECIMAL(18,2))) AS ok
FROM doc_line GROUP BY doc""")
def settlement_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    """Sales less fees plus tax against the stated net of a report."""
    tax = F.round(F.col("net") * F.col("vat_rate"), 2).cast("decimal(18,2)")
    agg = doc_line(spark, sf).groupBy("doc").agg(A.total("listed").alias("gross_sales"), A.total(F.col("listed") - F.col("net")).alias("fees"), A.total(tax).alias("tax"), A.total(F.col("net") + tax).alias("stated"))
    out = agg.withColumn("computed", (F.col("gross_sales") - F.col("fees") + F.col("tax")).cast(A.MONEY))
    return out.withColumn("ok", F.col("computed") == F.col("stated"))


@query(with_ctes(DOC_LINE) + """,
m AS (SELECT supplier, strftime(on_day, '%Y-%m') AS month, CAST(sum(net) AS DECIMAL(28,2)) AS spend, count(*) AS n FROM doc_line GROUP BY ALL),
s AS (SELECT *, lag(spend) OVER (PARTITION BY supplier ORDER BY month) AS before FROM m)
SELECT supplier, s_name, month, spend, n, round(avg(CAST(spend AS DOUBLE)) OVER (PARTITION BY supplier), 4) AS average,
       before > 0 AND abs(CAST(spend AS DOUBLE) / CAST(before AS DOUBLE) - 1) >= 0.05 AS stepped
FROM s JOIN supplier ON supplier.s_suppkey = s.supplier""")
def supplier_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Spend by month, its average, and months that step by 5 % or more."""
    months = doc_line(spark, sf).groupBy("supplier", month_key("on_day").alias("month")).agg(A.total("net").alias("spend"), F.count("*").alias("n"))
    w = W.partitionBy("supplier")
    before = F.lag("spend").over(w.orderBy("month"))
    stepped = (before > 0) & (F.abs(F.col("spend").cast("double") / before.cast("double") - 1) >= 0.05)
    out = months.withColumns({"average": F.round(F.avg(F.col("spend").cast("double")).over(w), 4), "stepped": stepped})
    return out.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier"), "s_name"), "supplier")


@query("""
WITH l AS (SELECT l_suppkey AS supplier, strftime(l_shipdate, '%Y-%m') AS month, l_returnflag = 'R' AS refund, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem),
m AS (SELECT supplier, month, sum(CASE WHEN refund THEN 0 ELSE price END)::DECIMAL(28,2) AS spend, sum(CASE WHEN refund THEN price ELSE 0 END)::DECIMAL(28,2) AS refunds, count(*) FILTER (refund) AS n_refunds FROM l GROUP BY ALL),
s AS (SELECT *, lag(spend) OVER (PARTITION BY supplier ORDER BY month) AS before FROM m)
SELECT supplier, sum(spend)::DECIMAL(28,2) AS spend, sum(refunds)::DECIMAL(28,2) AS refunds, sum(spend - refunds)::DECIMAL(28,2) AS net, sum(n_refunds)::BIGINT AS n_refunds, count(*) AS months,
       max(spend)::DECIMAL(28,2) AS largest_month, arg_max(month, (spend, month)) AS largest, count(*) FILTER (before > 0 AND abs(CAST(spend AS DOUBLE) / CAST(before AS DOUBLE) - 1) >= 0.05) AS steps
FROM s GROUP BY supplier""")
def supplier_balances(spark: SparkSession, sf: str) -> DataFrame:
    """What each supplier was paid and gave back, its months, the largest one, and how often a month steps by 5 % or more."""
    price, refund = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_returnflag") == "R"
    zero = F.lit(0).cast("decimal(18,2)")
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), month_key("l_shipdate").alias("month"), refund.alias("refund"), F.when(refund, zero).otherwise(price).alias("spend"), F.when(refund, price).otherwise(zero).alias("refunds"))
    months = lines.groupBy("supplier", "month").agg(A.total("spend").alias("spend"), A.total("refunds").alias("refunds"), F.count_if("refund").alias("n_refunds"))
    before = F.lag("spend").over(W.partitionBy("supplier").orderBy("month"))
    stepped = (before > 0) & (F.abs(F.col("spend").cast("double") / before.cast("double") - 1) >= 0.05)
    out = months.withColumn("stepped", F.coalesce(stepped, F.lit(False))).groupBy("supplier")
    money = "decimal(28,2)"
    return out.agg(F.sum("spend").cast(money).alias("spend"), F.sum("refunds").cast(money).alias("refunds"), F.sum(F.col("spend") - F.col("refunds")).cast(money).alias("net"), F.sum("n_refunds").alias("n_refunds"), F.count("*").alias("months"), F.max("spend").cast(money).alias("largest_month"), F.max_by("month", F.struct("spend", "month")).alias("largest"), F.count_if("stepped").alias("steps"))


@query(with_ctes(DOC, DOC_LINE) + """,
j AS (SELECT doc, line, supplier, product, on_day, CAST(gross * 100 AS BIGINT) AS c, CAST(net * 100 AS BIGINT) AS w FROM doc_line JOIN doc ON doc.id = doc_line.doc),
l AS (SELECT *, (c * w) // sum(w) OVER (PARTITION BY doc) AS low, row_number() OVER (PARTITION BY doc ORDER BY w DESC, line, supplier, product, on_day) AS rn FROM j)
SELECT doc, line, supplier, product, on_day, CAST(CAST(low + CASE WHEN rn = 1 THEN c - sum(low) OVER (PARTITION BY doc) ELSE 0 END AS DECIMAL(20,0)) / 100 AS DECIMAL(18,2)) AS share FROM l""")
def allocation_largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    """A header's total split over its lines by weight, exact to the cent."""
    rows = doc_line(spark, sf).join(doc(spark, sf).select(F.col("id").alias("doc"), "gross"), "doc")
    order = [F.col(c) for c in ("line", "supplier", "product", "on_day")]
    return A.largest_remainder(rows, "gross", "doc", F.col("net"), order).select("doc", "line", "supplier", "product", "on_day", "share")


@query(with_ctes(DOC) + """,
m AS (SELECT *, CAST(gross AS DOUBLE) AS x, median(CAST(gross AS DOUBLE)) OVER (PARTITION BY party) AS med, count(*) OVER (PARTITION BY party) AS past FROM doc),
d AS (SELECT *, median(abs(x - med)) OVER (PARTITION BY party) AS mad FROM m)
SELECT id, party, gross, round(med, 4) AS median, round(mad, 4) AS mad, round(0.6745 * abs(x - med) / mad, 6) AS z
FROM d WHERE past >= 5 AND mad > 0 AND 0.6745 * abs(x - med) / mad >= 3.5 AND abs(x - med) >= 0.5 * med""")
def median_mad_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts far from what the party usually charges."""
    out = A.amount_outliers(A.median_mad(doc(spark, sf), ["party"], "gross"), "gross")
    return out.select("id", "party", "gross", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"), F.round("z", 6).alias("z"))


@query(with_ctes(DOC_LINE) + """,
p AS (SELECT *, CAST(net AS DOUBLE) / CAST(qty AS DOUBLE) AS unit_price FROM doc_line WHERE qty > 0),
u AS (SELECT *, avg(unit_price) OVER (PARTITION BY supplier, product ORDER BY on_day, doc, line ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS usual FROM p)
SELECT supplier, product, on_day, doc, line, round(unit_price, 6) AS unit_price, round(usual, 6) AS usual, round(unit_price / usual - 1, 6) AS rise
FROM u WHERE usual > 0 AND unit_price / usual - 1 >= 0.15""")
def unit_price_jump(spark: SparkSession, sf: str) -> DataFrame:
    """Prices at least 15 % above the mean of the three purchases before."""
    p = doc_line(spark, sf).where("qty > 0").withColumn("unit_price", F.col("net").cast("double") / F.col("qty").cast("double"))
    out = N.price_jumps(p, ["supplier", "product"], "unit_price", [F.col(c) for c in ("on_day", "doc", "line")])
    return out.select("supplier", "product", "on_day", "doc", "line", *[F.round(c, 6).alias(c) for c in ("unit_price", "usual", "rise")])


@query(with_ctes(DOC_LINE) + """
SELECT product, round(CAST(sum(net) AS DOUBLE) / CAST(sum(qty) AS DOUBLE), 6) AS average, round(min(CAST(net AS DOUBLE) / CAST(qty AS DOUBLE)), 6) AS low,
       round(max(CAST(net AS DOUBLE) / CAST(qty AS DOUBLE)), 6) AS high, count(DISTINCT doc) AS invoices, count(DISTINCT supplier) AS suppliers
FROM doc_line WHERE qty > 0 GROUP BY product""")
def price_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity-weighted average, lowest and highest unit price, invoices and suppliers of each product."""
    price = F.col("net").cast("double") / F.col("qty").cast("double")
    average = F.sum("net").cast("double") / F.sum("qty").cast("double")
    # dealt once by product; two distinct counts in one aggregation would send each line three times
    lines = doc_line(spark, sf).where("qty > 0").select("product", "doc", "supplier", "net", "qty").repartition("product")
    first = lambda c: F.col(c).isNotNull() & (F.row_number().over(W.partitionBy("product", c).orderBy(c)) == 1)
    told = lines.withColumn("new_doc", first("doc")).withColumn("new_supplier", first("supplier"))
    return told.groupBy("product").agg(F.round(average, 6).alias("average"), F.round(F.min(price), 6).alias("low"), F.round(F.max(price), 6).alias("high"), F.count_if("new_doc").alias("invoices"), F.count_if("new_supplier").alias("suppliers"))


@query(with_ctes(DOC_LINE) + """,
p AS (SELECT *, CAST(round(CAST(net AS DOUBLE) / CAST(qty AS DOUBLE), 8) AS DOUBLE) AS unit_price FROM doc_line WHERE qty > 0),
u AS (SELECT *, lag(unit_price) OVER (PARTITION BY supplier, product ORDER BY on_day, doc, line) AS before FROM p)
SELECT supplier, product, on_day, doc, line, unit_price, before, round(unit_price / before - 1, 6) AS change
FROM u WHERE before > 0 AND abs(unit_price / before - 1) >= 0.05""")
def price_steps_lag(spark: SparkSession, sf: str) -> DataFrame:
    """unit prices that moved by 5 % or more since the purchase before."""
    p = doc_line(spark, sf).where("qty > 0").withColumn("unit_price", F.round(F.col("net").cast("double") / F.col("qty").cast("double"), 8))
    out = N.price_steps(p, ["supplier", "product"], "unit_price", [F.col(c) for c in ("on_day", "doc", "line")])
    return out.select("supplier", "product", "on_day", "doc", "line", "unit_price", "before", F.round("change", 6).alias("change"))


@query()
def price_regimes(spark: SparkSession, sf: str) -> DataFrame:
    """runs of near-equal unit prices of each product and the last two levels."""
    p = doc_line(spark, sf).where("qty > 0").select("product", "on_day", F.round(F.col("net").cast("double") / F.col("qty").cast("double"), 6).alias("unit_price"), F.struct("doc", "line", "supplier").cast("string").alias("tie"))
    return N.price_regimes(p, "product", "on_day", "unit_price", "tie")


@query(with_ctes(DOC) + """,
g AS (SELECT party, category, count(*) AS n FROM doc GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY n DESC, category) AS rn, sum(n) OVER (PARTITION BY party) AS total FROM g)
SELECT party, category, n, CAST(total AS BIGINT) AS of_n, n >= 2 AND n * 5 >= total * 4 AS usual FROM r WHERE rn = 1""")
def mode_stable(spark: SparkSession, sf: str) -> DataFrame:
    """The usual method of a party: most frequent, smallest on a tie; usual from 80 % and two payments."""
    out = A.stable_mode(doc(spark, sf), ["party"], "category").withColumnRenamed("of", "of_n")
    return out.withColumn("usual", (F.col("n") >= 2) & (F.col("n") * 5 >= F.col("of_n") * 4))


@query(with_ctes(DOC_LINE) + """
SELECT l.supplier, s_name, CAST(sum(net) AS DECIMAL(28,2)) AS spend, count(*) AS n FROM doc_line l JOIN supplier s ON l.supplier = s.s_suppkey
GROUP BY l.supplier, s_name ORDER BY spend DESC, l.supplier LIMIT 8""")
def top_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """The eight suppliers with the most spend (a top-k report)."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier"), "s_name")
    top = doc_line(spark, sf).groupBy("supplier").agg(A.total("net").alias("spend"), F.count("*").alias("n")).orderBy(F.col("spend").desc(), "supplier").limit(8)
    return top.join(s, "supplier")


@query(with_ctes(DOC) + """
SELECT question, n FROM (SELECT doc_type || ' ' || category || ' ' || strftime(issue_date, '%Y') AS question, count(*) AS n FROM doc GROUP BY 1)
ORDER BY n DESC, question LIMIT 10""")
def top_k_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most frequent questions once each (a top-k report)."""
    q = F.concat_ws(" ", "doc_type", "category", F.date_format("issue_date", "yyyy"))
    return doc(spark, sf).groupBy(q.alias("question")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "question").limit(10)


@query(with_ctes(DOC_LINE) + """
SELECT supplier, rank, on_day, doc, line, product, net FROM (
  SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY abs(date_diff('day', DATE '1998-06-15', on_day)), doc, line, product, net) AS rank FROM doc_line)
WHERE rank <= 20""")
def top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty lines of each supplier nearest to a day."""
    near = F.abs(F.datediff("on_day", F.lit(date(1998, 6, 15))))
    out = S.top_per_group(doc_line(spark, sf), ["supplier"], [near, *[F.col(c) for c in ("doc", "line", "product", "net")]], 20)
    return out.select("supplier", "rank", "on_day", "doc", "line", "product", "net")


@query(with_ctes(DOC) + """,
s AS (SELECT CASE WHEN party % 17 = 0 THEN 'personal' WHEN doc_type = 'invoice' THEN 'proven' WHEN gross < 10000 THEN 'not_needed'
                  WHEN doc_type = 'partial' THEN 'needs_you' ELSE 'looking' END AS state, strftime(issue_date, '%Y-%m') AS month FROM doc)
SELECT month, count(*) FILTER (state = 'personal') AS personal, count(*) FILTER (state = 'proven') AS proven, count(*) FILTER (state = 'not_needed') AS not_needed,
       count(*) FILTER (state = 'needs_you') AS needs_you, count(*) FILTER (state = 'looking') AS looking, count(*) AS n FROM s GROUP BY month""")
def five_state_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Every payment is in exactly one state; the states add up."""
    state = A.five_states(F.col("party") % 17 == 0, F.col("doc_type") == "invoice", F.col("gross") < 10000, F.col("doc_type") == "partial")
    names = ["personal", "proven", "not_needed", "needs_you", "looking"]
    wide = doc(spark, sf).select(month_key("issue_date").alias("month"), state.alias("state"))
    return wide.groupBy("month").agg(*[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in names], F.count("*").alias("n"))


@query(with_ctes(DOC) + """
SELECT strftime(issue_date, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (doc_type = 'invoice') AS closed,
       count(*) FILTER (doc_type = 'open') AS open, count(*) FILTER (doc_type = 'partial') AS blocked,
       CAST(CASE WHEN count(*) FILTER (doc_type = 'invoice') = count(*) THEN 100 ELSE least(99, floor(count(*) FILTER (doc_type = 'invoice') * 100 / count(*))) END AS BIGINT) AS percent,
       CASE WHEN count(*) FILTER (doc_type = 'invoice') = count(*) THEN 'closed' WHEN count(*) FILTER (doc_type = 'partial') > 0 THEN 'blocked' ELSE 'open' END AS status
FROM doc GROUP BY 1""")
def month_status(spark: SparkSession, sf: str) -> DataFrame:
    """A month's items by state, and percent closed (rounded down, 99 at most until all are)."""
    count = lambda t: F.count(F.when(F.col("doc_type") == t, 1))
    agg = doc(spark, sf).groupBy(month_key("issue_date").alias("month")).agg(F.count("*").alias("n"), count("invoice").alias("closed"), count("open").alias("open"), count("partial").alias("blocked"))
    status = F.when(F.col("closed") == F.col("n"), "closed").when(F.col("blocked") > 0, "blocked").otherwise("open")
    return agg.withColumns({"percent": A.percent_closed(F.col("closed"), F.col("n")), "status": status})


@query(with_ctes(DOC) + """
SELECT category, count(*) AS n, floor(count(*) FILTER (doc_type = 'invoice') * 1000 / count(*)) / 10.0::DOUBLE AS closed_pct,
       ceil(count(*) FILTER (doc_type = 'partial') * 1000 / count(*)) / 10.0::DOUBLE AS wrong_pct FROM doc GROUP BY category""")
def success_rates_conservative(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of which more is better are rounded down, the others up."""
    count = lambda t: F.count(F.when(F.col("doc_type") == t, 1))
    agg = doc(spark, sf).groupBy("category").agg(F.count("*").alias("n"), count("invoice").alias("good"), count("partial").alias("bad"))
    return agg.select("category", "n", A.floor_share(F.col("good"), F.col("n")).alias("closed_pct"), A.ceil_share(F.col("bad"), F.col("n")).alias("wrong_pct"))


@query(with_ctes(DOC) + """,
a AS (SELECT strftime(issue_date, '%Y') AS year, count(*) AS n, count(*) FILTER (doc_type <> 'open') AS n_covered,
      CAST(sum(gross) AS DECIMAL(28,2)) AS volume, CAST(coalesce(sum(gross) FILTER (doc_type <> 'open'), 0) AS DECIMAL(28,2)) AS volume_covered FROM doc GROUP BY 1)
SELECT *, least(floor(n_covered * 1000 / n) / 10.0::DOUBLE, floor(CAST(volume_covered AS DOUBLE) * 1000 / CAST(volume AS DOUBLE)) / 10.0::DOUBLE) AS share FROM a""")
def coverage_share(spark: SparkSession, sf: str) -> DataFrame:
    """The smaller of the share by count and by volume."""
    rows = doc(spark, sf).withColumn("year", F.date_format("issue_date", "yyyy"))
    return A.coverage_share(rows, ["year"], F.col("doc_type") != "open", "gross")


@query("""
WITH r AS (SELECT upper(p_name[1]) AS initial, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS band, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part)
SELECT initial, band, count(*) AS n, sum(price)::DECIMAL(28,2) AS price, (GROUPING(initial) + GROUPING(band))::INTEGER AS level FROM r GROUP BY ROLLUP (initial, band)""")
def prices_by_any_key(spark: SparkSession, sf: str) -> DataFrame:
    """parts' prices by keys put in as functions: a name's first letter and a band of sizes, with totals."""
    parts = table(spark, sf, "part").withColumn("price", F.col("p_retailprice").cast("decimal(18,2)"))
    band = lambda rows: F.when(rows["p_size"] < 10, "small").when(rows["p_size"] < 30, "middle").otherwise("large")
    return A.summed_by(parts, {"initial": lambda rows: F.upper(F.substring(rows["p_name"], 1, 1)), "band": band}, ["price"], levels=True)
