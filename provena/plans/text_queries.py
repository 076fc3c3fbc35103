"""Named queries over canonical forms: dates, numbers, tax ids, names, currencies, calendars, wording.

The written forms are made from the tables' own values; the SQL says what each of them means from those values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import normalise as N
from provena.functions import wording as X
from provena.plans.bind import DOC, doc, doc_line, table, with_ctes
from provena.plans.registry import query

PT_MONTHS = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()


@query(
    """
WITH d AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders),
r AS (SELECT id, d, CASE WHEN id % 8 IN (1, 2) AND day(d) <= 12 AND day(d) <> month(d)
                    THEN make_date(year(d), day(d), month(d)) END AS other FROM d)
SELECT id, CASE id % 8 WHEN 2 THEN make_date((2000 + year(d) % 100)::BIGINT, month(d), day(d)) ELSE d END AS first_reading,
       CASE id % 8 WHEN 2 THEN make_date((2000 + year(other) % 100)::BIGINT, month(other), day(other)) ELSE other END AS second_reading,
       CASE WHEN other IS NULL THEN 1 ELSE 2 END::BIGINT AS n_readings
FROM r"""
)
def date_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight ways to write each order's date, read back; day and month that can swap give two readings."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 8
    portuguese = F.element_at(F.array(*map(F.lit, PT_MONTHS)), F.month(d))
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(d, "dd/MM/yyyy"))
        .when(k == 2, F.date_format(d, "dd.MM.yy"))
        .when(k == 3, F.date_format(d, "yyyyMMdd"))
        .when(k == 4, F.date_format(d, " d MMMM yyyy"))
        .when(k == 5, F.date_format(d, "MMM d, yyyy"))
        .when(k == 6, F.concat(F.dayofmonth(d), F.lit(" de "), portuguese, F.lit(" de "), F.year(d)))
        .otherwise(F.concat(F.lit("Mon, "), F.date_format(d, "yyyy/M/d"), F.lit(" 10:30:00 UTC")))
    )
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), N.date_readings(text).alias("r"))
    return found.select("id", F.get("r", F.lit(0)).alias("first_reading"), F.get("r", F.lit(1)).alias("second_reading"), F.size("r").cast("bigint").alias("n_readings"))


@query(
    """
SELECT o_orderkey AS id,
       CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE 'FT ' || year(o_orderdate) || '/' || o_orderkey END AS number,
       CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE 'FT' || year(o_orderdate) || '/' || o_orderkey END AS number_key
FROM orders"""
)
def invoice_number_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice numbers in several spellings, their canonical form and comparison key."""
    k, year, id_ = F.col("o_orderkey") % 4, F.year("o_orderdate"), F.col("o_orderkey")
    text = F.when(k == 0, F.concat(F.lit("  ft  "), year, F.lit(" / "), id_)).when(k == 1, F.concat(F.lit("#Ft "), year, F.lit("/"), id_, F.lit(" "))).when(k == 2, F.concat(F.lit("ft\t"), year, F.lit("/ "), id_)).otherwise(" -- ")
    return table(spark, sf_dir, "orders").select(id_.alias("id"), N.invoice_number(text).alias("number"), N.invoice_number_key(text).alias("number_key"))


@query(
    """
WITH c AS (SELECT c_custkey AS id, lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS n FROM customer)
SELECT id, CASE id % 7 WHEN 0 THEN 'PT' WHEN 1 THEN 'DE' WHEN 3 THEN 'CH' WHEN 4 THEN 'GR' END AS country,
       CASE id % 7 WHEN 5 THEN NULL ELSE n END AS number, id % 7 IN (0, 2, 6) AS same_as_portuguese
FROM c"""
)
def tax_id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax numbers with labels, prefixes and suffixes, split into country and number, and compared."""
    k, n = F.col("id") % 7, F.col("n")
    spaced = F.concat_ws(" ", F.substring(n, 1, 3), F.substring(n, 4, 3), F.substring(n, 7, 3))
    text = (
        F.when(k == 0, F.concat(F.lit("pt "), spaced))
        .when(k == 1, F.concat(F.lit("VAT No. DE"), n))
        .when(k == 2, F.concat(F.lit("NIF: "), spaced))
        .when(k == 3, F.concat(F.lit("CHE-"), F.replace(spaced, F.lit(" "), F.lit(".")), F.lit(" MWST")))
        .when(k == 4, F.concat(F.lit("EL"), n))
        .when(k == 5, F.lit("unknown"))
        .otherwise(n)
    )
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0").alias("n"))
    return rows.withColumn("t", N.tax_id_parts(text)).select("id", "t.country", "t.number", F.coalesce(N.same_tax_id(text, F.concat(F.lit("PT"), n)), F.lit(False)).alias("same_as_portuguese"))


@query(
    """
SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 4 ELSE 1 END::BIGINT AS n_readings,
       CASE c_custkey % 6 WHEN 0 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 5 THEN 'PLN' END AS currency
FROM customer"""
)
def currency_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The currency that a code, symbol or name means; null where it is unknown or ambiguous."""
    k = F.col("c_custkey") % 6
    text = F.when(k == 0, F.lit(" euros ")).when(k == 1, F.lit("$")).when(k == 2, F.lit("£")).when(k == 3, F.lit("XQQ")).when(k == 4, F.lit("kr.")).otherwise(F.lit("pln"))
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), N.currency_readings(text).alias("r"))
    return found.select("id", F.size("r").cast("bigint").alias("n_readings"), F.when(F.size("r") == 1, F.get("r", F.lit(0))).alias("currency"))


@query(
    """
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 4 THEN NULL ELSE lower(p_name) END AS counterparty
FROM part WHERE NOT regexp_matches(p_name, '[0-9]')"""
)
def counterparty_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank spellings of a name (processor, references, legal form, case) and the key they share."""
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    text = F.when(k == 0, F.concat(F.lit("PAYPAL *"), F.upper(n), F.lit(" 402-935-9800"))).when(k == 1, F.concat(n, F.lit(", Lda."))).when(k == 2, F.concat(F.upper(n), F.lit(" *TRIP help.example.com"))).when(k == 3, F.concat(n, F.lit(" 123456 S.A."))).otherwise(F.lit(" 9911 "))
    return table(spark, sf_dir, "part").where(~n.rlike("[0-9]")).select(F.col("p_partkey").alias("id"), N.counterparty_key(text).alias("counterparty"))


@query(
    """
WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Obra JOB ' || (c_custkey % 9) || ' - fase' WHEN 1 THEN 'plate AA-' || lpad(CAST(c_custkey % 9 AS VARCHAR), 2, '0') || '-BB' WHEN 2 THEN 'xjob' || (c_custkey % 9) ELSE 'job/ ' || (c_custkey % 9) || 'x' END AS t FROM customer),
i AS (SELECT n, 'JOB-' || n AS job, 'AA ' || lpad(CAST(n AS VARCHAR), 2, '0') || ' BB' AS plate FROM range(9) r(n))
SELECT id, 'job' AS kind, job AS identifier FROM t JOIN i ON id % 4 = 0 AND id % 9 = n
UNION ALL SELECT id, 'plate', plate FROM t JOIN i ON id % 4 = 1 AND id % 9 = n"""
)
def identifier_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of cost centers that customers' texts name, whatever the separators.

    A hit needs its letters and digits in order and at most two separators between them: the squashed text holds the
    squashed identifier, and no letter or digit touches it. Each text meets the identifiers of a small table, whose
    size bounds the join.
    """
    c = F.col("c_custkey")
    n = (c % 9).cast("string")
    text = F.when(c % 4 == 0, F.concat(F.lit("Obra JOB "), n, F.lit(" - fase"))).when(c % 4 == 1, F.concat(F.lit("plate AA-"), F.lpad(n, 2, "0"), F.lit("-BB"))).when(c % 4 == 2, F.concat(F.lit("xjob"), n)).otherwise(F.concat(F.lit("job/ "), n, F.lit("x")))
    ids = [x for k in range(9) for x in (("job", f"JOB-{k}"), ("plate", f"AA {k:02d} BB"))]
    known = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("identifier"), F.lit(N.identifier_pattern(i)).alias("p")) for kind, i in ids])
    rows = table(spark, sf_dir, "customer").select(c.alias("id"), text.alias("t"))
    hits = rows.select("id", F.explode(F.filter(known, lambda s: F.regexp(N.fold("t"), s["p"]))).alias("h"))
    return hits.select("id", "h.kind", "h.identifier")


@query(
    with_ctes(DOC)
    + """
, w AS (SELECT id, gross, CAST(id % 7 + 1 AS BIGINT) AS parts FROM doc),
q AS (SELECT id, gross, parts, (CAST(gross * 100 AS BIGINT) * 100 // parts) AS scaled FROM w)
SELECT id, parts, CAST(round(CAST(gross AS DECIMAL(28,10)) / CAST(parts AS DECIMAL(18,0)), 2) AS DECIMAL(18,2)) AS each_half_up,
       CAST((CAST(gross * 100 AS BIGINT) // parts) AS DECIMAL(18,2)) / 100 AS each_down
FROM q""".replace("CAST(round(CAST(gross AS DECIMAL(28,10)) / CAST(parts AS DECIMAL(18,0)), 2) AS DECIMAL(18,2))", "CAST(((2 * CAST(gross * 100 AS BIGINT) + parts) // (2 * parts)) AS DECIMAL(18,2)) / 100").replace(" / 100", " * CAST(0.01 AS DECIMAL(3,2))")
)
def exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's total divided exactly, rounded half up and down to cents."""
    rows = doc(spark, sf_dir).select("id", "gross", (F.col("id") % 7 + 1).alias("parts"))
    each = N.divide("gross", "parts")
    wide = lambda x: F.round(x, 2).cast("decimal(21,4)")
    return rows.select("id", "parts", wide(each).alias("each_half_up"), wide(N.cents_down(each)).alias("each_down"))


@query(
    """
WITH l AS (
  SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS line, CAST(l_extendedprice AS DECIMAL(18,2)) AS net, CAST(l_tax AS DECIMAL(18,2)) AS rate,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)), 2) AS DECIMAL(18,2)) AS vat, l_linenumber % 5 AS k
  FROM lineitem),
v AS (SELECT doc, line, net, CAST(CASE WHEN k = 4 THEN vat + round(net * 0.5, 2) WHEN k = 3 THEN vat + round(net * 0.005, 2) ELSE vat END AS DECIMAL(18,2)) AS vat,
             CAST(net + vat + CASE WHEN k = 1 THEN 0.01 WHEN k = 2 THEN 0.02 ELSE 0 END AS DECIMAL(18,2)) AS gross FROM l),
r AS (SELECT * FROM (VALUES (0.00), (0.02), (0.04), (0.06), (0.08)) t(rate))
SELECT doc, line, abs(gross - (net + vat)) <= 0.01 AS adds_up,
       CASE WHEN EXISTS (SELECT 1 FROM r WHERE abs(v.vat - v.net * r.rate) <= greatest(0.01, v.net * 0.001)) THEN 'matches'
            WHEN vat >= 0 - greatest(0.01, net * 0.001) AND vat <= net * 0.08 + greatest(0.01, net * 0.001) THEN 'mixed' ELSE 'unexpected' END AS rate_fit
FROM v"""
)
def vat_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each line's net, tax and gross add up, and whether its tax fits an allowed rate or a mix."""
    money = lambda x: x.cast("decimal(18,2)")
    net, k = money(F.col("l_extendedprice")), F.col("l_linenumber") % 5
    vat0 = money(F.round(net * money(F.col("l_tax")), 2))
    vat = money(F.when(k == 4, vat0 + F.round(net * F.lit("0.5").cast("decimal(4,3)"), 2)).when(k == 3, vat0 + F.round(net * F.lit("0.005").cast("decimal(4,3)"), 2)).otherwise(vat0))
    gross = money(net + vat0 + F.when(k == 1, F.lit("0.01")).when(k == 2, F.lit("0.02")).otherwise(F.lit("0.00")).cast("decimal(4,2)"))
    rates = F.array(*[F.lit(r).cast("decimal(4,2)") for r in ("0.00", "0.02", "0.04", "0.06", "0.08")])
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("bigint").alias("line"), net.alias("net"), vat.alias("vat"), gross.alias("gross"))
    return lines.select("doc", "line", N.amounts_add_up(F.col("net"), F.col("vat"), F.col("gross")).alias("adds_up"), N.rate_fit(F.col("net"), F.col("vat"), rates).alias("rate_fit"))


RATES = [("north", "standard", "1995-01-01", "1996-06-30", "17.000"), ("north", "standard", "1996-07-01", None, "19.000"), ("north", "reduced", "1995-01-01", None, "5.000"), ("south", "standard", "1995-01-01", "1999-12-31", "13.000"), ("south", "standard", "2000-01-01", None, "15.000")]


@query(
    with_ctes(DOC, "rates(region, kind, valid_from, valid_to, rate) AS (VALUES " + ", ".join(f"('{r}', '{k}', DATE '{a}', {'NULL' if b is None else chr(68) + 'ATE ' + chr(39) + b + chr(39)}, CAST({x} AS DECIMAL(6,3)))" for r, k, a, b, x in RATES) + ")")
    + """
, d AS (SELECT id, issue_date, gross, CASE WHEN party % 2 = 0 THEN 'north' ELSE 'south' END AS region, CASE WHEN category LIKE '5%' THEN 'reduced' ELSE 'standard' END AS kind FROM doc)
SELECT d.id, d.region, d.kind, rate, CAST(round(gross * rate / 100, 2) AS DECIMAL(18,2)) AS vat
FROM d LEFT JOIN rates r ON d.region = r.region AND d.kind = r.kind AND issue_date >= valid_from AND (valid_to IS NULL OR issue_date <= valid_to)""".replace("round(gross * rate / 100, 2)", "round(gross * CAST(rate AS DECIMAL(6,3)) * CAST(0.01 AS DECIMAL(3,2)), 2)")
)
def vat_rate_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tax rate of a region and kind that is in force on a document's day, from a dated rate table."""
    rates = spark.createDataFrame([(r, k, a, b, x) for r, k, a, b, x in RATES], "region string, kind string, valid_from string, valid_to string, rate string")
    rates = rates.select("region", "kind", F.to_date("valid_from").alias("valid_from"), F.to_date("valid_to").alias("valid_to"), F.col("rate").cast("decimal(6,3)").alias("rate"))
    d = doc(spark, sf_dir).withColumn("region", F.when(F.col("party") % 2 == 0, "north").otherwise("south")).withColumn("kind", F.when(F.col("category").startswith("5"), "reduced").otherwise("standard"))
    valid = (F.col("issue_date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("issue_date") <= F.col("valid_to")))
    out = d.join(F.broadcast(rates).withColumnsRenamed({"region": "r_region", "kind": "r_kind"}), (F.col("region") == F.col("r_region")) & (F.col("kind") == F.col("r_kind")) & valid, "left")
    return out.select("id", "region", "kind", "rate", F.round(F.col("gross") * F.col("rate") * F.lit("0.01").cast("decimal(3,2)"), 2).cast("decimal(18,2)").alias("vat"))


@query(
    """
WITH RECURSIVE m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders),
e(y, d) AS (VALUES (1995, DATE '1995-04-16'), (1996, DATE '1996-04-07'), (1997, DATE '1997-03-30'), (1998, DATE '1998-04-12'), (1999, DATE '1999-04-04'), (2000, DATE '2000-04-23'), (2001, DATE '2001-04-15'), (2002, DATE '2002-03-31')),
h AS (SELECT d - 2 AS d FROM e UNION SELECT d FROM e UNION SELECT d + 60 FROM e
      UNION SELECT make_date(y, mm, dd) FROM e, (VALUES (1,1),(4,25),(5,1),(6,10),(8,15),(10,5),(11,1),(12,1),(12,8),(12,25)) f(mm, dd)),
days AS (SELECT m, CAST(unnest(generate_series(m, last_day(m), INTERVAL 1 DAY)) AS DATE) AS d FROM m),
w AS (SELECT m, d, row_number() OVER (PARTITION BY m ORDER BY d) AS n FROM days WHERE isodow(d) < 6 AND d NOT IN (SELECT d FROM h))
SELECT m AS month, last_day(m) AS last_day, (SELECT count(*) FROM w WHERE w.m = m.m)::BIGINT AS n_working, (SELECT d FROM w WHERE w.m = m.m AND n = 5) AS fifth_working_day
FROM m"""
)
def working_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's end, working days and fifth working day, with fixed and Easter holidays."""
    months = table(spark, sf_dir, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).distinct()
    days = months.withColumn("w", N.working_days("month"))
    return days.select("month", F.last_day("month").alias("last_day"), F.size("w").cast("bigint").alias("n_working"), F.get("w", F.lit(4)).alias("fifth_working_day"))


@query(
    with_ctes(DOC)
    + """
SELECT id, CASE WHEN id % 4 IN (0, 1) THEN gross END AS amount, CASE id % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' END AS currency,
       CASE WHEN id % 4 = 0 THEN CAST(0.9215 AS DECIMAL(18,6)) END AS rate
FROM doc"""
)
def fx_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The foreign amount and rate that a bank line declares; two amounts or only the account's own give none."""
    k = F.col("id") % 4
    comma = F.translate(F.format_number("gross", 2), ",.", ".,")
    text = F.when(k == 0, F.concat(F.lit("COMPRA LOJA USD "), comma, F.lit(" TAXA 0,9215"))).when(k == 1, F.concat(F.lit("Compra "), F.format_number("gross", 2), F.lit(" GBP loja"))).when(k == 2, F.concat(F.lit("USD 1,00 e CHF "), F.col("gross"))).otherwise(F.concat(F.lit("EUR "), comma))
    return doc(spark, sf_dir).select("id", N.fx_details(text, F.lit("EUR")).alias("f")).select("id", "f.amount", "f.currency", "f.rate")


@query(
    """
SELECT event_id AS id, 'ev_' || substr(sha256('=' || user_id || chr(31) || CASE WHEN event_id % 3 = 0 THEN '-' ELSE '=' || event_type END), 1, 16) AS stable_id,
       sha256(props) AS content_sha256
FROM events"""
)
def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that depend on content only, and content digests."""
    kind = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), N.stable_id("ev", "user_id", kind).alias("stable_id"), F.sha2("props", 256).alias("content_sha256"))


@query(
    """
WITH e AS (SELECT event_id AS id, event_type AS kind, CAST(value AS DECIMAL(18,2)) AS amount, CAST(ts AS DATE) AS d FROM events)
SELECT id, '€' || format('{:t,}', CAST(floor(amount) AS BIGINT)) || '.' || lpad(CAST(CAST((amount - floor(amount)) * 100 AS BIGINT) AS VARCHAR), 2, '0') AS money,
       strftime(d, '%-d %B') AS day, (id % 3) || ' ' || CASE WHEN id % 3 = 1 THEN 'day' ELSE 'days' END AS days
FROM e WHERE amount >= 0""".replace("{:t,}", "{:,}")
)
def owner_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, days and counts as an owner reads them."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").cast("decimal(18,2)").alias("amount"), F.to_date("ts").alias("d")).where("amount >= 0")
    return e.select("id", X.money_phrase("amount").alias("money"), F.date_format("d", "d MMMM").alias("day"), X.count_phrase(F.col("id") % 3, "day").alias("days"))


@query(
    """
SELECT o_orderkey AS id, o_orderkey % 5 <> 3 AS amount_usable, o_orderkey % 5 <> 2 AS date_usable, o_orderkey % 5 <> 1 AS number_usable,
       CASE o_orderkey % 5 WHEN 1 THEN 'invoice_number' WHEN 2 THEN 'issue_date' WHEN 3 THEN 'gross_amount' END AS missing
FROM orders"""
)
def usable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the values read for a document are real values of their fields, and the first required one that is not."""
    k = F.col("o_orderkey") % 5
    amount = F.when(k == 3, F.lit("n/a")).otherwise(F.format_number("o_totalprice", 2))
    day = F.when(k == 2, F.lit("31/02/1997")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    number = F.when(k == 1, F.lit("--")).otherwise(F.concat(F.lit("FT "), "o_orderkey"))
    from provena.functions.money import amount_readings

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.size(amount_readings(amount)) > 0).alias("amount_usable"), (F.size(N.date_readings(day)) > 0).alias("date_usable"), N.invoice_number(number).isNotNull().alias("number_usable"))
    return rows.withColumn("missing", F.when(~F.col("number_usable"), "invoice_number").when(~F.col("date_usable"), "issue_date").when(~F.col("amount_usable"), "gross_amount"))


@query(
    """
SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'known' WHEN 1 THEN 'lookalike' WHEN 2 THEN 'lookalike' WHEN 3 THEN 'unknown' ELSE 'free_mail' END AS verdict
FROM supplier"""
)
def sender_domain_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a sender's domain is a supplier's own, looks like it, is a free mailbox or unknown."""
    k, n = F.col("s_suppkey") % 5, F.col("s_suppkey")
    own = F.concat(F.lit("modern-supply"), F.translate(n.cast("string"), "0123456789", "abcdefghij"), F.lit(".com"))
    sender = F.when(k == 0, F.concat(F.lit("billing@mail."), own)).when(k == 1, F.concat(F.lit("a@"), F.replace(own, F.lit("m"), F.lit("rn")))).when(k == 2, F.concat(F.lit("a@"), F.translate(own, "o", "0"))).when(k == 3, F.lit("x@elsewhere.org")).otherwise(F.lit("owner@gmail.com"))
    return table(spark, sf_dir, "supplier").select(n.alias("id"), X.domain_verdict(sender, own).alias("verdict"))


@query()
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by numbered tokens, and the tokens' values, so that it can be undone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = docs.withColumn("r", X.redact("text"))
    return out.select("doc_id", "r.text", F.size("r.tokens").cast("bigint").alias("n_tokens"), (X.restore(F.col("r.text"), F.col("r.tokens")) == F.coalesce("text", F.lit(""))).alias("restores"))


WORDING_SQL = """
WITH t AS (SELECT event_id AS id, CAST(value AS DECIMAL(18,2)) AS v, event_id % 14 AS k FROM events)
"""


@query(
    WORDING_SQL
    + """
SELECT id, CASE k WHEN 0 THEN 'nothing_moved' WHEN 1 THEN 'internal' WHEN 2 THEN 'card_statement' WHEN 3 THEN 'cash' WHEN 4 THEN 'payout_report' WHEN 5 THEN 'tax_document'
  WHEN 6 THEN 'grant_letter' WHEN 7 THEN 'bank_evidence' WHEN 8 THEN 'loan_contract' WHEN 9 THEN 'bank_evidence' WHEN 10 THEN 'payroll'
  WHEN 11 THEN 'customer_invoice' WHEN 12 THEN 'supplier_invoice' ELSE 'receipt' END AS expected,
  CASE k WHEN 0 THEN 'zero_amount' WHEN 1 THEN 'bank_marked_internal' WHEN 2 THEN 'card_repayment' WHEN 3 THEN 'cash_withdrawal' WHEN 4 THEN 'payout' WHEN 5 THEN 'tax' WHEN 6 THEN 'grant'
  WHEN 7 THEN 'bank_fee' WHEN 8 THEN 'loan' WHEN 9 THEN 'bank_fee' WHEN 10 THEN 'payroll' WHEN 11 THEN 'money_in' WHEN 12 THEN 'money_out' ELSE 'card_purchase' END AS rule
FROM t"""
)
def expected_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evidence a bank line should have, by the first rule of the chain that applies."""
    return X.expected_evidence(X.sample_lines(table(spark, sf_dir, "events"))).select("id", "expected", "rule")


@query(
    WORDING_SQL
    + """
SELECT id, CASE WHEN k = 3 THEN 'cash' WHEN k IN (1) THEN 'transfer' WHEN k = 2 THEN 'card_repayment' WHEN k = 4 THEN 'payout' WHEN k = 5 THEN 'taxes' WHEN k = 7 THEN 'bank_fees' WHEN k = 9 THEN 'bank_fees'
  WHEN k = 8 THEN 'loans' WHEN k = 10 THEN 'salaries' WHEN k = 12 THEN 'energy' WHEN k = 13 THEN 'meals' ELSE 'other' END AS category, k = 13 AS maybe_personal, k = 10 AS sensitive
FROM t"""
)
def spending_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank line's spending category by rule, kind and wording; personal and sensitive wording."""
    return X.spending_category(X.expected_evidence(X.sample_lines(table(spark, sf_dir, "events")))).select("id", "category", "maybe_personal", "sensitive")


@query(
    with_ctes(DOC)
    + """
SELECT id, CASE id % 4 WHEN 0 THEN 'retention' WHEN 1 THEN 'deposit' END AS kind, CASE WHEN id % 4 = 0 THEN CAST(5 AS DECIMAL(6,2)) WHEN id % 4 = 1 THEN CAST(30.5 AS DECIMAL(6,2)) END AS percent,
       CASE id % 4 WHEN 2 THEN gross END AS amount
FROM doc"""
)
def contract_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retention or deposit that a text states, as a share or an amount."""
    k = F.col("id") % 4
    text = F.when(k == 0, F.lit("Retenção de garantia: 5% sobre o valor dos trabalhos")).when(k == 1, F.lit("a deposit of 30,5 % is due on signature")).when(k == 2, F.concat(F.lit("less advance payment EUR "), F.col("gross"))).otherwise(F.lit("no terms"))
    return doc(spark, sf_dir).select("id", X.contract_terms(text).alias("t")).select("id", "t.kind", "t.percent", "t.amount")


@query(
    """
WITH l AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS net, l_linenumber % 5 AS k FROM lineitem)
SELECT doc, line, CASE k WHEN 0 THEN 'kg' WHEN 1 THEN 'l' WHEN 2 THEN 'l' WHEN 3 THEN 'kg' ELSE 'unit' END AS basis,
       CAST(CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 1.5 WHEN 2 THEN 1.98 WHEN 3 THEN 2 ELSE 1 END AS DECIMAL(18,6)) AS per_unit
FROM l"""
)
def unit_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight, volume or count that a product's description packs into one unit."""
    k = F.col("line") % 5
    text = F.when(k == 0, "Arroz carolino 500 g").when(k == 1, "Azeite virgem 1,5 L").when(k == 2, "Cerveja 6x33cl lata").when(k == 3, "Farinha T55 2kg").otherwise("Esferográfica azul")
    return doc_line(spark, sf_dir).select("doc", "line", X.unit_basis(text).alias("u")).select("doc", "line", "u.basis", "u.per_unit")


@query(
    """
WITH p AS (SELECT c_custkey AS id, c_custkey % 8 AS k FROM customer)
SELECT id, CASE k WHEN 0 THEN DATE '2026-08-01' WHEN 1 THEN DATE '2026-09-01' WHEN 2 THEN DATE '2025-01-01' WHEN 3 THEN DATE '2026-04-01' WHEN 4 THEN DATE '2026-03-01' WHEN 5 THEN DATE '2026-06-17' WHEN 6 THEN DATE '2026-09-15' END AS period_start,
  CASE k WHEN 0 THEN DATE '2026-08-31' WHEN 1 THEN DATE '2026-09-30' WHEN 2 THEN DATE '2025-12-31' WHEN 3 THEN DATE '2026-06-30' WHEN 4 THEN DATE '2026-03-31' WHEN 5 THEN DATE '2026-09-15' WHEN 6 THEN DATE '2026-09-15' END AS period_end,
  CASE k % 4 WHEN 0 THEN 'spending' WHEN 1 THEN 'income' WHEN 2 THEN 'missing' ELSE 'documents' END AS intent
FROM p"""
)
def question_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period and intent of short questions, as of 15 September 2026."""
    k = F.col("c_custkey") % 8
    said = ["last month", "this month", "in 2025", "in Q2", "in March", "in the last 90 days", "today", "ever"]
    asks = ["how much did we spend", "what did we earn", "which receipts are missing", "show the invoices"]
    text = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, asks)), (k % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, said)), (k + 1).cast("int")))
    out = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), X.period_of(text, F.lit("2026-09-15").cast("date")).alias("p"), X.intent_of(text).alias("intent"))
    return out.select("id", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"), "intent")
