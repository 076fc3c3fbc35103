"""Named queries over the ledger, verification and the month's close."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators import closing as C
from provena.plans.bind import DOC, DOC_LINE, PAYMENT, TX, doc, doc_line, payment, table, tx, with_ctes
from provena.plans.registry import query

MONEY = "decimal(18,2)"
ZERO = "CAST(0 AS DECIMAL(18,2))"

LEDGER = """
l AS (
  SELECT 'bank' AS source, id, abs(amount) AS amount, CAST(CASE WHEN id % 5 = 0 THEN round(abs(amount) * CAST(0.25 AS DECIMAL(3,2)), 2) END AS DECIMAL(18,2)) AS client_share, CAST(NULL AS DECIMAL(18,2)) AS deposit_share,
         CASE id % 12 WHEN 0 THEN 'disputed' WHEN 1 THEN 'given_back' WHEN 2 THEN 'returned' WHEN 3 THEN 'cash_deposit' WHEN 4 THEN 'claim_waiting' WHEN 5 THEN 'client_money' WHEN 6 THEN 'payout' WHEN 7 THEN 'transfer' WHEN 8 THEN 'income' ELSE 'cost' END AS kind,
         CASE WHEN id % 24 = 6 THEN 'settled' END AS status, CASE WHEN id % 7 = 0 THEN 'rent' ELSE 'other' END AS category, CASE WHEN account % 2 = 0 THEN 'a' ELSE 'b' END AS company, id % 31 = 0 AS private, CASE WHEN id % 11 = 0 THEN 'USD' ELSE 'EUR' END AS currency FROM tx
  UNION ALL
  SELECT 'history', id, gross, NULL, CAST(CASE WHEN id % 4 = 0 THEN round(gross * CAST(0.1 AS DECIMAL(3,2)), 2) END AS DECIMAL(18,2)), 'cost', NULL, 'other', 'a', NULL, 'EUR' FROM doc),
p AS (
  SELECT source, id, kind, status, category, company, private, currency, part, value AS amount FROM (
    SELECT *, unnest(['client', 'deposit', 'own']) AS part, unnest([coalesce(client_share, 0), coalesce(deposit_share, 0), CAST(amount - coalesce(client_share, 0) - coalesce(deposit_share, 0) AS DECIMAL(18,2))]) AS value FROM l)
  WHERE value <> 0 OR (part = 'own' AND amount = 0)),
b AS (
  SELECT *, CASE WHEN private THEN 'private' WHEN kind = 'disputed' THEN 'disputed' WHEN kind = 'given_back' THEN 'given_back' WHEN kind = 'returned' THEN 'returned' WHEN kind = 'cash_deposit' THEN 'cash_banked'
    WHEN kind = 'claim_waiting' THEN 'claim_waiting' WHEN kind = 'client_money' THEN 'client_money' WHEN kind = 'payout' THEN CASE WHEN status = 'settled' THEN 'left_out' ELSE 'payout_waiting' END
    WHEN kind = 'transfer' THEN 'left_out' WHEN kind <> 'cost' THEN 'not_wanted' WHEN category = 'rent' THEN 'other_category' WHEN company <> 'a' THEN 'other_company' WHEN currency <> 'EUR' THEN 'foreign' ELSE 'counted' END AS bucket FROM p)"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 12
    names = ["disputed", "given_back", "returned", "cash_deposit", "claim_waiting", "client_money", "payout", "transfer", "income"]
    kind = F.coalesce(F.get(F.array(*map(F.lit, names)), k.cast("int")), F.lit("cost"))
    share = lambda x, s: F.round(x * F.lit(s).cast("decimal(3,2)"), 2).cast(MONEY)
    bank = tx(spark, sf_dir).select("id", F.abs("amount").cast(MONEY).alias("amount"), F.when(F.col("id") % 5 == 0, share(F.abs("amount"), "0.25")).alias("client_share"), kind.alias("kind"), F.when(F.col("id") % 24 == 6, "settled").alias("status"), F.when(F.col("id") % 7 == 0, "rent").otherwise("other").alias("category"), F.when(F.col("account") % 2 == 0, "a").otherwise("b").alias("company"), (F.col("id") % 31 == 0).alias("private"), F.when(F.col("id") % 11 == 0, "USD").otherwise("EUR").alias("currency"))
    history = doc(spark, sf_dir).select("id", F.col("gross").alias("amount"), F.when(F.col("id") % 4 == 0, share(F.col("gross"), "0.1")).alias("deposit_share"), F.lit("cost").alias("kind"), F.lit("other").alias("category"), F.lit("a").alias("company"), F.lit("EUR").alias("currency"))
    lines = C.split_shares(C.union_ledger({"bank": bank, "history": history}))
    return lines.withColumn("bucket", C.money_bucket(wanted=["cost"], exclude=["rent"], companies=["a"]))


@query(with_ctes(DOC, TX, LEDGER.strip()) + "\nSELECT source, id, part, amount, bucket FROM b")
def unified_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger of bank lines and history, split into client, deposit and own parts, each in its money bucket."""
    return _ledger(spark, sf_dir).select("source", "id", "part", "amount", "bucket")


@query(with_ctes(DOC, TX, LEDGER.strip()) + "\nSELECT bucket, count(*)::BIGINT AS n, CAST(sum(amount) AS DECIMAL(28,2)) AS total FROM b GROUP BY bucket")
def ledger_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and sum of the ledger's lines in each of the ordered money buckets."""
    return _ledger(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(28,2)").alias("total"))


@query(
    with_ctes(DOC, PAYMENT)
    + """
, s AS (SELECT id, CASE k WHEN 0 THEN 'c' || (party % 50) ELSE 'c' || (id % 50) END AS center, CAST(gross * 0.5 AS DECIMAL(18,2)) AS share, category FROM doc, (VALUES (0), (1)) t(k))
SELECT center, CAST(coalesce(sum(share) FILTER (category <> '1-URGENT'), 0) AS DECIMAL(18,2)) AS spent, CAST(coalesce(sum(share) FILTER (category = '1-URGENT'), 0) AS DECIMAL(18,2)) AS received,
       count(*) FILTER (s.id % 5 = 4)::BIGINT AS open_lines, count(DISTINCT p.pay_id)::BIGINT AS n_evidence
FROM s LEFT JOIN payment p ON s.id = p.pay_id GROUP BY center""".replace("gross * 0.5", "round(gross * CAST(0.5 AS DECIMAL(2,1)), 2)")
)
def cost_center_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spent, received, open lines and evidence of each cost center, from lines shared by two of them."""
    centers = F.explode(F.array(F.concat(F.lit("c"), F.col("party") % 50), F.concat(F.lit("c"), F.col("id") % 50))).alias("center")
    shares = doc(spark, sf_dir).select("id", centers, F.round(F.col("gross") * F.lit("0.5").cast("decimal(2,1)"), 2).cast(MONEY).alias("share"), F.when(F.col("category") == "1-URGENT", "in").otherwise("out").alias("direction"), (F.col("id") % 5 != 4).alias("done"))
    told = shares.join(payment(spark, sf_dir).select(F.col("pay_id").alias("id"), F.col("pay_id").alias("evidence")), "id", "left")
    return C.cost_center_totals(told)


@query()
def recharge_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each client's receipts pay back of costs made for them, oldest first."""
    rows = tx(spark, sf_dir).where("amount != 0").select(F.col("account").alias("client"), F.col("ts").alias("at"), "id", F.abs("amount").cast(MONEY).alias("amount"), (F.col("amount") < 0).alias("is_cost"), (F.col("id") % 3 == 0).alias("says_so"))
    return C.recharge_receipts(rows)


@query(
    with_ctes(DOC_LINE)
    + """
, s AS (SELECT doc, vat_rate AS rate, CAST(sum(net) AS DECIMAL(18,2)) AS summed, count(*) AS n FROM doc_line GROUP BY doc, vat_rate)
SELECT doc, rate, CAST(summed + CASE WHEN doc % 7 = 0 THEN 0.10 ELSE 0 END AS DECIMAL(18,2)) AS stated, summed, doc % 7 <> 0 OR 0.10 <= n * 0.01 AS fits FROM s"""
)
def lines_by_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines against its stated totals at each tax rate."""
    lines = doc_line(spark, sf_dir).select("doc", F.col("vat_rate").alias("rate"), "net")
    wrong = F.when(F.col("doc") % 7 == 0, F.lit("0.10")).otherwise(F.lit("0.00")).cast("decimal(4,2)")
    stated = lines.groupBy("doc", "rate").agg((F.sum("net") + F.first(wrong)).cast(MONEY).alias("stated"))
    return C.reconcile_rates(lines, stated).select("doc", "rate", "stated", "summed", "fits")


OBSERVED = """
o AS (
  SELECT id AS document, 'gross' AS field, v.value, v.method, v.source, v.confidence FROM doc, LATERAL (
    SELECT CAST(gross AS VARCHAR) AS value, 'structured_xml' AS method, 'e1' AS source, 0.99 AS confidence WHERE id % 6 IN (0, 2, 3)
    UNION ALL SELECT CAST(gross AS VARCHAR), 'ocr', 'e2@engine-a', 0.8 WHERE id % 6 IN (0, 1, 3, 5)
    UNION ALL SELECT CAST(gross AS VARCHAR), 'ocr', 'e3@engine-a', 0.7 WHERE id % 6 = 1
    UNION ALL SELECT CAST(gross + 1 AS VARCHAR), 'vlm', 'e4@engine-b', 0.9 WHERE id % 6 = 2
    UNION ALL SELECT CAST(gross + 1 AS VARCHAR), 'vlm', 'e4@engine-b', 0.3 WHERE id % 6 = 3
    UNION ALL SELECT CAST(gross AS VARCHAR), 'vlm', 'e5@engine-b', 0.2 WHERE id % 6 = 4
    UNION ALL SELECT CAST(gross AS VARCHAR), 'vlm', 'e5@engine-b', 0.6 WHERE id % 6 = 5) v)"""


def _observations(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    d, k = doc(spark, sf_dir), F.col("id") % 6
    right, wrong = F.col("gross").cast("string"), (F.col("gross") + 1).cast("string")
    given = [((0, 2, 3), right, "structured_xml", "e1", 0.99), ((0, 1, 3, 5), right, "ocr", "e2@engine-a", 0.8), ((1,), right, "ocr", "e3@engine-a", 0.7), ((2,), wrong, "vlm", "e4@engine-b", 0.9), ((3,), wrong, "vlm", "e4@engine-b", 0.3), ((4,), right, "vlm", "e5@engine-b", 0.2), ((5,), right, "vlm", "e5@engine-b", 0.6)]
    return [d.where(k.isin(*ks)).select(F.col("id").alias("document"), F.lit("gross").alias("field"), v.alias("value"), F.lit(m).alias("method"), F.lit(s).alias("source"), F.lit(c).alias("confidence")) for ks, v, m, s, c in given]


@query(
    with_ctes(DOC)
    + """
SELECT id AS document, 'gross' AS field, CASE id % 6 WHEN 0 THEN 'green' WHEN 2 THEN 'red' ELSE 'amber' END AS quality,
       CASE WHEN id % 6 IN (0, 1, 3, 5) THEN CAST(gross AS VARCHAR) END AS value, CASE id % 6 WHEN 1 THEN 1 WHEN 4 THEN 0 ELSE 2 END::BIGINT AS channels FROM doc"""
)
def field_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field readings as green (two independent channels, one of high rank), red (they differ) or amber."""
    maps = _observations(spark, sf_dir)
    return C.verify_fields(C.merge_observations(*maps))


@query(
    with_ctes(DOC, OBSERVED.strip())
    + """
SELECT document, field, method, source, confidence::DOUBLE AS confidence, value, row_number() OVER (PARTITION BY document, field ORDER BY
  CASE method WHEN 'structured_xml' THEN 90 WHEN 'vlm' THEN 55 ELSE 50 END DESC, confidence DESC, method, source, value) AS place FROM o"""
)
def ranked_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged readings of several extractors, from the strongest to the weakest."""
    maps = _observations(spark, sf_dir)
    return C.merge_observations(*maps, maps[0]).select("document", "field", "method", "source", "confidence", "value", F.col("place").cast("bigint").alias("place"))


@query(
    """
WITH a AS (SELECT event_id AS id, 'e' || (user_id % 4) AS entity, strftime(ts, '%Y-%m') AS month, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'system' ELSE 'owner' END AS actor, CASE WHEN event_id % 9 <> 0 THEN user_id END AS subject FROM events),
o AS (SELECT CASE WHEN event_id % 10 <> 0 THEN 'e' || (user_id % 4) END AS entity, strftime(ts, '%Y-%m') AS month, CAST(event_id % 50 AS BIGINT) AS seconds FROM events WHERE event_type = 'view'),
k AS (SELECT entity, month, coalesce(CAST(subject AS VARCHAR), '#' || id) AS s, kind, actor FROM a)
SELECT k.entity, k.month, count(DISTINCT CASE WHEN kind = 'click' AND actor = 'system' THEN s END)::BIGINT AS retrieved, count(DISTINCT CASE WHEN kind = 'purchase' THEN s END)::BIGINT AS chased, count(DISTINCT CASE WHEN kind = 'error' THEN s END)::BIGINT AS resolved,
  CAST(ceil((coalesce((SELECT sum(seconds) FROM o WHERE o.entity = k.entity AND o.month = k.month), 0) + coalesce((SELECT sum(seconds) FROM o WHERE o.entity IS NULL AND o.month = k.month), 0)) / 60.0) AS BIGINT) AS owner_minutes
FROM k GROUP BY k.entity, k.month"""
)
def month_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's month: distinct subjects of each kind of activity and the owner's minutes, shared ones included."""
    e = table(spark, sf_dir, "events")
    entity, month, id_ = F.concat(F.lit("e"), F.col("user_id") % 4), F.date_format("ts", "yyyy-MM"), F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "retrieved").when(F.col("event_type") == "purchase", "chased").when(F.col("event_type") == "error", "resolved").otherwise("other")
    acts = e.select(id_.alias("id"), entity.alias("entity"), month.alias("month"), kind.alias("kind"), F.when(id_ % 2 == 0, "system").otherwise("owner").alias("actor"), F.when(id_ % 9 != 0, F.col("user_id")).alias("subject"))
    time = e.where("event_type = 'view'").select(F.when(id_ % 10 != 0, entity).alias("entity"), month.alias("month"), (id_ % 50).alias("seconds"))
    return C.month_summary(acts, time)


@query(
    with_ctes(DOC)
    + """
, i AS (SELECT party % 40 AS client, CASE WHEN id % 5 < 3 OR party % 8 = 0 THEN 'done' WHEN id % 5 = 3 THEN 'missing' ELSE 'conflict' END AS state FROM doc),
a AS (SELECT client, count(*) FILTER (state = 'done') AS done, count(*) AS total, count(*) FILTER (state = 'missing')::BIGINT AS missing, count(*) FILTER (state = 'conflict')::BIGINT AS needs_accountant FROM i GROUP BY client)
SELECT client, CASE WHEN done = total THEN 100 ELSE least(99, done * 100 // total) END::BIGINT AS percent, missing, needs_accountant FROM a"""
)
def home_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each client's month: percent complete, missing, needs accountant, in order of urgency."""
    k = F.col("id") % 5
    items = doc(spark, sf_dir).select((F.col("party") % 40).alias("client"), F.when((k < 3) | (F.col("party") % 8 == 0), "done").when(k == 3, "missing").otherwise("conflict").alias("state"))
    return C.home_table(items)


@query(
    with_ctes(TX)
    + """
, w AS (SELECT *, max(booked_on) OVER (PARTITION BY account) AS last FROM tx),
p AS (SELECT * FROM w WHERE amount < 0 AND booked_on > last - 20),
s AS (SELECT account, kind, count(DISTINCT booked_on) AS days, min(-amount) AS low, max(-amount) AS high FROM p GROUP BY account, kind)
SELECT account, count(*)::BIGINT AS expenses, CAST(sum(-amount) AS DECIMAL(18,2)) AS expenses_total, count(*) FILTER (id % 3 <> 0)::BIGINT AS documents_found, count(*) FILTER (id % 3 = 0)::BIGINT AS missing_evidence,
       (SELECT count(*) FROM s WHERE s.account = p.account AND days >= 3)::BIGINT AS recurring, (SELECT count(*) FROM s WHERE s.account = p.account AND days >= 3 AND high >= low * 1.05)::BIGINT AS went_up
FROM p GROUP BY account"""
)
def business_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a first look at an account's last days finds: expenses, documents, what is missing, recurs or went up."""
    t = tx(spark, sf_dir)
    last = t.groupBy("account").agg(F.max("booked_on").alias("last"))
    p = t.join(last, "account").where((F.col("amount") < 0) & (F.col("booked_on") > F.date_sub("last", 20)))
    series = p.groupBy("account", "kind").agg(F.count_distinct("booked_on").alias("days"), F.min(-F.col("amount")).alias("low"), F.max(-F.col("amount")).alias("high")).where("days >= 3")
    found = series.groupBy("account").agg(F.count("*").alias("recurring"), F.count_if(F.col("high") >= F.col("low") * F.lit("1.05").cast("decimal(3,2)")).alias("went_up"))
    out = p.groupBy("account").agg(F.count("*").alias("expenses"), F.sum(-F.col("amount")).cast(MONEY).alias("expenses_total"), F.count_if(F.col("id") % 3 != 0).alias("documents_found"), F.count_if(F.col("id") % 3 == 0).alias("missing_evidence"))
    return out.join(found, "account", "left").fillna(0, ["recurring", "went_up"])


@query(
    """
WITH u AS (SELECT user_id AS tenant, strftime(ts, '%Y-%m') AS month, count(*) FILTER (event_type <> 'view')::BIGINT AS used FROM events WHERE NOT (event_type = 'error' AND event_id % 2 = 0) GROUP BY ALL)
SELECT tenant, month, used, CASE tenant % 3 WHEN 0 THEN 20 WHEN 1 THEN 50 END::BIGINT AS most, coalesce(used > CASE tenant % 3 WHEN 0 THEN 20 WHEN 1 THEN 50 END, false) AS over FROM u"""
)
def plan_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents counted by tenant and month against their plan's limit (none for the largest); history never counts."""
    e = table(spark, sf_dir, "events").where(~((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)))
    used = e.groupBy(F.col("user_id").alias("tenant"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count_if(F.col("event_type") != "view").alias("used"))
    limits = used.select("tenant").distinct().withColumn("most", F.when(F.col("tenant") % 3 == 0, 20).when(F.col("tenant") % 3 == 1, 50).cast("bigint"))
    return used.join(limits, "tenant").select("tenant", "month", "used", "most", F.coalesce(F.col("used") > F.col("most"), F.lit(False)).alias("over"))


@query("SELECT user_id AS subject, count(*)::BIGINT AS attempts FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10 12:00:00' GROUP BY user_id")
def recent_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed attempts of each subject since a moment."""
    e = table(spark, sf_dir, "events").where("event_type = 'error' AND ts >= TIMESTAMP_NTZ '2024-01-10 12:00:00'")
    return e.groupBy(F.col("user_id").alias("subject")).agg(F.count("*").alias("attempts"))


@query("SELECT event_type AS stage, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS subjects FROM events GROUP BY event_type")
def pipeline_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in each stage of the pipeline, and distinct subjects."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("subjects"))


@query("SELECT l_partkey AS product, l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS line, CAST(l_shipdate AS DATE) AS on_day FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE) DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1")
def latest_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the latest purchase of each product."""
    rows = doc_line(spark, sf_dir).select("product", "doc", "line", "on_day", "supplier")
    return C.latest_per_group(rows, ["product"], ["on_day", "doc", "line", "supplier"]).drop("supplier")


@query("SELECT event_id AS id, ts AS at, event_type AS kind FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty entries of the audit log (the limit is the feature)."""
    return C.audit_tail(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("kind")), None)


@query(
    """
WITH b AS (SELECT user_id AS entity, CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'error' THEN 'conflict' WHEN 'purchase' THEN 'missing_documents' WHEN 'signup' THEN 'connector' ELSE 'needs_owner' END AS kind, count(*)::BIGINT AS n FROM events GROUP BY ALL)
SELECT entity, kind, n, row_number() OVER (PARTITION BY entity ORDER BY CASE kind WHEN 'connector' THEN 2 WHEN 'needs_owner' THEN 4 WHEN 'conflict' THEN 5 WHEN 'missing_documents' THEN 7 ELSE 10 END) AS place FROM b"""
)
def month_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps each entity's month open, in the fixed order of severity."""
    kind = F.when(F.col("event_type") == "click", "in_progress").when(F.col("event_type") == "error", "conflict").when(F.col("event_type") == "purchase", "missing_documents").when(F.col("event_type") == "signup", "connector").otherwise("needs_owner")
    return C.ordered_blockers(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity"), kind.alias("kind")).agg(F.count("*").alias("n")))


@query(
    with_ctes(DOC)
    + """
, c AS (SELECT party AS series, min(id) AS id, CAST(max(gross) AS DECIMAL(18,2)) AS amount, count(*)::BIGINT AS occurrences, CAST((party % 5) * 0.25 AS DECIMAL(4,2)) AS uncertainty FROM doc GROUP BY party)
SELECT series, id, CAST(amount * occurrences * uncertainty AS DECIMAL(28,4)) AS worth FROM c ORDER BY worth DESC, id LIMIT 10"""
)
def questions_worth_asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten questions worth most, by amount, occurrences and uncertainty, one for each series (a top-k report)."""
    c = doc(spark, sf_dir).groupBy(F.col("party").alias("series")).agg(F.min("id").alias("id"), F.max("gross").alias("amount"), F.count("*").alias("occurrences"))
    c = c.withColumn("uncertainty", ((F.col("series") % 5) * F.lit("0.25").cast("decimal(4,2)")).cast("decimal(4,2)"))
    return C.select_questions(c, limit=10).select("series", "id", "worth")


@query(
    with_ctes(DOC)
    + """
SELECT id, CASE id % 9 WHEN 0 THEN 'changed_iban' WHEN 1 THEN 'invalid_bank_details' WHEN 2 THEN 'lookalike_domain' WHEN 3 THEN 'altered_document,suspicious_instructions' WHEN 4 THEN 'new_payment_recipient,not_enough_history'
  WHEN 5 THEN 'unusual_country,recipient_mismatch' WHEN 6 THEN 'unusual_amount' WHEN 7 THEN 'duplicate_invoice,unusual_currency' ELSE '' END AS signals,
  id % 9 < 4 AS hard_stop, CASE WHEN id % 9 < 4 THEN 'high' WHEN id % 9 IN (4, 5, 7) THEN 'medium' WHEN id % 9 = 6 THEN 'low' ELSE 'none' END AS severity FROM doc"""
)
def fraud_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I32: the fraud signals of each document, whether one of them stops payment, and the severity."""
    k, known = F.col("id") % 9, F.array(F.lit("PT50A"))
    gross = F.col("gross")
    rows = doc(spark, sf_dir).select(
        "id",
        F.when(k == 0, "PT50B").otherwise("PT50A").alias("iban"),
        F.when(k == 4, F.array().cast("array<string>")).otherwise(known).alias("known_ibans"),
        (k != 1).alias("iban_valid"),
        F.lit(None).cast("string").alias("twin_iban"),
        F.when(k == 2, "lookalike").otherwise("known").alias("domain_verdict"),
        (k == 3).alias("altered"),
        F.when(k == 3, "URGENT: new bank details").otherwise("thank you").alias("text"),
        (k == 4).alias("first_payment"),
        F.lit("a.com").alias("known_domain"),
        F.lit("a.com").alias("domain"),
        F.when(k == 5, "XX").otherwise("PT").alias("country"),
        F.array(F.lit("PT")).alias("known_countries"),
        (k != 5).alias("recipient_matches"),
        gross.alias("amount"),
        F.when(k == 6, gross / 4).otherwise(gross).cast(MONEY).alias("median"),
        F.lit("0.01").cast(MONEY).alias("mad"),
        F.when(k == 4, 2).otherwise(9).alias("past"),
        (k == 7).alias("number_seen"),
        F.when(k == 7, "USD").otherwise("EUR").alias("currency"),
        F.lit("EUR").alias("usual_currency"),
    )
    return C.fraud_signals(rows.where("gross > 1")).select("id", F.array_join("signals", ",").alias("signals"), "hard_stop", "severity")


@query(
    with_ctes(DOC)
    + """
SELECT id, CASE id % 6 WHEN 0 THEN 'modified_after_creation' WHEN 1 THEN 'created_long_after_issue' WHEN 2 THEN 'text_differs_from_scan' WHEN 3 THEN 'code_differs_from_print,editing_software' WHEN 4 THEN 'created_before_issue' ELSE '' END AS signals FROM doc"""
)
def tamper_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs that a document was changed: dates, text against scan, code against print, software."""
    k, day = F.col("id") % 6, F.col("issue_date")
    cents = lambda cond: (F.col("gross") + F.when(cond, 1).otherwise(0)).cast(MONEY)
    created = F.when(k == 1, F.date_add(day, 400)).when(k == 4, F.date_sub(day, 40)).otherwise(day)
    rows = doc(spark, sf_dir).select("id", created.alias("created"), F.when(k == 0, F.date_add(day, 5)).otherwise(created).alias("modified"), day.alias("issued"), F.col("gross").alias("text_total"), cents(k == 2).alias("scan_total"), cents(k == 3).alias("qr_total"), F.col("gross").alias("print_total"), F.when(k == 3, "Photo Editor 3").otherwise("billing").alias("producer"))
    return C.tamper_signals(rows).select("id", F.array_join("signals", ",").alias("signals"))


@query(
    """
SELECT l_orderkey AS page, l_orderkey * 10 + l_linenumber AS box, (CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE CASE WHEN EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = lineitem.l_orderkey AND o.l_linenumber % 2 = 1) THEN 2 ELSE 1 END END)::BIGINT AS "column"
FROM lineitem"""
)
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column of each text box of a page, from gaps between the boxes."""
    k = F.col("l_linenumber")
    x0 = F.when(k % 2 == 1, 10 + k).otherwise(300 + k)
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_orderkey") * 10 + k).alias("box"), x0.cast("double").alias("x0"), (x0 + 200).cast("double").alias("x1"))
    return C.column_layout(boxes).select("page", "box", "column")


@query(
    with_ctes(DOC)
    + """
, d AS (SELECT id, party, issue_date, gross, 'Supplier ' || (party % 20) || ' Lda' AS supplier, CASE WHEN party % 2 = 0 THEN 'a' ELSE 'b' END AS company, category AS text FROM doc)
SELECT id, supplier, company, issue_date, gross FROM d
WHERE lower(supplier) LIKE '%plier 1%' AND company = 'a' AND issue_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND gross BETWEEN 50000 - 20000.01 AND 50000 + 20000.01 AND lower(text) LIKE '%urgent%'"""
)
def document_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a part of the supplier's name, company, day range, amount and words."""
    from provena.functions.text import contains_all, fold

    d = doc(spark, sf_dir).select("id", "issue_date", "gross", F.concat_ws(" ", F.lit("Supplier"), F.col("party") % 20, F.lit("Lda")).alias("supplier"), F.when(F.col("party") % 2 == 0, "a").otherwise("b").alias("company"), F.col("category").alias("text"))
    near = F.abs(F.col("gross") - F.lit(50000)) <= F.lit("20000.01").cast("decimal(18,2)")
    hit = fold("supplier").contains("plier 1") & (F.col("company") == "a") & F.col("issue_date").between(F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date")) & near & contains_all("text", ["urgent"])
    return d.where(hit).select("id", "supplier", "company", "issue_date", "gross")


@query(
    with_ctes(DOC, PAYMENT, TX)
    + """
, o AS (SELECT id, issue_date + 30 AS due_on, gross, id IN (SELECT pay_id FROM payment) AS done FROM doc)
SELECT id, CASE WHEN due_on <= DATE '1998-06-30' THEN 'open_this_month' WHEN due_on <= DATE '1998-07-14' THEN 'due_soon' ELSE 'later' END AS state, (due_on - DATE '1998-06-30')::BIGINT AS days_left, gross >= 5000 AS high_value
FROM o WHERE NOT done"""
)
def open_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligations without proof at a month's end: open, due within two weeks or later, and of high value."""
    today = F.lit("1998-06-30").cast("date")
    o = doc(spark, sf_dir).withColumn("due_on", F.date_add("issue_date", 30)).join(payment(spark, sf_dir).select(F.col("pay_id").alias("id")), "id", "left_anti")
    state = F.when(F.col("due_on") <= today, "open_this_month").when(F.col("due_on") <= F.date_add(today, 14), "due_soon").otherwise("later")
    return o.select("id", state.alias("state"), F.datediff("due_on", today).cast("bigint").alias("days_left"), (F.col("gross") >= 5000).alias("high_value"))


@query(
    with_ctes(DOC, OBSERVED.strip())
    + """
, v AS (SELECT DISTINCT document, field, value, CASE WHEN method IN ('ocr', 'vlm') THEN method || ':' || split_part(source, '@', -1) ELSE method END AS channel, method = 'structured_xml' AS anchor FROM o),
b AS (SELECT document, field, value, count(DISTINCT channel) AS voters, count(*) FILTER (anchor) AS anchors FROM v GROUP BY ALL),
a AS (SELECT document, field, sum(voters) AS voters, arg_max(value, (voters, value)) AS top, max(voters) AS most, count(*) FILTER (anchors > 0) AS anchored, max(value) FILTER (anchors > 0) AS by_anchor FROM b GROUP BY ALL)
SELECT document, field, CASE WHEN anchored > 1 THEN 'anchors_differ' WHEN anchored = 1 THEN 'anchor' WHEN most * 2 > voters THEN 'majority' ELSE 'split' END AS how,
       CASE WHEN anchored = 1 THEN by_anchor WHEN anchored = 0 AND most * 2 > voters THEN top END AS value, voters::BIGINT AS voters FROM a"""
)
def field_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the readers of a field agree on, by anchors or a strict majority of independent channels."""
    return C.field_consensus(C.merge_observations(*_observations(spark, sf_dir)))


@query(
    with_ctes(DOC)
    + """
, l AS (SELECT strftime(issue_date, '%Y-%m') AS month, CASE WHEN party % 2 = 0 THEN 'sale' ELSE 'purchase' END AS direction, CASE WHEN id % 9 = 0 THEN 'credit_note' WHEN id % 7 = 0 THEN 'advance' ELSE 'invoice' END AS kind,
  CAST(round(gross * CAST(0.2 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS vat, CASE WHEN id % 7 = 1 THEN CAST(1.00 AS DECIMAL(18,2)) END AS settles FROM doc),
o AS (SELECT month, direction, vat * CASE kind WHEN 'credit_note' THEN -1 ELSE 1 END - CASE WHEN kind = 'invoice' THEN coalesce(settles, 0) ELSE 0 END AS own FROM l),
a AS (SELECT month, CAST(coalesce(sum(own) FILTER (direction = 'sale'), 0) AS DECIMAL(28,2)) AS charged, CAST(coalesce(sum(own) FILTER (direction = 'purchase'), 0) AS DECIMAL(28,2)) AS deductible FROM o GROUP BY month)
SELECT month, charged, deductible, CAST(charged - deductible AS DECIMAL(28,2)) AS to_pay FROM a"""
)
def vat_to_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax to pay by month: sales less purchases, credit notes negative, advances not counted twice."""
    i = F.col("id")
    kind = F.when(i % 9 == 0, "credit_note").when(i % 7 == 0, "advance").otherwise("invoice")
    lines = doc(spark, sf_dir).select(F.date_format("issue_date", "yyyy-MM").alias("month"), F.when(F.col("party") % 2 == 0, "sale").otherwise("purchase").alias("direction"), kind.alias("kind"), F.round(F.col("gross") * F.lit("0.2").cast("decimal(3,2)"), 2).cast(MONEY).alias("vat"), F.when(i % 7 == 1, F.lit("1.00").cast(MONEY)).alias("settles"))
    return C.net_vat(lines)


@query(
    with_ctes(DOC)
    + """
SELECT id, CASE WHEN id % 10 = 0 THEN 'a payment to a person' ELSE 'Party ' || party END AS counterparty, id % 10 = 0 AS hidden FROM doc WHERE party % 3 = 0 AND (id % 4 = 0 OR party % 2 = 0)"""
)
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a principal of one tenant and company sees: its own and shared rows, sensitive ones as a summary only."""
    from provena.operators.selection import scrub, visible_to

    rows = doc(spark, sf_dir).select("id", F.concat(F.lit("t"), F.col("party") % 3).alias("tenant_id"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("c"), F.col("party") % 2)).alias("company_id"), F.concat(F.lit("Party "), "party").alias("counterparty"))
    seen = scrub(visible_to(rows, "t0", ["c0"]), rows.where("id % 10 = 0"), "id", ["counterparty"], "a payment to a person")
    return seen.select("id", "counterparty", (F.col("id") % 10 == 0).alias("hidden"))


@query(
    with_ctes(DOC)
    + """
, p AS (SELECT party, day(min(issue_date)) AS usual_day, arg_min(gross, (issue_date, id)) AS usual FROM doc GROUP BY party)
SELECT id, abs(gross - usual) <= abs(usual) * 0.1::DOUBLE AND least(abs(day(issue_date) - usual_day), 31 - abs(day(issue_date) - usual_day)) <= 4 AS fits FROM doc JOIN p ON doc.party = p.party"""
)
def pattern_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's amount and day of the month fit its party's first one, round the month."""
    from provena.operators.selection import pattern_fits as fits

    d = doc(spark, sf_dir)
    usual = d.groupBy("party").agg(F.dayofmonth(F.min("issue_date")).alias("usual_day"), F.min_by("gross", F.struct("issue_date", "id")).alias("usual"))
    return d.join(usual, "party").select("id", fits(F.col("issue_date"), F.col("gross"), F.col("usual_day"), F.col("usual")).alias("fits"))


@query(
    """
WITH cash AS (SELECT 'cash' AS source, 'out' AS direction, 'cost' AS kind, o_orderstatus = 'P' AS pending, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, false AS twice FROM orders
  WHERE o_orderpriority = '5-LOW' AND o_orderstatus IN ('F', 'P') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
claims AS (SELECT 'claims', 'out', CASE WHEN l_linestatus = 'O' THEN 'claim_waiting' ELSE 'cost' END, false, CAST(l_extendedprice AS DECIMAL(18,2)), count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus IN ('O', 'F')),
tills AS (SELECT 'tills', 'in', 'till_cash', false, sum(CAST(value AS DECIMAL(18,2)))::DECIMAL(18,2), false FROM events WHERE event_type = 'purchase' GROUP BY CAST(ts AS DATE) HAVING sum(CAST(value AS DECIMAL(18,2))) <> 0),
desk AS (SELECT 'desk', 'in', 'income', false, CAST(c_acctbal AS DECIMAL(18,2)), false FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'),
reports AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DECIMAL(18,2) AS sales, sum(CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)))::DECIMAL(18,2) AS fees, count(*) % 5 <> 0 AS settled FROM lineitem GROUP BY 1, 2),
payouts AS (SELECT 'payouts', 'in', 'sales', false, sales, false FROM reports WHERE settled AND sales > 0 UNION ALL SELECT 'payouts', 'out', 'platform_fee', false, fees, false FROM reports WHERE settled AND fees > 0),
l AS (SELECT * FROM cash UNION ALL SELECT * FROM claims UNION ALL SELECT * FROM tills UNION ALL SELECT * FROM desk UNION ALL SELECT * FROM payouts)
SELECT source, direction, kind, pending, count(*) AS lines, sum(amount)::DECIMAL(28,2) AS amount, count(*) FILTER (twice) AS clashes FROM l GROUP BY ALL"""
)
def ledger_of_all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five sources beside the bank as ledger lines (cash purchases, claims, tills, desk receipts, payout parts), and how many lines share their id with another one."""
    from provena.operators import ledger as L

    orders, items, events = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "events"))
    stage = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "P", "needs_owner").otherwise("reading")
    documents = orders.select(F.col("o_orderkey").alias("document"), F.to_date("o_orderdate").alias("on"), F.col("o_totalprice").cast(MONEY).alias("gross"), F.lit("EUR").alias("currency"), F.lit("a").alias("company"), stage.alias("stage"), (F.col("o_orderpriority") == "5-LOW").alias("paid_in_cash"))
    returned, order = items.where("l_returnflag = 'R'"), F.col("l_orderkey").alias("document")
    status = F.when(F.col("l_linestatus") == "O", "waiting").when(F.col("l_linestatus") == "F", "paid").otherwise("declined")
    claims = returned.select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("claim"), order, F.to_date("l_shipdate").alias("on"), F.col("l_extendedprice").cast(MONEY).alias("amount"), F.lit("EUR").alias("currency"), F.lit("a").alias("company"), status.alias("status"))
    tills = events.where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("on")).agg(F.sum(F.col("value").cast(MONEY)).alias("cash")).select(F.concat(F.lit("till-"), F.col("on").cast("string")).alias("document"), "on", "cash", F.lit("EUR").alias("currency"), F.lit("a").alias("company"), F.lit(True).alias("usable"))
    desk = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("document"), F.lit("2024-01-01").cast("date").alias("on"), F.col("c_acctbal").cast(MONEY).alias("amount"), F.lit("a").alias("company"), (F.col("c_mktsegment") == "BUILDING").alias("cash"), F.lit("paid").alias("status"))
    price = F.col("l_extendedprice").cast(MONEY)
    reports = items.groupBy(F.concat_ws("@", F.col("l_suppkey").cast("string"), F.to_date("l_shipdate").cast("string")).alias("line"), F.to_date("l_shipdate").alias("on")).agg(F.sum(price).alias("gross_sales"), F.sum(F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2)).alias("fees"), (F.count("*") % 5 != 0).alias("settled"))
    reports = reports.withColumns({"document": F.col("line"), "currency": F.lit("EUR"), "company": F.lit("b"), "pending": F.lit(False)})
    ledger = L.whole_ledger(
        cash=L.cash_purchases(documents, returned.select(order), items.where("l_quantity > 45").select(order)),
        claims=L.expense_claims(claims),
        tills=L.till_cash(tills),
        desk=L.desk_receipts(desk),
        payouts=L.settled_payouts(reports, reports.select("line", "document", "currency", "gross_sales", "fees", "settled")),
    )
    twice = L.clashes(ledger).select("line", "n")
    told = ledger.join(twice, "line", "left").groupBy("source", "direction", "kind", "pending")
    return told.agg(F.count("*").alias("lines"), F.sum("amount").cast("decimal(28,2)").alias("amount"), F.count("n").alias("clashes"))
