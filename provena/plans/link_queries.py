"""Named queries over links between rows and their evidence, each with DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import normalise as N
from provena.operators import links as L
from provena.operators.matching import fifo_deposits as _fifo_deposits
from provena.plans import matching_queries, registry  # noqa: F401  (its SQL is quoted here)
from provena.plans.bind import DOC, PAYMENT, TX, doc, payment, table, tx, with_ctes
from provena.plans.registry import query

MONEY = "decimal(18,2)"

FX = """
day AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE isodow(o_orderdate) <= 5 AND dayofyear(o_orderdate) % 11 <> 0),
r AS (SELECT day, q, CAST(1000 + (dayofyear(day) * k) % 500 AS BIGINT) AS milli FROM day, (VALUES ('USD', 7), ('GBP', 11), ('CHF', 13)) c(q, k)),
d AS (SELECT id, issue_date, gross, CASE party % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE 'CHF' END AS base, CASE WHEN id % 3 = 0 THEN 'USD' ELSE 'EUR' END AS quote FROM doc),
b AS (SELECT d.*, CASE WHEN base = 'EUR' THEN 1000 WHEN issue_date - r.day <= 7 THEN r.milli END AS per_b FROM d ASOF LEFT JOIN r ON d.base = r.q AND d.issue_date >= r.day),
q AS (SELECT b.*, CASE WHEN quote = 'EUR' THEN 1000 WHEN issue_date - r.day <= 7 THEN r.milli END AS per_q FROM b ASOF LEFT JOIN r ON b.quote = r.q AND b.issue_date >= r.day)"""


@query(
    with_ctes(DOC, FX.strip())
    + """
SELECT id, base, quote, gross, CASE WHEN base = quote THEN gross
  ELSE CAST((2 * CAST(gross * 100 AS HUGEINT) * per_q + per_b) // (2 * per_b) AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)) END::DECIMAL(18,2) AS converted
FROM q"""
)
def fx_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of four currencies in euros or dollars, crossing through the euro at the rate of the day.

    The rate table has no weekends or holidays; the dollar is stated per euro, the others the other way round on some
    days would be inverses: here all are per euro.
    """
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().where((F.weekday("day") < 5) & (F.dayofyear("day") % 11 != 0))
    quotes = F.explode(F.array(*[F.struct(F.lit(q).alias("quote"), F.lit(k).alias("k")) for q, k in (("USD", 7), ("GBP", 11), ("CHF", 13))])).alias("c")
    rates = days.select(F.lit("EUR").alias("base"), "day", quotes).select("base", "c.quote", "day", ((1000 + F.dayofyear("day") * F.col("c.k") % 500).cast("decimal(20,10)") * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(20,10)").alias("rate"))
    k = F.col("party") % 4
    d = doc(spark, sf_dir).select("id", "issue_date", "gross", F.when(k == 0, "EUR").when(k == 1, "USD").when(k == 2, "GBP").otherwise("CHF").alias("base"), F.when(F.col("id") % 3 == 0, "USD").otherwise("EUR").alias("quote"))
    return L.convert(d, rates, "gross", "base", "quote", "issue_date", "converted").select("id", "base", "quote", "gross", "converted")


@query(
    """
WITH p AS (SELECT p_partkey AS id, p_partkey % 8 AS k, p_name AS n, replace(p_name, ' ', '') AS s, reverse(p_name) AS r FROM part)
SELECT id, CASE k WHEN 0 THEN 'same_vat' WHEN 1 THEN 'same' WHEN 2 THEN 'similar' WHEN 3 THEN 'different' WHEN 4 THEN 'different_name'
  WHEN 5 THEN 'same' WHEN 6 THEN 'unknown'
  ELSE CASE WHEN lower(r) = lower(n) THEN 'same' WHEN 1 - levenshtein(lower(n), lower(r))::DOUBLE / length(n) >= 0.86 THEN 'similar' WHEN 1 - levenshtein(lower(n), lower(r))::DOUBLE / length(n) <= 0.5 THEN 'different_name' ELSE 'unknown' END END AS relation
FROM p"""
)
def issuer_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each payee relates to the issuer of a document, by known keys, tax numbers or names."""
    k, n, key = F.col("p_partkey") % 8, F.col("p_name"), F.col("p_partkey").cast("string")
    known = k <= 4
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(known, key).alias("t_key"),
        F.when(known, F.when(k.isin(3, 4), F.concat(key, F.lit("x"))).otherwise(key)).alias("d_key"),
        k.isin(0, 1, 3).alias("t_strong"),
        k.isin(0, 1, 3).alias("d_strong"),
        n.alias("t_name"),
        F.when(k == 5, F.replace(n, F.lit(" "), F.lit(""))).when(k == 6, F.lit(None)).when(k == 7, F.reverse(n)).otherwise(n).alias("d_name"),
        F.when(known, key).alias("t_tax"),
        F.when(k == 0, key).alias("d_tax"),
    )
    return L.relation(rows).select("id", "relation")


@query(
    f"""
WITH c AS ({registry.ORACLES["match_scored_candidates"]}),
v AS (SELECT pay_id, id, points, CASE status WHEN 'exact' THEN 0 WHEN 'adjusted' THEN 1 ELSE 2 END AS s, abs(days) AS apart FROM c WHERE viable),
r AS (SELECT *, row_number() OVER w AS place FROM v WINDOW w AS (PARTITION BY pay_id ORDER BY points DESC, s, apart, id))
SELECT r.pay_id, r.id, r.points, r.place, (a.points - b.points)::BIGINT AS lead, coalesce(a.points - b.points <= 3, false) AS ambiguous
FROM r JOIN r a ON r.pay_id = a.pay_id AND a.place = 1 LEFT JOIN r b ON r.pay_id = b.pay_id AND b.place = 2"""
)
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every payment's viable documents in full order, the best one's lead, and whether that is too small to decide."""
    c = registry.QUERIES["match_scored_candidates"](spark, sf_dir).where("viable")
    order = [F.col("points").desc(), F.when(F.col("status") == "exact", 0).when(F.col("status") == "adjusted", 1).otherwise(2), F.abs("days"), F.col("id")]
    return L.rank_in_group(c, ["pay_id"], order, "points").select("pay_id", "id", "points", "place", "lead", "ambiguous")


@query(
    with_ctes(DOC)
    + """
, p AS (SELECT id AS pay_id, id - id % 4 AS target, CAST(round(gross * CAST(0.2 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS amount, id % 4 AS k FROM doc WHERE id % 4 IN (1, 2)),
m AS (SELECT p.pay_id, d.id, p.amount, d.gross FROM p JOIN doc d ON d.id = p.target AND p.amount > 0 AND p.amount < d.gross)
SELECT pay_id, id, amount, CAST(gross - sum(amount) OVER (PARTITION BY id ORDER BY pay_id) AS DECIMAL(18,2)) AS left FROM m""".replace(" AS left FROM", ' AS "left" FROM')
)
def partial_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of less than the document whose number their text quotes, and what is left of it."""
    d = doc(spark, sf_dir)
    number = lambda i: F.concat(F.lit("FT 9/"), i.cast("string"))
    text = F.concat(F.lit("pag parcial ft 9 / "), (F.col("id") - F.col("id") % 4).cast("string"), F.lit(" obrigado"))
    keys = F.transform(F.regexp_extract_all(text, F.lit(r"((?i)ft \d+ ?/ ?\d+)"), 1), N.invoice_number_key)
    paid = d.where((F.col("id") % 4).isin(1, 2)).select(F.col("id").alias("pay_id"), F.round(F.col("gross") * F.lit("0.2").cast("decimal(3,2)"), 2).cast(MONEY).alias("amount"), keys.alias("keys"))
    return L.quoted_partials(paid, d.select("id", "gross", N.invoice_number_key(number(F.col("id"))).alias("number_key")))


@query(
    with_ctes(DOC)
    + """
SELECT id, CAST(CASE id % 3 WHEN 0 THEN 2 ELSE 3 END AS BIGINT) AS parts, issue_date + 5 AS first_day, issue_date + CASE id % 3 WHEN 0 THEN 15 ELSE 25 END AS last_day
FROM doc WHERE id % 3 <> 2 AND gross > 1"""
)
def instalment_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that two or three payments quoting their number pay off exactly; one cent less pays nothing off."""
    d = doc(spark, sf_dir).where("gross > 1")
    third = F.floor(F.col("gross") * 100 / 3).cast(MONEY) * F.lit("0.01").cast("decimal(3,2)")
    n = F.when(F.col("id") % 3 == 0, 2).otherwise(3)
    part = F.explode(F.sequence(F.lit(1), n)).alias("k")
    rows = d.select("id", "issue_date", "gross", part, n.alias("n"))
    amount = F.when(F.col("k") < F.col("n"), third).otherwise(F.col("gross") - third * (F.col("n") - 1) - F.when(F.col("id") % 3 == 2, F.lit("0.01")).otherwise(F.lit("0.00")).cast("decimal(4,2)"))
    paid = rows.select((F.col("id") * 10 + F.col("k")).alias("pay_id"), amount.cast(MONEY).alias("amount"), F.date_add("issue_date", F.col("k") * 10 - 5).alias("booked_on"), F.array(F.col("id").cast("string")).alias("keys"))
    return L.instalments(paid, d.select("id", "gross", "issue_date", F.col("id").cast("string").alias("number_key")))


@query(
    """
SELECT c_custkey AS pay_id, c_custkey AS slip_id, c_custkey % 6 = 0 AS by_iban FROM customer WHERE c_custkey % 6 IN (0, 1) AND abs(CAST(c_acctbal AS DECIMAL(18,2))) > 0"""
)
def salary_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salary payments that a payslip proves: equal pay, in its window, the employee's account or else their name."""
    c, k = F.col("c_custkey"), F.col("c_custkey") % 6
    word = F.translate(c.cast("string"), "0123456789", "abcdefghij")
    name = F.concat(F.lit("Ana Maria q"), word, F.lit(" Costa"))
    rows = table(spark, sf_dir, "customer").where(F.abs(F.col("c_acctbal").cast(MONEY)) > 0)
    net = F.abs(F.col("c_acctbal").cast(MONEY))
    iban = F.concat(F.lit("PT50"), F.lpad(c.cast("string"), 21, "0"))
    slips = rows.select(c.alias("slip_id"), net.alias("net"), F.lit("2024-01-01").cast("date").alias("month"), F.when(k != 1, iban).alias("iban"), name.alias("employee"))
    paid = rows.select(
        c.alias("pay_id"),
        F.when(k == 4, net + F.lit("0.01").cast("decimal(4,2)")).otherwise(net).cast(MONEY).alias("amount"),
        F.when(k == 3, F.lit("2024-02-11")).otherwise(F.lit("2024-02-10")).cast("date").alias("booked_on"),
        F.when(k == 0, iban).when(k == 2, F.lit("PT50999999999999999999999")).alias("iban"),
        F.when(k == 5, F.lit("Costa")).otherwise(F.concat(F.lit("q"), word, F.lit(" COSTA"))).alias("name"),
    )
    return L.salary_proofs(paid, slips)


@query(
    """
WITH e AS (SELECT user_id AS company, CAST(ts AS DATE) AS day, event_type AS kind, CAST(value AS DECIMAL(18,2)) AS v FROM events),
t AS (SELECT company, day, CAST(sum(v) + CASE WHEN day(day) % 5 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS card FROM e WHERE kind = 'purchase' GROUP BY company, day),
r AS (SELECT company, day, CAST(sum(v) AS DECIMAL(18,2)) AS found FROM e WHERE kind = 'purchase' AND day(day) % 7 <> 0 GROUP BY company, day)
SELECT t.company, t.day, card, found, CASE WHEN card = 0 THEN 'none' WHEN found IS NULL THEN 'open' WHEN found = card THEN 'matched' ELSE 'differs' END AS status
FROM t LEFT JOIN r ON t.company = r.company AND t.day = r.day"""
)
def till_card_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A till's card takings of each day against the terminal's report of that day."""
    e = tx(spark, sf_dir).where("kind = 'purchase'").select(F.col("account").alias("company"), F.col("booked_on").alias("day"), (-F.col("amount")).cast(MONEY).alias("v"))
    tills = e.groupBy("company", "day").agg((F.sum("v") + F.when(F.dayofmonth("day") % 5 == 0, 1).otherwise(0)).cast(MONEY).alias("card"))
    lines = e.where(F.dayofmonth("day") % 7 != 0).select("company", "day", F.col("v").alias("sales"), F.lit("0.00").cast(MONEY).alias("refunds"))
    return L.till_card_days(tills, lines).select("company", "day", "card", "found", "status")


@query(
    with_ctes(DOC, PAYMENT)
    + """
, c AS (SELECT id AS claim_id, party AS employee, gross AS amount FROM doc WHERE id % 3 = 0),
s AS (SELECT employee, CAST(sum(amount) AS DECIMAL(18,2)) AS total, count(*) AS n, min(claim_id) AS first_id FROM c GROUP BY employee),
p AS (SELECT first_id AS pay_id, s.employee, CASE s.employee % 3 WHEN 0 THEN total WHEN 1 THEN (SELECT amount FROM c WHERE claim_id = first_id) ELSE CAST(total + 1 AS DECIMAL(18,2)) END AS amount FROM s),
o AS (SELECT p.pay_id, count(*) AS n, min(claim_id) AS claim_id FROM p JOIN c ON p.employee = c.employee AND p.amount = c.amount GROUP BY p.pay_id)
SELECT p.pay_id, p.employee, CASE WHEN o.n = 1 THEN 'one' WHEN o.n > 1 THEN 'several' WHEN s.total = p.amount THEN 'all' END AS how,
       CASE WHEN o.n = 1 THEN o.claim_id END AS claim_id, CASE WHEN o.n IS NULL AND s.total = p.amount THEN s.n END AS n_claims
FROM p JOIN s ON p.employee = s.employee LEFT JOIN o ON p.pay_id = o.pay_id"""
)
def employee_reimbursements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reimbursements of one exact claim of an employee, else of all of their claims together."""
    claims = doc(spark, sf_dir).where("id % 3 = 0").select(F.col("id").alias("claim_id"), F.col("party").alias("employee"), F.col("gross").alias("amount"))
    s = claims.groupBy("employee").agg(F.sum("amount").cast(MONEY).alias("total"), F.min(F.struct("claim_id", "amount")).alias("first"))
    k = F.col("employee") % 3
    paid = s.select(F.col("first.claim_id").alias("pay_id"), "employee", F.when(k == 0, F.col("total")).when(k == 1, F.col("first.amount")).otherwise(F.col("total") + 1).cast(MONEY).alias("amount"))
    return L.reimbursements(paid, claims)


@query(
    with_ctes(DOC, PAYMENT)
    + """
, r AS (SELECT id AS receipt, party, gross AS amount, issue_date FROM doc),
p AS (SELECT pay_id, party, amount, booked_on FROM payment),
j AS (SELECT p.pay_id, r.receipt, booked_on - issue_date AS days FROM p JOIN r ON p.party = r.party AND p.amount = r.amount WHERE abs(booked_on - issue_date) <= 7),
u AS (SELECT *, count(*) OVER (PARTITION BY pay_id) + count(*) OVER (PARTITION BY receipt) AS n FROM j)
SELECT pay_id, receipt, days::BIGINT AS days FROM u WHERE n = 2"""
)
def card_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card payments and receipts of equal amount within seven days, where exactly one fits on both sides."""
    receipts = doc(spark, sf_dir).select(F.col("id").alias("receipt"), "party", F.col("gross").alias("amount"), "issue_date")
    found = L.unique_within(payment(spark, sf_dir), receipts, ["party", "amount"], "pay_id", "receipt", F.datediff("booked_on", "issue_date"), [(-7, 7)])
    return found.select("pay_id", "receipt", F.col("days").cast("bigint").alias("days"))


@query(
    """
SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'satisfied' WHEN 1 THEN 'satisfied' WHEN 2 THEN 'conflict' WHEN 3 THEN 'doubt' WHEN 4 THEN 'open' WHEN 5 THEN 'satisfied' ELSE 'conflict' END AS outcome,
       CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 5 THEN 1 END::BIGINT AS parts, CASE o_orderkey % 7 WHEN 0 THEN false WHEN 1 THEN false WHEN 5 THEN true END AS late,
       CASE WHEN o_orderkey % 7 IN (0, 5) THEN 'e' || o_orderkey END AS proof
FROM orders WHERE o_totalprice > 1"""
)
def obligation_satisfaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligations and what proves them: exact, in parts, another amount, unverified, nothing, late, read two ways."""
    d = doc(spark, sf_dir).where("gross > 1")
    due = F.date_add("issue_date", 30)
    k, ref, half = F.col("id") % 7, F.col("id").cast("string"), (F.floor(F.col("gross") * 50) * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)
    fact = lambda name, amount, on, green: F.struct(F.concat(F.lit(name), ref).alias("evidence"), amount.cast(MONEY).alias("amount"), on.alias("on"), F.lit(green).alias("green"))
    cent, gross = F.lit("0.01").cast("decimal(4,2)"), F.col("gross")
    facts = (
        F.when(k == 0, F.array(fact("e", gross, due, True), fact("e", gross, due, True)))
        .when(k == 1, F.array(fact("a", half, due, True), fact("b", gross - half, due, True)))
        .when(k == 2, F.array(fact("e", gross + cent, due, True)))
        .when(k == 3, F.array(fact("e", gross, due, False)))
        .when(k == 5, F.array(fact("e", gross, F.date_add("issue_date", 31), True)))
        .when(k == 6, F.array(fact("e", gross, due, True), fact("e", gross - cent, due, True)))
    )
    told = d.select(ref.alias("reference"), F.explode(facts).alias("f")).select("reference", "f.*")
    return L.satisfy(d.select("id", F.col("gross").alias("amount"), due.alias("by"), ref.alias("reference")), told)


@query(
    """
WITH c AS (SELECT conv_id, turn, role FROM conversations),
m AS (SELECT conv_id, turn, (conv_id * 3 + turn) % 4 AS k FROM c WHERE role = 'assistant' AND turn > 0 AND EXISTS (SELECT 1 FROM c u WHERE u.conv_id = c.conv_id AND u.role = 'user'))
SELECT conv_id || '-' || turn AS mail, CASE WHEN k < 3 THEN conv_id END AS thread, CASE k WHEN 0 THEN 'in_reply_to' WHEN 1 THEN 'references' WHEN 2 THEN 'subject' END AS by FROM m"""
)
def mail_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and the threads that they belong to, by In-Reply-To, References or a token in the subject."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    asked = c.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    threads = asked.select(F.col("conv_id").alias("thread"), F.concat(F.lit("<"), "conv_id", F.lit(">")).alias("message_id"), F.concat(F.lit("BO-"), "conv_id").alias("token"), F.lit("a.com").alias("domain"))
    k, own = (F.col("conv_id") * 3 + F.col("turn")) % 4, F.concat(F.lit("<"), "conv_id", F.lit(">"))
    mails = c.where("role = 'assistant' AND turn > 0").join(asked.select("conv_id"), "conv_id", "left_semi").select(
        F.concat_ws("-", "conv_id", "turn").alias("mail"),
        F.when(k == 0, own).alias("in_reply_to"),
        F.when(k == 1, F.array(own, F.lit("<unknown>"))).otherwise(F.array().cast("array<string>")).alias("references"),
        F.when(k == 2, F.concat(F.lit("Re: [BO-"), "conv_id", F.lit("] invoice"))).otherwise(F.lit("Re: invoice")).alias("subject"),
        F.lit("b.com").alias("sender_domain"),
    )
    return L.match_replies(mails, threads).select("mail", "thread", "by")


@query(
    with_ctes(TX)
    + """
, v AS (SELECT account, kind AS company, sum(CASE kind WHEN 'purchase' THEN 3 WHEN 'click' THEN 1 ELSE 2 END)::BIGINT AS weight FROM tx GROUP BY account, kind),
r AS (SELECT *, row_number() OVER w AS rn, lead(weight) OVER w AS next FROM v WINDOW w AS (PARTITION BY account ORDER BY weight DESC, company))
SELECT account, CASE WHEN next IS NULL OR next < weight THEN company END AS company, weight, NOT (next IS NULL OR next < weight) AS ask FROM r WHERE rn = 1"""
)
def weighted_company_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company with the most weight of votes for each account; a tie is asked about."""
    votes = tx(spark, sf_dir).select("account", F.col("kind").alias("company"), F.when(F.col("kind") == "purchase", 3).when(F.col("kind") == "click", 1).otherwise(2).alias("w"))
    return L.weighted_votes(votes, "account", "company", "w")


@query(
    with_ctes(TX)
    + """
SELECT id, CASE WHEN id % 4 = 0 AND account % 2 = 0 THEN 'company-' || (account % 3) WHEN account % 5 <> 0 THEN 'company-' || (account % 2) END AS owner,
       CASE WHEN id % 4 = 0 AND account % 2 = 0 THEN 'card' WHEN account % 5 <> 0 THEN 'account' END AS by FROM tx"""
)
def line_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose each bank line is: the card's owner before the account's."""
    lines = tx(spark, sf_dir).select("id", "account", F.when(F.col("id") % 4 == 0, F.col("account")).alias("card_last4"))
    accounts = lines.select("account").distinct()
    cards = accounts.where("account % 2 = 0").select(F.col("account").alias("card_last4"), F.concat(F.lit("company-"), F.col("account") % 3).alias("owner"))
    own = accounts.where("account % 5 != 0").select("account", F.concat(F.lit("company-"), F.col("account") % 2).alias("owner"))
    return L.owners(lines, cards, own).select("id", "owner", "by")


BANKS = {"0007": "Banco Norte", "0018": "Banco Central", "0033": "Banco Mar", "0035": "Caixa Geral"}


@query(
    """
WITH c AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '0007' WHEN 1 THEN '0018' WHEN 2 THEN '0033' WHEN 3 THEN '0035' ELSE '9999' END AS code FROM customer)
SELECT id, CASE code WHEN '0007' THEN 'Banco Norte' WHEN '0018' THEN 'Banco Central' WHEN '0033' THEN 'Banco Mar' WHEN '0035' THEN 'Caixa Geral' END AS bank,
       CASE WHEN id % 3 = 0 THEN 'Supplier#' || lpad(CAST(id % 100 + 1 AS VARCHAR), 9, '0') END AS site_supplier
FROM c"""
)
def banks_and_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank of an IBAN by its country and bank code, and the supplier whose site a link's host is."""
    c = F.col("c_custkey")
    code = F.element_at(F.array(*map(F.lit, [*BANKS, "9999"])), (c % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(c.alias("id"), F.concat(F.lit("PT50 "), code, F.lit(" 0000 12345678901 54")).alias("iban"), F.when(c % 3 == 0, F.concat(F.lit("https://www.site"), c % 100 + 1, F.lit(".example.com/faturas"))).alias("link"))
    names = N._map([(k, F.lit(v)) for k, v in BANKS.items()])
    plain = F.regexp_replace("iban", r"\s", "")
    bank = F.when(F.substring(plain, 1, 2) == "PT", F.try_element_at(names, F.substring(plain, 5, 4)))
    from provena.functions.web import host

    sites = table(spark, sf_dir, "customer").select((c % 100 + 1).alias("n")).distinct().select(F.concat(F.lit("site"), "n", F.lit(".example.com")).alias("host"), F.concat(F.lit("Supplier#"), F.lpad(F.col("n").cast("string"), 9, "0")).alias("site_supplier"))
    told = rows.withColumn("host", F.regexp_replace(host("link"), r"^www\.", ""))
    return told.join(sites, "host", "left").select("id", bank.alias("bank"), "site_supplier")


PAYOUTS = """
r AS (SELECT id AS report_id, party % 3 AS provider, issue_date AS paid_on, gross AS net FROM doc WHERE id % 2 = 0),
p AS (SELECT id AS pay_id, CASE WHEN id % 5 = 0 THEN NULL ELSE party % 3 END AS provider, issue_date + CAST(id % 14 - 3 AS INTEGER) AS booked_on,
             CAST(gross + CASE WHEN id % 8 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS amount, CASE WHEN id % 6 = 0 THEN id END AS quoted FROM doc WHERE id % 2 = 0),
w AS (SELECT p.pay_id, r.report_id, booked_on - paid_on AS gap, coalesce(quoted = report_id, false) AS by_ref, amount = net AS exact
      FROM p JOIN r ON (p.provider IS NULL OR p.provider = r.provider) AND booked_on - paid_on BETWEEN -3 AND 10),
s1 AS (SELECT pay_id, report_id, count(*) OVER (PARTITION BY pay_id) + count(*) OVER (PARTITION BY report_id) - 2 AS rivals FROM w WHERE exact AND by_ref),
w2 AS (SELECT * FROM w WHERE pay_id NOT IN (SELECT pay_id FROM s1) AND report_id NOT IN (SELECT report_id FROM s1)),
s2 AS (SELECT pay_id, report_id, count(*) OVER (PARTITION BY pay_id) + count(*) OVER (PARTITION BY report_id) - 2 AS rivals FROM w2 WHERE exact),
w3 AS (SELECT * FROM w2 WHERE pay_id NOT IN (SELECT pay_id FROM s2) AND report_id NOT IN (SELECT report_id FROM s2)),
s3 AS (SELECT * FROM (SELECT pay_id, report_id, count(*) OVER (PARTITION BY pay_id) + count(*) OVER (PARTITION BY report_id) - 2 AS rivals FROM w3 WHERE by_ref) WHERE rivals = 0),
w4 AS (SELECT * FROM w3 WHERE abs(gap) <= 14 AND pay_id NOT IN (SELECT pay_id FROM s3) AND report_id NOT IN (SELECT report_id FROM s3)),
s4 AS (SELECT * FROM (SELECT pay_id, report_id, gap, count(*) OVER (PARTITION BY pay_id) AS a, count(*) OVER (PARTITION BY report_id) AS b FROM w4) WHERE a = 1 AND b = 1 AND gap BETWEEN -1 AND 4)"""


@query(
    with_ctes(DOC, PAYOUTS.strip())
    + """
SELECT pay_id, report_id, CASE WHEN rivals = 0 THEN 'settled' ELSE 'ambiguous' END AS outcome, 1 AS step FROM s1
UNION ALL SELECT pay_id, report_id, CASE WHEN rivals = 0 THEN 'settled' ELSE 'ambiguous' END, 2 FROM s2
UNION ALL SELECT pay_id, report_id, 'differs', 3 FROM s3 UNION ALL SELECT pay_id, report_id, 'differs', 4 FROM s4"""
)
def payout_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank payouts and settlement reports, in the four steps from exact and quoted to alone in a quiet window."""
    d = doc(spark, sf_dir).where("id % 2 = 0")
    provider = (F.col("party") % 3).cast("bigint")
    reports = d.select(F.col("id").alias("report_id"), provider.alias("provider"), F.lit("EUR").alias("currency"), F.col("issue_date").alias("paid_on"), F.col("gross").alias("net"))
    paid = d.select(
        F.col("id").alias("pay_id"),
        F.when(F.col("id") % 5 != 0, provider).alias("provider"),
        F.lit("EUR").alias("currency"),
        F.date_add("issue_date", (F.col("id") % 14 - 3).cast("int")).alias("booked_on"),
        (F.col("gross") + F.when(F.col("id") % 8 == 0, 1).otherwise(0)).cast(MONEY).alias("amount"),
        F.when(F.col("id") % 6 == 0, F.col("id").cast("string")).alias("quoted"),
    )
    return L.match_payouts(paid, reports)


@query(
    with_ctes(DOC)
    + """
SELECT party, id AS "row", CASE id % 6 WHEN 0 THEN 'matched' WHEN 1 THEN 'differs' WHEN 2 THEN 'matched' WHEN 3 THEN 'not_found' WHEN 4 THEN 'paid' ELSE 'not_found' END AS outcome,
       CASE WHEN id % 6 IN (0, 1, 2, 4) THEN id END AS ours FROM doc
WHERE (party, gross) IN (SELECT (party, gross) FROM doc GROUP BY party, gross HAVING count(*) = 1)"""
)
def statement_lines_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's statement lines against our documents by number, then by amount and day, and against payments."""
    d = doc(spark, sf_dir)
    d = d.join(d.groupBy("party", "gross").count().where("count = 1").select("party", "gross"), ["party", "gross"])
    k, number = F.col("id") % 6, F.concat(F.lit("FT"), "id")
    cent = F.lit("0.01").cast("decimal(4,2)")
    amount = F.when(k.isin(1), F.col("gross") + cent + F.lit(1000000)).otherwise(F.col("gross")).cast(MONEY)
    lines = d.select("party", F.col("id").alias("row"), F.when(k.isin(0, 1), number).when(k == 5, F.lit("unknown")).alias("number"), F.date_add("issue_date", F.when(k == 3, 11).otherwise(3)).alias("on"), amount.alias("amount"), (k == 4).alias("is_payment"))
    own = d.where((k != 4)).select("party", "id", F.when(k != 2, number).alias("number"), F.col("gross").alias("amount"), F.col("issue_date").alias("on"))
    paid = d.where(k == 4).select("party", "id", F.col("gross").alias("amount"), F.col("issue_date").alias("on"))
    return L.check_statement(lines, own, paid)


@query(
    with_ctes(DOC, PAYMENT)
    + """
, s AS (SELECT id AS series, party, CASE id % 2 WHEN 0 THEN 'card' ELSE 'debit' END AS method, issue_date AS around FROM doc WHERE id % 10 = 0),
p AS (SELECT pay_id, party, booked_on, CASE pay_id % 3 WHEN 0 THEN 'card' ELSE 'debit' END AS paid_by FROM payment),
j AS (SELECT series, pay_id, abs(booked_on - around) AS apart, CASE WHEN paid_by = method THEN 0 ELSE 1 END AS other FROM s JOIN p ON s.party = p.party WHERE abs(booked_on - around) <= 45)
SELECT series, pay_id, apart::BIGINT AS days_apart, other = 0 AS usual_method FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY other, apart, pay_id) AS rn FROM j) WHERE rn = 1"""
)
def series_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payment of a recurring series nearest its expected day, of the usual method before any other."""
    series = doc(spark, sf_dir).where("id % 10 = 0").select(F.col("id").alias("series"), "party", F.when(F.col("id") % 2 == 0, "card").otherwise("debit").alias("method"), F.col("issue_date").alias("around"))
    paid = payment(spark, sf_dir).select("pay_id", "party", "booked_on", F.when(F.col("pay_id") % 3 == 0, "card").otherwise("debit").alias("method"))
    return L.nearest_of_usual_method(series, paid)


@query()
def cash_deposits_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deposits take the till days of the three weeks before them, oldest first, all or nothing."""
    t = tx(spark, sf_dir)
    days = t.where("kind = 'purchase'").groupBy("account", F.col("booked_on").alias("day")).agg((-F.sum("amount")).cast(MONEY).alias("cash"))
    deposits = t.where("kind = 'signup' AND amount > 0").select("account", "id", F.col("booked_on").alias("day"), "amount")
    return _fifo_deposits(days, deposits, "account")


@query(
    with_ctes(DOC)
    + """
, p AS (SELECT id AS pay, party, gross AS amount, issue_date AS paid_on FROM doc WHERE id % 3 = 0),
r AS (SELECT id AS ret, party, gross AS amount, issue_date + CAST(id % 70 AS INTEGER) AS back_on FROM doc WHERE id % 6 = 0),
j AS (SELECT pay, ret, back_on - paid_on AS days FROM p JOIN r ON p.party = r.party AND p.amount = r.amount),
a AS (SELECT *, count(*) OVER (PARTITION BY pay) + count(*) OVER (PARTITION BY ret) AS n FROM j WHERE days BETWEEN 0 AND 60),
b AS (SELECT *, count(*) OVER (PARTITION BY pay) + count(*) OVER (PARTITION BY ret) AS n FROM j WHERE days BETWEEN 0 AND 14)
SELECT pay, ret, days::BIGINT AS days, 1 AS "window" FROM a WHERE n = 2
UNION ALL SELECT pay, ret, days, 2 FROM b WHERE n = 2 AND pay NOT IN (SELECT pay FROM a WHERE n = 2) AND ret NOT IN (SELECT ret FROM a WHERE n = 2)"""
)
def returned_debits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debits that came back and the payment each one undoes: alone within 60 days, else alone within 14."""
    d = doc(spark, sf_dir)
    paid = d.where("id % 3 = 0").select(F.col("id").alias("pay"), "party", F.col("gross").alias("amount"), F.col("issue_date").alias("paid_on"))
    back = d.where("id % 6 = 0").select(F.col("id").alias("ret"), "party", F.col("gross").alias("amount"), F.date_add("issue_date", (F.col("id") % 70).cast("int")).alias("back_on"))
    found = L.unique_within(paid, back, ["party", "amount"], "pay", "ret", F.datediff("back_on", "paid_on"), [(0, 60), (0, 14)])
    return found.select("pay", "ret", F.col("days").cast("bigint").alias("days"), "window")


@query(
    with_ctes(DOC)
    + """
, l AS (SELECT id AS lease, n + 1 AS instalment, party, gross AS amount, CAST(issue_date + to_months(CAST(n AS INTEGER)) AS DATE) AS due_on FROM doc, range(6) r(n) WHERE id % 20 = 0),
p AS (SELECT lease * 10 + instalment AS pay, party, amount, due_on + CAST((lease + instalment * 3) % 14 AS INTEGER) AS booked_on FROM l WHERE instalment <> 2),
j AS (SELECT pay, lease, instalment, booked_on - due_on AS days FROM p JOIN l ON p.party = l.party AND p.amount = l.amount WHERE abs(booked_on - due_on) <= 10),
u AS (SELECT *, count(*) OVER (PARTITION BY pay) + count(*) OVER (PARTITION BY lease, instalment) AS n FROM j)
SELECT pay, lease, instalment::BIGINT AS instalment, days::BIGINT AS days FROM u WHERE n = 2"""
)
def lease_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lease instalments and the payment of each, of equal amount within ten days, where exactly one fits."""
    n = F.explode(F.sequence(F.lit(1), F.lit(6))).alias("instalment")
    plan = doc(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("lease"), "party", F.col("gross").alias("amount"), "issue_date", n).withColumn("due_on", F.add_months("issue_date", F.col("instalment") - 1))
    paid = plan.where("instalment != 2").select((F.col("lease") * 10 + F.col("instalment")).alias("pay"), "party", "amount", F.date_add("due_on", ((F.col("lease") + F.col("instalment") * 3) % 14).cast("int")).alias("booked_on"))
    line = F.struct("lease", "instalment")
    found = L.unique_within(paid, plan.withColumn("line", line), ["party", "amount"], "pay", "line", F.datediff("booked_on", "due_on"), [(-10, 10)])
    return found.select("pay", "line.lease", F.col("line.instalment").cast("bigint").alias("instalment"), F.col("days").cast("bigint").alias("days"))
