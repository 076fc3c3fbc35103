"""Named queries over the readers: payloads, letters and files made from the tables, read back, against SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.plans.bind import DOC, DOC_LINE, TX, doc, doc_line, table, tx, with_ctes
from provena.plans.registry import query
from provena.sources import files as R
from provena.sources import texts as T
from provena.sources.sinks import canonical_json, manifest, package_hash
from provena.storage import scratch_path

MONEY = "decimal(18,2)"


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank lines as a provider's JSON rows; every fifth without an id of its own."""
    t = tx(spark, sf_dir)
    other = F.concat(F.lit("Party "), F.col("account"))
    side = F.struct(F.concat(F.lit("PT50"), F.lpad(F.col("account").cast("string"), 21, "0")).alias("iban"))
    row = F.struct(
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("p"), "id")).alias("transactionId"),
        F.col("booked_on").cast("string").alias("bookingDate"),
        F.struct(F.col("amount").cast("string").alias("amount"), F.lit("eur").alias("currency")).alias("transactionAmount"),
        F.when(F.col("amount") < 0, other).alias("creditorName"),
        F.when(F.col("amount") >= 0, other).alias("debtorName"),
        F.when(F.col("amount") < 0, side).alias("creditorAccount"),
        F.when(F.col("amount") >= 0, side).alias("debtorAccount"),
        F.array(F.lit("pay"), F.col("kind")).alias("remittanceInformationUnstructuredArray"),
    )
    return t.select("id", "account", F.to_json(row).alias("value"))


@query(
    with_ctes(TX)
    + """
SELECT id, CASE WHEN id % 5 <> 0 THEN 'p' || id END AS provider_id, booked_on, amount, 'EUR' AS currency, 'Party ' || account AS counterparty,
       'PT50' || lpad(CAST(account AS VARCHAR), 21, '0') AS counterparty_iban, 'pay ' || kind AS description FROM tx"""
)
def bank_feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's JSON rows as booked bank lines; the counterparty is the other side of the sign."""
    return R.bank_lines(_feed(spark, sf_dir)).drop("account")


@query(
    with_ctes(TX)
    + """
, k AS (SELECT id, account, booked_on, CASE WHEN id % 5 <> 0 THEN 'p' || id ELSE '#' || sha256(CAST(booked_on AS VARCHAR) || '|' || amount || '|EUR|Party ' || account || '|pay ' || kind) END AS key, id % 5 <> 0 AS own FROM tx),
n AS (SELECT *, row_number() OVER (PARTITION BY account, booked_on, key ORDER BY id) AS nth FROM k)
SELECT id AS line, substr(sha256('t1|' || account || '|' || key || '|' || CASE WHEN own THEN '0' ELSE CAST(nth AS VARCHAR) END), 1, 16) AS id FROM n"""
)
def bank_line_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of bank lines that a second download repeats: by provider id, else by content and number of that day."""
    lines = R.bank_lines(_feed(spark, sf_dir)).withColumnRenamed("id", "line")
    return R.stable_ids(lines, F.lit("t1"), F.col("account").cast("string"), [F.col("line")]).select("line", "id")


def _ubl(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc(spark, sf_dir)
    lines = doc_line(spark, sf_dir)
    tag = lambda name, x: F.concat(F.lit(f"<cbc:{name}>"), x.cast("string"), F.lit(f"</cbc:{name}>"))
    item = F.concat(F.lit("<cac:InvoiceLine>"), tag("ID", F.col("line")), tag("InvoicedQuantity", F.col("qty")), tag("LineExtensionAmount", F.col("net")), F.lit("<cac:Item><cbc:Name>Part "), F.col("product"), F.lit("</cbc:Name></cac:Item></cac:InvoiceLine>"))
    body = lines.groupBy(F.col("doc").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "supplier", "product", item.alias("x")))), lambda s: s["x"]), "").alias("lines"), F.sum("net").cast(MONEY).alias("net"))
    parts = [
        F.lit('<?xml version="1.0"?><Invoice xmlns="urn:i" xmlns:cbc="urn:b" xmlns:cac="urn:a">'),
        tag("ID", F.concat(F.lit("FT "), "id")),
        tag("IssueDate", F.col("issue_date")),
        tag("DocumentCurrencyCode", F.lit("EUR")),
        F.lit("<cac:AccountingSupplierParty><cac:Party><cac:PartyName><cbc:Name>Party "),
        F.col("party").cast("string"),
        F.lit("</cbc:Name></cac:PartyName></cac:Party></cac:AccountingSupplierParty><cac:LegalMonetaryTotal>"),
        tag("TaxExclusiveAmount", F.col("net")),
        tag("TaxInclusiveAmount", F.col("gross")),
        F.lit("</cac:LegalMonetaryTotal>"),
        F.col("lines"),
        F.lit("</Invoice>"),
    ]
    xml = F.when(F.col("id") % 50 == 7, F.lit("<!DOCTYPE x><Invoice/>")).otherwise(F.concat(*parts))
    return d.join(body, "id").select("id", xml.alias("xml"))


@query(
    with_ctes(DOC, DOC_LINE)
    + """
, n AS (SELECT doc, CAST(sum(net) AS DECIMAL(18,2)) AS net FROM doc_line GROUP BY doc)
SELECT id, CASE WHEN bad THEN 'document_type' END AS problem, CASE WHEN NOT bad THEN 'invoice' END AS doc_type, CASE WHEN NOT bad THEN 'FT ' || id END AS invoice_number, CASE WHEN NOT bad THEN issue_date END AS issue_date,
       CASE WHEN NOT bad THEN 'EUR' END AS currency, CASE WHEN NOT bad THEN 'Party ' || party END AS supplier_name, CASE WHEN NOT bad THEN net END AS net_amount, CASE WHEN NOT bad THEN gross END AS gross_amount
FROM (SELECT doc.*, n.net, id % 50 = 7 AS bad FROM doc JOIN n ON doc.id = n.doc)"""
)
def einvoice_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The critical fields of electronic invoices; one with a document type is refused with its reason."""
    return R.einvoice_fields(_ubl(spark, sf_dir), "xml").select("id", "problem", "doc_type", "invoice_number", "issue_date", "currency", "supplier_name", "net_amount", "gross_amount")


@query(
    with_ctes(DOC, DOC_LINE)
    + """
SELECT doc AS id, row_number() OVER (PARTITION BY doc ORDER BY line, supplier, product, CAST(qty AS VARCHAR), CAST(net AS VARCHAR)) AS line, CAST(line AS VARCHAR) AS line_id, 'Part ' || product AS description, CAST(qty AS DECIMAL(18,3)) AS quantity, net
FROM doc_line WHERE doc % 50 <> 7"""
)
def einvoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of electronic invoices."""
    return R.einvoice_lines(_ubl(spark, sf_dir), "xml", ["id"]).select("id", "line", "line_id", "description", "quantity", "net")


@query(
    with_ctes(TX)
    + """
, l AS (SELECT account, booked_on, CAST(abs(amount) AS DECIMAL(18,2)) AS sales, CAST(round(abs(amount) * CAST(0.02 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS fees, id % 40 = 0 AS off FROM tx)
SELECT CAST(account AS VARCHAR) AS payout_id, max(booked_on) AS payout_date, count(*) AS n_lines, CAST(sum(sales) AS DECIMAL(28,2)) AS sales, CAST(sum(fees) AS DECIMAL(28,2)) AS fees, CAST(sum(sales - fees) AS DECIMAL(28,2)) AS net, bool_and(NOT off) AS adds_up
FROM l GROUP BY account"""
)
def settlement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payout report written as a delimited file with headers of its own, read by aliases, and summed for each payout."""
    t = tx(spark, sf_dir)
    gross = F.abs("amount").cast(MONEY)
    fee = F.round(gross * F.lit("0.02").cast("decimal(3,2)"), 2).cast(MONEY)
    stated = (gross - fee + F.when(F.col("id") % 40 == 0, F.lit("0.05")).otherwise(F.lit("0.00")).cast("decimal(4,2)")).cast(MONEY)
    comma = lambda x: F.replace(x.cast("string"), F.lit("."), F.lit(","))
    path = scratch_path(spark, "settlement-csv")
    out = t.select(F.date_format("booked_on", "dd/MM/yyyy").alias("Settlement Date"), F.col("id").alias("Transaction ID"), comma(gross).alias("Gross amount"), comma(-fee).alias("Fee"), comma(stated).alias("Net"), F.col("account").alias("Payout ID"))
    out.write.csv(path, header=True, sep=";")
    lines = R.settlement_lines(R.read_csv(spark, path, R.SETTLEMENT_ALIASES))
    return R.settlement_reports(lines).select("payout_id", "payout_date", "n_lines", "sales", "fees", "net", "adds_up")


@query(
    with_ctes(DOC)
    + """
SELECT id, CASE WHEN id % 3 = 0 THEN CAST(party AS VARCHAR) END AS buyer, CASE WHEN id % 3 = 0 THEN gross END AS total, CASE WHEN id % 3 = 1 THEN 'PT50' || id END AS iban, CASE WHEN id % 3 = 1 THEN gross END AS to_pay FROM doc"""
)
def qr_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal and payment QR payloads, by the first handler that reads them."""
    k, g = F.col("id") % 3, F.col("gross").cast("string")
    fiscal = F.concat(F.lit("A:123456789*B:"), F.col("party"), F.lit("*C:PT*D:FT*O:"), g, F.lit("*Q:abcd"))
    epc = F.concat(F.lit("BCD\n002\n1\nSCT\nBICPTPL\nParty\nPT50"), F.col("id"), F.lit("\nEUR"), g, F.lit("\n\nref\ntext"))
    rows = doc(spark, sf_dir).select("id", F.when(k == 0, fiscal).when(k == 1, epc).otherwise("hello").alias("q"))
    told = rows.select("id", R.qr_fields(F.col("q")).alias("m"), R.epc_fields(F.col("q")).alias("e"))
    return told.select("id", F.col("m")["B"].alias("buyer"), F.col("m")["O"].cast(MONEY).alias("total"), "e.iban", F.col("e.amount").alias("to_pay"))


@query(
    with_ctes(DOC)
    + """
SELECT id, CASE id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/zip' WHEN 2 THEN 'application/json' WHEN 3 THEN 'text/csv' ELSE 'application/octet-stream' END AS type, id % 2 = 0 AS intact FROM doc"""
)
def sniffed_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of uploads by their bytes, then as declared, then by name; and whether they came as sent."""
    k = F.col("id") % 5
    body = F.when(k == 0, F.concat(F.lit("%PDF-1.7 "), "id")).when(k == 1, F.concat(F.lit("PK\x03\x04"), "id")).when(k == 2, F.concat(F.lit(' {"a": '), "id", F.lit("}"))).otherwise(F.concat(F.lit("x"), "id"))
    rows = doc(spark, sf_dir).select("id", F.encode(body, "UTF-8").alias("content"), F.when(k == 3, "text/csv; charset=x").alias("declared"), F.lit("file").alias("name"))
    claimed = F.when(F.col("id") % 2 == 0, F.upper(F.sha2("content", 256))).otherwise(F.lit("00"))
    return rows.select("id", R.sniffed_type(F.col("content"), F.col("declared"), F.col("name")).alias("type"), R.intact(F.col("content"), claimed).alias("intact"))


@query(
    with_ctes(DOC)
    + """
SELECT id, kind, number, total, currency, seller, day FROM (SELECT id, 'Invoice' AS kind, 'FT' || id AS number, gross AS total, 'EUR' AS currency, 'Party ' || party AS seller, issue_date AS day FROM doc WHERE id % 2 = 0)"""
)
def structured_page_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices that pages state as JSON-LD; other bodies and plain pages give nothing."""
    d = doc(spark, sf_dir)
    ld = F.to_json(F.struct(F.lit("Invoice").alias("@type"), F.concat(F.lit("FT"), "id").alias("confirmationNumber"), F.struct(F.col("gross").cast("string").alias("price"), F.lit("EUR").alias("priceCurrency")).alias("totalPaymentDue"), F.struct(F.concat(F.lit("Party "), "party").alias("name")).alias("provider"), F.col("issue_date").cast("string").alias("paymentDueDate")))
    ld = F.when(F.col("id") % 2 == 0, ld).otherwise(F.lit('{"@type": "Article"}'))
    page = F.concat(F.lit('<html><head><script type="application/ld+json">'), ld, F.lit("</script></head><body>hello</body></html>"))
    return T.structured_invoices(d.select("id", page.alias("html")), ["id"])


@query(with_ctes(DOC) + "\nSELECT id, 'FT ' || year(issue_date) || '/' || id AS number, '/pdf/' || id AS href, 'FT ' || year(issue_date) || '/' || id AS label FROM doc")
def listed_page_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoices that a supplier's list page links to; other links give nothing."""
    name = F.concat(F.lit("FT "), F.year("issue_date"), F.lit("/"), "id")
    page = F.concat(F.lit("<table><tr><td><a href='/help'>Help</a></td><td><a href='/pdf/"), "id", F.lit("'> "), name, F.lit(" </a></td></tr></table>"))
    return T.listed_invoices(doc(spark, sf_dir).select("id", page.alias("html")), ["id"])


@query(
    with_ctes(DOC)
    + """
SELECT id, 'FT ' || id AS number, CAST(gross AS VARCHAR) AS total, CAST(CASE WHEN id % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_numbers FROM doc"""
)
def labelled_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values behind labels in text pages; of several the first one counts."""
    text = F.concat(F.lit("Dear customer\n Invoice No : FT "), "id", F.lit("\r\nTOTAL: "), "gross", F.when(F.col("id") % 4 == 0, F.lit("\nInvoice no: other")).otherwise(F.lit("")))
    found = T.labelled_fields(doc(spark, sf_dir).select("id", text.alias("text")), ["id"], "text", {"number": ["invoice no"], "total": ["total"]})
    wide = found.groupBy("id").pivot("field", ["number", "total"]).agg(F.first("value").alias("v"), F.first("n").alias("n"))
    return wide.select("id", F.col("number_v").alias("number"), F.col("total_v").alias("total"), F.col("number_n").cast("bigint").alias("n_numbers"))


@query(
    with_ctes(DOC_LINE)
    + """
SELECT doc AS id, 'Part ' || product AS description, CAST(qty AS DECIMAL(18,3)) AS quantity, CAST(2.50 AS DECIMAL(18,2)) AS unit_price, CAST(qty * 2.50 AS DECIMAL(18,2)) AS total FROM doc_line WHERE line % 3 <> 0 AND qty * 2.5 < 1000"""
)
def invoice_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an invoice's text, kept only where quantity times price is the total."""
    total = (F.col("qty") * F.lit("2.50").cast("decimal(4,2)") + F.when(F.col("line") % 3 == 0, 1).otherwise(0)).cast(MONEY)
    text = F.concat(F.lit("Description Qty Price Total\nPart "), "product", F.lit("  "), "qty", F.lit("  2.50  "), total)
    rows = doc_line(spark, sf_dir).where(F.col("qty") * 2.5 < 1000).select(F.col("doc").alias("id"), text.alias("text"))
    return T.text_lines(rows, ["id"], "text").drop("line")


@query(
    with_ctes(DOC)
    + """
SELECT id, issue_date AS "on", 'factura' AS kind, 'FT' || id AS number, gross AS debit, CAST(0 AS DECIMAL(18,2)) AS credit, gross AS balance FROM doc
UNION ALL SELECT id, issue_date + 1, 'pagamento', 'RC' || id, 0, gross, 0 FROM doc"""
)
def supplier_statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of suppliers' account statements."""
    g, day = F.translate(F.format_number("gross", 2), ",.", ".,"), lambda d: F.date_format(d, "dd/MM/yyyy")
    text = F.concat(F.lit("Extracto de conta\n"), day("issue_date"), F.lit(" Factura FT"), "id", F.lit(" "), g, F.lit(" - "), g, F.lit("\n"), day(F.date_add("issue_date", 1)), F.lit(" Pagamento RC"), "id", F.lit(" - "), g, F.lit(" 0,00\nTotal"))
    return T.statement_lines(doc(spark, sf_dir).select("id", text.alias("text")), ["id"], "text").drop("row")


@query(with_ctes(DOC) + "\nSELECT id, issue_date AS day, CAST(10.50 AS DECIMAL(18,2)) AS cash, gross AS card, CAST(gross + 10.50 + CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS total, id % 9 <> 0 AS adds_up FROM doc")
def till_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily till reports, with whether cash and card are the total."""
    total = (F.col("gross") + F.lit("10.50").cast("decimal(4,2)") + F.when(F.col("id") % 9 == 0, 1).otherwise(0)).cast(MONEY)
    text = F.concat(F.lit("RELATÓRIO Z\nData: "), F.date_format("issue_date", "dd/MM/yyyy"), F.lit("\nDinheiro: 10,50\nMultibanco: "), F.replace(F.col("gross").cast("string"), F.lit("."), F.lit(",")), F.lit("\nTotal: "), total)
    return T.till_days(doc(spark, sf_dir).select("id", text.alias("text")), ["id"], "text")


@query("SELECT c_custkey AS id, c_name AS person, '2024-03' AS month, CAST(c_custkey + 1000 AS DECIMAL(18,2)) AS net, CAST(c_custkey + 1400 AS DECIMAL(18,2)) AS gross FROM customer WHERE c_custkey % 6 <> 0")
def payslip_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, month and pay of payslips; texts that lack one of them give nothing."""
    c = F.col("c_custkey")
    text = F.concat(F.lit("RECIBO\nNome: "), "c_name", F.lit("\nPeríodo: 03/2024\nIlíquido: "), c + 1400, F.lit(",00\n"), F.when(c % 6 != 0, F.concat(F.lit("Líquido: "), c + 1000, F.lit(",00"))).otherwise(F.lit("")))
    return T.payslips(table(spark, sf_dir, "customer").select(c.alias("id"), text.alias("text")), ["id"], "text")


@query(
    with_ctes(DOC)
    + """
SELECT id, CAST(n + 1 AS BIGINT) AS instalment, CAST(issue_date + to_months(CAST(n AS INTEGER)) AS DATE) AS due_on, gross AS amount FROM doc, range(12) r(n) WHERE id % 20 = 0"""
)
def lease_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instalments of leases: one for each month of the term."""
    leases = doc(spark, sf_dir).where("id % 20 = 0").select("id", F.col("issue_date").alias("start"), F.lit(12).alias("months"), F.col("gross").alias("rent"))
    return T.lease_plan(leases, ["id"])


@query(
    with_ctes(DOC)
    + """
SELECT id, CASE WHEN id % 3 = 2 THEN 'social_security' ELSE 'tax_office' END AS issuer, id % 3 = 2 AS confirmed, CASE WHEN id % 3 = 0 THEN issue_date END AS due_on, gross AS amount FROM doc"""
)
def obligation_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that ask for a payment or confirm one: issuer, day due and amount."""
    k = F.col("id") % 3
    asked = F.concat(F.lit("Autoridade Tributária: pague até "), F.date_format("issue_date", "d/M/yyyy"), F.lit(" o valor de "), "gross", F.lit(" EUR"))
    text = F.when(k == 0, asked).when(k == 1, F.concat(F.lit("Autoridade Tributária, em dívida "), "gross", F.lit(" €"))).otherwise(F.concat(F.lit("Segurança Social: pagamento recebido de "), "gross", F.lit(" EUR")))
    return T.obligations(doc(spark, sf_dir).select("id", text.alias("text")), ["id"], "text", {"tax_office": ["autoridade tributaria"], "social_security": ["seguranca social"]})


@query(
    with_ctes(TX)
    + """
SELECT id, '{"amount":"' || amount || '","booked_on":"' || booked_on || '","kind":' || CASE WHEN id % 4 = 0 THEN 'null' ELSE '"' || kind || '"' END || '}' AS json FROM tx"""
)
def canonical_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as canonical JSON: sorted keys, decimals as text, ISO dates, nulls kept."""
    rows = tx(spark, sf_dir).withColumn("kind", F.when(F.col("id") % 4 != 0, F.col("kind")))
    return rows.select("id", canonical_json("kind", "amount", "booked_on").alias("json"))


@query("SELECT count(*)::BIGINT AS files, sum(strlen(html))::BIGINT AS bytes FROM pages WHERE html IS NOT NULL")
def package_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files and bytes of a package's manifest, whose digest doesn't depend on the order of its lines."""
    p = table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.concat(F.lit("page-"), F.col("page_id") % 10).alias("name"), F.encode("html", "UTF-8").alias("content"))
    return package_hash(manifest(p, "name", "content")).select("files", "bytes")


@query(
    """
SELECT CAST(ts AS DATE) AS day, count(*) AS lines, sum(CAST(value AS DECIMAL(18,2)))::DECIMAL(28,2) AS amount,
       CAST(ts AS DATE) > DATE '2024-01-05' OR event_id % 97 = 0 AND CAST(ts AS DATE) > DATE '2023-12-31' AS in_second_run
FROM events GROUP BY ALL"""
)
def bank_feed_synced(spark: SparkSession, sf: str) -> DataFrame:
    """Two syncs of a growing folder of the events: what the second run brings, late lines and repeats included, counts once.

    The first run sees the days up to 5 January less some late lines; the second one a folder with the rest, those late
    lines and the last days once more.
    """
    from datetime import date

    from provena.sources import feeds
    from provena.storage import scratch_path, write_table

    day = F.to_date("ts")
    lines = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("line_id"), F.col("user_id").cast("string").alias("account"), day.cast("string").alias("booked_on"), F.col("value").cast("decimal(18,2)").cast("string").alias("amount"), F.col("props").alias("text"), day.cast("string").alias("day"), (F.col("event_id") % 97 == 0).alias("late"))
    folder, cut = scratch_path(spark, "feed"), "2024-01-05"
    land = lambda rows: rows.drop("late").write.mode("append").partitionBy("day").json(folder)
    land(lines.where((F.col("day") <= cut) & ~F.col("late")))
    first = write_table(feeds.sync(spark, folder, None, None), "synced")
    land(lines.where((F.col("day") > cut) | F.col("late")))
    land(lines.where(F.col("day").between("2024-01-03", cut)))
    cursor = first.agg(F.max("booked_on")).first()[0] or date(2024, 1, 1)
    second = write_table(feeds.sync(spark, folder, first, cursor), "synced")
    both = first.withColumn("in_second_run", F.lit(False)).unionByName(second.withColumn("in_second_run", F.lit(True)))
    return both.groupBy(F.col("booked_on").alias("day"), "in_second_run").agg(F.count("*").alias("lines"), F.sum("amount").cast("decimal(28,2)").alias("amount"))


@query(
    """
WITH l AS (SELECT user_id AS tenant, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
c AS (SELECT tenant, max(seq) AS seen FROM l WHERE ts < TIMESTAMP '2024-01-10 00:00:00' GROUP BY tenant)
SELECT l.tenant, count(*) AS n, min(l.seq) AS first_seq, max(l.seq) AS last_seq, count(DISTINCT event_type) AS kinds
FROM l LEFT JOIN c ON l.tenant = c.tenant WHERE l.seq > coalesce(c.seen, 0) GROUP BY l.tenant"""
)
def events_after_cursor(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events behind the last one seen before 10 January."""
    from pyspark.sql import Window as W

    from provena.sources.feeds import scan_after

    log = table(spark, sf, "events").select(F.col("user_id").alias("tenant"), "event_type", "ts", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))
    seen = log.where("ts < TIMESTAMP_NTZ '2024-01-10 00:00:00'").groupBy("tenant").agg(F.max("seq").alias("seen"))
    return scan_after(log, seen).groupBy("tenant").agg(F.count("*").alias("n"), F.min("seq").cast("bigint").alias("first_seq"), F.max("seq").cast("bigint").alias("last_seq"), F.count_distinct("event_type").alias("kinds"))


@query(
    """
WITH RECURSIVE
c AS (SELECT '21.' || n_regionkey || '.' || n_nationkey || '.' || c_custkey AS account, '21.' || n_regionkey || '.' || n_nationkey AS parent, c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS opening
      FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT c.account, CAST(o_totalprice AS DECIMAL(18,2)) AS debit, 0::DECIMAL(18,2) AS credit FROM orders JOIN c ON o_custkey = c_custkey
      UNION ALL
      SELECT '71.' || o_orderpriority, 0, CAST(o_totalprice AS DECIMAL(18,2)) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
a AS (SELECT account, parent, opening FROM c
      UNION ALL SELECT '71.' || o_orderpriority, '71', 0 FROM (SELECT DISTINCT o_orderpriority FROM orders)
      UNION ALL SELECT '71', NULL, 0
      UNION ALL SELECT '21', NULL, 0
      UNION ALL SELECT '21.' || r_regionkey, '21', 0 FROM region
      UNION ALL SELECT '21.' || n_regionkey || '.' || n_nationkey, '21.' || n_regionkey, 0 FROM nation),
t(account, ancestor) AS (SELECT account, account FROM a UNION ALL SELECT t.account, a.parent FROM t JOIN a ON t.ancestor = a.account WHERE a.parent IS NOT NULL),
m AS (SELECT account, sum(debit) AS debit, sum(credit) AS credit FROM p GROUP BY account)
SELECT t.ancestor AS account, count(*) AS accounts, sum(a.opening)::DECIMAL(28,2) AS opening, sum(coalesce(m.debit, 0))::DECIMAL(28,2) AS debit, sum(coalesce(m.credit, 0))::DECIMAL(28,2) AS credit,
       (sum(a.opening) + sum(coalesce(m.debit, 0)) - sum(coalesce(m.credit, 0)))::DECIMAL(28,2) AS closing,
       (sum(a.opening) + sum(coalesce(m.debit, 0)) - sum(coalesce(m.credit, 0)))::DECIMAL(28,2) AS stated, true AS agrees
FROM t JOIN a ON t.account = a.account LEFT JOIN m ON t.account = m.account GROUP BY t.ancestor"""
)
def ledger_trial_balance(spark: SparkSession, sf: str) -> DataFrame:
    """customers' and sales accounts with all orders as postings, written as an audit file's XML, read back by row tag and rolled up."""
    from functools import reduce

    from provena.plans.bind import money
    from provena.sources import audit_ledgers as A
    from provena.storage import scratch_path, write_table

    text = lambda *parts: F.concat_ws(".", *[F.lit(x) if x.isdigit() else F.col(x) for x in parts])
    nation, orders = table(spark, sf, "nation"), table(spark, sf, "orders")
    customers = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    customers = customers.select("c_custkey", text("21", "n_regionkey", "n_nationkey", "c_custkey").alias("account"), text("21", "n_regionkey", "n_nationkey").alias("parent"), money("c_acctbal").alias("opening"))
    sales = orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), "account"), "o_custkey").select(F.concat(F.lit("T"), "o_orderkey").alias("transaction"), F.to_date("o_orderdate").alias("day"), F.month("o_orderdate").alias("period"), "account", text("71", "o_orderpriority").alias("income"), money("o_totalprice").alias("total"))
    zero = F.lit(0).cast("decimal(18,2)")
    head = ["transaction", "day", "period"]
    postings = sales.select(*head, "account", F.col("total").alias("debit"), zero.alias("credit")).unionByName(sales.select(*head, F.col("income").alias("account"), zero.alias("debit"), F.col("total").alias("credit")))
    # accounts above these hold nothing themselves
    empty = [nation.select(text("21", "n_regionkey", "n_nationkey").alias("account"), text("21", "n_regionkey").alias("parent")), table(spark, sf, "region").select(text("21", "r_regionkey").alias("account"), F.lit("21").alias("parent")), orders.select(text("71", "o_orderpriority").alias("account"), F.lit("71").alias("parent")).distinct(), spark.createDataFrame([("21", None), ("71", None)], "account string, parent string")]
    chart = reduce(DataFrame.unionByName, [customers.select("account", "parent", "opening"), *[e.withColumn("opening", zero) for e in empty]])
    moved = postings.groupBy("account").agg((F.sum("debit") - F.sum("credit")).cast("decimal(28,2)").alias("net"))
    chart = chart.join(moved, "account", "left").select("account", F.concat(F.lit("Account "), "account").alias("description"), "parent", F.lit("GM").alias("category"), "opening", (F.col("opening") + F.coalesce("net", zero)).cast("decimal(28,2)").alias("closing"))
    folder = scratch_path(spark, "ledgers")
    A.write_ledgers(chart, postings, folder)
    accounts = write_table(A.read_accounts(spark, f"{folder}/accounts"), "accounts")
    return A.trial_balance(accounts, A.read_journal(spark, f"{folder}/journal"))
