"""Reader of tax-authority audit files (SAF-T, Portugal): headers, customers, sales invoices, control totals.

Spark's own XML source finds the elements, so a file is split over tasks by invoice and never parsed whole into one
row (the control totals excepted, see :func:`audit_controls`). Document types are not read: entities are not expanded.
Everything on an invoice is an expression over its own lines, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: types whose lines stand on the debit side; states that control totals leave out; the format's types
CREDIT_NOTES = ("NC", "RE", "TD", "DA")
NOT_IN_TOTALS = ("A", "F")
KNOWN_TYPES = tuple("FT FR FS NC ND RP RE CS LD RA VD TV TD AA DA RC RG GR GT GA GC GD CM CC FC FO NE OU OR PF DC".split())

MONEY = "decimal(18,2)"
TOLERANCE = "0.01"
INVOICE = (
    "InvoiceNo STRING, ATCUD STRING, InvoiceType STRING, InvoiceDate DATE, CustomerID STRING, DocumentStatus STRUCT<InvoiceStatus: STRING>, "
    "Line ARRAY<STRUCT<DebitAmount: DECIMAL(18,6), CreditAmount: DECIMAL(18,6), Tax: STRUCT<TaxType: STRING, TaxCountryRegion: STRING, TaxCode: STRING, TaxPercentage: DECIMAL(9,4), TaxAmount: DECIMAL(18,2)>>>, "
    "WithholdingTax ARRAY<STRUCT<WithholdingTaxAmount: DECIMAL(18,2)>>, "
    "DocumentTotals STRUCT<TaxPayable: DECIMAL(18,2), NetTotal: DECIMAL(18,2), GrossTotal: DECIMAL(18,2), Currency: STRUCT<CurrencyCode: STRING, CurrencyAmount: DECIMAL(18,2)>>"
)


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).select(F.col("_metadata.file_path").alias("file"), "*")


def audit_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: whose books, for which period, by which software; the currency is EUR where none is named."""
    raw = _elements(spark, path, "Header", "AuditFileVersion STRING, TaxRegistrationNumber STRING, CompanyName STRING, FiscalYear INT, StartDate DATE, EndDate DATE, CurrencyCode STRING, SoftwareCertificateNumber STRING")
    return raw.select(
        "file",
        F.col("AuditFileVersion").alias("version"),
        F.regexp_replace("TaxRegistrationNumber", r"^PT|\s", "").alias("tax_id"),
        F.col("CompanyName").alias("company"),
        F.col("FiscalYear").alias("fiscal_year"),
        F.col("StartDate").alias("start_date"),
        F.col("EndDate").alias("end_date"),
        F.coalesce("CurrencyCode", F.lit("EUR")).alias("currency"),
        F.col("SoftwareCertificateNumber").alias("software"),
    )


def audit_customers(spark: SparkSession, path: str) -> DataFrame:
    """The customers that a file's invoices refer to; of rows with one id in a file the largest counts."""
    raw = _elements(spark, path, "Customer", "CustomerID STRING, CustomerTaxID STRING, CompanyName STRING, BillingAddress STRUCT<Country: STRING>").where("CustomerID IS NOT NULL")
    own = F.struct(F.col("CustomerTaxID").alias("tax_id"), F.col("CompanyName").alias("name"), F.col("BillingAddress.Country").alias("country"))
    return raw.groupBy("file", F.col("CustomerID").alias("customer_id")).agg(F.max(own).alias("c")).select("file", "customer_id", F.col("c.tax_id").alias("customer_tax_id"), F.col("c.name").alias("customer_name"), F.col("c.country").alias("customer_country"))


def audit_controls(spark: SparkSession, path: str) -> DataFrame:
    """What a file says of all its invoices: number of entries, total debit and total credit.

    The totals stand in the element that holds the invoices, so this pass reads a file's whole section as one record.
    """
    raw = _elements(spark, path, "SalesInvoices", "NumberOfEntries LONG, TotalDebit DECIMAL(18,2), TotalCredit DECIMAL(18,2)")
    return raw.select("file", F.col("NumberOfEntries").alias("entries"), F.col("TotalDebit").alias("total_debit"), F.col("TotalCredit").alias("total_credit"))


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0).cast("decimal(38,12)"), lambda a, x: (a + F.coalesce(value(x), F.lit(0))).cast("decimal(38,12)"))


def _cents(x: Column) -> Column:
    return F.round(x, 2).cast(MONEY)


def audit_invoices(spark: SparkSession, path: str) -> DataFrame:
    """One row for each sales invoice, with what its lines add up to and where it contradicts itself.

    Amounts are in the document's own sense: a credit note's lines stand on the debit side and count as positive.
    ``tax_bases`` has one entry for each tax type, region, code and rate. ``lines_vat`` is the VAT that the lines'
    rates imply; stamp duty is a fixed amount, or a rate of the lines rounded for each rate. ``problems`` names
    totals off by more than a cent (and half a cent of VAT for each line, which may be rounded alone), unknown types,
    and a unique code that is malformed or whose sequence is not the document's number.
    """
    raw = _elements(spark, path, "Invoice", INVOICE).withColumn("__sign", F.when(F.col("InvoiceType").isin(*CREDIT_NOTES), -1).otherwise(1))
    lines = F.coalesce("Line", F.expr("array()").cast(raw.schema["Line"].dataType))
    read = raw.withColumn("__l", F.transform(lines, lambda x: F.struct(((F.coalesce(x["CreditAmount"], F.lit(0)) - F.coalesce(x["DebitAmount"], F.lit(0))) * F.col("__sign")).cast("decimal(18,6)").alias("amount"), x["Tax"].alias("tax"))))
    taxed = F.filter("__l", lambda x: x["tax"].isNotNull())
    key = lambda x: F.struct(F.coalesce(x["tax"]["TaxType"], F.lit("")).alias("tax_type"), F.coalesce(x["tax"]["TaxCountryRegion"], F.lit("")).alias("region"), F.coalesce(x["tax"]["TaxCode"], F.lit("")).alias("code"), x["tax"]["TaxPercentage"].alias("rate"))
    of_key = lambda k: F.filter("__t", lambda x: key(x).eqNullSafe(k))
    bases = F.transform(F.array_distinct(F.transform("__t", key)), lambda k: F.struct(k["tax_type"].alias("tax_type"), k["region"].alias("region"), k["code"].alias("code"), k["rate"].alias("rate"), _cents(_sum(of_key(k), lambda x: x["amount"])).alias("base")))
    vat = _sum(F.filter("__t", lambda x: x["tax"]["TaxType"] == "IVA"), lambda x: x["amount"] * x["tax"]["TaxPercentage"] / 100)
    stamped = F.filter("__t", lambda x: x["tax"]["TaxType"] == "IS")
    rated = F.filter(stamped, lambda x: x["tax"]["TaxAmount"].isNull() & (F.coalesce(x["tax"]["TaxPercentage"], F.lit(0)) != 0))
    rates = F.array_distinct(F.transform(rated, lambda x: x["tax"]["TaxPercentage"]))
    by_rate = _sum(F.transform(rates, lambda p: F.round(_sum(F.filter(rated, lambda x: x["tax"]["TaxPercentage"] == p), lambda x: x["amount"]) * p / 100, 2)), lambda x: x)
    stamp = _sum(stamped, lambda x: x["tax"]["TaxAmount"]) + by_rate
    read = read.withColumn("__t", taxed).select(
        "file",
        F.col("InvoiceNo").alias("invoice_no"),
        F.col("ATCUD").alias("unique_code"),
        F.col("InvoiceType").alias("invoice_type"),
        F.col("DocumentStatus.InvoiceStatus").alias("status"),
        F.col("InvoiceDate").alias("invoice_date"),
        F.col("CustomerID").alias("customer_id"),
        F.col("DocumentTotals.NetTotal").alias("net_total"),
        F.col("DocumentTotals.TaxPayable").alias("tax_payable"),
        F.col("DocumentTotals.GrossTotal").alias("gross_total"),
        _cents(stamp).alias("stamp_duty"),
        F.when(F.size("WithholdingTax") > 0, _cents(_sum(F.col("WithholdingTax"), lambda x: x["WithholdingTaxAmount"]))).alias("withholding_total"),
        F.col("DocumentTotals.Currency.CurrencyCode").alias("foreign_currency"),
        F.col("DocumentTotals.Currency.CurrencyAmount").alias("foreign_amount"),
        bases.alias("tax_bases"),
        F.size("__l").cast("long").alias("line_count"),
        _cents(_sum(F.col("__l"), lambda x: x["amount"])).alias("lines_net"),
        _cents(vat).alias("lines_vat"),
        _cents(_sum(lines, lambda x: x["DebitAmount"])).alias("debit"),
        _cents(_sum(lines, lambda x: x["CreditAmount"])).alias("credit"),
    )
    off = lambda a, b: F.abs(a - b) > F.lit(TOLERANCE).cast(MONEY)
    c = F.col
    sequence = F.regexp_extract(F.trim(F.regexp_replace(F.trim("unique_code"), r"(?i)^ATCUD(\s*:\s*|\s+)", "")), r"^[A-Z0-9]{8,}-([0-9]+)$", 1)
    coded = c("unique_code").isNotNull() & (c("unique_code") != "0")
    found = F.array_compact(
        F.array(
            F.when(c("net_total").isNull() | c("tax_payable").isNull() | c("gross_total").isNull(), "totals_missing"),
            F.when(off(c("net_total") + c("tax_payable"), c("gross_total")), "gross_differs"),
            F.when(off(c("lines_net"), c("net_total")), "net_differs_from_lines"),
            F.when(F.abs(c("tax_payable") - c("stamp_duty") - c("lines_vat")) > F.lit("0.01").cast("decimal(18,3)") + F.lit("0.005").cast("decimal(18,3)") * c("line_count"), "tax_differs_from_lines"),
            F.when(~c("invoice_type").isin(*KNOWN_TYPES), "unknown_type"),
            F.when(coded & (sequence == ""), "code_malformed"),
            F.when(coded & (sequence != "") & ~F.regexp_extract("invoice_no", r"/(\d+)$", 1).try_cast("bigint").eqNullSafe(sequence.try_cast("bigint")), "code_of_another_document"),
        )
    )
    return read.withColumn("problems", found).join(audit_customers(spark, path), ["file", "customer_id"], "left")


def audit_file_problems(invoices: DataFrame, controls: DataFrame) -> DataFrame:
    """One row for each file: repeated numbers, and control totals that its invoices don't add up to.

    Cancelled documents and those invoiced elsewhere count as entries, but not in the totals.
    """
    counted = F.when(~F.coalesce(F.col("status").isin(*NOT_IN_TOTALS), F.lit(False)), F.lit(1))
    numbers = invoices.groupBy("file", "invoice_no").agg(F.count("*").alias("n"), F.sum(counted * F.col("debit")).alias("debit"), F.sum(counted * F.col("credit")).alias("credit"))
    found = numbers.groupBy("file").agg(F.sum("n").alias("invoices"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated_numbers"), F.coalesce(F.sum("debit"), F.lit(0)).cast(MONEY).alias("debit"), F.coalesce(F.sum("credit"), F.lit(0)).cast(MONEY).alias("credit"))
    off = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > F.lit(TOLERANCE).cast(MONEY), F.lit(False))
    told = controls.join(found, "file", "full").withColumns({"invoices": F.coalesce("invoices", F.lit(0)), "debit": F.coalesce("debit", F.lit(0).cast(MONEY)), "credit": F.coalesce("credit", F.lit(0).cast(MONEY))})
    return told.select("file", "invoices", F.coalesce("repeated_numbers", F.lit(0)).alias("repeated_numbers"), F.coalesce(F.col("entries") != F.col("invoices"), F.lit(False)).alias("entries_differ"), off("total_debit", "debit").alias("debit_differs"), off("total_credit", "credit").alias("credit_differs"))
