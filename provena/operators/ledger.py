"""The ledger's sources beside the bank (H01): each as lines of one schema, by what its own record proves.

Lines are (line, on, amount, direction, currency, company, kind, category, pending, paid_in_cash, evidence). What a source's
record doesn't prove makes no line, so nothing counts twice: a cash purchase has no bank line, a till's card part comes
with the card payouts, an employee's receipt is their claim, a payout whose report settles it is its sales and fees.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = ("line", "on", "amount", "direction", "currency", "company", "kind", "category", "pending", "paid_in_cash", "evidence")


def _lines(rows: DataFrame, **columns: Column) -> DataFrame:
    c = {"currency": F.col("currency"), "company": F.col("company"), "category": F.lit("other"), "pending": F.lit(False), "paid_in_cash": F.lit(False), "evidence": F.col("document").cast("string")} | columns
    return rows.select(*[(c[n].cast("decimal(18,2)") if n == "amount" else c[n]).alias(n) for n in LINE])


def cash_purchases(documents: DataFrame, claimed: DataFrame, matched: DataFrame) -> DataFrame:
    """Documents (document, on, gross, currency, company, stage, paid_in_cash) paid in cash, with the receipt as their only evidence.

    Closed ones with a company count; ones that wait for the owner are pending, without a company. Documents of a
    claim (``claimed``: document) and those with a payment (``matched``: document) are those sources' lines.
    """
    own = documents.where("paid_in_cash AND gross IS NOT NULL").join(claimed.select("document").unionByName(matched.select("document")).distinct(), "document", "left_anti")
    waits = F.col("stage") == "needs_owner"
    kept = own.where(waits | (F.col("stage") == "closed") & F.col("company").isNotNull())
    return _lines(kept, line=F.col("document").cast("string"), on=F.col("on"), amount=F.abs("gross"), direction=F.lit("out"), company=F.when(~waits, F.col("company")), kind=F.lit("cost"), pending=waits, paid_in_cash=F.lit(True))


def expense_claims(claims: DataFrame) -> DataFrame:
    """Claims (claim, document, on, amount, currency, company, status): a cost once approved or paid, waiting before, none if declined."""
    kept = claims.where(F.col("status").isin("waiting", "approved", "paid"))
    return _lines(kept, line=F.concat(F.lit("claim:"), "claim"), on=F.col("on"), amount=F.col("amount"), direction=F.lit("out"), kind=F.when(F.col("status") == "waiting", "claim_waiting").otherwise("cost"))


def till_cash(days: DataFrame) -> DataFrame:
    """The cash of till days (document, on, cash, currency, company, usable); days that can't be used or took none make no line."""
    return _lines(days.where("usable AND cash <> 0"), line=F.concat(F.col("document").cast("string"), F.lit(":cash")), on=F.col("on"), amount=F.col("cash"), direction=F.lit("in"), kind=F.lit("till_cash"), category=F.lit("sales"), paid_in_cash=F.lit(True))


def desk_receipts(receipts: DataFrame) -> DataFrame:
    """Members' receipts (document, on, amount, company, cash, status) paid in cash at the desk, for which the bank has no line."""
    kept = receipts.where("cash AND status = 'paid' AND company IS NOT NULL")
    return _lines(kept, line=F.concat(F.lit("desk:"), F.col("document").cast("string")), on=F.col("on"), amount=F.col("amount"), direction=F.lit("in"), currency=F.lit("EUR"), kind=F.lit("income"), category=F.lit("income"), paid_in_cash=F.lit(True))


def settled_payouts(payouts: DataFrame, reports: DataFrame) -> DataFrame:
    """Payouts (line, on, company, pending) whose report (line, document, currency, gross_sales, fees, settled) proves them: sales in, fees out."""
    both = payouts.select("line", "on", "company", "pending").join(reports.where("settled"), "line")
    part = lambda name, amount, way, kind: _lines(both.where(F.col(amount) > 0), line=F.concat("line", F.lit(f":{name}")), on=F.col("on"), amount=F.col(amount), direction=F.lit(way), kind=F.lit(kind), category=F.lit(name if name == "sales" else "platform_fees"), pending=F.col("pending"))
    return part("sales", "gross_sales", "in", "sales").unionByName(part("fees", "fees", "out", "platform_fee"))


def whole_ledger(**sources: DataFrame) -> DataFrame:
    """One ledger of all sources' lines, each with its ``source``. A line id that two sources give stays twice: :func:`clashes` finds it."""
    return reduce(DataFrame.unionByName, [rows.select(*LINE).withColumn("source", F.lit(name)) for name, rows in sources.items()])


def clashes(ledger: DataFrame) -> DataFrame:
    """(line, n): line ids that occur more than once; a ledger that counts nothing twice has none."""
    return ledger.groupBy("line").agg(F.count("*").alias("n")).where("n > 1")
