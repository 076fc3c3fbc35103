"""Filters and predicates (C01-C16) and ordered lists."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.functions.text import contains_all


def search_documents(docs: DataFrame, words: list[str], text_col: str = "text", *, since: date | None = None, until: date | None = None, day_col: str | None = None) -> DataFrame:
    """Documents whose folded text contains every word, optionally within days. A null text matches nothing."""
    out = docs.where(F.coalesce(contains_all(text_col, words), F.lit(False)))
    if day_col and since:
        out = out.where(F.col(day_col) >= F.lit(since))
    if day_col and until:
        out = out.where(F.col(day_col) <= F.lit(until))
    return out


def select_ledger(lines: DataFrame, *, start: date | None = None, end: date | None = None, parties: list | None = None, categories: list | None = None, amount=None, within: str = "0.005", day_col: str = "issue_date", amount_col: str = "gross") -> DataFrame:
    """Ledger lines by days (inclusive), parties, categories and an amount give or take half a cent."""
    out = lines
    if start is not None:
        out = out.where(F.col(day_col) >= F.lit(start))
    if end is not None:
        out = out.where(F.col(day_col) <= F.lit(end))
    if parties:
        out = out.where(F.col("party").isin(parties))
    if categories:
        out = out.where(F.col("category").isin(categories))
    if amount is not None:
        out = out.where(F.abs(F.abs(F.col(amount_col)) - F.lit(amount).cast("decimal(18,2)")) <= F.lit(within).cast("decimal(5,3)"))
    return out


def without_evidence(payments: DataFrame, evidence: DataFrame, on) -> DataFrame:
    """Rows that no evidence answers."""
    return payments.join(evidence, on, "left_anti")


def due_soon(obligations: DataFrame, today: Column, within_days: int = 14, due_col: str = "due_on") -> DataFrame:
    """What is late or due within some days, with ``days_left`` and ``late``; late first by day, then id."""
    left = F.datediff(F.col(due_col), today)
    return obligations.where(left <= within_days).withColumns({"days_left": left.cast("bigint"), "late": left < 0})


def open_at(obligations: DataFrame, month_end: Column, due_col: str = "due_on", proof_col: str = "evidence") -> DataFrame:
    """Unsatisfied obligations that are due by the end of a month."""
    return obligations.where((F.coalesce(F.size(proof_col), F.lit(0)) <= 0) & (F.col(due_col) <= F.last_day(month_end)))


def rule_matches(rule: dict[str, Column], subject: dict[str, Column], amount: Column | None = None, low: Column | None = None, high: Column | None = None) -> Column:
    """All criteria that a rule sets are met; criteria left null are not asked. The range is on the absolute amount."""
    out = F.lit(True)
    for k, want in rule.items():
        out = out & (want.isNull() | want.eqNullSafe(subject[k]))
    if amount is not None and low is not None:
        out = out & (low.isNull() | (F.abs(amount) >= low))
    if amount is not None and high is not None:
        out = out & (high.isNull() | (F.abs(amount) <= high))
    return F.coalesce(out, F.lit(False))


def pattern_fits(day: Column, amount: Column, usual_day: Column, usual_amount: Column, *, ratio: float = 0.1, days: int = 4) -> Column:
    """The amount is within a ratio of the usual one and the day of the month is near, round the month."""
    d = F.abs(F.dayofmonth(day) - usual_day)
    return (F.abs(amount - usual_amount) <= F.abs(usual_amount) * F.lit(ratio)) & (F.least(d, 31 - d) <= days)


def period_covered(coverage_end: Column, gaps: Column, start: Column, end: Column, settle_days: int) -> Column:
    """Reading reached the period's end plus the settle time, and no known gap (start, end) overlaps it."""
    overlap = F.exists(gaps, lambda g: (g["start"] < end) & (start < g["end"]))
    return F.coalesce((F.date_add(end, settle_days) <= coverage_end) & ~overlap, F.lit(False))


def missing_fields(doc_type: Column, fields: Column, required: dict[str, list[str]], otherwise: list[str]) -> Column:
    """Required fields of a document type that the map of fields lacks or holds as null, in order of name."""
    want = F.coalesce(*[F.when(doc_type == t, F.array(*[F.lit(x) for x in sorted(r)])) for t, r in sorted(required.items())], F.array(*[F.lit(x) for x in sorted(otherwise)]))
    return F.filter(want, lambda f: F.element_at(fields, f).isNull())


def high_value(gross: Column, line_net: Column, *, high: str = "5000.00", asset: str = "1000.00") -> tuple[Column, Column]:
    """(worth a second look, may be a capital asset)."""
    return F.abs(gross) >= F.lit(high).cast("decimal(18,2)"), F.abs(line_net) >= F.lit(asset).cast("decimal(18,2)")


def source_of(payments: DataFrame, cards: DataFrame, accounts: DataFrame) -> DataFrame:
    """Where a payment came from: the card by its last four digits, else the account.

    ``cards`` (card_last4, card_source) with one row for each number in use; a number of several cards decides
    nothing. Adds ``source``.
    """
    sure = cards.groupBy("card_last4").agg(F.min("card_source").alias("card_source"), F.count_distinct("card_source").alias("n")).where("n = 1").drop("n")
    return payments.join(sure, "card_last4", "left").join(accounts, "account_id", "left").withColumn("source", F.coalesce("card_source", "account_source")).drop("card_source", "account_source")


def visible_to(rows: DataFrame, tenant: str, companies: list[str] | None = None, *, tenant_col: str = "tenant_id", company_col: str = "company_id") -> DataFrame:
    """C14: rows of one tenant, and of the companies that a principal may see; shared rows have a null company."""
    out = rows.where(F.col(tenant_col) == tenant)
    return out if companies is None else out.where(F.col(company_col).isNull() | F.col(company_col).isin(companies))


def scrub(rows: DataFrame, sensitive: DataFrame, id_col: str, columns: list[str], summary: str) -> DataFrame:
    """The named columns of sensitive rows show only a summary."""
    flagged = rows.join(sensitive.select(F.col(id_col), F.lit(True).alias("__sensitive")).distinct(), id_col, "left")
    return flagged.withColumns({c: F.when(F.col("__sensitive"), F.lit(summary)).otherwise(F.col(c)) for c in columns}).drop("__sensitive")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in a total order."""
    ranked = rows.withColumn(rank_col, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("bigint"))
    return ranked.where(F.col(rank_col) <= n)
