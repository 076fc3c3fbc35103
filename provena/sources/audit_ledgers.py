"""Ledgers of audit files (A24): chart of accounts and journal read element by element, balances rolled up the account tree.

Spark's XML source takes a file of several lines as one piece. The text source doesn't: with an element's end tag as
its line separator it cuts a file anywhere and still gives whole elements, which ``from_xml`` reads. So one large file
spreads over tasks, and a task holds one element. Amounts are exact decimals; an element that is missing or no number
is null. Tags carry no prefix, as the format has none; document types are cut off unread, so no entity is expanded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.storage import write_table

MONEY = "decimal(18,2)"
_SUM = "decimal(28,2)"
#: Elements of the format (fixed names).
ACCOUNT = f"AccountID string, AccountDescription string, OpeningDebitBalance {MONEY}, OpeningCreditBalance {MONEY}, ClosingDebitBalance {MONEY}, ClosingCreditBalance {MONEY}, GroupingCategory string, GroupingCode string"
_LINE = "struct<RecordID: string, AccountID: string, SourceDocumentID: string, Description: string, {}: decimal(18,2)>"
TRANSACTION = f"TransactionID string, Period int, TransactionDate date, SourceID string, Description string, Lines struct<DebitLine: array<{_LINE.format('DebitAmount')}>, CreditLine: array<{_LINE.format('CreditAmount')}>>"
#: How ledgers are written: XML packs to a small part of its size; a packed file isn't cut, so its elements are limited.
PACKED = {"compression": "gzip", "maxRecordsPerFile": 200_000}
#: Deeper charts are taken for cyclic.
MOST_LEVELS = 32


def elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of one tag in all files of a path, as rows of ``schema``; text outside of them is skipped."""
    raw = spark.read.option("lineSep", f"</{tag}>").text(path)
    own = F.regexp_extract("value", rf"(?s)<{tag}(?=[\s>]).*$", 0)
    whole = raw.select(own.alias("x")).where("x <> ''")
    return whole.select(F.from_xml(F.concat("x", F.lit(f"</{tag}>")), schema, {"rowTag": tag}).alias("e")).where("e IS NOT NULL").select("e.*")


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """(account, description, parent, category, opening, closing): balances are debit less credit."""
    rows = elements(spark, path, "Account", ACCOUNT)
    net = lambda a, b: (F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))).cast(_SUM)
    return rows.where("AccountID IS NOT NULL").select(
        F.col("AccountID").alias("account"),
        F.col("AccountDescription").alias("description"),
        F.col("GroupingCode").alias("parent"),
        F.col("GroupingCategory").alias("category"),
        net(F.col("OpeningDebitBalance"), F.col("OpeningCreditBalance")).alias("opening"),
        net(F.col("ClosingDebitBalance"), F.col("ClosingCreditBalance")).alias("closing"),
    )


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """(transaction, day, period, record, account, document, debit, credit): a row for each line of a posting."""
    rows = elements(spark, path, "Transaction", TRANSACTION)

    def side(name: str, amount: str):
        zero = F.lit(0).cast(MONEY)
        value = lambda x: F.coalesce(x[amount], zero)
        debit = name == "DebitLine"
        return F.transform(F.coalesce(F.col(f"Lines.{name}"), F.array()), lambda x: F.struct(x["RecordID"].alias("record"), x["AccountID"].alias("account"), x["SourceDocumentID"].alias("document"), (value(x) if debit else zero).alias("debit"), (zero if debit else value(x)).alias("credit")))

    lines = F.concat(side("DebitLine", "DebitAmount"), side("CreditLine", "CreditAmount"))
    head = [F.col("TransactionID").alias("transaction"), F.col("TransactionDate").alias("day"), F.col("Period").alias("period")]
    return rows.select(*head, F.explode(lines).alias("l")).select("transaction", "day", "period", "l.*")


def unbalanced(journal: DataFrame) -> DataFrame:
    """(transaction, debit, credit): postings whose sides differ."""
    sums = journal.groupBy("transaction").agg(F.sum("debit").cast(_SUM).alias("debit"), F.sum("credit").cast(_SUM).alias("credit"))
    return sums.where("debit <> credit")


def ancestors(accounts: DataFrame) -> DataFrame:
    """(account, ancestor, up): each account with itself (0 steps up), its parent, and so on to the top.

    One join for each level of the chart, each with the chart's (account, parent) pairs; a chart of more than
    ``MOST_LEVELS`` levels, as a cyclic one would be, raises. A parent that isn't in the chart ends the way up.
    """
    chart = write_table(accounts.select("account", "parent").distinct(), "chart")
    level = chart.select("account", F.col("account").alias("ancestor"), F.lit(0).alias("up"))
    out = [level]
    up = chart.select(F.col("account").alias("ancestor"), "parent").where("parent IS NOT NULL AND parent <> account")
    held = chart.select(F.col("account").alias("parent"))
    up = write_table(up.join(held, "parent", "left_semi"), "chart-edges")
    while True:
        level = write_table(level.join(up, "ancestor").select("account", F.col("parent").alias("ancestor"), (F.col("up") + 1).alias("up")), "chart-level")
        if level.isEmpty():
            break
        out.append(level)
        if len(out) > MOST_LEVELS:
            raise ValueError(f"the chart of accounts has more than {MOST_LEVELS} levels or a cycle")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def trial_balance(accounts: DataFrame, journal: DataFrame) -> DataFrame:
    """(account, accounts, opening, debit, credit, closing, stated, agrees) of every account, those below it included.

    ``closing`` is opening + debit - credit; ``stated`` the closing balance that the file gives, summed likewise; they
    must agree on every level. Lines are summed by account before they move; an account without lines has zeros.
    """
    moved = journal.groupBy("account").agg(F.sum("debit").cast(_SUM).alias("debit"), F.sum("credit").cast(_SUM).alias("credit"))
    own = accounts.select("account", "opening", "closing").join(moved, "account", "left").fillna(0, ["debit", "credit"])
    rows = ancestors(accounts).join(own, "account")
    total = lambda c: F.sum(c).cast(_SUM)
    out = rows.groupBy(F.col("ancestor").alias("account")).agg(F.count("*").alias("accounts"), total("opening").alias("opening"), total("debit").alias("debit"), total("credit").alias("credit"), total("closing").alias("stated"))
    closing = (F.col("opening") + F.col("debit") - F.col("credit")).cast(_SUM)
    return out.select("account", "accounts", "opening", "debit", "credit", closing.alias("closing"), "stated", (closing == F.col("stated")).alias("agrees"))


def write_ledgers(accounts: DataFrame, postings: DataFrame, path: str) -> None:
    """The chart and the journal as XML files below ``path`` (accounts/, journal/), in the format that the readers take.

    ``accounts`` as :func:`read_accounts` gives them; ``postings`` (transaction, day, period, account, debit, credit)
    are gathered by transaction. Files are packed (gzip), with at most ``PACKED`` elements in one.
    """
    part = lambda c, s: F.when(s * F.col(c) > 0, s * F.col(c)).otherwise(0).cast(MONEY)
    chart = accounts.select(F.col("account").alias("AccountID"), F.col("description").alias("AccountDescription"), part("opening", 1).alias("OpeningDebitBalance"), part("opening", -1).alias("OpeningCreditBalance"), part("closing", 1).alias("ClosingDebitBalance"), part("closing", -1).alias("ClosingCreditBalance"), F.col("category").alias("GroupingCategory"), F.col("parent").alias("GroupingCode"))
    chart.write.format("xml").option("rootTag", "GeneralLedgerAccounts").option("rowTag", "Account").options(**PACKED).mode("overwrite").save(f"{path}/accounts")

    def lines(amount: str, name: str):
        row = F.struct(F.concat_ws("-", "transaction", "account").alias("RecordID"), F.col("account").alias("AccountID"), F.col("transaction").alias("SourceDocumentID"), F.col(amount).cast(MONEY).alias(name))
        return F.collect_list(F.when(F.col(amount) > 0, row))

    journal = postings.groupBy("transaction", "day", "period").agg(F.struct(lines("debit", "DebitAmount").alias("DebitLine"), lines("credit", "CreditAmount").alias("CreditLine")).alias("Lines"))
    journal = journal.select(F.col("transaction").alias("TransactionID"), F.col("period").alias("Period"), F.col("day").alias("TransactionDate"), "Lines")
    journal.write.format("xml").option("rootTag", "Journal").option("rowTag", "Transaction").options(**PACKED).mode("overwrite").save(f"{path}/journal")
