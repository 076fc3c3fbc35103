from decimal import Decimal as D

import pytest

from provena.sources import audit_ledgers as A

FILE = """<?xml version="1.0" encoding="UTF-8"?>
<AuditFile xmlns="urn:OECD:StandardAuditFile-Tax:PT_1.04_01"><MasterFiles><GeneralLedgerAccounts>
{accounts}
</GeneralLedgerAccounts></MasterFiles><GeneralLedgerEntries><Journal><JournalID>1</JournalID>
{transactions}
</Journal></GeneralLedgerEntries></AuditFile>"""


def account(i, parent, opening=0, closing=0):
    side = lambda n, x: f"<{n}DebitBalance>{max(x, 0):.2f}</{n}DebitBalance><{n}CreditBalance>{max(-x, 0):.2f}</{n}CreditBalance>"
    return f"<Account><AccountID>{i}</AccountID><AccountDescription>A &amp; {i}</AccountDescription>{side('Opening', opening)}{side('Closing', closing)}" + (f"<GroupingCode>{parent}</GroupingCode>" if parent else "") + "</Account>"


def posting(i, debits, credits):
    lines = "".join(f"<DebitLine><RecordID>{k}</RecordID><AccountID>{a}</AccountID><DebitAmount>{x}</DebitAmount></DebitLine>" for k, (a, x) in enumerate(debits))
    lines += "".join(f"<CreditLine><RecordID>{k}</RecordID><AccountID>{a}</AccountID><CreditAmount>{x}</CreditAmount></CreditLine>" for k, (a, x) in enumerate(credits))
    return f"<Transaction><TransactionID>{i}</TransactionID><Period>1</Period><TransactionDate>2024-01-05</TransactionDate><Lines>{lines}</Lines></Transaction>"


def test_a_file_rolls_up(spark, tmp_path):
    accounts = [account("1", None), account("11", "1", 100, 70), account("111", "11", 5, 7.5), account("2", None, 0, 10), account("3", "gone", 1, 1)]
    postings = [posting("a", [("111", "2.50")], [("11", "2.50")]), posting("b", [("2", "27.50")], [("11", "27.50")]), posting("c", [], [("2", "17.50")])]
    path = tmp_path / "saft.xml"
    path.write_text(FILE.format(accounts="\n".join(accounts), transactions="\n".join(postings)))
    chart, journal = A.read_accounts(spark, str(path)), A.read_journal(spark, str(path))
    assert {(r.account, r.description, r.parent, r.opening) for r in chart.collect()} >= {("11", "A & 11", "1", D("100.00")), ("1", "A & 1", None, D("0.00"))}
    assert sorted((r.transaction, r.account, r.debit, r.credit) for r in journal.collect())[0] == ("a", "11", D("0.00"), D("2.50"))
    assert [tuple(r) for r in A.unbalanced(journal).collect()] == [("c", D("0.00"), D("17.50"))]
    got = {r.account: (r.accounts, r.opening, r.closing, r.agrees) for r in A.trial_balance(chart, journal).collect()}
    assert got == {"1": (3, D("105.00"), D("77.50"), True), "11": (2, D("105.00"), D("77.50"), True), "111": (1, D("5.00"), D("7.50"), True), "2": (1, D("0.00"), D("10.00"), True), "3": (1, D("1.00"), D("1.00"), True)}


def test_one_file_spreads_over_tasks(spark, tmp_path):
    path = tmp_path / "big.xml"
    path.write_text(FILE.format(accounts=account("1", None), transactions="\n".join(posting(f"t{k}", [("1", "1.00")], [("1", "1.00")]) for k in range(4000))))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        journal = A.read_journal(spark, str(path))
        assert journal.rdd.getNumPartitions() > 4
        assert journal.select("transaction").distinct().count() == 4000 and journal.count() == 8000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_cyclic_chart_raises_and_no_rows(spark):
    schema = "account string, description string, parent string, category string, opening decimal(28,2), closing decimal(28,2)"
    chart = spark.createDataFrame([("a", None, "b", None, D(0), D(0)), ("b", None, "a", None, D(0), D(0))], schema)
    with pytest.raises(ValueError, match="cycle"):
        A.ancestors(chart)
    none = spark.createDataFrame([], schema)
    journal = spark.createDataFrame([], "transaction string, account string, debit decimal(18,2), credit decimal(18,2)")
    assert A.trial_balance(none, journal).count() == 0


def test_ledgers_are_written_packed(spark, tmp_path):
    accounts = spark.sql("SELECT '1' AS account, 'a' AS description, string(null) AS parent, 'GM' AS category, 0.00BD AS opening, 5.00BD AS closing")
    postings = spark.sql("SELECT concat('T', id) AS transaction, DATE'2024-01-02' AS day, 1 AS period, '1' AS account, 1.00BD AS debit, 0.00BD AS credit FROM range(5)")
    A.write_ledgers(accounts, postings, str(tmp_path))
    assert {p.suffix for k in ("accounts", "journal") for p in (tmp_path / k).glob("part-*")} == {".gz"}
    assert sorted(r.transaction for r in A.read_journal(spark, str(tmp_path / "journal")).collect()) == [f"T{i}" for i in range(5)]
