from decimal import Decimal

import pytest

from provena.sources import audit_files as A

D = Decimal


def line(credit="", debit="", tax=""):
    side = (f"<CreditAmount>{credit}</CreditAmount>" if credit else "") + (f"<DebitAmount>{debit}</DebitAmount>" if debit else "")
    return f"<Line><LineNumber>1</LineNumber>{side}{tax}</Line>"


def tax(kind, code, rate="", amount=""):
    return f"<Tax><TaxType>{kind}</TaxType><TaxCountryRegion>PT</TaxCountryRegion><TaxCode>{code}</TaxCode>" + (f"<TaxPercentage>{rate}</TaxPercentage>" if rate else "") + (f"<TaxAmount>{amount}</TaxAmount>" if amount else "") + "</Tax>"


def invoice(no, kind, net, payable, gross, lines, code="0", status="N", customer="C1", more=""):
    return (
        f"<Invoice><InvoiceNo>{no}</InvoiceNo><ATCUD>{code}</ATCUD><DocumentStatus><InvoiceStatus>{status}</InvoiceStatus></DocumentStatus><InvoiceDate>2026-03-05</InvoiceDate>"
        f"<InvoiceType>{kind}</InvoiceType><CustomerID>{customer}</CustomerID>{lines}<DocumentTotals><TaxPayable>{payable}</TaxPayable><NetTotal>{net}</NetTotal><GrossTotal>{gross}</GrossTotal></DocumentTotals>{more}</Invoice>"
    )


VAT = tax("IVA", "NOR", "23")
BOOK = (
    '<?xml version="1.0" encoding="UTF-8"?><AuditFile xmlns="urn:example:audit"><Header><AuditFileVersion>1.04_01</AuditFileVersion><TaxRegistrationNumber>500000000</TaxRegistrationNumber>'
    "<CompanyName>Example</CompanyName><FiscalYear>2026</FiscalYear><StartDate>2026-03-01</StartDate><EndDate>2026-03-31</EndDate></Header>"
    "<MasterFiles><Customer><CustomerID>C1</CustomerID><CustomerTaxID>999999990</CustomerTaxID><CompanyName>Buyer &amp; Co</CompanyName><BillingAddress><Country>PT</Country></BillingAddress></Customer></MasterFiles>"
    "<SourceDocuments><SalesInvoices><NumberOfEntries>{entries}</NumberOfEntries><TotalDebit>{debit}</TotalDebit><TotalCredit>{credit}</TotalCredit>{invoices}</SalesInvoices></SourceDocuments></AuditFile>"
)


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    rows = [
        invoice("FT A/1", "FT", "150.00", "32.50", "182.50", line("100.00", tax=VAT) + line("40.00", tax=VAT) + line("10.00", tax=tax("IVA", "RED", "3")), code="ABCD1234-1", more="<WithholdingTax><WithholdingTaxAmount>5.00</WithholdingTaxAmount></WithholdingTax>"),
        invoice("NC A/2", "NC", "10.00", "2.30", "12.30", line(debit="10.00", tax=VAT), code="ABCD1234-7"),
        invoice("FT A/3", "FT", "100.00", "4.00", "104.00", line("100.00", tax=tax("IS", "OUT", "4")), customer="C9"),
        invoice("FT A/4", "XX", "20.00", "9.00", "30.00", line("21.00", tax=VAT), status="A", code="short-4"),
        invoice("FT A/4", "FT", "0.00", "0.00", "0.00", ""),
    ]
    (folder / "one.xml").write_text(BOOK.format(entries=6, debit="10.00", credit="250.00", invoices="".join(rows)))
    (folder / "empty.xml").write_text(BOOK.format(entries=0, debit="0.00", credit="0.00", invoices=""))
    return str(folder)


def test_invoices_and_their_lines(spark, book):
    got = {(r.invoice_no, r.invoice_type): r for r in A.audit_invoices(spark, book).collect()}
    assert len(got) == 5
    first = got["FT A/1", "FT"]
    assert (first.lines_net, first.lines_vat, first.stamp_duty, first.line_count, first.withholding_total) == (D("150.00"), D("32.50"), D("0.00"), 3, D("5.00"))
    assert sorted((b.code, b.base) for b in first.tax_bases) == [("NOR", D("140.00")), ("RED", D("10.00"))]
    assert (first.customer_tax_id, first.customer_name, first.customer_country, first.problems) == ("999999990", "Buyer & Co", "PT", [])
    credit = got["NC A/2", "NC"]
    assert (credit.lines_net, credit.debit, credit.problems) == (D("10.00"), D("10.00"), ["code_of_another_document"])
    stamp = got["FT A/3", "FT"]
    assert (stamp.stamp_duty, stamp.lines_vat, stamp.customer_name, stamp.problems) == (D("4.00"), D("0.00"), None, [])
    assert got["FT A/4", "XX"].problems == ["gross_differs", "net_differs_from_lines", "tax_differs_from_lines", "unknown_type", "code_malformed"]
    nothing = got["FT A/4", "FT"]
    assert (nothing.line_count, nothing.lines_net, nothing.tax_bases, nothing.problems) == (0, D("0.00"), [], [])


def test_files_against_their_control_totals(spark, book):
    heads = A.audit_headers(spark, book).collect()
    assert {(h.tax_id, h.fiscal_year, h.currency, str(h.end_date)) for h in heads} == {("500000000", 2026, "EUR", "2026-03-31")} and len(heads) == 2
    got = {r.file.rsplit("/", 1)[1]: r for r in A.audit_file_problems(A.audit_invoices(spark, book), A.audit_controls(spark, book)).collect()}
    one, empty = got["one.xml"], got["empty.xml"]
    # the cancelled invoice counts as an entry, not in the totals
    assert (one.invoices, one.repeated_numbers, one.entries_differ, one.debit_differs, one.credit_differs) == (5, 1, True, False, False)
    assert (empty.invoices, empty.repeated_numbers, empty.entries_differ, empty.debit_differs, empty.credit_differs) == (0, 0, False, False, False)
