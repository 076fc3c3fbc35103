"""Readers over small files, and writers: hash chains, object stores, packages, queues."""

import io
import zipfile
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from provena.operators.chain import verify_chain
from provena.sources import files as R
from provena.sources import sinks as S
from provena.sources import texts as T


def test_delimited_files_are_bound_by_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Data;Descrição ;"Valor (EUR)"\n2024-01-02;"a;b ""c""";1,50\n2024-01-03;x;\n', encoding="utf-8")
    got = R.read_csv(spark, str(tmp_path / "a.csv"), {"on": ["data"], "text": ["descricao"], "amount": ["valor eur"], "fee": ["taxa"]})
    assert [tuple(r) for r in got.collect()] == [("2024-01-02", 'a;b "c"', "1,50", None), ("2024-01-03", "x", None, None)]
    assert R.sniff_delimiter("a,b;c;d") == ";" and R.sniff_delimiter("a\tb\tc") == "\t" and R.sniff_delimiter("plain") == ";"
    assert spark.range(1).select(R.header_key(F.lit("Nº Fatura"))).first()[0]


def test_json_payloads(spark):
    rows = spark.createDataFrame([('{"a": {"b": [1, "2.50"]}, "c": "x"}',), ("no json",), (None,)], "p string")
    got = R.json_fields(rows, "p", {"n": ("$.a.b[0]", "int"), "amount": ("$.a.b[1]", "decimal(18,2)"), "none": ("$.z", "string")}).select("n", "amount", "none").collect()
    assert [tuple(r) for r in got] == [(1, D("2.50"), None), (None, None, None), (None, None, None)]


def test_documents_of_the_other_syntax(spark):
    cii = (
        "<rsm:CrossIndustryInvoice xmlns:rsm='r' xmlns:ram='a' xmlns:udt='u'><rsm:ExchangedDocument><ram:ID>R1</ram:ID><ram:TypeCode>381</ram:TypeCode><ram:IssueDateTime><udt:DateTimeString>20240131</udt:DateTimeString></ram:IssueDateTime></rsm:ExchangedDocument>"
        "<rsm:SupplyChainTradeTransaction><ram:ApplicableHeaderTradeSettlement><ram:InvoiceCurrencyCode>EUR</ram:InvoiceCurrencyCode><ram:SpecifiedTradeSettlementHeaderMonetarySummation><ram:GrandTotalAmount>12.30</ram:GrandTotalAmount></ram:SpecifiedTradeSettlementHeaderMonetarySummation></ram:ApplicableHeaderTradeSettlement></rsm:SupplyChainTradeTransaction></rsm:CrossIndustryInvoice>"
    )
    rows = spark.createDataFrame([(1, cii), (2, "<!DOCTYPE a><Invoice/>"), (3, None), (4, "<Invoice>" + "<x/>" * 1_500_000 + "<ID>big</ID></Invoice>")], "id int, xml string")
    got = {r.id: r for r in R.einvoice_fields(rows, "xml").drop("xml").collect()}
    assert (got[1].doc_type, got[1].invoice_number, got[1].issue_date, got[1].gross_amount, got[1].problem) == ("credit_note", "R1", date(2024, 1, 31), D("12.30"), None)
    assert [got[i].problem for i in (2, 3)] == ["document_type", "empty"] and got[4].invoice_number == "big"
    credit = "<CreditNote><CreditNoteLine><ID>1</ID><CreditedQuantity>2</CreditedQuantity></CreditNoteLine><CreditNoteLine><ID>2</ID></CreditNoteLine></CreditNote>"
    lines = R.einvoice_lines(spark.createDataFrame([(1, credit)], "id int, xml string"), "xml", ["id"]).collect()
    assert [(r.line, r.line_id, r.quantity) for r in lines] == [(1, "1", D("2.000")), (2, "2", None)]


MAIL = b"""From: A <a@x.com>
To: b@y.com
Subject: =?utf-8?q?Fatura_de_mar=C3=A7o?=
Message-ID: <1@x>
Date: Mon, 4 Mar 2024 10:00:00 +0000
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=B

--B
Content-Type: text/plain; charset=utf-8

Ol=C3=A1 https://x.com/f.pdf
--B
Content-Type: application/pdf; name=f.pdf
Content-Disposition: attachment; filename=f.pdf
Content-Transfer-Encoding: base64

JVBERi0=
--B--
"""


def test_mail_and_pages(spark):
    rows = spark.createDataFrame([("m1", bytearray(MAIL)), ("m2", bytearray(b""))], "path string, content binary")
    got = {r.path: r for r in T.read_mail(rows).collect()}
    assert got["m1"].depth == 0 and got["m1"].problem is None and "ol" in got["m1"].text.lower()
    assert "m2" in got
    page = spark.createDataFrame([(1, "<title>T</title><p>a</p><script>x</script><a href='/f.pdf'>Download invoice</a><a href='https://facebook.com/x'>f</a>"), (2, None)], "id int, html string")
    read = {r.id: r for r in T.read_pages(page).collect()}
    assert (read[1].text, read[1].title, read[2].text) == ("a\nDownload invoicef", "T", "")
    scores = T.link_scores(T.read_pages(page).where("id = 1").select(F.inline("anchors"))).collect()
    assert scores[0].points > 50 and scores[1].points <= -100


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    good = archive(a=b"one", b=archive(c=b"two"))
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w") as z:
        z.writestr("x", b"hello world")
        z.writestr("y", b"fine")
    damaged = stored.getvalue().replace(b"hello world", b"hellO world", 1)
    bomb = archive(z=b"\0" * 2_000_000)
    rows = spark.createDataFrame([(n, bytearray(x)) for n, x in (("good", good), ("damaged", damaged), ("bomb", bomb), ("none", b"text"))], "path string, content binary")
    got = {(r.path, r.member): (bytes(r.content) if r.content is not None else None, r.skipped) for r in T.expand_zips(rows).collect()}
    assert got["good", "a"] == (b"one", None) and got["good", "b!c"] == (b"two", None)
    assert got["damaged", "x"] == (None, "damaged: BadZipFile") and got["damaged", "y"] == (b"fine", None)
    assert got["bomb", "z"] == (None, "ratio") and got["none", ""] == (None, "not an archive")


def events(spark, *rows):
    return spark.createDataFrame(rows, "tenant_id string, `order` int, body string")


def test_appends_go_on_with_the_chain(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    first = S.append_events(events(spark, ("3f", 1, "a"), ("3f", 2, "b"), ("76", 1, "x")), path)
    assert first.count() == 3
    second = S.append_events(events(spark, ("76", 1, "y"), ("3f", 5, "c"), ("new", 1, "n")), path)
    assert sorted((r.tenant_id, r.seq) for r in second.collect()) == [("3f", 3), ("76", 2), ("new", 1)]
    log = R.event_log(spark, path)
    assert log.count() == 6 and log.where("tenant_id = '3f'").count() == 3
    assert verify_chain(log, "tenant_id", "seq", "body").where("NOT intact").count() == 0
    seen = spark.createDataFrame([("3f", 3), ("76", 1)], "tenant_id string, last_seq bigint")
    third = S.append_events(events(spark, ("3f", 1, "d"), ("76", 1, "z")), path, expected=seen)
    assert [(r.tenant_id, r.seq) for r in third.collect()] == [("3f", 4)]
    assert R.event_log(spark, path, "3f", after=2).count() == 2


def test_a_second_writer_is_refused(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    S.append_events(events(spark, ("a", 1, "x")), path)
    chained = S.chained

    def slow(*args):
        monkeypatch.setattr(S, "chained", chained)
        S.append_events(events(spark, ("a", 1, "other")), path)
        (tmp_path / "log" / "batch-000003").mkdir()
        return chained(*args)

    monkeypatch.setattr(S, "chained", slow)
    (tmp_path / "log" / "batch-000003").exists()
    out = None
    try:
        out = S.append_events(events(spark, ("a", 2, "mine")), path)
    except S.LogMoved:
        pass
    bodies = {r.body for r in R.event_log(spark, path).collect()}
    assert "other" in bodies and (out is None) == ("mine" not in bodies)


def test_objects_are_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    put = lambda *xs: S.put_objects(spark.createDataFrame([(bytearray(x),) for x in xs], "content binary"), path)
    assert put(b"a", b"b", b"a").count() == 2
    assert put(b"b", b"c").count() == 1 and put(b"b").count() == 0
    assert sorted(bytes(r.content) for r in spark.read.option("recursiveFileLookup", "true").parquet(path).collect()) == [b"a", b"b", b"c"]


def test_packages_queues_and_reports(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"1")), ("a", bytearray(b"2")), ("b", bytearray(b"3"))], "name string, content binary")
    lines = S.manifest(files, "name", "content")
    assert lines.select("name").distinct().count() == 3
    assert S.package_hash(lines).first() == S.package_hash(lines.orderBy(F.col("name").desc()).repartition(3)).first()
    assert S.package_hash(lines).first().package_sha256 != S.package_hash(lines.where("name = 'b'")).first().package_sha256
    have = spark.createDataFrame([("b", bytearray(b"x")), ("c", bytearray(b"y"))], "name string, content binary")
    assert {r.name: r.state for r in S.verify_package(lines.where("name = 'b'"), have, "name", "content").collect()} == {"b": "changed", "c": "unexpected"}
    jobs = spark.createDataFrame([("t", "k", "1"), ("t", "k", "1"), ("t", "k", "2")], "tenant_id string, kind string, key string")
    assert S.enqueue_once(jobs, None).count() == 2 and S.enqueue_once(jobs, jobs.where("key = '1'")).count() == 1
    rows = spark.createDataFrame([("t", "x", D("1.50")), ("u", "y", D("2.50"))], "tenant_id string, kind string, amount decimal(18,2)")
    report = {(r.tenant_id, r.kind): r.amount for r in S.period_report(rows, ["tenant_id", "kind"], "amount").collect()}
    assert report == {("t", "x"): D("1.50"), ("u", "y"): D("2.50"), (None, None): D("4.00")}
    S.export_tenant(rows, f"file://{tmp_path}/export", "t")
    assert spark.read.json(f"file://{tmp_path}/export").count() == 1
    S.write_ledger(rows, f"file://{tmp_path}/ledger", ["kind", "amount"], ["kind"])
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/ledger").collect()] == ["kind;amount", "x;1.50", "kind;amount", "y;2.50"] or spark.read.csv(f"file://{tmp_path}/ledger", header=True, sep=";").count() == 2


def test_no_shared_folder_is_an_error_on_a_cluster():
    from provena.storage import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
