from datetime import date
from decimal import Decimal as D

import pytest

from provena.sources import extractors as X

INVOICE = X.PatternExtractor("invoice", {"number": (r"No\.? (\S+)", "string"), "on": (r"Date: (\S+)", "date"), "total": (r"Total: ([0-9.]+)", "decimal(18,2)"), "paid": (r"\bpaid\b", "boolean")}, "Invoice", 0.8)
ANY = X.PatternExtractor("any", {"total": (r"([0-9]+\.[0-9]{2})", "decimal(18,2)"), "n": (r"\b[0-9]+\b", "bigint")}, "", 0.5)
TEXTS = [(1, "Invoice No. A/7 Date: 2024-02-01 Total: 12.50 paid"), (2, "Total 3.25 and 17"), (3, None), (4, "Invoice Date: 2024-02-31 Total: ..")]


@pytest.fixture
def docs(spark):
    X.register_extractors(spark, [INVOICE, ANY])
    spark.createDataFrame(TEXTS, "id int, text string").createOrReplaceTempView("extractor_texts")


def test_columns_follow_the_name(spark, docs):
    out = spark.sql("SELECT id, e.* FROM extractor_texts t, LATERAL extract_fields(t.text, 'invoice') e")
    assert out.dtypes == [("id", "int"), ("number", "string"), ("on", "date"), ("total", "decimal(18,2)"), ("paid", "boolean")]
    assert sorted(map(tuple, out.collect())) == [(1, "A/7", date(2024, 2, 1), D("12.50"), True), (4, None, None, None, False)]
    other = spark.sql("SELECT id, e.* FROM extractor_texts t, LATERAL extract_fields(t.text, 'any') e")
    assert other.columns == ["id", "total", "n"] and other.count() == 3


def test_first_match_wins_and_merge(spark, docs):
    first = spark.sql("SELECT id, e.* FROM extractor_texts t, LATERAL first_extraction(t.text, 'invoice', 'any') e")
    assert {(r.id, r.extractor) for r in first.collect()} == {(1, "invoice"), (2, "any"), (4, "invoice")}
    both = X.merged(first, spark.sql("SELECT id, e.* FROM extractor_texts t, LATERAL first_extraction(t.text, 'any') e"))
    got = {(r.id, r.field): (r.value, r.extractor, r.agree) for r in both.collect()}
    assert got[1, "total"] == ("12.50", "invoice", 2) and got[1, "n"] == ("7", "any", 1) and got[2, "total"] == ("3.25", "any", 1)


def test_wrong_names_are_refused(spark, docs):
    with pytest.raises(Exception, match="an extractor's name is one of any, invoice"):
        spark.sql("SELECT * FROM extract_fields('x', 'nope')").collect()
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT e.* FROM extractor_texts t, LATERAL extract_fields(t.text, t.text) e").collect()
    with pytest.raises(ValueError, match="no type"):
        X.PatternExtractor("x", {"a": ("b", "float")})
    with pytest.raises(ValueError, match="two extractors"):
        X.register_extractors(spark, [ANY, ANY])
