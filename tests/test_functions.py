from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provena.functions import checks, money, register, text, web


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_fold_and_squash(spark):
    assert one(spark, text.fold("a"), a="  Ação  LTDA\t nº") == "acao ltda nº"
    assert one(spark, text.squash("a"), a="FT 2024/ 0012-A") == "ft20240012a"
    assert one(spark, text.name_key("a"), a="Padaria São João, Lda") == "padaria sao joao"
    assert one(spark, text.fold("a"), a=None) is None


@pytest.mark.parametrize(("a", "b", "least", "most"), [("acme", "acme", 1, 1), ("ac me", "acme", 0.98, 0.98), ("acme", "acme tools", 0.85, 0.99), ("acme to", "acme tools", 0.8, 0.95), ("acme", "zzzz", 0, 0.1), ("", "x", 0, 0)])
def test_name_similarity(spark, a, b, least, most):
    assert least <= one(spark, text.name_similarity("a", "b"), a=a, b=b) <= most


def test_marker_tie_is_open(spark):
    marks = {"en": ["the"], "fr": ["les"]}
    assert one(spark, text.best_marker("a", marks), a="the the cat") == "en"
    assert one(spark, text.best_marker("a", marks), a="the les") is None
    assert one(spark, text.best_marker("a", marks), a="nothing") is None


@pytest.mark.parametrize(("x", "ok"), [("4539578763621486", True), ("4539578763621487", False), ("12a4", False), ("", False)])
def test_luhn(spark, x, ok):
    assert one(spark, checks.luhn_ok("a"), a=x) is ok


@pytest.mark.parametrize(("x", "ok"), [("GB82 WEST 1234 5698 7654 32", True), ("DE89370400440532013000", True), ("DE89370400440532013001", False), ("XX", False)])
def test_iban(spark, x, ok):
    assert one(spark, checks.iban_ok("a"), a=x) is ok


def test_mod97_any_length(spark):
    digits = "98765432109876543210987654321098765"
    assert one(spark, checks.mod97("a"), a=digits) == int(digits) % 97


@pytest.mark.parametrize(
    ("x", "readings"),
    [("1.234,56", ["1234.56"]), ("1,234.56", ["1234.56"]), ("1.234", ["1234.00"]), ("12,5", ["12.50"]), ("-12.30", ["-12.30"]), ("(99,90)", ["-99.90"]), ("EUR 1 000,00", ["1000.00"]), ("1.2.3", []), ("abc", []), ("10.000.000", ["10000000.00"])],
)
def test_amounts(spark, x, readings):
    assert one(spark, money.amount_readings("a"), a=x) == [Decimal(r) for r in readings]


def test_web(spark):
    url = "https://user@Shop.Example.co.uk:8443/a?page=3&x=1#top"
    assert one(spark, web.host("a"), a=url) == "shop.example.co.uk"
    assert one(spark, web.registrable_domain(web.host("a")), a=url) == "example.co.uk"
    assert one(spark, web.query_value("a", "page"), a=url) == "3"
    assert one(spark, web.query_value("a", "none"), a=url) is None
    assert one(spark, web.json_at("a", "$.k", "bigint"), a='{"k": 3}') == 3
    assert one(spark, web.json_at("a", "$.k", "bigint"), a="not json") is None


def test_registered_macros(spark):
    names = register.register_functions(spark)
    assert "fold_text" in names
    assert spark.sql("SELECT squash_text('Ñ a-1') AS x").first().x == "na1"
    assert spark.sql("SELECT month_day_distance(30, 2) AS x").first().x == 3


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab cé1-", max_size=12), min_size=1, max_size=30))
def test_fold_is_stable(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "a string")
    assert rows.where(text.fold(text.fold("a")) != text.fold("a")).count() == 0
    assert rows.where(F.length(text.squash("a")) > F.length(text.fold("a"))).count() == 0
