import pytest

from provena.plans import tools as T


def test_answers_with_arguments(spark, sf):
    some = T.call(spark, sf, "spending", '{"start": "1995-01-01", "customers": ["1", "2", "4"]}')
    every = T.call(spark, sf, "spending", {"start": "1900-01-01"})
    assert some.columns == ["label", "n", "amount"] and 0 < sum(r.n for r in some.collect()) < sum(r.n for r in every.collect()) == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert T.call(spark, sf, "spending", {"start": "1900-01-01", "customers": []}).count() == 0
    assert T.call(spark, sf, "largest", '{"most": 3}').count() == 3
    odd = "x' OR '1'='1"
    assert T.call(spark, sf, "documents", {"phrase": odd}).count() == 0


@pytest.mark.parametrize(
    ("name", "arguments", "reason"),
    [
        ("nothing", "{}", "no such tool"),
        ("spending", "no json", "no JSON"),
        ("spending", "[1]", "must be an object"),
        ("spending", "{}", "start is missing"),
        ("spending", '{"start": "1995-13-01"}', "start must be a date"),
        ("spending", '{"start": 5}', "start must be of type string"),
        ("spending", '{"start": "1995-01-01", "drop": 1}', "drop is no argument"),
        ("spending", '{"start": "1995-01-01", "customers": [1]}', "strings only"),
        ("largest", '{"most": 0}', "at least 1"),
        ("largest", '{"most": 1000}', "at most 100"),
        ("largest", '{"most": true}', "type integer"),
        ("largest", '{"above": "1"}', "type number"),
        ("documents", '{"phrase": "a", "lang": "xx"}', "one of en, de, es, fr"),
    ],
)
def test_bad_arguments_are_refused_with_a_reason(name, arguments, reason):
    with pytest.raises(T.BadArguments, match=reason):
        T.bound(name, arguments)


def test_all_faults_are_told():
    with pytest.raises(T.BadArguments) as e:
        T.bound("spending", '{"end": 1, "x": 2}')
    assert len(e.value.reasons) == 3
    assert {c["name"] for c in T.catalog()} == {"spending", "largest", "documents"} and all(c["arguments"]["type"] == "object" for c in T.catalog())
