from datetime import date as d
from datetime import datetime as t

from pyspark.sql import functions as F

from provena.operators import aliases as A

ROWS = "id int, iban string, tax_id string, descriptor string, on date, decided_at timestamp"
DAY, NOON = d(2024, 5, 10), t(2024, 5, 10, 12)
PARTIES = [("iban", "I1", 1), ("iban", "I2", 2), ("tax_id", "T1", 1), ("tax_id", "T2", 2)]
NAMES = [(1, "acme tools"), (2, "globex"), (3, "initech"), (4, "initech systems")]


def resolved(spark, rows, aliases):
    out = A.resolve(spark.createDataFrame(rows, ROWS), "id", ["iban", "tax_id"], spark.createDataFrame(PARTIES, "kind string, value string, party bigint"), spark.createDataFrame(aliases, A.ALIASES), spark.createDataFrame(NAMES, "party bigint, name string"))
    return {r.id: (r.party, r.method, r.candidates) for r in out.collect()}


def test_the_chain(spark):
    rows = [
        (1, "I1", "T1", "globex", DAY, NOON), (2, "I1", "T2", "x", DAY, NOON), (3, None, None, "amzn mktp", DAY, NOON), (4, None, None, "acme tool", DAY, NOON),
        (5, None, None, "initech", DAY, NOON), (6, None, "T9", "nobody knows", DAY, NOON), (7, None, None, None, DAY, NOON), (8, "I2", None, "amzn mktp", DAY, NOON),
    ]
    got = resolved(spark, rows, [("amzn mktp", 3, None, None, t(2024, 1, 1), None)])
    assert got == {
        1: (1, "iban", [1]), 2: (None, "conflict", [1, 2]), 3: (3, "learned", [3]), 4: (1, "fuzzy", []),
        5: (3, "fuzzy", []), 6: (None, "unresolved", []), 7: (None, "unresolved", []), 8: (None, "conflict", [2, 3]),
    }


def test_what_is_learned_later_decides_nothing_earlier(spark):
    aliases = spark.createDataFrame([("shop", 1, d(2024, 1, 1), None, t(2024, 3, 1), None)], A.ALIASES)
    said = spark.createDataFrame([("shop", 2, d(2024, 1, 1))], "descriptor string, party bigint, valid_from date")
    after = A.learn(said, aliases, F.lit(t(2024, 6, 1)).cast("timestamp"))
    rows = [(1, d(2024, 2, 1), t(2024, 2, 1)), (2, d(2024, 2, 1), t(2024, 4, 1)), (3, d(2024, 2, 1), t(2024, 7, 1)), (4, d(2023, 2, 1), t(2024, 7, 1))]
    df = spark.createDataFrame([(i, "shop", on, at) for i, on, at in rows], "id int, descriptor string, on date, decided_at timestamp")
    told = lambda table: {r.id: r.party for r in A.known_aliases(df, "id", "descriptor", "on", "decided_at", table).collect()}
    assert told(aliases) == {2: 1, 3: 1}
    assert told(after) == {2: 1, 3: 2}  # what was decided in April stays as it was


def test_two_at_once_stay_open_and_ends_hold(spark):
    rows = [(1, None, None, "a", DAY, NOON), (2, None, None, "b", DAY, NOON), (3, None, None, "c", DAY, NOON)]
    aliases = [("a", 1, None, None, t(2024, 1, 1), None), ("a", 2, None, None, t(2024, 1, 1), None), ("b", 1, None, DAY, t(2024, 1, 1), None), ("c", 1, None, None, t(2024, 1, 1), t(2024, 2, 1)), ("c", 3, DAY, d(2024, 5, 11), t(2024, 1, 1), None)]
    assert resolved(spark, rows, aliases) == {1: (None, "conflict", [1, 2]), 2: (None, "unresolved", []), 3: (3, "learned", [3])}
