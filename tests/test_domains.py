import random

from pyspark.sql import functions as F

from provena.functions import domains as N


def test_labels_equal_the_codec(spark):
    words = ["bücher", "例え", "mañana", "пример", "a-b-ü", "ü", "plain", "ẞ", "ελ"]
    hosts = ["www.xn--" + w.encode("punycode").decode() + ".Com" for w in words] + ["xn--\x80bad.com", "xn--a!b", "a..b.", "", None]
    got = [r.h for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(N.decoded_host("h").alias("h")).collect()]
    assert got[: len(words)] == [f"www.{w.lower() if w == 'plain' else w}.com".replace("plain", "plain") for w in words]
    assert got[-3:] == ["a.b", None, None]


def test_distance_against_a_recursive_one(spark):
    from functools import cache

    @cache
    def plain(a, b):
        if not a or not b:
            return len(a) + len(b)
        best = min(plain(a[:-1], b) + 1, plain(a, b[:-1]) + 1, plain(a[:-1], b[:-1]) + (a[-1] != b[-1]))
        if len(a) > 1 and len(b) > 1 and a[-1] == b[-2] and a[-2] == b[-1]:
            best = min(best, plain(a[:-2], b[:-2]) + 1)
        return best

    r = random.Random(3)
    pairs = [("".join(r.choice("abc") for _ in range(r.randrange(7))), "".join(r.choice("abc") for _ in range(r.randrange(7)))) for _ in range(300)]
    assert all(N.swap_distance(a, b) == plain(a, b) for a, b in pairs)
    df = spark.createDataFrame([*pairs, (None, "a")], "a string, b string").select(N.edit_distance("a", "b").alias("d")).collect()
    assert [x.d for x in df] == [plain(a, b) for a, b in pairs] + [None]


def test_verdicts(spark):
    known = [("v", "vodafone.pt"), ("v", "billing@vodafone.pt"), ("g", "joao@gmail.com"), ("m", "modern-supply.com"), ("x", "xo.com")]
    cases = {
        1: ("v", "Vodafone <a@mail.vodafone.pt>", "known", None), 2: ("v", "a@vodafnoe.pt", "lookalike", "vodafone.pt"), 3: ("v", "a@v0dafone.com", "lookalike", "vodafone.pt"),
        4: ("v", "a@vodafone-billing.net", "lookalike", "vodafone.pt"), 5: ("v", "a@other.org", "changed", None), 6: ("v", "x@gmail.com", "free_mail", None),
        7: ("g", "Joao@Gmail.com", "known", None), 8: ("g", "maria@gmail.com", "new_address", None), 9: ("z", "a@b.com", "unknown", None), 10: ("v", None, "unknown", None),
        11: ("m", "a@rnodern-supply.com", "lookalike", "modern-supply.com"), 12: ("m", "a@modern-suply.com", "lookalike", "modern-supply.com"), 13: ("x", "a@x0.com", "lookalike", "xo.com"),
        14: ("x", "a@xa.com", "changed", None), 15: ("v", "a@xn--" + "vоdafone".encode("punycode").decode() + ".pt", "lookalike", "vodafone.pt"),
    }
    m = spark.createDataFrame([(i, p, s) for i, (p, s, *_) in cases.items()], "id int, party string, sender string")
    got = {r.id: (r.verdict, r.imitated) for r in N.check_senders(m, spark.createDataFrame(known, "party string, entry string")).collect()}
    assert got == {i: c[2:] for i, c in cases.items()}


def test_close_names_against_all_pairs(spark):
    r = random.Random(5)
    names = sorted({"".join(r.choice("abé") for _ in range(r.randrange(6))) for _ in range(120)})
    want = {(a, b) for a in names for b in names if a < b and N.swap_distance(a, b) == 1}
    got = N.close_names(spark.createDataFrame([(n,) for n in [*names, *names, None]], "n string"), "n")
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    assert got.select(F.count("*")).first()[0] > 0
