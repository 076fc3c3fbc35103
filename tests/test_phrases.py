import random

from pyspark.sql import functions as F

from provena.operators import phrases as P


def brute(text, phrases):
    """(phrase, word, start, end) of each occurrence, by comparing words."""
    words, out = P.folded_words(text or ""), []
    for p in phrases:
        w = [x for x, _, _ in P.folded_words(p)]
        out += [(p, i, words[i][1], words[i + len(w) - 1][2]) for i in range(len(words) - len(w) + 1) if w and [x for x, _, _ in words[i : i + len(w)]] == w]
    return sorted(out)


def test_folded_words():
    assert P.folded_words("Çafé-bar, ÉÑ 12x") == [("cafe", 0, 4), ("bar", 5, 8), ("en", 10, 12), ("12x", 13, 16)]
    text = "İx Ab"
    assert [(w, text[a:b]) for w, a, b in P.folded_words(text)][-1] == ("ab", "Ab")


def test_hits_against_brute_force(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: r.choice(["a", "b", "café", "dé", "x1", "y"])
    texts = [(i, "".join(word() + r.choice([" ", "-", ", ", "\n"]) for _ in range(r.randrange(40)))) for i in range(80)] + [(900, None), (901, ""), (902, "--")]
    phrases = sorted({" ".join(word() for _ in range(r.randrange(1, 5))) for _ in range(60)}) + ["Cafe DÉ", "!!", ""]
    docs = spark.createDataFrame(texts, "id int, t string").repartition(3)
    table = spark.createDataFrame([(p, len(p)) for p in phrases], "phrase string, extra int")
    want = sorted((i, *h) for i, t in texts for h in brute(t, phrases))
    told = lambda: sorted(tuple(x) for x in P.phrase_hits(docs, "id", "t", table, "phrase").select("id", "phrase", "word", "start", "end").collect())
    assert told() == want
    monkeypatch.setattr(P, "SHARD_CHARS", 50)  # many automata
    assert told() == want
    assert P.phrase_hits(docs, "id", "t", table.limit(0), "phrase").count() == 0


def test_a_large_table_reads_the_texts_once(spark, monkeypatch, tmp_path):
    texts = [(i, f"supplier {i:05d} paid Café {i:05d}, not supplier 0{i}") for i in range(40)]
    spark.createDataFrame(texts, "id int, t string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    table = spark.range(3000).select(F.concat(F.lit("Supplier#"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("phrase"))
    monkeypatch.setattr(P, "SHARD_CHARS", 500)
    hits = P.phrase_hits(docs, "id", "t", table, "phrase")
    assert sorted((r.id, r.phrase, r.word) for r in hits.collect()) == [(i, f"Supplier#{i:05d}", 0) for i in range(40)]
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_hashes_of_runs_do_not_depend_on_their_place():
    hashes = P.RunHashes()
    words = "a b c a b c d".split()
    found = dict(hashes(words, [1, 3, 7, 8]))
    assert sorted(found) == [1, 3, 7]
    assert found[3][0] == found[3][3] and len(set(found[3].tolist())) == 4
    assert next(hashes(words[3:6], [3]))[1][0] == found[3][0]


def test_many_phrases_in_one_pass(spark):
    table = spark.range(20_000).select(F.concat(F.lit("Supplier#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("phrase"))
    docs = spark.createDataFrame([(1, "paid to Supplier#000012345 and SUPPLIER 000000007."), (2, "supplier#12345")], "id int, t string")
    got = sorted((r.id, r.phrase) for r in P.phrase_hits(docs, "id", "t", table, "phrase").collect())
    assert got == [(1, "Supplier#000000007"), (1, "Supplier#000012345")]


def test_the_first_rule_decides(spark):
    rules = spark.createDataFrame([(2, "fee", "account fee"), (1, "tax", "tax office"), (2, "fee", "fee"), (3, "pay", "salary")], "rank int, rule string, phrase string")
    docs = spark.createDataFrame([(1, "salary, account fee"), (2, "Fee to the TAX-Office"), (3, "nothing"), (4, None)], "id int, t string")
    got = {r.id: (r.rule, r.phrase, r.start) for r in P.first_rule(docs, "id", "t", rules).collect()}
    assert got == {1: ("fee", "account fee", 8), 2: ("tax", "tax office", 11), 3: (None, None, None), 4: (None, None, None)}
