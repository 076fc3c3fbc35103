"""Operators 3, 4, 7, 8, 9, 10 on odd rows and against brute force."""

import hashlib
import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provena.llm import blocks as B
from provena.llm.decontaminate import contamination
from provena.llm.lm_score import stupid_backoff
from provena.llm.quality import quality_rules
from provena.llm.queries import tokenizer_path
from provena.llm.substring_dedup import COVERS, cover_for, drop_repeated_passages
from provena.llm.token_count import MergeCounter, UnigramCounter, count_tokens, count_tokens_of, load_vocabulary
from provena.llm.wordarrays import Words, text_slices
from provena.llm.zip_quality import CompressionClassifier, spread_pieces


def words(t):
    return (t or "").encode().split()


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# -- word arrays ---------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té\x0b", max_size=40)), max_size=12))
def test_word_arrays(texts):
    import pyarrow as pa

    w = Words(pa.array(texts, pa.string()))
    flat = [x for t in texts for x in words(t)]
    assert w.counts().tolist() == [len(words(t)) for t in texts]
    assert [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)] == flat
    same = {}
    for x, h in zip(flat, w.hash.tolist(), strict=True):
        assert same.setdefault(x, h) == h
    assert len(set(same.values())) == len(same)
    starts, hashes = w.windows(2)
    pairs = {}
    for s, h in zip(starts.tolist(), hashes.tolist(), strict=True):
        assert pairs.setdefault((flat[s], flat[s + 1]), h) == h
    assert len(set(pairs.values())) == len(pairs)


def test_text_slices_cover_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (1, 50, 3, 0, 9, 9, 200, 1)]})
    parts = list(text_slices([batch], "t", 20))
    assert pa.Table.from_batches(parts).column("t").to_pylist() == batch.column("t").to_pylist()
    assert max(len(p) for p in parts) < len(batch)


def test_packed_hashes_round_trip():
    r = np.random.default_rng(1)
    h = np.unique(r.integers(0, 2**64, 1000, dtype=np.uint64))
    c = r.integers(1, 2**32, len(h), dtype=np.uint64).astype(np.uint32)
    a, b = B.unpack(B.pack(h, c))
    assert (a == h).all() and (b == c).all()
    assert len(B.unpack(B.pack(h[:0], c[:0]))[0]) == 0


# -- 8: substring dedup --------------------------------------------------------------------------------------------


def brute_passages(rows, window):
    count = Counter(tuple(w[i : i + window]) for r in rows for w in [words(r[1])] for i in range(len(w) - window + 1))
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((r[0], len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("period", list(COVERS))
def test_covers(period):
    cover = COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("window", [3, 9, 35])
def test_passages(odd, odd_rows, window):
    got = drop_repeated_passages(odd, window=window)
    assert by_row(got, "doc_id", "n_words", "n_removed", "text") == brute_passages(odd_rows, window)
    assert got.columns == [*[c for c in odd.columns if c != "n_words"], "n_words", "n_removed", "removed_spans"]
    for r in got.collect():
        assert sum(s.end - s.start for s in r.removed_spans) == r.n_removed


def test_passages_in_many_small_blocks(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(B.to_blocks, "__defaults__", (500, "blocks"))
    assert by_row(drop_repeated_passages(odd, window=20), "doc_id", "n_words", "n_removed", "text") == brute_passages(odd_rows, 20)
    assert cover_for(35)[0] == 21


def test_no_passages(none):
    assert drop_repeated_passages(none).collect() == []


# -- 9: language model ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("common", [{}, {"common": 12, "hot": 3}, {"common": 1, "hot": 1}])
@pytest.mark.parametrize(("order", "min_count"), [(1, 2), (2, 2), (3, 2), (3, 4), (4, 2)])
def test_stupid_backoff(odd, odd_rows, order, min_count, common):
    docs = [words(r[1]) for r in odd_rows]
    count = Counter(tuple(w[i : i + n]) for w in docs for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(len(w) for w in docs)
    want = []
    for r, w in zip(odd_rows, docs, strict=True):
        score, backed = 0.0, 0
        for i in range(len(w)):
            high = min(order, i + 1)
            for n in range(high, 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    score += math.log(count[gram] / total)
                elif count[gram] >= min_count:
                    score += math.log(count[gram] / count[gram[:-1]])
                else:
                    score += math.log(0.4)
                    continue
                backed += n < high
                break
        want.append((r[0], len(w), round(score, 5), backed))
    got = stupid_backoff(odd, order=order, min_count=min_count, **common)
    assert sorted(((r.doc_id, r.n_words, round(r.log_score, 5), r.n_backed_off) for r in got.collect()), key=str) == sorted(want, key=str)


def test_scores_tell_words_of_regular_structure_apart(spark):
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, a.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert [round(r.log_score, 9) for r in stupid_backoff(docs).collect()] == [round(math.log(0.5), 9)] * 2
    words = [(i, " ".join(w if i == 1 else w.translate(str.maketrans("ab", "ba")) for w in ["x"] * 34 + [a])) for i in (1, 2)]
    assert [r.n_removed for r in drop_repeated_passages(spark.createDataFrame(words, "doc_id long, text string")).collect()] == [0, 0]


def test_the_model_is_counted_and_joined(odd):
    plan = stupid_backoff(odd)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and "FlatMapGroups" not in plan
    assert stupid_backoff(odd.limit(0)).count() == 0


def test_no_scores(none):
    assert stupid_backoff(none).collect() == []


# -- 4: decontamination --------------------------------------------------------------------------------------------

ASCII = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(t):
    return ASCII.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(rows, items, window=13):
    win = {}
    for i, t in items:
        w = normal(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            win.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for r in rows:
        w, found = normal(r[1]), set()
        hit = [False] * len(w)
        for m in {len(k) for k in win}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in win:
                    hit[i : i + m] = [True] * m
                    found |= win[tuple(w[i : i + m])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((r[0], len(w), sum(hit), len(ids), ",".join(ids), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark, odd, odd_rows):
    base = odd_rows[0][1]
    items = [(1, base[40:260]), (2, " ".join(normal(base)[10:20]).upper() + "!"), (3, "one, TWO"), (10, "one two"), (4, None), (5, ""), (None, "three four"), (1, base[40:260]), (6, "日本語 の")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for nodes in (1 << 20, 400):
        got = contamination(odd, bench, nodes=nodes)
        assert by_row(got.withColumn("ids", F.array_join("items", ",")), "doc_id", "n_words", "n_hit", "n_items", "ids", "contaminated") == brute_hits(odd_rows, items)
    for r in got.where("n_hit > 0").collect():
        original = odd_rows[[x[0] for x in odd_rows].index(r.doc_id)][1] if r.doc_id != 9 else None
        if original:
            assert sum(len(normal(original[s.start : s.end])) for s in r.hit_spans) == r.n_hit
    assert set(got.columns) == {*odd.columns, "n_hit", "n_items", "items", "contaminated", "hit_spans"}


@pytest.mark.parametrize(("share", "flagged"), [(0.0, True), (0.7, True), (0.8, True), (0.81, False), (1.0, False)])
def test_share_of_hit_words_is_exact(spark, share, flagged):
    docs = spark.createDataFrame([(1, "a b c d e f g h x y")], "doc_id long, text string")
    got = contamination(docs, spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string"), min_share=share).first()
    assert (got.n_hit, got.n_words, got.contaminated) == (8, 10, flagged)


def test_no_benchmark_and_no_documents(spark, odd, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(odd, bench).where("n_hit > 0 OR contaminated").count() == 0
    assert contamination(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


# -- 7: quality rules ----------------------------------------------------------------------------------------------


def brute_quality(rows, min_docs, max_share):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    key = lambda x: x.strip(" \t\n\x0b\f\r").lower()
    held, of = Counter(), Counter(r[3] for r in rows)
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n") if key(x)}:
            held[r[3], k] += 1
    out = []
    for r in rows:
        w, t = split(r[1]), r[1] or ""
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if key(x)]
        bad = lambda x: held[r[3], key(x)] >= min_docs and held[r[3], key(x)] > max_share * of[r[3]]  # noqa: E731, B023
        gone = [x for x in lines if bad(x)]
        removed = sum(len(split(x)) for x in gone)
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        left = len(w) - removed
        kept_text = "\n".join(x for x in t.split("\n") if not (key(x) and bad(x))) if r[1] is not None else None
        out.append((r[0], len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), failed, len(gone), removed, not failed and left >= 20 and left >= 0.3 * len(w), kept_text))
    return sorted(out, key=str)


@pytest.mark.parametrize(("min_docs", "max_share"), [(2, 0.0), (3, 0.2), (1000, 0.0)])
def test_quality(odd, odd_rows, min_docs, max_share):
    got = quality_rules(odd, min_docs=min_docs, max_share=max_share)
    want = brute_quality(odd_rows, min_docs, max_share)
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_removed_words", "kept", "text") == want
    assert got.columns[:6] == [c for c in odd.columns if c != "n_words"]


def test_quality_of_repetition(spark):
    texts = ["a b c " * 40, "a b c d " * 2 + " ".join(f"w{i}" for i in range(60)), "x " * 70, "a b", "a b c", "a a a a", "# $ | <p> &amp;"]
    rows = [(i, t, "en", "s", 0, "", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, extra int")
    got = quality_rules(df)
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_removed_words", "kept", "text") == brute_quality(rows, 30, 0.03)


def test_quality_runs_no_python(odd, none):
    plan = quality_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert quality_rules(none).collect() == []


# -- 3: token counts -----------------------------------------------------------------------------------------------


def library(vocabulary, byte_fallback=True):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


@pytest.mark.skipif(not Path(tokenizer_path()).exists(), reason="no vocabulary file")
def test_tokens_under_the_scores_of_a_public_vocabulary(spark, odd, none, sf):
    vocabulary = [("<unk>", 0.0), *(v for v in load_vocabulary(tokenizer_path()) if v[0])]
    t = library(vocabulary)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    for r in count_tokens(docs, vocabulary).collect():
        assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids), r.text
    assert count_tokens(none, vocabulary).collect() == []
    assert count_tokens(odd.withColumn("N_Tokens", F.lit(1)), vocabulary).columns == [*odd.columns, "n_tokens", "n_pieces"]


@pytest.mark.skipif(not Path(tokenizer_path()).exists(), reason="no vocabulary file")
def test_tokens_of_the_public_tokenizer(spark, odd, none, sf):
    import sentencepiece

    from provena.llm.queries import op3_token_counts

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    assert all(r.n_tokens == len(model.encode(texts[r.doc_id])) for r in got)
    out = count_tokens_of(odd, tokenizer_path(), kind="merges")
    assert out.columns == [*odd.columns, "n_tokens", "n_pieces"]
    assert all(r.n_tokens == len(model.encode(r.text or "")) for r in out.collect())
    assert count_tokens_of(none, tokenizer_path(), kind="merges").collect() == []
    counter = MergeCounter(load_vocabulary(tokenizer_path()))
    for t in ("<s> </s><unk> <0x41>", " ", "  a ", "x" * 3000, "ab" * 900 + " " * 77, "a\x00b\u2581\u2581 c\n\n", "日本 😀 ﬁ ＡＢ", "\u2581" * 40 + "the"):
        assert counter.count(t)[0] == len(model.encode(t))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab▁", min_size=1, max_size=4), max_size=14), st.text(alphabet="ab c", max_size=24))
def test_merges_against_their_definition(tokens, text):
    ranked = [(t, -float(i // 2)) for i, t in enumerate(dict.fromkeys(["a", "b", "▁", *tokens]))]
    counter = MergeCounter(ranked)
    assert counter.count(text)[0] == (len(counter.merged(("▁" + text).replace(" ", "▁"))) if text else 0)


TIES = [("<unk>", 0.0), ("▁", -2.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("aba", -6.0), ("▁a", -4.0), ("▁ab", -6.0), ("bb", -3.0), ("ba", -4.0)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcé ▁\n", max_size=30))
def test_tokens_with_ties_and_unknown_characters(t):
    assert UnigramCounter(TIES).count(t)[0] == len(library(TIES, False).encode(t, add_special_tokens=False).ids)
    bytes_too = [*TIES, *((f"<0x{b:02X}>", 0.0) for b in range(256) if b != 0x0A)]
    assert UnigramCounter(bytes_too).count(t)[0] == len(library(bytes_too).encode(t, add_special_tokens=False).ids)


# -- 10: compression classifier ------------------------------------------------------------------------------------


def test_classifier(spark, odd, none):
    good = [(i, " ".join(f"word{(i * 7 + k) % 50}" for k in range(60))) for i in range(0, 120, 2)]
    bad = [(i, " | ".join(f"$$x{(i * 5 + k) % 50}%%" for k in range(60))) for i in range(1, 120, 2)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    model = CompressionClassifier.fit(docs.where("doc_id < 80"), labels)
    held = model.score(docs.where("doc_id >= 80")).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    again = CompressionClassifier.fit(docs.where("doc_id < 80").repartition(7), labels)
    assert (again.good, again.bad, again.weights) == (model.good, model.bad, model.weights)
    out = model.score(odd.withColumn("Score", F.lit(1)))
    assert out.columns == [*odd.columns, "feature", "score", "predicted"]
    assert out.where("score IS NULL OR score < 0 OR score > 1 OR predicted NOT IN (0, 1)").count() == 0
    assert len({(r.score, r.predicted) for r in out.where("doc_id IN (1, 2)").collect()}) == 1
    assert model.score(none).collect() == []
    one = CompressionClassifier.fit(docs, labels.where("quality = 1"))
    assert one.score(docs).where("predicted != 1").count() == 0
    assert CompressionClassifier.fit(none, labels).score(odd).select("score").distinct().first().score == 0.5


def test_classifier_on_held_out_labels(spark, sf):
    from provena.llm.queries import op10_quality_classifier

    sf = sf.replace("sf0.001", "sf0.01")
    out = op10_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.9 * len(out) > 40
    good, bad = ([r.score for r in out if r.quality == q] for q in (1, 0))
    # the share of (good, bad) pairs in the right order doesn't profit from most labels being good
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_samples_are_spread_over_the_text(spark):
    text = "".join(chr(97 + i // 1000) for i in range(20_000))
    got = spark.createDataFrame([(text,), ("short",)], "t string").select(spread_pieces(F.col("t"))).collect()
    assert got[1][0] == "short" and len(got[0][0]) == 4000
    assert got[0][0][:1000] == text[:1000] and got[0][0][-1000:] == text[-1000:]


def test_digest_is_of_the_text(spark):
    assert spark.range(1).select(F.sha2(F.lit("é"), 256)).first()[0] == hashlib.sha256("é".encode()).hexdigest()
