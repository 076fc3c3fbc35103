"""Operator 9: stupid-backoff language-model scores from corpus n-gram counts, as joins and sums.

1. *Vocabulary.* Words are counted over the whole corpus. The ``COMMON`` most frequent ones get small numbers, which
   are broadcast with their counts (a bounded table); any other word is its 62-bit hash, with a negative sign.
2. *Exploded n-grams.* Every position becomes a row (text, n-gram) of these codes. A text is a number too: so many
   bits of its hash as tell all texts apart, which is checked.
3. *Counts.* Rows are dealt by n-gram, and counted and joined in one exchange. A pair's rows go to the partition of its
   rarer word: of two common words to that of the pair, with a rare word to that word's own (of two rare words to
   both), so that the pair's count and the rare word's meet there; common words' counts come by broadcast.
4. *Scores.* Each row's log score depends on these counts only; they are summed for each text, with partial sums
   before the shuffle, and joined to the documents.

No key can be hot: pairs of the ``HOT`` most frequent words, bounded in number, are counted before the shuffle and
their counts broadcast, so they never become rows. Any other pair holds a word outside those, hence at most one in
``HOT`` of all words; a rare word holds at most one in ``COMMON``.

Orders above 2 add, for each order, what its seen n-grams gain over backing off: a table of n-gram counts joined to
that of the order below by prefix and suffix, then to the exploded n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.llm.common import without, write_table
from provena.llm.wordarrays import Words, text_slices

#: The published backoff factor.
BACKOFF = 0.4
#: Words with numbers and broadcast counts; the most frequent of them, whose pairs are counted before the shuffle.
COMMON, HOT = 65_536, 1024
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: Bytes of text that a task explodes at once.
SLICE = 1 << 20
OUTPUTS = ("n_words", "log_score", "mean_log_score", "n_backed_off")
#: Which word of its pair a row's rare word is: the lowest bit of the other word's code.
_FIRST, _SECOND = 0, 1
#: The word before a document's first one: no hash is this number but with probability 2 ** -62.
_START = -(1 << 62)


def _rare(hashes: np.ndarray) -> np.ndarray:
    return (hashes | np.uint64(1 << 63)).view(np.int64) & ~np.int64(1)


def text_numbers(docs: DataFrame, text: Column) -> Column:
    """A number for each distinct text: the fewest bits of its hash that are likely to tell all texts apart.

    Texts that share a number all the same are found by a second hash and numbered by that one.
    """
    n = docs.count()
    bits = min(64, max(32, 2 * n.bit_length() + 4))
    number = lambda seed: F.shiftrightunsigned(F.xxhash64(F.lit(seed), text), 64 - bits) if bits < 64 else F.xxhash64(F.lit(seed), text)
    seen = docs.select(number(0).alias("t"), F.xxhash64(F.lit(2), text).alias("h")).groupBy("t").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    shared = [r.t for r in seen.where("low != high").limit(10_001).collect()]
    if len(shared) > 10_000:
        raise RuntimeError("too many texts with equal hashes")
    return F.when(number(0).isin(shared), -F.abs(number(1)) - 2).otherwise(number(0)) if shared else number(0)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): hashes of all words and how often the corpus holds them, as a written table."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            words, place = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            return words, np.bincount(place, np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in text_slices(batches, "text", SLICE):
            held.append(np.unique(_rare(Words(batch.column("text")).hash), return_counts=True))
            held = [merged()]
            if len(held[0][0]) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held[0]], ["word", "n"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held[0]], ["word", "n"])

    counts = docs.select("text").mapInArrow(rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return write_table(counts, "word-counts")


class Codes:
    """The numbers of the common words; other words are their own (negative) code."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.counts = counts
        self.order = np.argsort(words)
        self.words = words[self.order]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        rare = _rare(hashes)
        if not len(self.words):
            return rare
        at = np.minimum(np.searchsorted(self.words, rare), len(self.words) - 1)
        return np.where(self.words[at] == rare, self.order[at], rare)


def _positions(words: Words) -> np.ndarray:
    """The place of each word in its document."""
    return np.arange(len(words.hash)) - np.repeat(words.first[:-1], words.counts())


def _hot_pairs(docs: DataFrame, codes, hot: int) -> np.ndarray:
    """Counts of the pairs of the most frequent words, added up before the shuffle: at most ``hot`` * ``hot`` numbers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(hot * hot, np.int64)
        for batch in text_slices(batches, "text", SLICE):
            words = Words(batch.column("text"))
            c = codes.value.of(words.hash)
            a, b = c[:-1], c[1:]
            both = (a >= 0) & (a < hot) & (b >= 0) & (b < hot) & (_positions(words)[1:] > 0)
            total += np.bincount(a[both] * hot + b[both], minlength=hot * hot)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["pair", "n"])

    found = docs.select("text").mapInArrow(rows, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(hot * hot, np.int64)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out


def _own_sums(docs: DataFrame, shared, hot: int, order: int, min_count: int, backoff: float, total: int) -> DataFrame:
    """(t, score, n, backed): for each row what the broadcast counts settle, and the number of its words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, pairs = shared.value
        log1 = np.log(np.maximum(codes.counts, 1)) if len(codes.counts) else np.zeros(1)
        seen = np.log(np.maximum(pairs, 1)) - np.repeat(log1[:hot], hot)[: len(pairs)]
        settled = np.where(pairs >= min_count, seen, math.log(backoff) + np.tile(log1[:hot], hot)[: len(pairs)] - math.log(total or 1))
        for batch in text_slices(batches, "text", SLICE):
            words = Words(batch.column("text"))
            c, place = codes.of(words.hash), _positions(words)
            doc = np.repeat(np.arange(batch.num_rows), words.counts())
            first = (c >= 0) & ((place == 0) | (order == 1))
            score = np.bincount(doc[first], log1[c[first]] - math.log(total or 1), minlength=batch.num_rows).astype(np.float64)
            backed = np.zeros(batch.num_rows, np.int64)
            if order > 1 and len(c):
                a, b = c[:-1], c[1:]
                known = (a >= 0) & (a < hot) & (b >= 0) & (b < hot) & (place[1:] > 0)
                pair, of = a[known] * hot + b[known], doc[1:][known]
                score += np.bincount(of, settled[pair], minlength=batch.num_rows)
                backed += np.bincount(of[pairs[pair] < min_count], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(score, pa.float64()), pa.array(words.counts(), pa.int64()), pa.array(backed, pa.int64())], ["t", "score", "n", "backed"])

    return docs.select("t", "text").mapInArrow(rows, "t long, score double, n long, backed long")


def _pair_rows(docs: DataFrame, numbers, hot: int, order: int) -> DataFrame:
    """(t, w, o): a row for each pair, or first word, that the broadcast counts don't settle.

    ``w`` holds both words of a pair of common ones (``o`` is 0), else the rare word by which the row is dealt; then
    ``o`` is the other word's code, doubled if it is common, with the rare word's side in its lowest bit.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            words = Words(batch.column("text"))
            c, place = numbers.value.of(words.hash), _positions(words)
            doc = np.repeat(np.arange(batch.num_rows), words.counts())
            alone = (c < 0) & ((place == 0) | (order == 1))
            out = [(doc[alone], c[alone], np.full(int(alone.sum()), _START + _SECOND))]
            if order > 1 and len(c):
                two = place[1:] > 0
                a, b, d = c[:-1][two], c[1:][two], doc[1:][two]
                common = (a >= 0) & (b >= 0) & ~((a < hot) & (b < hot))
                doubled = lambda x: np.where(x < 0, x, x << 1)
                out.append((d[common], a[common] << 17 | b[common], np.zeros(int(common.sum()), np.int64)))
                out.append((d[a < 0], a[a < 0], doubled(b[a < 0]) + _FIRST))
                out.append((d[b < 0], b[b < 0], doubled(a[b < 0]) + _SECOND))
            of, w, o = (np.concatenate([x[i] for x in out]) for i in range(3))
            # in the order of documents, whose repeated numbers then compress well on their way
            order_ = np.argsort(of, kind="stable")
            yield pa.RecordBatch.from_arrays([batch.column("t").take(pa.array(of[order_])), pa.array(w[order_], pa.int64()), pa.array(o[order_], pa.int64())], ["t", "w", "o"])

    return docs.select("t", "text").mapInArrow(rows, "t long, w long, o long")


def _scored_pairs(rows: DataFrame, common: DataFrame, total: int, min_count: int, backoff: float) -> DataFrame:
    """(t, score, backed) of ``rows``, from counts within the exchange and the common words' table."""
    dealt = rows.repartition("w")
    rare, second = F.col("w") < 0, (F.col("w") < 0) & (F.col("o").bitwiseAND(1) == _SECOND)
    told = dealt.withColumns({"c2": F.count("*").over(W.partitionBy("w", "o")), "c1": F.count_if(second).over(W.partitionBy("w"))})
    seen, other, start = F.col("c2") >= min_count, F.col("o") >= 0, F.col("o") == _START + _SECOND
    need = F.when(~rare, F.when(seen, F.shiftright("w", 17)).otherwise(F.col("w").bitwiseAND((1 << 17) - 1))).when(other & (seen == second), F.shiftright("o", 1))
    told = told.withColumn("need", need).join(F.broadcast(common), F.col("need") == F.col("code"), "left")
    at = lambda n: F.log(n.cast("double"))
    low = math.log(backoff) - math.log(total or 1)
    by_seen, by_backoff = at(F.col("c2")) - at(F.col("of")), low + at(F.col("of"))
    score = (
        F.when(~rare, F.when(seen, by_seen).otherwise(by_backoff))
        .when(start, at(F.col("c1")) - math.log(total or 1))
        # of two rare words the first one's partition scores a seen pair, the second one's an unseen one
        .when(second, F.when(seen, F.when(other, by_seen).otherwise(0.0)).otherwise(low + at(F.col("c1"))))
        .otherwise(F.when(seen, at(F.col("c2")) - at(F.col("c1"))).otherwise(F.when(other, by_backoff).otherwise(0.0)))
    )
    backed = F.when(~seen & ~start & (~rare | second | other), 1).otherwise(0)
    return told.select("t", score.alias("score"), backed.cast("long").alias("backed"))


def _grams(docs: DataFrame, codes, order: int, heads: bool) -> DataFrame:
    """(t, g1 ... gN): the n-grams of each document, or only the one that it begins with."""
    names = [f"g{i + 1}" for i in range(order)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            words = Words(batch.column("text"))
            c, place = codes.value.of(words.hash), _positions(words)
            doc = np.repeat(np.arange(batch.num_rows), words.counts())
            ends = np.flatnonzero(place == order - 1 if heads else place >= order - 1)
            took = pa.array(doc[ends])
            yield pa.RecordBatch.from_arrays([batch.column("t").take(took), *(pa.array(c[ends - order + 1 + i], pa.int64()) for i in range(order))], ["t", *names])

    return docs.select("t", "text").mapInArrow(rows, ", ".join(f"{n} long" for n in ["t", *names]))


def _higher_orders(docs: DataFrame, codes, words: DataFrame, order: int, min_count: int, backoff: float) -> list[DataFrame]:
    """(t, score, backed): for each order from 3 on what it adds to the sums; backing off is counted here."""
    names = lambda k: [f"g{i + 1}" for i in range(k)]
    below = write_table(_grams(docs, codes, 2, False).groupBy("g1", "g2").agg(F.count("*").alias("c")).where(F.col("c") >= min_count), "2-grams")
    below = below.join(words.select(F.col("code").alias("g1"), F.col("of").alias("c1")), "g1").select("g1", "g2", "c", (F.log("c") - F.log("c1")).alias("s"))
    out = []
    for k in range(2, order + 1):
        if k > 2:
            own = _grams(docs, codes, k, False).groupBy(*names(k)).agg(F.count("*").alias("c")).where(F.col("c") >= min_count)
            prefix = below.select(*names(k - 1), F.col("c").alias("before"))
            suffix = below.select(*[F.col(f"g{i + 1}").alias(f"g{i + 2}") for i in range(k - 1)], F.col("s").alias("less"))
            s = F.log("c") - F.log("before")
            below = write_table(own.join(prefix, names(k - 1)).join(suffix, names(k)[1:]).select(*names(k), "c", s.alias("s"), (s - math.log(backoff) - F.col("less")).alias("gain")), f"{k}-grams")
        missed = F.col("c").isNull().cast("long")
        heads = _grams(docs, codes, k, k < order).join(below.select(*names(k), "c", *(["gain"] if k > 2 else [])), names(k), "left")
        if k == order:
            out.append(heads.select("t", (math.log(backoff) + F.coalesce("gain", F.lit(0.0))).alias("score"), missed.alias("backed")))
        else:
            out.append(heads.select("t", F.lit(0.0).alias("score"), missed.alias("backed")))
            if k > 2:
                every = _grams(docs, codes, k, False).join(below.select(*names(k), "gain"), names(k), "left")
                out.append(every.select("t", (math.log(backoff) + F.coalesce("gain", F.lit(0.0))).alias("score"), F.lit(0).cast("long").alias("backed")))
    return out


def stupid_backoff(docs: DataFrame, *, text_col: str = "text", order: int = 2, min_count: int = 2, backoff: float = BACKOFF, common: int = COMMON, hot: int = HOT) -> DataFrame:
    """Score every whole text under the stupid-backoff model of all of them.

    A word's score is count(n-gram) / count(its context) for the highest order whose n-gram the corpus holds at
    least ``min_count`` times (orders above 1), times ``backoff`` for each order skipped; at order 1 it is
    count(word) / total words. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; n-grams lie within one document.

    Returns the input's columns and ``n_words``, ``log_score`` (sum of natural logarithms), ``mean_log_score``
    (null without words), ``n_backed_off`` (words scored below the highest order that their position allows);
    input columns of these names are replaced. A null or empty text has no words and log_score 0; repeated rows
    count as often as they occur; an empty table gives an empty result. Words are told apart by 62 bits of their hash.
    """
    docs = without(docs, *OUTPUTS, "__t", "__n", "__score", "__backed")
    session, context = docs.sparkSession, docs.sparkSession.sparkContext
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    number = text_numbers(docs, text)
    texts = docs.select(number.alias("t"), text.alias("text"))

    counts = word_counts(texts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.col("n").desc(), "word").limit(common).collect()
    codes = Codes(np.array([r.word for r in top], np.int64), np.array([r.n for r in top], np.int64))
    numbers = context.broadcast(codes)
    hot = min(hot, len(top))
    pairs = _hot_pairs(texts, numbers, hot) if order > 1 and hot else np.zeros(hot * hot, np.int64)
    table = session.createDataFrame([(i, r.n) for i, r in enumerate(top)], "code long, of long")

    scored = _scored_pairs(_pair_rows(texts, numbers, hot, order), table, total, min_count, backoff)
    own = _own_sums(texts, context.broadcast((codes, pairs)), hot, order, min_count, backoff, total)
    if order > 2:
        scored, own = scored.withColumn("backed", F.lit(0).cast("long")), own.withColumn("backed", F.lit(0).cast("long"))
        every = counts.select(F.col("word").alias("code"), F.col("n").alias("of")).join(F.broadcast(session.createDataFrame([(r.word,) for r in top], "code long")), "code", "left_anti").unionByName(table)
        for more in _higher_orders(texts, numbers, every, order, min_count, backoff):
            scored = scored.unionByName(more)
    sums = scored.groupBy("t").agg(F.sum("score").alias("score"), F.sum("backed").alias("backed"))
    each = own.groupBy("t").agg(F.count("*").alias("rows"), F.first("n").alias("n"), F.first("score").alias("own_score"), F.first("backed").alias("own_backed"))
    # a text that several rows hold has as many rows of each pair
    share = lambda c: F.coalesce(F.col(c) / F.col("rows"), F.lit(0.0)) + F.col(f"own_{c}")
    told = write_table(each.join(sums, "t", "left").select(F.col("t").alias("__t"), F.col("n").alias("__n"), share("score").alias("__score"), share("backed").alias("__backed")), "text-scores")
    out = docs.withColumn("__t", number).join(told, "__t")
    names: list[Column] = [F.col(f"`{c}`") for c in docs.columns]
    mean = F.when(F.col("__n") > 0, F.col("__score") / F.col("__n"))
    return out.select(*names, F.col("__n").alias("n_words"), F.col("__score").alias("log_score"), mean.alias("mean_log_score"), F.round("__backed").cast("long").alias("n_backed_off"))
