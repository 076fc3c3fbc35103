"""Operator 13: ranked lexical search over a tiered impact index.

A posting's impact on an item is its term's weight times a saturating share of the term's count in the document, all in
64-bit integers (:func:`term_weight`, :func:`contributions`).

1. *Forward rows.* One pass over the texts counts each document's terms and those of the query set's vocabulary.
2. *Index.* With the corpus counts known, every posting gets its impact and falls into a tier by it: the rarest terms
   and the highest counts come first, whichever term they belong to. A document's postings of one tier are a pair of
   array columns, so reading the first tiers of the table reads those columns' chunks only. For each tier and term the
   highest impact in lower tiers is the term's residual bound.
3. *Search.* Items in blocks are scored against all rows of the tiers read so far. A row's score so far is a lower
   bound; with the residual bounds of its missing terms it is an upper bound. Each task keeps the ``k`` best lower bounds
   of each item and the highest upper bound among all other rows. An item whose ``k``-th best lower bound is above
   that has its documents; items without this proof fall through to the next tier. Behind the last tier nothing is
   left, so bounds are scores. The documents of items proved early are then scored in full.

Nothing is dealt by term, so frequent words make no hot task; what a task gives out is ``k`` rows an item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.llm.common import write_table
from provena.llm.wordarrays import text_slices

#: Shares of the postings in the first tiers; the last one has the rest.
TIER_SHARES = (0.1, 0.3)
#: Postings' impacts at the tiers' edges are estimated on about this many documents (the result does not hang on them).
SAMPLE_DOCS = 20_000
#: Distinct terms of the items that share an index, and that are searched at once; items searched at once.
INDEX_TERMS, BLOCK_TERMS, BLOCK_ITEMS = 200_000, 16_384, 256
#: Rows that a task scores at once.
SCORE_ROWS = 512
_NO_ID = (1 << 63) - 1
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters, digits and other characters beyond ASCII; A-Z lower-cased."""
    return text.translate(_KEEP).split()


def term_weight(documents: int, holding: int) -> int:
    """A term's weight by the documents that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def contributions(weights: np.ndarray, counts: np.ndarray, length: np.ndarray | int, documents: int, total: int) -> np.ndarray:
    """Impacts of postings: weight, count in the document, and the document's terms against the mean."""
    m = 25 + (75 * length * documents) // total
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times) of each row of the query set, numbered; as a written table."""
    kind = items.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            out = [(n, i, t, c) for n, i, text in zip(batch.column("item"), batch.column("item_id"), batch.column("text").cast(pa.large_binary()), strict=True) for t, c in Counter(terms_of(text.as_py() or b"")).items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[0].as_py() for o in out], pa.int64()), pa.array([o[1].as_py() for o in out], batch.schema.field("item_id").type), pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.int64())], ["item", "item_id", "term", "times"])

    numbers = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
    return write_table(numbers.mapInArrow(rows, f"item long, item_id {kind}, term binary, times long"), "item-terms")


class TieredIndex:
    """Postings of all documents for a vocabulary, in tiers of falling impact.

    ``rows`` is a written table of a row for each document that holds a term: row (its number), doc_id, and for tier
    ``j`` the arrays ``t{j}`` (term numbers) and ``c{j}`` (impacts). ``bounds[j]`` holds for each term the highest
    impact in the tiers below ``j``.
    """

    def __init__(self, rows: DataFrame, vocabulary: list[bytes], tiers: int, bounds: list[np.ndarray]):
        self.rows, self.vocabulary, self.tiers, self.bounds = rows, vocabulary, tiers, bounds
        self.number = {t: i for i, t in enumerate(vocabulary)}

    @classmethod
    def build(cls, docs: DataFrame, vocabulary: Sequence[bytes], *, id_col: str = "doc_id", text_col: str = "text", shares: Sequence[float] = TIER_SHARES) -> TieredIndex:
        """Index every row of ``docs``; lengths and document counts are those of whole texts and the whole table."""
        spark, vocabulary = docs.sparkSession, sorted(set(vocabulary))
        if len(vocabulary) > INDEX_TERMS:
            raise ValueError(f"{len(vocabulary)} terms; an index takes {INDEX_TERMS} at most")
        known = spark.sparkContext.broadcast(vocabulary)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = {t: i for i, t in enumerate(known.value)}
            for batch in text_slices(batches, "text"):
                lengths, sizes, terms, times = [], [], [], []
                for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                    words = terms_of(text or b"")
                    own = Counter(words)
                    held = own.keys() & number.keys()
                    lengths.append(len(words))
                    sizes.append(len(held))
                    terms += [number[t] for t in held]
                    times += [own[t] for t in held]
                at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))], ["doc_id", "n", "terms", "times"])

        texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
        counted = texts.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<long>")
        forward = write_table(counted.withColumn("row", F.monotonically_increasing_id()), "term-counts")
        documents, total, postings, refused = forward.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.count(F.when(F.col("doc_id") == _NO_ID, 1))).first()
        if refused:
            raise ValueError(f"a document id of {_NO_ID} can't be ranked")
        holding = dict(map(tuple, forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect())) if postings else {}
        weights = spark.sparkContext.broadcast(np.array([term_weight(documents, holding.get(i, 0)) for i in range(len(vocabulary))], np.int64))
        tiers = len(shares) + 1

        def impacts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Row of the batch, term and impact of each posting."""
            at, terms, times = _lists(batch, "terms", "times")
            size = np.diff(at)
            return np.repeat(np.arange(batch.num_rows), size), terms, contributions(weights.value[terms], times, np.repeat(batch.column("n").to_numpy(), size), documents, total)

        def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(impacts(batch)[2])], ["c"])

        share = min(1.0, SAMPLE_DOCS / max(1, documents))
        sample = forward.where("size(terms) > 0").where(F.xxhash64("row") <= min(_NO_ID, int((share - 0.5) * 2 * _NO_ID))).select("n", "terms", "times")
        levels = [1 - sum(shares[: j + 1]) for j in range(len(shares))]
        cuts = (sample.mapInArrow(sampled, "c long").agg(F.percentile_approx("c", levels, 1000)).first()[0] if levels else None) or [1] * len(levels)

        def tiered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, term, impact = impacts(batch)
                tier = np.sum([impact < c for c in cuts], axis=0) if cuts else np.zeros(len(impact), int)
                columns = [batch.column("row"), batch.column("doc_id")]
                for j in range(tiers):
                    own = (tier == j) & (impact > 0)
                    at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[own], minlength=batch.num_rows))]).astype(np.int32))
                    columns += [pa.ListArray.from_arrays(at, pa.array(term[own], pa.int32())), pa.ListArray.from_arrays(at, pa.array(impact[own], pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)

        names = ["row", "doc_id", *(f"{x}{j}" for j in range(tiers) for x in "tc")]
        schema = ", ".join(["row long", "doc_id long", *(f"t{j} array<int>, c{j} array<long>" for j in range(tiers))])
        rows = write_table(forward.where("size(terms) > 0").select("row", "doc_id", "n", "terms", "times").mapInArrow(tiered, schema), "tiered-index")
        below = np.zeros(len(vocabulary), np.int64)
        bounds = [below]
        for j in range(tiers - 1, 0, -1):
            below = below.copy()
            for t, most in rows.select(F.explode(F.arrays_zip(f"t{j}", f"c{j}")).alias("p")).groupBy(F.col(f"p.t{j}").alias("t")).agg(F.max(f"p.c{j}")).collect():
                below[t] = max(below[t], most)
            bounds.insert(0, below)
        return cls(rows, vocabulary, tiers, bounds)

    def search(self, terms: Sequence[tuple[int, bytes, int]], k: int) -> DataFrame | None:
        """(item, row, doc_id, score, tier) of the ``k`` best documents of items given as (item, term, times)."""
        numbers = sorted({i for i, _, _ in terms})
        of_item = {i: n for n, i in enumerate(numbers)}
        own = sorted({self.number[t] for _, t, _ in terms if t in self.number})
        local = np.full(len(self.vocabulary) + 1, -1, np.int64)
        local[own] = np.arange(len(own))
        times = np.zeros((len(own), len(numbers)), np.int64)
        for i, t, n in terms:
            if t in self.number:
                times[local[self.number[t]], of_item[i]] += n
        rows, left, proved, found = self.rows, list(range(len(numbers))), [], []
        spark = rows.sparkSession
        for j in range(self.tiers):
            if not left:
                break
            shared = spark.sparkContext.broadcast((local, times[:, left], self.bounds[j][own]))
            columns = [f"{x}{i}" for i in range(j + 1) for x in "tc"]
            told = write_table(rows.select("row", "doc_id", *columns).mapInArrow(_scored(shared, j + 1, k), "item int, row long, doc_id long, low long, high long"), "tier-scores")
            best = W.partitionBy("item").orderBy(F.col("low").desc(), F.col("doc_id").asc_nulls_last(), "row")
            ranked = told.where("row IS NOT NULL").withColumn("rank", F.row_number().over(best))
            if j == self.tiers - 1:
                kept = ranked.where(F.col("rank") <= k).select("item", "row", "doc_id", F.col("low").alias("score"))
                found.append(self._named(kept, [numbers[i] for i in left], j))
                break
            kept = write_table(ranked.where(F.col("rank") <= k).drop("rank"), "tier-best")
            others = told.join(kept.select("item", "row"), ["item", "row"], "left_anti").groupBy("item").agg(F.max("high").alias("rest"))
            state = kept.groupBy("item").agg(F.count("*").alias("n"), F.min("low").alias("low")).join(others, "item", "left")
            good = [r[0] for r in state.where((F.coalesce("rest", F.lit(0)) == 0) | (F.col("n") >= k) & (F.col("low") > F.col("rest"))).select("item").collect()]
            if good:
                exact = self._exact(kept.where(F.col("item").isin(good)).select("item", "row"), local, times[:, left])
                found.append(self._named(exact, [numbers[i] for i in left], j))
            proved += good
            left = [i for n, i in enumerate(left) if n not in set(good)]
        out = None
        for f in found:
            out = f if out is None else out.unionByName(f)
        return out

    @staticmethod
    def _named(rows: DataFrame, numbers: list[int], tier: int) -> DataFrame:
        """Items by their numbers in the query set."""
        names = F.array(*[F.lit(n).cast("long") for n in numbers])
        return rows.select(names[F.col("item")].alias("item"), "row", "doc_id", "score", F.lit(tier).alias("tier"))

    def _exact(self, wanted: DataFrame, local: np.ndarray, times: np.ndarray) -> DataFrame:
        """The scores of chosen (item, row), at most ``k`` for each item of a block, from all tiers."""
        tiers = self.tiers
        shared = self.rows.sparkSession.sparkContext.broadcast((local, times))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            local, times = shared.value
            for batch in batches:
                items, made = batch.column("item").to_numpy(), np.zeros(batch.num_rows, np.int64)
                for j in range(tiers):
                    at, terms, impact = _lists(batch, f"t{j}", f"c{j}")
                    row, own = np.repeat(np.arange(batch.num_rows), np.diff(at)), local[terms]
                    use = own >= 0
                    np.add.at(made, row[use], impact[use] * times[own[use], items[row[use]]])
                yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("row"), batch.column("doc_id"), pa.array(made)], ["item", "row", "doc_id", "score"])

        joined = self.rows.join(F.broadcast(wanted), "row").select("item", "row", "doc_id", *[f"{x}{j}" for j in range(self.tiers) for x in "tc"])
        return joined.mapInArrow(score, "item int, row long, doc_id long, score long")


def _lists(batch: pa.RecordBatch, first: str, second: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and values of two list columns of equal shape."""
    a, b = batch.column(first), batch.column(second)
    at = a.offsets.to_numpy()
    return at - at[0], a.flatten().to_numpy().astype(np.int64), b.flatten().to_numpy()


def _scored(shared, tiers: int, k: int):
    """A function over index rows: the task's ``k`` best rows of each item, and one row with no number whose ``high`` bounds all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, times, bound = shared.value
        items = times.shape[1]
        # sums of whole numbers below 2**53 are exact in doubles, in any order
        exact = float(1 << 53) > times.sum(axis=0).max(initial=0) * 4.7e10
        kind = np.float64 if exact else np.int64
        partial = (local[:-1] < 0).any()
        weight, missing = times.astype(kind), (times * bound[:, None]).astype(kind)
        whole, sums = missing.sum(axis=0).astype(np.int64), missing.any()
        rest = np.zeros(items, np.int64)
        none = np.zeros(0, np.int64)
        best = [none] * 5  # item, row, id, low, high
        last = np.zeros((items, 2), np.int64)  # score and id of each item's k-th best
        last[:, 1] = _NO_ID
        for whole_batch in batches:
            for begin in range(0, whole_batch.num_rows, SCORE_ROWS):
                batch = whole_batch.slice(begin, SCORE_ROWS)
                parts = [_lists(batch, f"t{j}", f"c{j}") for j in range(tiers)]
                low = np.zeros((batch.num_rows, items), np.int64)
                high = np.broadcast_to(whole, low.shape).copy() if sums else low
                for at, terms, impact in parts:
                    own = local[terms]
                    for r in range(batch.num_rows):
                        a, b = at[r], at[r + 1]
                        if a < b:
                            t, c = own[a:b], impact[a:b]
                            if partial:
                                t, c = t[t >= 0], c[t >= 0]
                            low[r] += (c.astype(kind) @ weight[t]).astype(np.int64)
                            if sums:
                                high[r] -= missing[t].sum(axis=0).astype(np.int64)
                if sums:
                    high += low
                number = batch.column("row").to_numpy()
                ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
                enters = (low > 0) & ((low > last[:, 0]) | (low == last[:, 0]) & (ids[:, None] < last[:, 1]))
                rest = np.maximum(rest, np.where(enters, 0, high).max(axis=0, initial=0))
                r, i = np.nonzero(enters)
                if len(r):
                    best = [np.concatenate(x) for x in zip(best, (i, number[r], ids[r], low[r, i], high[r, i]), strict=True)]
                    order = np.lexsort((best[1], best[2], -best[3], best[0]))
                    best = [x[order] for x in best]
                    begins = np.searchsorted(best[0], np.arange(items))
                    nth = np.arange(len(order)) - begins[best[0]]
                    np.maximum.at(rest, best[0][nth >= k], best[4][nth >= k])
                    best = [x[nth < k] for x in best]
                    full = nth[nth < k] == k - 1
                    last[best[0][full]] = np.column_stack([best[3][full], best[2][full]])
        out = [np.concatenate(x) for x in zip(best, (np.arange(items), np.zeros(items, np.int64), np.zeros(items, np.int64), np.zeros(items, np.int64), rest), strict=True)]
        other = np.arange(len(out[0])) >= len(best[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0].astype(np.int32)), pa.array(out[1].astype(np.int64), mask=other), pa.array(out[2].astype(np.int64), mask=other | (out[2] == _NO_ID)), pa.array(out[3].astype(np.int64)), pa.array(out[4].astype(np.int64))],
            ["item", "row", "doc_id", "low", "high"],
        )

    return run


RESULT = ["item_id", "rank", "doc_id", "score", "tier"]


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shares: Sequence[float] = TIER_SHARES) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each row of ``items``; equal scores by ascending id.

    Returns item_id, rank (from 1), doc_id, score and ``tier``, the number (from 0) of the last tier that the item's
    proof took. A null or empty text has no terms; such items have no rows. Each row of either table counts for
    itself, whatever its id: repeated documents are ranked one after another, null ids behind others of the same
    score, and an item id that occurs twice is answered twice. The largest 64-bit id is refused. Other columns are
    not read; an empty table on either side gives no rows. The query set may have any number of items; they share
    indexes of at most ``INDEX_TERMS`` terms, and an item with more than half of that may be refused.
    """
    spark, terms = docs.sparkSession, item_terms(items, item_col, item_text_col)
    sizes = terms.groupBy("item").agg(F.count("*").alias("size"))
    before = F.sum("size").over(W.orderBy("item"))
    places = write_table(sizes.select("item", "size", F.floor((before - 1) / (INDEX_TERMS // 2)).alias("batch")), "item-places")
    answers: list[DataFrame] = []
    for (batch,) in places.select("batch").distinct().orderBy("batch").collect():
        own = [(r.item, r.size) for r in places.where(F.col("batch") == batch).orderBy("item").collect()]
        index = None
        for block in _blocks(own):
            rows = [(r.item, bytes(r.term), r.times) for r in terms.where(F.col("item").between(block[0], block[-1])).select("item", "term", "times").collect()]
            if index is None:
                wanted = terms.where(F.col("item").between(own[0][0], own[-1][0])).select("term").distinct().collect()
                index = TieredIndex.build(docs, [bytes(r.term) for r in wanted], id_col=id_col, text_col=text_col, shares=shares)
            found = index.search(rows, k)
            answers += [found] if found is not None else []
    kind = items.schema[item_col].dataType.simpleString()
    if not answers:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long, tier int")
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    best = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    named = terms.select("item", "item_id").distinct()
    return out.withColumn("rank", F.row_number().over(best)).join(named, "item").select(*RESULT)


def _blocks(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Items in order, so many at once that their terms and they themselves stay within the block's limits."""
    block, held = [], 0
    for item, size in sizes:
        if block and (len(block) >= BLOCK_ITEMS or held + size > BLOCK_TERMS):
            yield block
            block, held = [], 0
        block.append(item)
        held += size
    if block:
        yield block
