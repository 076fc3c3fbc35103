"""Nearest vectors by an inverted-file index (D33): cells around centroids, probed cells only, exact cosine within them.

1. Equal vectors are one class; of its ids only the smallest ``k + 1`` can ever be among ``k`` neighbours, so only they
   are kept. A value that a third of all rows share is one row of the index.
2. Centroids are fitted on a bounded sample of the classes by spherical k-means; a cell that draws much more than its
   share is divided again, so that dense regions have small cells. How many cells a query has to probe is measured
   on the same sample: the smallest number whose recall among the sample's own neighbours reaches ``recall``.
3. Every row is put into its nearest cell. Cells are cut into blocks of ``BLOCK_ROWS`` by a hash, and a query meets each
   block of its cells in one small matrix product; a task holds one block and the queries' slice, never a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.storage import write_table

#: Classes that the centroids and the number of probes are fitted on, at most; queries of them that measure recall.
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 400
#: Cells, at most; a cell may draw this many times its share of the sample before it is divided.
MOST_CELLS, UNEVEN = 4096, 3
#: Rows of a block, and queries that meet it in one product.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024


def unit(v: Column) -> Column:
    """The vector at length 1 as doubles; null where it has no direction (null, empty, zero, not finite)."""
    plain = F.transform(v, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(plain, F.lit(0.0), lambda a, y: a + y * y))
    return F.transform(F.array(F.struct(plain.alias("v"), size.alias("n"))), lambda s: F.when((s["n"] > 0) & (s["n"] < float("inf")), F.transform(s["v"], lambda x: x / s["n"])))[0]


def unit_rows(ids: pa.Array, vectors: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The ids and unit vectors (a matrix) of the vectors that have a direction. Vectors of unlike length raise."""
    some = np.asarray(vectors.value_lengths()) > 0
    own = vectors.filter(pa.array(some))
    lengths = set(np.unique(own.value_lengths()).tolist())
    if len(lengths) > 1:
        raise ValueError(f"vectors have one length, not {sorted(lengths)}")
    v = own.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), *(lengths or {0}))
    size = np.sqrt(np.sum(v * v, axis=1))
    held = (size > 0) & np.isfinite(size)
    return ids.filter(pa.array(some)).filter(pa.array(held)), v[held] / size[held][:, None]


class NearestRows:
    """What may be among the ``most`` nearest of each query, once cosines are rounded to ``DIGITS`` and ordered by id where equal.

    Rows come in any number: those below a query's last place so far, by more than rounding can lift, go at once. Of
    rows with one cosine the smallest ids are enough.
    """

    SLICE_ROWS, DIGITS, HELD = 2048, 6, 1 << 18

    def __init__(self, queries: np.ndarray, most: int):
        self.queries, self.most = queries, most
        self.floor = np.full(len(queries), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, ids: pa.Array, units: np.ndarray) -> None:
        if not len(self.queries):
            return
        told = ids.to_numpy(zero_copy_only=False)
        for at in range(0, len(units), self.SLICE_ROWS):
            near = self.queries @ units[at : at + self.SLICE_ROWS].T
            last = near.shape[1] - self.most
            if last >= 0 and not np.isfinite(self.floor).all():
                self.floor = np.maximum(self.floor, np.partition(near, last, axis=1)[:, last])
            q, j = np.nonzero(near >= self._least()[:, None])
            self.held.append((q, told[at + j], near[q, j]))
            self.n += len(q)
            if self.n > max(self.HELD, 4 * self.most * len(self.queries)):
                self._drop()

    def _least(self) -> np.ndarray:
        return self.floor - 2 * 10.0**-self.DIGITS

    def _drop(self) -> None:
        q, ids, near = (np.concatenate([h[k] for h in self.held]) for k in range(3))
        order = np.argsort(ids, kind="stable")
        order = order[np.lexsort((-near[order], q[order]))]
        q, ids, near = q[order], ids[order], near[order]
        at = np.arange(len(q))
        last = at - np.searchsorted(q, q) == self.most - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], near[last])
        begins = np.ones(len(q), bool)
        begins[1:] = (q[1:] != q[:-1]) | (near[1:] != near[:-1])
        kept = (near >= self._least()[q]) & (at - np.maximum.accumulate(np.where(begins, at, 0)) < self.most)
        self.held, self.n = [(q[kept], ids[kept], near[kept])], int(kept.sum())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the query, id of the row, cosine)."""
        if self.held:
            self._drop()
        return self.held[0] if self.held else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _classes(rows: DataFrame, id_col: str, vector: str, most: int) -> DataFrame:
    """(h1, h2, v, ids): distinct directions, keyed by two hashes, and the ``most`` smallest ids of each."""
    own = rows.select(F.col(id_col).alias("id"), unit(F.col(vector)).alias("v")).where("v IS NOT NULL AND id IS NOT NULL")
    own = own.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    few = own.withColumn("nth", F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))).where(F.col("nth") <= most)
    return few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))


def _means(x: np.ndarray, cells: int, random: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors by Lloyd's steps from distinct rows; empty cells go."""
    found = x[random.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        moved = sums[size > 1e-12] / size[size > 1e-12][:, None]
        if moved.shape == found.shape and np.abs(moved - found).max() < 1e-6:
            break
        found = moved
    return found


def fit_cells(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids over a sample; a cell with more than ``UNEVEN`` times its share is divided, as long as that helps."""
    random = np.random.default_rng(seed)
    done: list[np.ndarray] = []
    todo = [(x, cells)]
    share = max(1.0, len(x) / cells) * UNEVEN
    while todo:
        part, n = todo.pop()
        found = _means(part, n, random)
        own = np.argmax(part @ found.T, axis=1)
        for k in range(len(found)):
            inside = part[own == k]
            if len(inside) > share and len(inside) < len(part):
                todo.append((inside, max(2, round(len(inside) * UNEVEN / share))))
            else:
                done.append(found[k])
    return np.array(done)


def _recall_probes(x: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """The fewest probed cells with which the sample's own neighbours are found at this rate."""
    own = np.argmax(x @ centroids.T, axis=1)
    asked = x[: min(SAMPLE_QUERIES, len(x))]
    order = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)  # the turn in which a query probes a cell
    near = asked @ x.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2
    best = np.argsort(-near, axis=1)[:, : min(k, max(1, len(x) - 1))]
    turns = np.sort(order[np.arange(len(asked))[:, None], own[best]].ravel())
    return int(turns[min(len(turns) - 1, int(np.ceil(recall * len(turns))) - 1)]) + 1


def _near_cells(df: DataFrame, centroids: np.ndarray, most: int) -> DataFrame:
    """``cells`` of each row's vector ``v``, nearest first."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            made = []
            for at in range(0, len(v), 1024):
                near = -(v[at : at + 1024] @ shared.value.T)
                top = np.argpartition(near, most - 1, axis=1)[:, :most] if most < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
                made.append(np.take_along_axis(top, np.argsort(np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1))
            cells = np.concatenate(made) if made else np.zeros((0, most), int)
            at = np.arange(len(cells) + 1, dtype=np.int32) * (cells.shape[1] if len(cells) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(cells.ravel().astype(np.int32)))], [*batch.schema.names, "cells"])

    return df.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in df.dtypes)}, cells array<int>")


@dataclass
class VectorIndex:
    """``rows`` (cell, block, v, ids) as a written table, the centroids, the blocks of each cell, and how many cells to probe."""

    rows: DataFrame
    blocks: DataFrame
    centroids: np.ndarray
    probes: int
    k: int

    @classmethod
    def build(cls, rows: DataFrame, id_col: str, vector: str, *, k: int = 5, recall: float = 0.97, cells: int | None = None, probes: int | None = None) -> VectorIndex | None:
        """Index every row with a direction; None where there is none. Vectors have one length.

        Null vectors, zero vectors and null ids are not found; rows that repeat an id and vector count once. ``k`` is
        the most neighbours that a search may ask for. Without ``cells`` there are as many as the root of the classes.
        """
        classes = write_table(_classes(rows, id_col, vector, k + 1), "vector-classes")
        n = classes.count()
        if not n:
            return None
        sample = np.array([r.v for r in classes.orderBy("h1", "h2").limit(SAMPLE_ROWS).select("v").collect()])
        centroids = fit_cells(sample, min(cells or max(1, round(n**0.5)), MOST_CELLS, len(sample)))
        probes = probes or _recall_probes(sample, centroids, k, recall)
        placed = _near_cells(classes, centroids, 1).withColumn("cell", F.col("cells")[0]).drop("cells")
        placed = write_table(placed, "vector-cells")
        blocks = write_table(placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n_blocks")), "vector-blocks")
        dealt = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod("h1", F.col("n_blocks")).cast("int"))
        return cls(write_table(dealt.select("cell", "block", "v", "ids"), "vector-index"), blocks, centroids, probes, k)

    def search(self, queries: DataFrame, id_col: str, vector: str, k: int | None = None) -> DataFrame:
        """(query_id, rank, found_id, cosine): up to ``k`` neighbours of each query but itself, equal cosines by id."""
        k = min(k or self.k, self.k)
        own = queries.select(F.col(id_col).alias("query_id"), unit(F.col(vector)).alias("v")).where("v IS NOT NULL")
        own = write_table(own.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}), "vector-queries")
        asked = own.groupBy("h1", "h2").agg(F.first("v").alias("v"))
        probed = _near_cells(asked, self.centroids, min(self.probes, len(self.centroids))).select("h1", "h2", "v", F.explode("cells").alias("cell"))
        met = probed.join(F.broadcast(self.blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        # a block that very many queries ask is met by slices of them
        slices = write_table(met.select("h1", "h2", "v", "cell", "block"), "vector-probes")
        counts = slices.groupBy("cell").agg(F.ceil(F.count_distinct("h1") / QUERY_ROWS).cast("int").alias("n_slices"))
        counts = write_table(counts, "vector-slices")
        left = slices.join(F.broadcast(counts), "cell").withColumn("slice", F.pmod("h2", F.col("n_slices")).cast("int")).drop("n_slices")
        right = self.rows.join(F.broadcast(counts), "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1))).drop("n_slices")
        keys = ["cell", "block", "slice"]
        kind = self.rows.schema["ids"].dataType.elementType.simpleString()
        most = self.k + 1

        def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
            out = []
            if len(asked) and len(rows):
                q, r = (t.column("v").combine_chunks().flatten().to_numpy().reshape(len(t), -1) for t in (asked, rows))
                near, ids = q @ r.T, rows.column("ids").to_pylist()
                first = np.array([i[0] for i in ids], dtype=object)
                for n, (h1, h2) in enumerate(zip(asked.column("h1").to_pylist(), asked.column("h2").to_pylist(), strict=True)):
                    floor = np.partition(near[n], -most)[-most] if len(ids) > most else -2
                    best = sorted(np.flatnonzero(near[n] >= floor), key=lambda j: (-near[n][j], first[j]))[:most]
                    out += [(h1, h2, i, float(near[n][j])) for j in best for i in ids[j]]
            return pa.Table.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], rows.schema.field("ids").type.value_type), pa.array([o[3] for o in out], pa.float64())], ["h1", "h2", "found_id", "cosine"])

        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"h1 long, h2 long, found_id {kind}, cosine double")
        best = W.partitionBy("h1", "h2").orderBy(F.col("cosine").desc(), "found_id")
        few = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most).drop("nth")
        told = own.drop("v").join(few, ["h1", "h2"]).where(F.col("query_id") != F.col("found_id"))
        last = W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "found_id")
        ranked = told.withColumn("rank", F.row_number().over(last).cast("bigint")).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "found_id", F.round("cosine", 6).alias("cosine"))


def recall_of(found: DataFrame, exact: DataFrame) -> float | None:
    """The share of the exact neighbours (query_id, found_id) that were found; a neighbour of the same cosine counts too."""
    worst = exact.groupBy("query_id").agg(F.min("cosine").alias("least"), F.count("*").alias("n"))
    hits = worst.join(found, "query_id", "left").groupBy("query_id", "n").agg(F.count(F.when(F.col("cosine") >= F.col("least") - 1e-6, 1)).alias("hits"))
    return hits.agg(F.sum(F.least("hits", "n")) / F.sum("n")).first()[0]
