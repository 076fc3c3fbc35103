"""Operator 11: a Merkle manifest of a dataset, by an associative forest of unresolved nodes.

Rows are leaves. The leaves of a tree (here: of a language) ascend by id; while a level has more than one node, each
run of ``ARITY`` consecutive nodes becomes its parent. The roots of the trees, in order, are the leaves of one more
tree, whose root is the dataset's. As the number of leaves is counted first, the arity of every run is known.

1. *Positions.* Leaf digests, not texts, are dealt by ranges and sorted; prefix sums of the partitions' sizes give
   every leaf its place in its tree.
2. *Fragments.* A partition folds its leaves, read in order, into a sparse forest: nodes keyed by tree, level and
   index. Whenever all nodes of a run have met, their parent takes their place. What is left are the few nodes at
   the partition's edges.
3. *Tree reduction.* Fragments of neighbouring partitions are merged by the same rule, ``FAN_IN`` at a time and round
   by round, until one holds the root; each round is a written table, so a lost executor repeats one merge. Merging is
   associative, and any split of the leaves gives the same root. The driver sees the root only. Unlike an RDD's
   ``treeReduce`` the rounds also give out the runs that they complete, since proofs need them.
4. *Proofs.* Runs from level ``BLOCK_LEVEL`` up are joined from the root down into the upper part of each block's proof
   (a row for each ``ARITY ** BLOCK_LEVEL`` leaves); a block's leaves then meet that one row and fold the levels below
   themselves. No group has more than ``ARITY ** BLOCK_LEVEL`` leaves, whatever the sizes of the trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.llm.common import default_parallelism, join_sized, write_table

ARITY, BLOCK_LEVEL, FAN_IN = 8, 3, 64
#: The tree over the other trees' roots.
TOP = -1
NODE = "struct<tree: long, level: int, place: long, width: long, digest: string>"
FRAGMENT = f"kind string, part long, nodes array<{NODE}>"
_NODES = pa.list_(pa.struct([("tree", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("width", pa.int64()), ("digest", pa.string())]))
_FRAGMENT = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("nodes", _NODES)])
PROOF = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PROOF = pa.schema([("id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])
_ROW_BITS = 33


def digest_of(*parts: str) -> str:
    """The lower-case hex SHA-256 of texts put together; digests enter as hex."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(*columns: Column) -> Column:
    """A row's leaf: each value as its UTF-8 byte count, a colon and the value, or a dash where it is null."""
    told = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*told), 256)


class Forest:
    """Nodes whose runs are not complete yet; ``add`` resolves every run that a node completes.

    ``trees`` is the number of trees: a tree's root becomes a leaf of the tree over all. Complete runs of level
    ``keep`` and above, and all of the top tree, are put on ``done``, roots on ``roots``.
    """

    def __init__(self, trees: int, keep: int = BLOCK_LEVEL):
        self.trees, self.keep = trees, keep
        self.open: dict[tuple[int, int, int], dict[int, tuple[int, str]]] = {}
        self.done: list[list[tuple]] = []
        self.roots: list[tuple] = []

    def add(self, tree: int, level: int, place: int, width: int, digest: str) -> None:
        while True:
            if width == 1:
                self.roots.append((tree, level, place, width, digest))
                if tree == TOP:
                    return
                tree, level, place, width = TOP, 0, tree, self.trees
                continue
            first = place - place % ARITY
            run = self.open.setdefault((tree, level, first), {})
            run[place - first] = (width, digest)
            arity = min(ARITY, width - first)
            if len(run) < arity:
                return
            del self.open[tree, level, first]
            if level >= self.keep or tree == TOP:
                self.done.append([(tree, level, first + k, width, run[k][1]) for k in range(arity)])
            digest = digest_of(*(run[k][1] for k in range(arity)))
            level, place, width = level + 1, first // ARITY, -(-width // ARITY)

    def flush(self, part: int, every: bool = True) -> Iterator[tuple[str, int, list]]:
        """Fragment rows: completed runs and roots, and (with ``every``) the nodes that are left."""
        yield from (("run", part, run) for run in self.done)
        yield from (("root", part, [root]) for root in self.roots)
        self.done, self.roots = [], []
        if every:
            left = [(tree, level, first + k, width, digest) for (tree, level, first), run in self.open.items() for k, (width, digest) in run.items()]
            self.open = {}
            if left:
                yield "open", part, left


def _batch(rows: list[tuple[str, int, list]]) -> pa.RecordBatch:
    names = [f.name for f in _NODES.value_type]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[dict(zip(names, n, strict=True)) for n in r[2]] for r in rows], _NODES)], schema=_FRAGMENT)


def numbered(rows: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """The rows, with ``part`` (a range of the order) and ``nth``, their place from 0 in the order over all ranges.

    A range's rows lie sorted in one file, so a scan meets them in order.
    """
    dealt = rows.repartitionByRange(default_parallelism(rows.sparkSession), *order).sortWithinPartitions(*order)
    at = write_table(dealt.withColumn("__at", F.monotonically_increasing_id()), label).withColumn("part", F.shiftright("__at", _ROW_BITS))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = at.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    placed = join_sized(at, write_table(bases, f"{label}-bases"), "part", "inner")
    return placed.withColumn("nth", F.col("__base") + F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)).drop("__at", "__base")


@dataclass
class Manifest:
    """The leaves with their places (id, tree key, leaf, altered, part, tree, place, width), the runs, and the roots."""

    leaves: DataFrame
    runs: DataFrame
    roots: DataFrame
    root: str | None

    def subroots(self) -> DataFrame:
        """(key, leaves, subroot) of each tree."""
        own = self.roots.where(F.col("tree") != TOP).select("tree", F.col("digest").alias("subroot"))
        return self.leaves.groupBy("tree", "key").agg(F.count("*").alias("leaves")).join(own, "tree").drop("tree")


def _folded(leaves: DataFrame, trees: int) -> DataFrame:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, part = Forest(trees), None
        for batch in batches:
            out: list = []
            for own, *node in zip(*(batch.column(c).to_pylist() for c in ("part", "tree", "place", "width", "leaf")), strict=True):
                if own != part:
                    out += forest.flush(part) if part is not None else []
                    part = own
                forest.add(node[0], 0, *node[1:])
            out += forest.flush(part, every=False)
            if out:
                yield _batch(out)
        if part is not None:
            yield _batch(list(forest.flush(part)))

    return leaves.select("part", "tree", "place", "width", "leaf").mapInArrow(fold, FRAGMENT)


def _reduced(fragments: DataFrame, trees: int) -> list[DataFrame]:
    """The written rounds of the reduction, the first one included; the last one has no open node."""
    rounds = [fragments]
    size = fragments.where("kind = 'open'").agg(F.max("part")).first()[0]

    def merge(table: pa.Table) -> pa.Table:
        forest, part = Forest(trees), table.column("group")[0].as_py()
        for nodes in table.column("nodes").to_pylist():
            for node in nodes:
                forest.add(**node)
        rows = list(forest.flush(part))
        return pa.Table.from_batches([_batch(rows)] if rows else [], _FRAGMENT)

    while size is not None:
        groups = -(-(size + 1) // FAN_IN)
        group = F.floor(F.col("part") * groups / (size + 1)).cast("long")
        merged = rounds[-1].where("kind = 'open'").withColumn("group", group).groupBy("group").applyInArrow(merge, FRAGMENT)
        rounds.append(write_table(merged, "merkle-round"))
        size = groups - 1 if groups > 1 else None
    return rounds


def build_manifest(docs: DataFrame, columns: Sequence[str], *, id_col: str = "doc_id", tree_col: str = "lang", altered: Column | None = None) -> Manifest:
    """The Merkle manifest of ``docs``: a leaf of each row's ``columns``, a tree for each value of ``tree_col``.

    Leaves of a tree ascend by ``id_col`` (an integer, null first; rows with one id by their leaves), trees by
    ``tree_col`` (null first, UTF-8 bytewise). ``altered``, if given, is a second digest of the rows for which it is
    not null, which :func:`proofs` folds in place of the leaf. Nulls in any column are told from empty texts;
    repeated rows are leaves of their own; other columns are not read. An empty table has no root.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{tree_col}`").cast("string").alias("key"),
        row_digest(*[F.col(f"`{c}`") for c in columns]).alias("leaf"),
        (F.lit(None).cast("string") if altered is None else altered).alias("altered"),
    )
    order = [F.col("key").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf")]
    placed = numbered(write_table(rows, "merkle-leaves"), order, "merkle-sorted")
    kinds = placed.groupBy("key").agg(F.min("nth").alias("first"), F.count("*").alias("width"))
    trees = write_table(numbered(kinds, [F.col("key").asc_nulls_first()], "merkle-trees").select(F.col("key").alias("of"), F.col("nth").alias("tree"), "first", "width"), "merkle-tree-places")
    leaves = join_sized(placed, trees, F.col("key").eqNullSafe(F.col("of")), "inner").withColumn("place", F.col("nth") - F.col("first")).drop("of", "first", "nth")
    count = trees.count()
    rounds = _reduced(write_table(_folded(leaves, count), "merkle-fragments"), count)
    told = rounds[0]
    for r in rounds[1:]:
        told = told.unionByName(r)
    roots = told.where("kind = 'root'").select(F.explode("nodes").alias("n")).select("n.*")
    top = roots.where(F.col("tree") == TOP).select("digest").head(1)
    return Manifest(leaves, told.where("kind = 'run'").select("nodes"), roots, top[0][0] if top else None)


def _upper(manifest: Manifest) -> DataFrame:
    """(tree, block, subroot, upper): the siblings of each block's node from its level to the root, as (left, right) texts."""
    kids = manifest.runs.select("nodes", F.posexplode("nodes").alias("pos", "n"))
    side = lambda what: F.array_join(F.transform(F.filter("nodes", what), lambda n: n["digest"]), "")
    place = F.col("n.place")
    beside = kids.select("n.tree", "n.level", "n.place", F.struct(side(lambda n: n["place"] < place).alias("left"), side(lambda n: n["place"] > place).alias("right")).alias("pair"))
    beside = write_table(beside, "merkle-siblings")
    heights = manifest.roots.groupBy((F.col("tree") == TOP).alias("top")).agg(F.max("level")).collect()
    height = {r[0]: r[1] for r in heights}
    none = F.array().cast("array<struct<left: string, right: string>>")

    def below(parents: DataFrame, level: int, tops: bool) -> DataFrame:
        """The children's siblings in front of their parents'."""
        own = beside.where((F.col("level") == level) & (F.col("tree") == TOP if tops else F.col("tree") != TOP))
        of = parents.withColumnsRenamed({"place": "of", "tree": "at"})
        return own.join(of, (F.col("tree") == F.col("at")) & (F.floor(F.col("place") / ARITY) == F.col("of"))).select("tree", "place", F.concat(F.array("pair"), "upper").alias("upper"))

    roots = manifest.roots
    top = roots.where(F.col("tree") == TOP).select("tree", "place", none.alias("upper"))
    for level in range(height.get(True, 0) - 1, -1, -1):
        top = below(top, level, True)
    subroots = roots.where(F.col("tree") != TOP).select("tree", "level", "digest")
    starts = write_table(subroots.join(top.select(F.col("place").alias("of"), "upper"), F.col("tree") == F.col("of")).select("tree", "level", F.col("digest").alias("subroot"), "upper"), "merkle-tops")
    begun = lambda rule: starts.where(rule).select("tree", F.lit(0).cast("long").alias("place"), "upper")
    nodes = begun(F.col("level") >= max(BLOCK_LEVEL, height.get(False, 0)))
    for level in range(height.get(False, 0) - 1, BLOCK_LEVEL - 1, -1):
        nodes = below(nodes, level, False).unionByName(begun(F.col("level") == level))
    nodes = nodes.unionByName(begun(F.col("level") < BLOCK_LEVEL))
    return write_table(nodes.withColumnRenamed("place", "block").join(starts.select("tree", "subroot"), "tree"), "merkle-upper")


def proofs(manifest: Manifest) -> DataFrame:
    """One row for each leaf: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` is the digest of the leaf's siblings, level by level up to the root and left to right;
    ``folded_root`` is recomputed from the altered digest, where there is one, or the leaf and those siblings;
    ``verified`` tells whether it equals the root.
    """
    root = manifest.root

    def prove(leaves: pa.Table, above: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("place")
        upper = above.column("upper")[0].as_py()
        tail = [(p["left"], p["right"]) for p in upper]
        subroot, width = above.column("subroot")[0].as_py(), leaves.column("width")[0].as_py()
        own = level = leaves.column("leaf").to_pylist()
        paths: list[list[tuple[str, str]]] = []  # of each level: the digests left and right of each node
        while width > 1 and len(paths) < BLOCK_LEVEL:
            runs = [level[k : k + ARITY] for k in range(0, len(level), ARITY)]
            paths.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))])
            level, width = [digest_of(*run) for run in runs], -(-width // ARITY)
        out = []
        for k, (i, leaf, other) in enumerate(zip(leaves.column("id").to_pylist(), own, leaves.column("altered").to_pylist(), strict=True)):
            path = [p[k // ARITY**n] for n, p in enumerate(paths)] + tail
            folded = other or leaf
            for left, right in path:
                folded = digest_of(left, folded, right)
            out.append((i, leaf, subroot, root, digest_of(*(x for pair in path for x in pair)), folded, folded == root))
        return pa.Table.from_arrays([pa.array([o[n] for o in out], f.type) for n, f in enumerate(_PROOF)], schema=_PROOF)

    leaves = manifest.leaves.select("id", "leaf", "altered", "tree", "place", "width", F.floor(F.col("place") / ARITY**BLOCK_LEVEL).alias("block"))
    return leaves.groupBy("tree", "block").cogroup(_upper(manifest).groupBy("tree", "block")).applyInArrow(prove, PROOF)
