"""Operator 2: n-gram Jaccard join by a MinHash LSH forest, with exact verification.

1. *Classes.* Documents with equal shingle sets are one class; only its representative (smallest id) goes on. However
   many copies there are, they are never expanded into pairs.
2. *Forest.* A signature of ``trees * depth`` minhashes is cut into ``trees`` labels. A tree's labels form a prefix
   trie, whose nodes of each level are a table (level, key, members). All trees are climbed together: every class
   begins with whole labels and shortens its matched prefix tree by tree and level by level, down to ``floor`` values
   at most, until a partner at the threshold meets it somewhere with probability ``recall``. A node of more than
   ``crowd`` classes is entered last, only if the target can't be reached without it, so classes among boilerplate
   keep longer prefixes in the trees where it shows and shorter ones elsewhere. Whether a node is crowded does not
   hang on any one partner, so the choice doesn't favour trees in which a partner is missed.
3. *Candidate groups.* A node that some class has chosen joins all its members to the smallest one: linearly many
   edges, whose connected components are the candidate groups.
4. *Verification.* A group is dealt by size class (linked sets differ in size by less than one class) and in blocks,
   so that a group of any size spreads over many tasks; every pair of blocks of equal or adjacent size classes is
   compared exactly. A task counts the links of its documents and returns a spanning forest of them, never the pairs.
   The components of these forests are the result's groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import join_sized, without, write_table
from provena.llm.wordarrays import Words, mix, text_slices
from provena.operators.graph import connected_components

OUTPUTS = ("group_id", "class_id", "n_copies", "n_links", "n_shingles")
#: Documents of one side of a block pair.
BLOCK = 64
#: Distinct shingles compared at once in a task.
COLUMNS = 4096
#: Prefix length of the shallowest trie level, and members beyond which a node counts as crowded.
FLOOR, CROWD = 5, 64


def climb(crowded: dict[int, int], threshold: float, trees: int, depth: int, floor: int, recall: float) -> list[int]:
    """The prefix length that a class uses in each tree.

    ``crowded`` tells for a tree the longest prefix whose node is crowded (nodes above it are crowded too). Prefixes
    are shortened one level at a time over all trees, those within crowded nodes after all others, until the
    probability to miss a partner at ``threshold`` in every tree is 1 - ``recall`` or less (or all are at ``floor``).
    """
    lengths = [depth] * trees
    missed = [0.0, *(math.log1p(-(threshold**k)) if threshold < 1 else -math.inf for k in range(1, depth + 1))]
    goal, sum_ = math.log1p(-recall) if recall < 1 else -math.inf, trees * missed[depth]
    for enter in (False, True):
        for level in range(depth - 1, floor - 1, -1):
            for tree in range(trees):
                if sum_ <= goal:
                    return lengths
                if lengths[tree] == level + 1 and (enter or crowded.get(tree, 0) < level):
                    lengths[tree] = level
                    sum_ += missed[level] - missed[level + 1]
    return lengths


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``n`` hash functions on 32 bits, from a counter."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word shingles; fewer words, but not none, are one shingle."""
    starts, hashes = words.windows(size)
    edges, counts = np.searchsorted(starts, words.first), words.counts()
    short = np.zeros(len(counts), np.uint64)
    for n in range(1, size):
        short[counts == n] = words.window_hash(words.first[:-1][counts == n], n)
    for i, n in enumerate(counts):
        yield np.unique(hashes[edges[i] : edges[i + 1]]) if n >= size else short[i : i + min(1, n)]


def minhashes(shingles: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048, None] * multiply[None, :] + add[None, :]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        part ^= part >> np.uint32(12)
        np.minimum(out, part.min(axis=0), out=out)
    return out


def _floor_keys(labels: np.ndarray, floor: int) -> np.ndarray:
    """One 64-bit key for each tree: the tree's number and the first values of its label."""
    trees = len(labels)
    key = mix(np.arange(trees, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    for j in range(floor):
        key = mix(key ^ labels[:, j].astype(np.uint64)) + np.uint64(j)
    return key.view(np.int64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each item's component under edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sorted shingle sets have Jaccard similarity ``threshold`` or more, exactly."""
    sets = [*left, *right]
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    distinct, place, df = np.unique(every, return_inverse=True, return_counts=True)
    # a shingle of one set only adds to no intersection
    column = np.cumsum(df > 1) - 1
    keep = df[place] > 1
    owner, place = owner[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    m, width = len(left), int(place[-1]) + 1 if len(place) else 0
    common = np.zeros((m, len(right)), np.float32)
    for at in range(0, width, COLUMNS):
        low, high = np.searchsorted(place, [at, at + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        part[owner[low:high], place[low:high] - at] = 1
        common += part[:m] @ part[m:].T
    union = size[:m, None] + size[None, m:] - common
    return common >= threshold * union - 1e-6 * (union > 0)


def trie_rows(signed: DataFrame, depth: int, floor: int) -> DataFrame:
    """(id, tree, keys): the keys of a class's nodes at prefix lengths ``floor`` to ``depth``, for each tree."""
    rows = signed.select("id", F.posexplode("keys").alias("tree", "key"), "tails")
    steps = depth - floor
    keys = [F.col("key")]
    for j in range(steps):
        keys.append(F.xxhash64(keys[-1], F.get("tails", F.col("tree") * steps + j)))
    return rows.select("id", "tree", F.array(*keys).alias("keys"))


def choose_prefixes(matched: DataFrame, nodes: DataFrame, *, threshold: float, trees: int, depth: int, floor: int, recall: float, crowd: int) -> DataFrame:
    """(id, tree, length, key): the trie node that each class uses in each tree where it meets any other.

    ``matched`` has (id, tree, keys), ``nodes`` (length, key, n, low) those with more than one member. Classes
    without crowded nodes all climb alike; for the others their crowded lengths (one entry for each tree) decide.
    """
    usual = climb({}, threshold, trees, depth, floor, recall)
    levels = matched.select("id", "tree", F.posexplode("keys").alias("nth", "key")).withColumn("length", F.col("nth") + floor)
    crowded = levels.join(nodes.where(F.col("n") > crowd).select("length", "key"), ["length", "key"], "left_semi")
    crowded = crowded.groupBy("id", "tree").agg(F.max("length").alias("length")).groupBy("id").agg(F.collect_list(F.struct("tree", "length")).alias("crowded"))

    def climbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [climb({c["tree"]: c["length"] for c in row}, threshold, trees, depth, floor, recall) for row in batch.column("crowded").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.list_(pa.int32()))], ["id", "lengths"])

    plans = write_table(crowded.mapInArrow(climbed, "id long, lengths array<int>"), "prefix-lengths")
    told = join_sized(matched, plans, "id", "left").withColumn("length", F.get(F.coalesce("lengths", F.array(*map(F.lit, usual))), F.col("tree")))
    return told.select("id", "tree", "length", F.get("keys", F.col("length") - floor).alias("key"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    trees: int = 32,
    depth: int = 8,
    floor: int = FLOOR,
    recall: float = 0.9999,
    crowd: int = CROWD,
    block: int = BLOCK,
) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of word shingles, ``threshold`` or more.

    Returns one row for each distinct id: ``id_col``, ``group_id`` (smallest id of all documents that links
    connect), ``class_id`` (smallest id with the same shingle set), ``n_copies`` (other documents of that class),
    ``n_links`` (documents that this one links to, copies included) and ``n_shingles``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A text of fewer than ``shingle`` words, but not none, is one
    shingle. A null or empty text has no shingles and links to nothing. Ids are integers (others are cast to long,
    and fail if they can't be). Rows with a null id are left out; of rows with one id the smallest shingle set counts
    (by hash); an empty table gives an empty result. Every pair of a candidate group is verified; a pair at the
    threshold fails to become a candidate with probability 1 - ``recall`` at most. Sets are compared as sets of
    64-bit hashes; classes are told apart by 128 bits over two independent hashes of their words.
    """
    multiply, add = _permutations(trees * depth)
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            low, high, size, keys, tails = [], [], [], [], []
            words = Words(batch.column("text"))
            for s, other in zip(shingle_sets(words, shingle), shingle_sets(words.reseeded(1), shingle), strict=True):
                low.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                high.append(int(mix(other).sum(dtype=np.uint64).view(np.int64)))
                size.append(len(s))
                labels = minhashes(s, multiply, add).reshape(trees, depth)
                keys.append(_floor_keys(labels, floor) if len(s) else None)
                tails.append(labels[:, floor:].ravel().view(np.int32) if len(s) else None)
            arrays = [batch.column("id"), *(pa.array(x, pa.int64()) for x in (low, high, size)), pa.array(keys, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "a", "b", "n_shingles", "keys", "tails"])

    signed = write_table(docs.mapInArrow(signatures, "id long, a long, b long, n_shingles long, keys array<long>, tails array<int>"), "signatures")
    own = signed.groupBy("id").agg(F.min(F.struct("a", "b", "n_shingles")).alias("s")).select("id", "s.*")
    # classes: the set of shingles, by two 64-bit sums and its size; texts without shingles are classes of one
    classes = own.groupBy("a", "b", "n_shingles").agg(F.min("id").alias("class_id"), F.count("*").alias("members")).where("n_shingles > 0")
    classes = write_table(classes, "classes")
    shared = classes.where("members > 1")
    members = own.join(shared, ["a", "b", "n_shingles"], "left")
    members = write_table(members.select("id", "n_shingles", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("members", F.lit(1)).alias("members")), "members")

    # of rows with one id and one set, one speaks for the class
    reps = signed.join(classes.select(F.col("class_id").alias("id"), "a", "b", "n_shingles"), ["id", "a", "b", "n_shingles"], "left_semi")
    met = reps.select("id", F.explode("keys").alias("key")).groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    met = write_table(met.select("key"), "trie-floor")
    # written before they are joined, so that a node of very many classes is met by broadcast or split over tasks
    matched = write_table(join_sized(trie_rows(reps, depth, floor).withColumn("key", F.col("keys")[0]), met, "key", "left_semi").select("id", "tree", "keys").distinct(), "matched")
    levels = matched.select("id", F.posexplode("keys").alias("nth", "key")).select("id", (F.col("nth") + floor).alias("length"), "key")
    nodes = levels.groupBy("length", "key").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("n > 1")
    nodes = write_table(nodes, "trie-nodes")
    chosen = choose_prefixes(matched, nodes, threshold=threshold, trees=trees, depth=depth, floor=floor, recall=recall, crowd=crowd)
    used = write_table(nodes.join(chosen.select("length", "key").distinct(), ["length", "key"], "left_semi").select("length", "key", "low"), "used-nodes")
    edges = join_sized(levels, used, ["length", "key"], "inner").where("id != low").select(F.col("id").alias("u"), F.col("low").alias("v")).distinct()
    candidates = connected_components(write_table(edges, "edges")).select(F.col("node").alias("id"), F.col("root").alias("grp"))

    candidates = candidates.join(members.where("id = class_id").select("id", "members", "n_shingles"), "id")
    # linked sets differ in size by a factor of 1 / threshold at most, so by one size class (1 % wider: rounding)
    span = F.floor(F.log("n_shingles") / (1.01 * math.log(1 / threshold))) if threshold < 1 else F.col("n_shingles")
    candidates = write_table(candidates.withColumn("span", span.cast("long")), "candidates")
    sizes = write_table(candidates.groupBy("grp", "span").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "group-sizes")
    near = sizes.select("grp", "span", "blocks").join(sizes.select("grp", F.col("span").alias("other_span"), F.col("blocks").alias("other_blocks")), "grp").where(F.abs(F.col("span") - F.col("other_span")) <= 1)
    # a row holds the three size classes that can be linked to its own, however many blocks they have
    near = write_table(near.groupBy("grp", "span", "blocks").agg(F.collect_list(F.struct(F.col("other_span").alias("span"), F.col("other_blocks").alias("blocks"))).alias("beside")), "block-pairs")
    # the texts meet a narrow table of candidates, their sets the block pairs: neither is wide where it is broadcast
    dealt = write_table(candidates.select("id", "grp", "span", "members"), "dealt")
    held = join_sized(docs, dealt, "id", "inner")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            made = [s.tobytes() for s in shingle_sets(Words(batch.column("text")), shingle)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held_columns), pa.array(made, pa.binary())], [*held_columns, "shingles"])

    held_columns = ["id", "grp", "span", "members"]
    sets_of = held.select(*held_columns, "text").mapInArrow(sets, ", ".join([*(f"{c} long" for c in held_columns), "shingles binary"]))
    told = join_sized(sets_of, near, ["grp", "span"], "inner").withColumn("blk", F.struct("span", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("part")))
    others = F.flatten(F.transform("beside", lambda b: F.transform(F.sequence(F.lit(0), b["blocks"] - 1), lambda k: F.struct(b["span"].alias("span"), k.alias("part")))))
    # a block meets another once: in the pair (smaller, larger)
    pairs = told.select("id", "grp", "blk", "members", "shingles", F.explode(others).alias("other")).withColumns({"i": F.least("blk", "other"), "j": F.greatest("blk", "other")})
    pairs = pairs.select("id", "grp", "members", "shingles", "i", "j", F.expr("blk = i").alias("left"), F.expr("blk = j").alias("right"))

    def verify(table: pa.Table) -> pa.Table:
        # rows with one id may repeat: keep one
        ids = table.column("id").to_numpy()
        _, first = np.unique(ids, return_index=True)
        table = table.take(pa.array(first))
        ids, weight = (table.column(c).to_numpy() for c in ("id", "members"))
        left, right = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        found = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        if not len(left) or not len(right):
            return pa.table({"id": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        hits = linked([found[x] for x in left], [found[x] for x in right], threshold)
        same = table.column("i")[0] == table.column("j")[0]
        if same:
            np.fill_diagonal(hits, False)
        links = np.zeros(len(ids), np.int64)
        links[left] += hits @ weight[right]
        if not same:
            links[right] += hits.T @ weight[left]
        a, b = np.nonzero(hits)
        root = _roots(len(ids), left[a], right[b])
        some = links > 0
        return pa.table({"id": ids[some], "root": ids[root[some]], "links": links[some]})

    verified = write_table(pairs.groupBy("grp", "i", "j").applyInArrow(verify, "id long, root long, links long"), "verified")
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(write_table(verified.where("id != root").select(F.col("id").alias("u"), F.col("root").alias("v")).distinct(), "links"))
    told = links.join(groups.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias("class_id"), "links", "root")
    # written, so that a class of very many copies is joined by broadcast or split by adaptive execution
    out = join_sized(members, write_table(told, "linked-classes"), "class_id", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("root", "class_id").alias("group_id"),
        "class_id",
        (F.col("members") - 1).alias("n_copies"),
        (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        "n_shingles",
    )


def keep_one_of_each_group(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id is the smallest of their group; rows without an id stay."""
    gone = groups.where(F.col(id_col) != F.col("group_id")).select(F.col(id_col).alias("__of"))
    docs = without(docs, "__of")
    return docs.join(gone, F.col(id_col) == F.col("__of"), "left_anti")
