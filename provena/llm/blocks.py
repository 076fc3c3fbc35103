"""Blocked hash exchange: ask a global question about very many hashes in few, compressed rows.

Documents are packed into *blocks* (a few MB of text, all columns kept) and written once to the shared folder.
Each block then asks about its distinct hashes: one row for each (block, hash bucket) that holds them sorted,
delta-coded and compressed, with the block's own counts. A bucket adds up the counts of equal hashes over all
blocks and replies to each block. A hash, however frequent, is one entry for each block that holds it: counts are
combined before the shuffle and no key gathers its rows in one task. The number of buckets grows with the input,
so that a bucket holds about ``BUCKET_ENTRIES`` hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import default_parallelism, write_table
from provena.llm.wordarrays import count_words, text_bytes

#: Text bytes of a block (a longer document is a block of its own).
BLOCK_BYTES = 4 << 20
#: Hashes that a bucket holds, about.
BUCKET_ENTRIES = 1_000_000
REPLY = "block_id long, bucket int, payload binary"
ASK = "bucket int, block_id long, payload binary"


def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct uint64 ``hashes`` and uint32 ``counts`` as compressed bytes."""
    deltas = np.diff(hashes, prepend=np.uint64(0))
    planes = deltas.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(hashes).to_bytes(8, "little") + zstandard.compress(planes, 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    planes = np.frombuffer(zstandard.decompress(data[8:]), np.uint8)
    deltas = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(deltas, dtype=np.uint64), np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).view(np.uint32).ravel()


def to_blocks(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES, label: str = "blocks") -> DataFrame:
    """Rows (block_id, n_words, payload): ``docs`` in blocks, as a written table. The payload is an Arrow stream."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = words = 0

        def row():
            nonlocal held, size, words, seq
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            made = pa.RecordBatch.from_pydict({"block_id": [(part << 32) + seq], "n_words": [words], "payload": [sink.getvalue().to_pybytes()]})
            held, size, words, seq = [], 0, 0, seq + 1
            return made

        for batch in batches:
            data, offsets = text_bytes(batch.column(text_col))
            at, n = 0, batch.num_rows
            while at < n:
                to = int(np.searchsorted(offsets, offsets[at] + block_bytes - size, "right")) - 1
                to = min(n, max(to, at + (not held)))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += int(offsets[to] - offsets[at])
                    words += count_words(data, offsets[at : to + 1])
                if to < n or size >= block_bytes:
                    yield row()
                at = to
        if held:
            yield row()

    return write_table(docs.mapInArrow(blocks, "block_id long, n_words long, payload binary"), label)


def opened(payload) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all()


def total_words(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("n_words")).first()[0] or 0


def bucket_count(blocks: DataFrame, entries_per_word: float) -> int:
    """Buckets so that each gets about BUCKET_ENTRIES of the asks that ``blocks`` will make."""
    return max(default_parallelism(blocks.sparkSession), int(total_words(blocks) * entries_per_word / BUCKET_ENTRIES) + 1)


def ask_rows(block_id: int, hashes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The rows with which a block asks about ``hashes`` (repeats are counted)."""
    distinct, counts = np.unique(hashes, return_counts=True)
    home = ((distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.searchsorted(home, np.arange(buckets + 1, dtype=np.uint64))
    used = np.flatnonzero(np.diff(edges))
    return pa.RecordBatch.from_pydict(
        {"bucket": pa.array(used, pa.int32()), "block_id": pa.array([block_id] * len(used), pa.int64()), "payload": pa.array([pack(distinct[edges[b] : edges[b + 1]], counts[edges[b] : edges[b + 1]]) for b in used], pa.binary())}
    )


def ask(blocks: DataFrame, hashes_of: Callable[[pa.Table], np.ndarray], buckets: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, payload in zip(batch.column("block_id"), batch.column("payload"), strict=True):
                yield ask_rows(block_id.as_py(), hashes_of(opened(payload)), buckets)

    return blocks.select("block_id", "payload").mapInArrow(rows, ASK)


def ask_again(blocks: DataFrame, replies: DataFrame, hashes_of: Callable[[pa.Table, np.ndarray], np.ndarray], buckets: int) -> DataFrame:
    """A second question of each block, made from its rows and the replies to the first."""

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        block_id = left.column("block_id")[0].as_py()
        return pa.Table.from_batches([ask_rows(block_id, hashes_of(opened(left.column("payload")[0]), aligned(right)), buckets)])

    return blocks.select("block_id", "payload").groupBy("block_id").cogroup(replies.groupBy("block_id")).applyInArrow(rows, ASK)


def answer(asks: DataFrame, only_from: int = 0) -> DataFrame:
    """Replies (block_id, bucket, payload): the counts over all blocks of the hashes that a block asked about.

    The counts come in the order of the block's sorted distinct hashes (see :func:`aligned`), or, with
    ``only_from``, as the hashes that have at least so many (see :func:`chosen`).
    """

    def reply(table: pa.Table) -> pa.Table:
        asked = [unpack(x.as_py()) for x in table.column("payload")]
        distinct, place = np.unique(np.concatenate([h for h, _ in asked]), return_inverse=True)
        total = np.bincount(place, np.concatenate([c for _, c in asked]).astype(np.float64)).astype(np.int64)
        out, at = [], 0
        for hashes, _ in asked:
            own = np.minimum(total[place[at : at + len(hashes)]], 2**32 - 1)
            out.append(pack(hashes[own >= only_from], own[own >= only_from]) if only_from else pack(np.zeros(len(own), np.uint64), own))
            at += len(hashes)
        return pa.table({"block_id": table.column("block_id"), "bucket": table.column("bucket"), "payload": pa.array(out, pa.binary())})

    return asks.groupBy("bucket").applyInArrow(reply, REPLY)


def _parts(replies: pa.Table, which: int) -> np.ndarray:
    """One part of all replies to a block, in the order of hashes: buckets are ranges of hashes."""
    order = np.argsort(replies.column("bucket").to_numpy(), kind="stable")
    got = [unpack(replies.column("payload")[int(i)].as_py())[which] for i in order]
    return np.concatenate(got) if got else np.zeros(0, (np.uint64, np.uint32)[which])


def aligned(replies: pa.Table) -> np.ndarray:
    """The counts of a block's sorted distinct hashes."""
    return _parts(replies, 1)


def chosen(replies: pa.Table) -> np.ndarray:
    """The sorted hashes that came back under ``only_from``."""
    return _parts(replies, 0)


def finish(blocks: DataFrame, replies: DataFrame, result_of: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """Each block's documents with what its replies decide."""

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        return result_of(opened(left.column("payload")[0]), right)

    return blocks.select("block_id", "payload").groupBy("block_id").cogroup(replies.groupBy("block_id")).applyInArrow(rows, schema)


def among(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each hash is one of the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(hashes), bool)
    return keys[np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)] == hashes
