"""Operator 8: removal of repeated passages by difference-cover anchors.

Anchors (short windows) are hashed only at word positions that belong to a difference cover modulo its period,
counted from the start of each document. Two equal windows of ``window`` words, wherever they start, share an
aligned anchor: some offset below the period puts both on cover positions. So only windows that hold a repeated
anchor can repeat; these candidates are extended to the full window, whose hash decides.

Both questions ("which anchors / windows occur at least twice?") go through the blocked hash exchange, so a
passage that a third of all documents share is one entry for each block. Hashes have 64 bits.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from provena.llm import blocks as B
from provena.llm.common import without, write_table
from provena.llm.wordarrays import Words, text_bytes

#: Perfect difference sets modulo q*q+q+1 (fixed values): every residue is a difference of two members.
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
OUTPUTS = ("n_words", "n_removed", "removed_spans")


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover whose anchors keep at least a third of the window."""
    period = max(v for v in COVERS if window - v + 1 >= max(1, window // 3))
    return period, COVERS[period]


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    period, cover = cover_for(window)
    starts, hashes = words.windows(window - period + 1)
    offset = (starts - np.repeat(words.first[:-1], words.counts())[starts]) % period
    keep = np.isin(offset, cover)
    return starts[keep], hashes[keep]


def _candidates(words: Words, window: int, anchor_starts: np.ndarray) -> np.ndarray:
    """Starts of windows that hold one of the anchors within their first ``period`` positions."""
    period, _ = cover_for(window)
    n = len(words.hash)
    begin = np.repeat(words.first[:-1], words.counts())
    end = np.repeat(words.first[1:], words.counts())
    low = np.maximum(begin[anchor_starts], anchor_starts - period + 1)
    high = np.minimum(end[anchor_starts] - window, anchor_starts) + 1
    fits = high > low
    marks = np.bincount(low[fits], minlength=n + 1).astype(np.int64) - np.bincount(high[fits], minlength=n + 1)
    return np.flatnonzero(np.cumsum(marks)[:n] > 0)


def drop_repeated_passages(docs: DataFrame, *, text_col: str = "text", window: int = 35) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that starts anywhere else too (same document included).

    Returns the input's columns, with ``text`` the kept words joined by one space, and ``n_words``, ``n_removed``
    and ``removed_spans`` (array of (start, end) word positions, end exclusive); input columns of these names are
    replaced. Windows are judged on the input. A null or empty text has no words and becomes the empty text; a
    text shorter than the window keeps all its words; a repeated row is a repeat, so both lose their windows; an
    empty table gives an empty result. One row comes back for each input row.
    """
    docs = without(docs, *OUTPUTS)
    spark, columns = docs.sparkSession, docs.columns
    words_of = lambda table: Words(table.column(text_col))

    def anchors(table: pa.Table) -> np.ndarray:
        return _anchors(words_of(table), window)[1]

    def windows(table: pa.Table, counts: np.ndarray) -> np.ndarray:
        words = words_of(table)
        starts, hashes = _anchors(words, window)
        _, place = np.unique(hashes, return_inverse=True)
        return words.window_hash(_candidates(words, window, starts[counts[place] > 1]), window)

    def result(table: pa.Table, replies: pa.Table) -> pa.Table:
        words = words_of(table)
        starts, hashes = words.windows(window)
        starts = starts[B.among(hashes, B.chosen(replies))]
        n = len(words.hash)
        marks = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64)
        marks[window:] -= marks[:-window].copy() if n >= window else 0
        gone = np.cumsum(marks)[:n] > 0
        data, offsets = text_bytes(table.column(text_col))
        data = data.tobytes()
        kept, removed, spans = [], [], []
        for i in range(table.num_rows):
            own = gone[words.first[i] : words.first[i + 1]]
            found = data[offsets[i] : offsets[i + 1]].split()
            if own.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                found = list(compress(found, ~own))
            else:
                spans.append([])
            removed.append(int(own.sum()))
            kept.append(b" ".join(found).decode())
        arrays = {c: table.column(c) for c in columns} | {text_col: pa.array(kept, pa.string())}
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table(arrays | {"n_words": pa.array(words.counts(), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed_spans": pa.array(spans, span)})

    blocks = B.to_blocks(docs, text_col, label="passages")
    period, cover = cover_for(window)
    buckets = B.bucket_count(blocks, len(cover) / period)
    repeated = B.answer(B.ask(blocks, anchors, buckets))
    again = write_table(B.answer(B.ask_again(blocks, repeated, windows, buckets), only_from=2), "windows")
    schema = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    del spark
    return B.finish(blocks, again, result, schema)
