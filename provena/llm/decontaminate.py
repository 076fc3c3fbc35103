"""Operator 4: benchmark decontamination with one Aho-Corasick automaton.

Item texts and document texts are normalised alike: A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
Every window of ``window`` consecutive item words becomes a pattern whose symbols are words, so that matches start and
end at words; a document is scanned once and match offsets map back to its words and to character offsets of the
original text.

The documents are never shuffled. The benchmark's texts are broadcast and each worker builds the automaton once. One
automaton holds at most ``NODES`` nodes (a node takes about 50 bytes; an item word makes up to ``window`` of them), so
that neither the driver nor a worker ever holds more, however large the benchmark: beyond that it is cut into shards
by item, and each further shard scans the written result of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import without, write_table

#: Nodes of one automaton, at most (some 200 MB in a worker); an item of more is an automaton of its own.
NODES = 4_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII bytes outside 0-9, A-Z, a-z become spaces; A-Z become a-z; bytes of other characters stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
OUTPUTS = ("n_words", "n_hit", "n_items", "items", "contaminated", "hit_spans")

_built: dict = {}


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def _patterns(items: list[tuple[str | None, str | None]], window: int) -> dict[tuple[bytes, ...], tuple[str, ...]]:
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = _words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).update(() if item is None else (item,))
    return {p: tuple(sorted(ids)) for p, ids in found.items()}


def _automaton(shard: _Shard, window: int):
    """(numbers of the item words, automaton over them), built once in each worker; the one before it is let go."""
    if shard.id not in _built:
        _built.clear()
        made = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        numbers: dict[bytes, int] = {}
        for pattern, items in _patterns(shard.broadcast.value, window).items():
            made.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in pattern), (len(pattern), items))
        made.make_automaton()
        _built[shard.id] = numbers, made
    return _built[shard.id]


class _Shard:
    """Broadcast items with a name of their own, by which workers keep their automaton."""

    def __init__(self, spark, items, window):
        self.broadcast = spark.sparkContext.broadcast(items)
        self.id = f"{spark.sparkContext.applicationId}/{id(self)}/{len(items)}/{window}/{hash(tuple(items))}"


def _hits(numbers: dict[bytes, int], automaton, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
    """(first, last + 1) word spans of all occurrences, and the items they belong to."""
    at, items = [], set()
    if words and len(automaton):
        for end, (size, own) in automaton.iter(tuple([numbers.get(w, 0) for w in words])):
            at.append((end - size + 1, end + 1))
            items.update(own)
    return np.array(at, np.int64).reshape(-1, 2), items


def _merged(spans: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    marks = np.bincount(spans[:, 0], minlength=n + 1) - np.bincount(spans[:, 1], minlength=n + 1)
    hit = np.cumsum(marks[:n]) > 0
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2), int(hit.sum())


def _character_spans(text: str, spans: np.ndarray) -> list[dict]:
    data = np.frombuffer(text.encode().translate(NORMAL), np.uint8)
    word = data != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]]))).reshape(-1, 2)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [{"start": int(chars[edges[a][0]]), "end": int(chars[edges[b - 1][1]])} for a, b in spans]


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 13, min_share: float = 0.05, nodes: int = NODES
) -> DataFrame:
    """Mark the words of each document that an occurrence of a benchmark window covers.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
    Returns the input's columns and ``n_words``, ``n_hit`` (words covered), ``items`` (sorted item ids as strings),
    ``n_items``, ``contaminated`` (n_hit > 0 and n_hit >= min_share * n_words, exactly) and ``hit_spans`` (array of
    (start, end) character offsets in the original text); input columns of these names are replaced.

    A null or empty text has no words and no hits; null or empty items match nothing; an item with a null id marks
    words but is not listed; repeated items count once; each repeated row gets its own result; an empty table on
    either side gives no hits.
    """
    docs = without(docs, *OUTPUTS, "__items", "__spans")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id_col).cast("string").alias("i"), F.col(item_text_col).alias("t"))
    shards = int((items.agg(F.sum(F.regexp_count("t", F.lit(WORD)))).first()[0] or 0) * window // nodes) + 1
    columns, share = docs.columns, Fraction(str(min_share))
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    carry = T.StructType([*docs.schema.fields, T.StructField("__items", T.ArrayType(T.StringType())), T.StructField("__spans", T.ArrayType(T.IntegerType()))])
    final = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("n_items", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("contaminated", T.BooleanType()),
            T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        ]
    )

    def scan(shard: _Shard, first: bool, last: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, automaton = _automaton(shard, window)
            for batch in batches:
                n = batch.num_rows
                texts = batch.column(text_col)
                before = zip(batch.column("__items").to_pylist(), batch.column("__spans").to_pylist(), strict=True) if not first else (([], []) for _ in range(n))
                out: dict[str, list] = {k: [] for k in ("n", "hit", "items", "flag", "chars", "raw")}
                for text, (items_before, spans_before) in zip(texts, before, strict=True):
                    text = text.as_py() or ""
                    words = _words(text)
                    spans, found = _hits(numbers, automaton, words)
                    spans = np.concatenate([np.array(spans_before, np.int64).reshape(-1, 2), spans])
                    spans, hit = _merged(spans, len(words)) if len(spans) else (spans, 0)
                    out["items"].append(sorted({*items_before, *found}))
                    out["raw"].append(spans.ravel().tolist())
                    if last:
                        out["n"].append(len(words))
                        out["hit"].append(hit)
                        out["flag"].append(hit > 0 and hit >= share * len(words))
                        out["chars"].append(_character_spans(text, spans) if hit else [])
                arrays = [batch.column(c) for c in columns]
                if not last:
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(out["items"], pa.list_(pa.string())), pa.array(out["raw"], pa.list_(pa.int32()))], [*columns, "__items", "__spans"])
                else:
                    made = [pa.array(out["n"], pa.int64()), pa.array(out["hit"], pa.int64()), pa.array([len(x) for x in out["items"]], pa.int64()), pa.array(out["items"], pa.list_(pa.string())), pa.array(out["flag"], pa.bool_()), pa.array(out["chars"], spans_type)]
                    yield pa.RecordBatch.from_arrays([*arrays, *made], final.names)

        return rows

    for k in range(shards):
        own = items if shards == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k)
        shard = _Shard(spark, [(r.i, r.t) for r in own.toLocalIterator()], window)
        last = k == shards - 1
        docs = docs.mapInArrow(scan(shard, k == 0, last), final if last else carry)
        if not last:
            docs = write_table(docs, "scanned")
    return docs
