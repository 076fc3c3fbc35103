"""Operator 10: quality scores from compression with class dictionaries.

Two zstandard dictionaries of equal size are trained from good and from bad labelled texts (bounded samples). A
text that looks like one class compresses better under its dictionary: the feature is the difference of the two
compressed sizes, divided by the plain compressed size. Texts are compressed in small pieces, so that the
dictionaries and not the text's own past decide. A logistic curve fitted to labelled training rows turns the
difference into a probability, the calibrated score.

Scoring is one pass without a shuffle; what is broadcast are the two dictionaries and two numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import without, write_table

#: Labelled rows of each class that the dictionaries are trained on, at most, and characters of each: of a longer text
#: that many, in pieces spread evenly from its start to its end.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_PIECES = 1000, 4000, 4
#: Labelled rows that the curve is fitted to, at most.
FIT_ROWS = 5_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Bytes of text compressed at a time; sizes add up over a longer text.
PIECE = 4 << 10
OUTPUTS = ("score", "predicted", "feature")


class SizeDifference:
    """The normalised size difference of a text under two class dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        def compressor(dictionary: bytes):
            data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
            if data:
                data.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_dict_id=False, write_content_size=False)

        self.good, self.bad, self.plain = compressor(good), compressor(bad), compressor(b"")

    def __call__(self, text: str | None) -> float:
        data = (text or "").encode()
        if not data:
            return 0.0
        good, bad, plain = (sum(len(c.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE)) for c in (self.good, self.bad, self.plain))
        return (bad - good) / plain


def spread_pieces(text: Column) -> Column:
    """At most ``SAMPLE_CHARS`` characters of a text: the whole, or pieces spread from its start to its end."""
    size = SAMPLE_CHARS // SAMPLE_PIECES
    at = lambda k: F.floor((F.char_length(text) - size) * k / (SAMPLE_PIECES - 1)).cast("int") + 1
    return F.when(F.char_length(text) <= SAMPLE_CHARS, text).otherwise(F.concat(*[F.substring(text, at(F.lit(k)), F.lit(size)) for k in range(SAMPLE_PIECES)]))


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; with too few texts to train one, the texts themselves as raw content."""
    samples = [t.encode()[i : i + 1000] for t in texts for i in range(0, len(t.encode()), 1000)]
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights of the columns of ``x`` and an intercept, by Newton steps, with a small pull towards 0 so that separable rows have an answer."""
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    design = np.column_stack([x / scale, np.ones(len(x))])
    theta = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (p - y) + 0.01 * theta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(len(theta))
        step = np.linalg.solve(hessian, gradient)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return [float(t) for t in theta / np.append(scale, 1.0)]


class CompressionClassifier:
    """Dictionaries of both classes and the fitted curve."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float]):
        self.good, self.bad, self.weights = good, bad, weights

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, fit_rows: int = FIT_ROWS) -> CompressionClassifier:
        """Fit on bounded samples of the labelled documents, chosen among the labels by a hash of the id.

        The ids are chosen first, so only the sample's texts leave their rows: at most ``sample_rows`` of each class
        for the dictionaries (``SAMPLE_CHARS`` of each) and ``fit_rows`` for the curve, whose features are taken by
        dictionaries of the other half of the ids. Rows with a null text, id or
        label are left out, and of documents with one id one counts. Without rows of both classes the score is
        their share (or 1/2).
        """
        rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("y")).distinct()
        rows = rows.withColumn("half", F.pmod(F.xxhash64(F.lit(2), "of"), F.lit(2)))
        dictionary = [rows.where(F.col("y") == y).orderBy(F.xxhash64("of"), "of").limit(sample_rows).withColumn("use", F.lit("dictionary")) for y in (0, 1)]
        curve = rows.orderBy(F.xxhash64(F.lit(1), "of"), "of").limit(fit_rows).withColumn("use", F.lit("curve"))
        chosen = F.broadcast(dictionary[0].unionByName(dictionary[1]).unionByName(curve))
        texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("of"), F.col(text_col).alias("t")).join(chosen, "of")
        texts = write_table(texts.dropDuplicates(["of", "use"]), "labelled-sample")
        samples = {y: [(r.t, r.half) for r in texts.where((F.col("use") == "dictionary") & (F.col("y") == y)).select(spread_pieces(F.col("t")).alias("t"), "of", "half").orderBy("of").collect()] for y in (0, 1)}
        if not samples[0] or not samples[1]:
            share = 0.999 if samples[1] else 0.001 if samples[0] else 0.5
            return cls(b"", b"", [0.0, math.log(share / (1 - share))])
        # a text compresses too well by a dictionary that it trained: each half's feature is taken by the other half's
        seen = []
        for half in (0, 1):
            good, bad = (_dictionary([t for t, h in samples[y] if h != half] or [t for t, _ in samples[y]]) for y in (1, 0))
            seen.append(_with_feature(texts.where((F.col("use") == "curve") & (F.col("half") == half)), "t", good, bad).select("of", "feature", "y"))
        got = seen[0].unionByName(seen[1]).toPandas().sort_values("of")
        good, bad = (_dictionary([t for t, _ in samples[y]]) for y in (1, 0))
        return cls(good, bad, fit_logistic(got[["feature"]].to_numpy(), got.y.to_numpy(float)))

    def score(self, docs: DataFrame, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
        """The input's columns, ``feature``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (score >= threshold).

        Input columns of these names are replaced. A null or empty text has feature 0. Every row is scored by its
        text alone, so repeated rows are equal; an empty table gives an empty result.
        """
        docs = without(docs, *OUTPUTS)
        out = _with_feature(docs, text_col, self.good, self.bad)
        slope, shift = self.weights
        score = 1 / (1 + F.exp(-(F.lit(slope) * F.col("feature") + F.lit(shift))))
        return out.withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _with_feature(df: DataFrame, text_col: str, good: bytes, bad: bytes) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((good, bad))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = SizeDifference(*shared.value)
        for batch in batches:
            made = pa.array([measure(x.as_py()) for x in batch.column(text_col)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "feature"])

    return df.mapInArrow(rows, T.StructType([*df.schema.fields, T.StructField("feature", T.DoubleType())]))
