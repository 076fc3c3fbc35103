"""Phrases and identifiers in texts (I23, I34, I35, D19): all phrases of a table are found in one pass over each text.

A text is folded and cut into words; a phrase is found where its words follow each other. The phrase table is data. Up to
``SHARD_CHARS`` characters of it are one automaton, built once in each worker from a broadcast. Of a larger table only a
bitmap of hashed phrases is broadcast, of ``FILTER_BITS`` at most: runs of words that are in it leave their text and
meet the phrases by an equi-join. So texts are read once and never move, however many phrases there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.functions.text import MARKED, PLAIN
from provena.storage import write_table

#: Characters of phrases in one automaton; some 40 bytes of memory for each in a worker.
SHARD_CHARS = 2_000_000
_WORD = re.compile("[a-z0-9]+")
#: Bytes of text that a task takes at once.
SLICE_CHARS = 4 << 20
#: Bits of the bitmap of hashed phrases: sixteen for each phrase, rounded up to a power of two, within these limits.
FILTER_BITS = (1 << 15, 1 << 27)
#: The base of the hash of a run of words, its inverse, and the words whose hashes a worker keeps.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
KEPT_WORDS = 500_000


def _folded(lower: str) -> str:
    """A lower-case text without marks. A replacement for each mark that occurs is far faster than ``translate`` by a table."""
    if not lower.isascii():
        for marked, plain in zip(MARKED, PLAIN, strict=True):
            lower = lower.replace(marked, plain)
    return lower


def folded_words(text: str) -> list[tuple[str, int, int]]:
    """The words of a folded text with their places in the text itself."""
    lower = text.lower()
    if len(lower) == len(text):
        return [(m.group(), m.start(), m.end()) for m in _WORD.finditer(_folded(lower))]
    # a character may be several in lower case
    parts = [c.lower() for c in text]
    at = [i for i, p in enumerate(parts) for _ in p]
    return [(m.group(), at[m.start()], at[m.end() - 1] + 1) for m in _WORD.finditer(_folded("".join(parts)))]


class PhraseFinder:
    """Finds all occurrences of (number, words) phrases in folded texts."""

    def __init__(self, phrases: Sequence[tuple[int, str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for number, words in phrases:
            if words:
                by.setdefault(f" {words} ", []).append(number)
        for key, numbers in by.items():
            self.automaton.add_word(key, (key.count(" ") - 1, numbers))
        self.some = bool(by)
        if self.some:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(number, index of the first word, start, end in the text) of each occurrence, by their ends."""
        words = folded_words(text) if self.some else []
        if not words:
            return
        flat = " " + " ".join(w for w, _, _ in words) + " "
        ends, at = {}, 0  # the word that ends at a place of the flat text
        for i, (w, _, _) in enumerate(words):
            at += len(w) + 1
            ends[at] = i
        for place, (n, numbers) in self.automaton.iter(flat):
            last = ends[place]
            first = last - n + 1
            for number in numbers:
                yield number, first, words[first][1], words[last][2]


class WordHashes(dict):
    """64-bit hashes of words; a worker keeps a bounded number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
        return found


class RunHashes:
    """Hashes of all runs of some numbers of words: the sum of the words' hashes times powers of an odd base."""

    def __init__(self):
        self.words = WordHashes()
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, b, np.uint64)])) for b in (_BASE, _INVERSE))

    def __call__(self, words: Sequence[str], lengths: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(length, hash of the run from each word on) for each length that the words have."""
        n = len(words)
        self._grow(n)
        own = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * self.powers[:n])])
        for m in lengths:
            if m <= n:
                yield m, (sums[m:] - sums[:-m]) * self.inverses[: n - m + 1]


def filter_places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a bitmap of ``bits`` (a power of two)."""
    mixed = hashes ^ (hashes >> np.uint64(32))
    mixed = mixed * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(35)) & np.uint64(bits - 1), (mixed ^ (mixed >> np.uint64(29))) & np.uint64(bits - 1)


#: The last automaton of this worker, with the phrases that it was built from.
_FINDERS: list[tuple[list, PhraseFinder]] = []


def phrase_table(phrases: DataFrame, phrase_col: str) -> DataFrame:
    """``phrases`` with ``words`` (folded) and a number; phrases without a word are left out."""
    words = F.array_join(F.regexp_extract_all(F.translate(F.lower(F.col(phrase_col)), MARKED, PLAIN), F.lit("[a-z0-9]+"), 0), " ")
    return write_table(phrases.withColumn("words", words).where("words <> ''").withColumn("number", F.monotonically_increasing_id()), "phrases")


def phrase_hits(texts: DataFrame, id_col: str, text_col: str, phrases: DataFrame, phrase_col: str) -> DataFrame:
    """All occurrences: id, the phrase's own columns, word (index of its first word), start and end in the text.

    A null text has none. Phrases that are equal once folded are all found; one phrase may lie within another.
    """
    table = phrase_table(phrases, phrase_col)
    size = table.agg(F.sum(F.char_length("words") + 2)).first()[0] or 0
    rows = texts.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text IS NOT NULL")
    hits = _hits_by_automaton(rows, table) if size <= SHARD_CHARS else _hits_by_runs(rows, table)
    return hits.withColumnRenamed("__id", id_col).select(id_col, *phrases.columns, "words", "word", "start", "end")


def _hits_by_automaton(rows: DataFrame, table: DataFrame) -> DataFrame:
    kind = rows.schema["__id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast([(r.number, r.words) for r in table.select("number", "words").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _FINDERS or _FINDERS[0][0] is not shared.value:
            _FINDERS[:] = [(shared.value, PhraseFinder(shared.value))]
        find = _FINDERS[0][1]
        for batch in batches:
            held: list[tuple] = []
            chars = 0
            ids: list[int] = []
            for n, text in enumerate(batch.column("__text").to_pylist()):
                mine = list(find(text))
                held += mine
                ids += [n] * len(mine)
                chars += len(text)
                if chars >= SLICE_CHARS:
                    yield out(batch, ids, held)
                    held, ids, chars = [], [], 0
            yield out(batch, ids, held)

    def out(batch: pa.RecordBatch, ids: list[int], held: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([h[k] for h in held], pa.int64() if k == 0 else pa.int32()) for k in range(4)]
        return pa.RecordBatch.from_arrays([batch.column("__id").take(pa.array(ids, pa.int64())), *columns], ["__id", "number", "word", "start", "end"])

    return rows.mapInArrow(run, f"__id {kind}, number long, word int, start int, end int").join(table, "number")


def _phrase_filter(table: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the phrases' hashes; it comes to the driver in pieces of 4 KB, ``bits`` in all."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RunHashes()
        for batch in batches:
            words = [w.split(" ") for w in batch.column("words").to_pylist()]
            own = np.array([next(hashes(w, [len(w)]))[1][0] for w in words], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(filter_places(own, bits)).astype(np.int64))], ["place"])

    piece, bit = F.shiftright("place", 15), F.col("place").bitwiseAND(32767)
    found = table.select("words").mapInArrow(places, "place long").groupBy(piece.alias("piece")).agg(F.bitmap_construct_agg(bit).alias("b"))
    whole = np.zeros(bits >> 3, np.uint8)
    for r in found.collect():
        whole[r.piece << 12 : (r.piece + 1) << 12] = np.frombuffer(r.b, np.uint8)
    return whole


def _hits_by_runs(rows: DataFrame, table: DataFrame) -> DataFrame:
    kind = rows.schema["__id"].dataType.simpleString()
    n, lengths = table.agg(F.count("*"), F.sort_array(F.collect_set(F.size(F.split("words", " "))))).first()
    bits = min(max(FILTER_BITS[0], 1 << (16 * n - 1).bit_length()), FILTER_BITS[1])
    shared = rows.sparkSession.sparkContext.broadcast(_phrase_filter(table, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hashes, seven = shared.value, RunHashes(), np.uint64(7)
        inside = lambda p: (bitmap[p >> np.uint64(3)] >> (p & seven).astype(np.uint8)) & 1

        def found(text: str) -> Iterator[tuple[str, int, int, int]]:
            lower = text.lower()
            spans = None if len(lower) == len(text) else folded_words(text)
            words = _WORD.findall(_folded(lower)) if spans is None else [w for w, _, _ in spans]
            for m, own in hashes(words, lengths):
                one, two = filter_places(own, bits)
                first = np.flatnonzero(inside(one))
                for i in first[inside(two[first]) == 1].tolist():
                    spans = spans or folded_words(text)
                    yield " ".join(words[i : i + m]), i, spans[i][1], spans[i + m - 1][2]

        for batch in batches:
            held: list[tuple] = []
            ids: list[int] = []
            chars = 0
            for n, text in enumerate(batch.column("__text").to_pylist()):
                mine = list(found(text))
                held += mine
                ids += [n] * len(mine)
                chars += len(text)
                if chars >= SLICE_CHARS:
                    yield out(batch, ids, held)
                    held, ids, chars = [], [], 0
            yield out(batch, ids, held)

    def out(batch: pa.RecordBatch, ids: list[int], held: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([h[k] for h in held], pa.string() if k == 0 else pa.int32()) for k in range(4)]
        return pa.RecordBatch.from_arrays([batch.column("__id").take(pa.array(ids, pa.int64())), *columns], ["__id", "words", "word", "start", "end"])

    # a run that only looked like a phrase meets none
    return rows.mapInArrow(run, f"__id {kind}, words string, word int, start int, end int").join(table, "words")


def first_rule(texts: DataFrame, id_col: str, text_col: str, rules: DataFrame, *, rank: str = "rank", phrase_col: str = "phrase") -> DataFrame:
    """The decision of an ordered chain of rules for each text: the first rule (smallest rank) that has a phrase in it.

    ``rules`` (rank, ..., phrase) has a row for each phrase. Of the rule's phrases the earliest counts, the longer one
    at one place, then the smaller. Returns the id, the rule's columns, word, start, end; nulls where no rule applies.
    """
    hits = phrase_hits(texts, id_col, text_col, rules, phrase_col)
    own = [c for c in hits.columns if c != id_col]
    best = W.partitionBy(id_col).orderBy(F.col(rank), F.col("word"), (F.col("end") - F.col("start")).desc(), F.col("words"), *[F.col(c) for c in rules.columns])
    told = hits.withColumn("__nth", F.row_number().over(best)).where("__nth = 1").drop("__nth")
    return texts.select(id_col).join(told.select(id_col, *own), id_col, "left")
