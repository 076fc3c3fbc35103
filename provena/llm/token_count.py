"""Operator 3: exact token counts of a tokenizer, without its tokens, by dynamic programming over vocabulary matches.

Text is cut as the tokenizer cuts it: blanks become the mark U+2581 and one is put in front. For each distinct piece
an Aho-Corasick automaton enumerates all vocabulary matches, and dynamic programming carries one token count for each
position. Two tokenizers are known, each with its exact tie rules:

*Unigram* (:class:`UnigramCounter`): Viterbi by score; no token crosses a mark. Rules are those of the ``tokenizers``
library's unigram model: scores add up in double precision from left to right; at each end a candidate must beat the
best one strictly, candidates coming by ascending start, so that the longest wins a tie; a character without a token
of its own may be unknown at the lowest score less 10, and counts as its bytes where the vocabulary holds all of them,
else as one token for each run of unknown characters.

*Merges* (:class:`MergeCounter`): byte-pair encoding of the ``sentencepiece`` library, where the pair whose
concatenation is the token of the highest score merges first, the leftmost of a tie. No sum of scores gives its
segmentation, but merges are local: a sequence of tokens is the encoding exactly if each two neighbours are the
encoding of their own text. So the encoding of every prefix ends in the one match that agrees with the last token of
the prefix before it, and the count follows. The installed vocabularies hold merges only, hence the query uses this.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from provena.llm.common import without

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Pieces whose counts a worker remembers.
CACHE = 500_000
OUTPUTS = ("n_tokens", "n_pieces")


#: A run of marks and what follows it, where no token holds a mark after another character.
MARKED = re.compile(f"{MARK}+[^{MARK}]*")


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(token, score) in order of id, from a SentencePiece model file; control and unknown tokens have no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    silent = lambda i: model.is_control(i) or model.is_unknown(i)
    return [("" if silent(i) else model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class _Counter:
    """What both tokenizers share: the automaton of all matches, byte tokens, counts of pieces seen before."""

    def __init__(self, vocabulary: list[tuple[str, float]], merges: bool):
        tokens = {t: float(s) for t, s in vocabulary if t}
        bytes_ = {f"<0x{b:02X}>": b for b in range(256)}
        self.bytes = {bytes_[t] for t in bytes_.keys() & tokens.keys()}
        # a byte's token stands for the byte only: its name in a text is ordinary text
        self.scores = {t: s for t, s in tokens.items() if t not in bytes_} if merges else tokens
        self.automaton = ahocorasick.Automaton()
        for token, score in self.scores.items():
            self.automaton.add_word(token, (len(token), score))
        self.automaton.make_automaton()
        self.cache: dict[str, int] = {}

    def _unknown_tokens(self, text: str) -> int:
        raw = text.encode()
        return len(raw) if self.bytes.issuperset(raw) else 1

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, pieces) of a whole text."""
        if not text:
            return 0, 0
        total, pieces, cache = 0, self.cut(text.replace(" ", MARK)), self.cache
        for p in pieces:
            got = cache.get(p)
            if got is None:
                if len(cache) >= CACHE:
                    cache.clear()
                got = self.piece(p)
                if len(p) <= 64:
                    cache[p] = got
            total += got
        return total, len(pieces)


class UnigramCounter(_Counter):
    """Counts tokens of texts under a unigram vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        super().__init__(vocabulary, merges=False)
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY

    def cut(self, text: str) -> list[str]:
        return [MARK + p for p in text.removeprefix(MARK).split(MARK)]

    def piece(self, text: str) -> int:
        """Tokens of one piece."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        tokens, run = [0] * (n + 1), [0] * (n + 1)  # run: where the run of unknown characters that ends here began, + 1
        best[0] = 0.0
        at, alone = 0, set()

        def unknown(end: int) -> None:
            """Close ``end``: its last candidate is the one character before it, unknown."""
            if end - 1 in alone:
                return
            score = best[end - 1] + self.unknown
            if best[end] is None or score > best[end]:
                best[end] = score
                begin = run[end - 1] or end
                run[end] = begin
                tokens[end] = tokens[begin - 1] + self._unknown_tokens(text[begin - 1 : end])

        for last, (size, score) in self.automaton.iter(text):
            end = last + 1
            while at < end - 1:
                at += 1
                unknown(at)
            if size == 1:
                alone.add(last)
            score += best[end - size]
            if best[end] is None or score > best[end]:
                best[end], tokens[end], run[end] = score, tokens[end - size] + 1, 0
        while at < n:
            at += 1
            unknown(at)
        return tokens[n]


class MergeCounter(_Counter):
    """Counts tokens of texts under byte-pair merges; the vocabulary's scores rank them."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        super().__init__(vocabulary, merges=True)
        self.whole = any(MARK in t.lstrip(MARK) for t in self.scores)
        self.agreed: dict[tuple[str, str], bool] = {}

    def cut(self, text: str) -> list[str]:
        return [MARK + text] if self.whole else MARKED.findall(MARK + text)

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by its definition."""
        parts, score = list(text), self.scores.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = score(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _agree(self, before: str, token: str) -> bool:
        """Whether the two tokens are the encoding of their text (``before`` may be empty)."""
        if len(self.agreed) >= 2 * CACHE:
            self.agreed.clear()
        known = self.agreed[before, token] = self.merged(before + token) == ([before, token] if before else [token])
        return known

    def piece(self, text: str) -> int:
        """Tokens of one piece."""
        n, scores, agreed = len(text), self.scores, self.agreed
        last, tokens = [""] * (n + 1), [0] * (n + 1)  # the last token, and how many, of each prefix
        matches: list[list[int]] = [[] for _ in range(n + 1)]
        for at, (size, _) in self.automaton.iter(text):
            matches[at + 1].append(size)
        for end in range(1, n + 1):
            for size in (*matches[end], 1):
                begin = end - size
                before, token = last[begin], text[begin:end]
                known = agreed.get((before, token))
                if known or known is None and self._agree(before, token):
                    last[end], tokens[end] = token, tokens[begin] + (1 if token in scores else self._unknown_tokens(token))
                    break
        return tokens[n]


_counters: dict[str, _Counter] = {}
COUNTERS = {"unigram": UnigramCounter, "merges": MergeCounter}


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], *, kind: str = "unigram", text_col: str = "text") -> DataFrame:
    """The input's columns, ``n_tokens`` of each whole text and ``n_pieces`` (the pieces it is cut into).

    ``kind`` is the vocabulary's tokenizer, ``unigram`` or ``merges``.

    Input columns of these names are replaced. A null or empty text has no tokens; each row counts by itself, so
    repeated rows are equal; an empty table gives an empty result. The vocabulary is a fixed file of some 32,000
    tokens and is broadcast.
    """
    docs = without(docs, *OUTPUTS)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    name = f"{docs.sparkSession.sparkContext.applicationId}/{id(shared)}/{len(vocabulary)}/{hash(tuple(vocabulary))}/{kind}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _counters:
            _counters.clear()
            _counters[name] = COUNTERS[kind](shared.value)
        counter = _counters[name]
        for batch in batches:
            made = [counter.count(x.as_py() or "") for x in batch.column(text_col)]
            new = [pa.array([m[i] for m in made], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *OUTPUTS])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in OUTPUTS)]))


def count_tokens_of(docs: DataFrame, path: str, *, kind: str = "unigram", text_col: str = "text") -> DataFrame:
    """:func:`count_tokens` with the vocabulary file at ``path``."""
    return count_tokens(docs, load_vocabulary(path), kind=kind, text_col=text_col)

