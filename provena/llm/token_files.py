"""Operator 12: token ids in flat binary files with 64-bit document offsets, written and memory-mapped by Spark tasks.

Layout of a folder, all numbers little-endian, one set of files for each partition ``NNNNN``:

- ``part-NNNNN.ids``: token ids, one after another, 2 bytes each where the vocabulary fits into them, else 4;
- ``part-NNNNN.offsets``: unsigned 64-bit positions in that file's ids, one more than it has documents;
- ``part-NNNNN.docs``: signed 64-bit document ids (the smallest number stands for a null id).

Documents are dealt by ranges of their id and sorted, so partitions and the documents in them ascend. A task encodes
one document after another straight into its files, under names of its own attempt, and renames them at the end; what
a lost executor had written is written again under the same names. The manifest has one row for each partition; the
prefix sums of its counts are the partitions' bases, so a document's place in the whole sequence is its partition's
base and its offset. Readers map the files and touch only what they are asked for.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.llm.common import default_parallelism, scratch_path, write_table
from provena.llm.wordarrays import text_slices

MANIFEST = "part int, path string, width int, docs long, tokens long"
READ = "doc_id long, part int, start long, n_tokens long, ids_crc32 long"
#: The stored id of a document whose id is null.
NO_ID = -(1 << 63)
#: Distinct pieces of text whose ids an encoder keeps; beyond that it starts anew.
CACHED_PIECES = 600_000
#: Documents that a reader passes on at once.
READ_DOCS = 10_000

#: ASCII punctuation but the apostrophe, which may begin a piece together with letters.
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
#: Latin letters in lower case, which no normaliser of :attr:`PieceEncoder.STAGES` changes.
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


class PieceEncoder:
    """Ids of whole texts by a ``tokenizers`` file, as packed bytes; equal pieces are encoded once.

    Where the file's stages are :attr:`STAGES`, a text is cut at ASCII white space, which they drop, and letters are
    cut from the ASCII punctuation behind them, from which they part them. The words of letters that are new in a
    slice of texts are encoded together: their tokens end where one with the word-end mark does. With other stages
    whole texts are encoded. Ids equal the library's for the whole text.
    """

    #: The stages of a word-end vocabulary file for which the cuts are right.
    STAGES = [
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
        None,
        None,
    ]

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[bytes, bytes] = {}
        said = json.loads(self.tokenizer.to_str())
        plain = all(not (t["lstrip"] or t["rstrip"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in said["added_tokens"])
        end = said["model"].get("end_of_word_suffix")
        self.by_pieces = bool(plain and end and [said[k] for k in ("normalizer", "pre_tokenizer", "post_processor", "truncation")] == self.STAGES)
        if self.by_pieces:
            self.words = Tokenizer.from_file(path)  # the same model behind the stages that are left to do for such words
            self.words.normalizer = normalizers.Sequence([])
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(end)]] = True

    def whole(self, texts: list[bytes]) -> list[bytes]:
        """The library's packed ids of texts, through all its stages."""
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, pieces: set[bytes]) -> None:
        """Encode new pieces."""
        parted, words, rest = [], [], []
        for piece in pieces:
            head = piece.rstrip(_PUNCTUATION)
            if not (head.isalpha() and head.islower() or _LATIN(head)):
                rest.append(piece)
            elif len(head) == len(piece):
                words.append(piece)
            else:
                parted.append((piece, head, piece[len(head) :]))
        known = self.pieces
        words += {h for _, h, _ in parted}.difference(known, words)
        rest += {t for _, _, t in parted}.difference(known, rest)
        if words:
            ids = np.array(self.words.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, self.dtype)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(cuts) != len(words):
                raise ValueError("words and word ends differ")
            blob, at = ids.tobytes(), 0
            for word, to in zip(words, cuts, strict=True):
                known[word] = blob[at:to]
                at = to
        known.update(zip(rest, self.whole(rest), strict=True))
        for piece, head, tail in parted:
            known[piece] = known[head] + known[tail]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The packed ids of UTF-8 texts."""
        if not self.by_pieces:
            return self.whole(texts)
        split = []
        for text in texts:
            lower = text.lower()
            # lower-casing must not make a mark
            split.append((text if any(m in lower for m in self.marks) else lower).split())
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        new = {p for pieces in split for p in set(pieces).difference(self.pieces)}
        if new:
            self._learn(new)
        get = self.pieces.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder_of(path: str) -> PieceEncoder:
    """The encoder of a vocabulary file, one for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def _mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file's numbers: memory-mapped where the store is a mounted one, else read."""
    store, root = _store(folder)
    path = f"{root}/{name}"
    if not store.get_file_info(path).size:
        return np.zeros(0, dtype)
    if store.type_name == "local":
        return np.memmap(path, dtype, "r")
    return np.frombuffer(store.open_input_file(path).read(), dtype)


class _PartWriter:
    """The three files of one partition."""

    def __init__(self, folder: str, part: int, attempt: int):
        self.store, self.root = _store(folder)
        self.store.create_dir(self.root, recursive=True)
        self.names = {k: (f"{self.root}/.{attempt}-{part:05d}.{k}", f"{self.root}/part-{part:05d}.{k}") for k in ("ids", "offsets", "docs")}
        self.files = {k: self.store.open_output_stream(n[0], compression=None) for k, n in self.names.items()}
        self.docs = self.tokens = 0
        self.files["offsets"].write(np.zeros(1, "<u8").tobytes())

    def add(self, doc_ids: list, packed: list[bytes], width: int) -> None:
        ends = self.tokens + np.cumsum([len(p) // width for p in packed])
        self.files["ids"].write(b"".join(packed))
        self.files["offsets"].write(ends.astype("<u8").tobytes())
        self.files["docs"].write(np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes())
        self.docs, self.tokens = self.docs + len(packed), int(ends[-1])

    def close(self) -> None:
        for k, (own, name) in self.names.items():
            self.files[k].close()
            if self.store.type_name != "local" and self.store.get_file_info(name).type != fs.FileType.NotFound:
                self.store.delete_file(name)
            self.store.move(own, name)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, *, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id`` to each, and write the ids in ascending order of the document id.

    ``tokenizer`` is the path of a ``tokenizers`` file on every executor; ``folder`` is in a store that all of them
    share (by default it is made in the shared folder). Returns the manifest (part, path, width, docs, tokens), a
    written table of one row for each partition that has documents. A null text is empty: it has the end id alone.
    A null id comes first; rows with one id follow each other by a hash of their text; the id ``-2**63`` is refused.
    Other columns are not read. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(partitions or default_parallelism(spark), *order).sortWithinPartitions(*order, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, out = encoder_of(tokenizer), TaskContext.get().partitionId(), None
        width = encoder.dtype.itemsize
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        for batch in text_slices(batches, "text"):
            ids = batch.column("id").to_pylist()
            if NO_ID in ids:
                raise ValueError(f"a document id of {NO_ID} can't be stored")
            out = out or _PartWriter(folder, part, TaskContext.get().taskAttemptId())
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            out.add(ids, [e + end for e in encoder.encode(texts)], width)
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": folder, "width": width, "docs": out.docs, "tokens": out.tokens}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    return write_table(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def partition_bases(manifest: DataFrame) -> DataFrame:
    """The manifest and ``base``, the tokens of all partitions before: one number for each partition is summed."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def map_document(folder: str, part: int, nth: int, width: int) -> np.ndarray:
    """The ids of the ``nth`` document of a partition, mapped: no other document is read."""
    at = _mapped(folder, f"part-{part:05d}.offsets", "<u8")
    return _mapped(folder, f"part-{part:05d}.ids", f"<u{width}")[int(at[nth]) : int(at[nth + 1])]


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row for each document of the files that the manifest names, in no particular order of rows.

    doc_id, part, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned, of the ids as little-endian
    unsigned 32-bit integers). Files that don't fit their manifest or offsets raise.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"part-{row['part']:05d}"
                ids, at, docs = (_mapped(row["path"], f"{name}.{k}", d) for k, d in (("ids", f"<u{row['width']}"), ("offsets", "<u8"), ("docs", "<i8")))
                at = at.astype(np.int64)
                if (len(docs), len(at) - 1, len(ids), int(at[-1])) != (row["docs"], row["docs"], row["tokens"], row["tokens"]) or (np.diff(at) < 0).any():
                    raise ValueError(f"{name} does not fit its manifest")
                for a in range(0, len(docs), READ_DOCS):
                    b = min(a + READ_DOCS, len(docs))
                    own = docs[a:b]
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(at[a:b], at[a + 1 : b + 1], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, pa.int64(), mask=own == NO_ID),
                            pa.array(np.full(b - a, row["part"], np.int32)),
                            pa.array(row["base"] + at[a:b]),
                            pa.array(np.diff(at[a : b + 1])),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "part", "start", "n_tokens", "ids_crc32"],
                    )

    parts = partition_bases(manifest).repartition(default_parallelism(spark), "part")
    return parts.mapInArrow(read, READ)


def token_file_round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """:func:`write_token_files`, then :func:`read_token_files` of what it wrote."""
    return read_token_files(docs.sparkSession, write_token_files(docs, tokenizer, folder, **options))
