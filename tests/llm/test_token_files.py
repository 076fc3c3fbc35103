import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from provena.llm import queries as Q
from provena.llm.token_files import NO_ID, PieceEncoder, map_document, partition_bases, read_token_files, token_file_round_trip, write_token_files

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def brute(rows):
    """(doc_id, start, n_tokens, crc) of rows (id, text), in the order of the files."""
    t, out, start = Tokenizer.from_file(PATH), [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def told(df):
    return [tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]


def test_encoder_equals_library():
    t = Tokenizer.from_file(PATH)
    texts = [
        "", " \n\t ", "<|ENDOFTEXT|> a", "<|endoftext|>x <|startoftext|>", "don't 'S's '' ' x'.s! abc'. it'll",
        "é.É́ ́x é... İI ΣΑΣ. ǅ ŉ ß", "a\x1cb\x85c d １２ ½ — x—. \xa0 d\x00e", "treè.́ a.́ á.́ naïve,,, wörd.***",
        "日本語 の 文章 😀 emoji", "x" * 5000, "a.b.c 3.14 1e9 foo_bar 'tis 've", "ÀÉ ÷ × a÷ ÿ. þ! ÿ÷",
    ]
    e = PieceEncoder(PATH)
    assert e.by_pieces
    for _ in range(2):  # anew, and from what is kept
        assert e.encode([x.encode() for x in texts]) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in texts]
    other = str(public_tokenizers.path("byte_bpe_50k.json"))
    b = PieceEncoder(other)
    assert not b.by_pieces
    u = Tokenizer.from_file(other)
    assert b.encode([x.encode() for x in texts]) == [np.array(u.encode(x, add_special_tokens=False).ids, b.dtype).tobytes() for x in texts]


def test_whole_table_against_library(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert told(Q.QUERIES["op12_token_files"](spark, sf)) == brute(rows)


def test_odd_rows(spark, odd, odd_rows, none):
    got = told(token_file_round_trip(odd, PATH))
    want = brute([(r[0], r[1]) for r in odd_rows])
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sorted((g[0] or 0, g[2], g[3]) for g in got) == sorted((w[0] or 0, w[2], w[3]) for w in want)
    assert [g[1] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]
    assert told(token_file_round_trip(none, PATH)) == []


def test_files_and_bases(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(100, 0, -1)], "doc_id long, text string")
    manifest = write_token_files(docs, PATH, str(tmp_path / "out"), end_id=None, partitions=5)
    parts = partition_bases(manifest).orderBy("part").collect()
    assert len(parts) == 5 and sum(p.docs for p in parts) == 100
    assert [p.base for p in parts] == [sum(q.tokens for q in parts[:k]) for k in range(5)]
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert names == sorted(f"part-{p.part:05d}.{k}" for p in parts for k in ("ids", "offsets", "docs"))
    last = parts[-1]
    ids = np.fromfile(tmp_path / "out" / f"part-{last.part:05d}.docs", "<i8")
    assert ids[-1] == 100
    one = map_document(str(tmp_path / "out"), last.part, len(ids) - 1, last.width)
    assert isinstance(one, np.memmap) and len(one) == 100 % 7
    again = write_token_files(docs, PATH, str(tmp_path / "out"), end_id=None, partitions=5)  # as after a lost executor
    assert told(read_token_files(spark, again)) == told(read_token_files(spark, manifest))
    with open(tmp_path / "out" / f"part-{last.part:05d}.ids", "ab") as f:
        f.write(b"\0\0")
    with pytest.raises(Exception, match="does not fit its manifest"):
        told(read_token_files(spark, manifest))


def test_reserved_id_is_refused(spark):
    with pytest.raises(Exception, match="can't be stored"):
        write_token_files(spark.createDataFrame([(NO_ID, "x")], "doc_id long, text string"), PATH)
