"""Token counts, token files and SentencePiece against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkroster.llm.sentencepiece_codec import PieceModel, encode_documents, round_trips
from sparkroster.llm.token_counts import MergeCounter, token_counts
from sparkroster.llm.token_output import read_token_files, token_file_digest, token_files, write_token_files

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"


def random_texts(seed: int, n: int, letters: str) -> list[str]:
    source = random.Random(seed)
    return ["".join(source.choice(letters) for _ in range(source.randrange(60))) for _ in range(n)]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.mark.parametrize("letters", ["aab 1\n\t'stre", "éß日 😀\u0301a \u3000\x85\x1c", "<|endoftx> a"])
def test_merged_counts_are_the_librarys(letters):
    texts = [*random_texts(1, 1500, letters), "<|endoftext|>" * 2 + "x", "a" * 20_000, "", " "]
    want = [len(e.ids) for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]
    assert MergeCounter(BYTES).count(texts) == want


def test_token_counts_of_whole_tables(spark, odd_docs):
    library = Tokenizer.from_file(BYTES)
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        want = []
        for i, text in rows_of(docs):
            n = len(library.encode(text, add_special_tokens=False).ids)
            want.append((i, len(text.encode()), n, n > 1024))
        assert sorted(map(tuple, token_counts(docs, BYTES).collect()), key=str) == sorted(want, key=str)
    assert token_counts(odd_docs.limit(0), BYTES).collect() == []


def expected_digest(docs):
    library, at, out = Tokenizer.from_file(WORDS), 0, []
    for i, text in sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_token_files_round_trip(spark, odd_docs):
    for docs in (odd_docs.repartition(4), spark.read.parquet(f"{SF}/documents.parquet").repartition(3)):
        got = sorted(map(tuple, token_files(docs, WORDS).collect()), key=lambda r: r[1])
        assert got == expected_digest(docs)
    assert token_files(odd_docs.limit(0), WORDS).collect() == []


def test_token_files_have_their_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = write_token_files(docs, str(tmp_path / "ids"), WORDS, n_files=3)
    files = sorted(p for p in (tmp_path / "ids").iterdir() if p.suffix == ".parquet")
    assert len(files) == 3
    last = -1
    for file in files:
        meta = pq.ParquetFile(file).metadata
        columns = {meta.row_group(0).column(c).path_in_schema: meta.row_group(0).column(c) for c in range(meta.num_columns)}
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert columns["ids.list.element"].has_dictionary_page
        ids = pq.read_table(file)["doc_id"].to_pylist()
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]
    assert token_file_digest(spark, path).count() == docs.count()
    plan = read_token_files(spark, path).select("n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<n_tokens:bigint>" in plan


@pytest.fixture(scope="module")
def pieces():
    return PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("letters", ["aabbecdt  \n\tthein", "▁éßxΩ中😀 <0x41>s", "  a ", "1.,;the in"])
def test_pieces_are_the_librarys(pieces, letters):
    model, library = pieces
    texts = [*random_texts(5, 1500, letters), "", " ", "  ", "a" * 2000, " " * 700 + "x", "\x00a", "of.\n the"]
    want = library.encode(texts, num_threads=1)
    assert model.encode(pa.array(texts, pa.large_string())).to_pylist() == want
    assert model.decode(pa.array(want, pa.list_(pa.int32()))).to_pylist() == library.decode(want)


def test_joined_pieces_are_the_librarys(pieces):
    model, library = pieces
    source, words = random.Random(4), [p.replace("▁", " ") for p in model.ids]
    texts = ["".join(source.choice(words) for _ in range(10)) for _ in range(3000)]
    assert model.encode(pa.array(texts, pa.large_string())).to_pylist() == library.encode(texts, num_threads=1)


def test_round_trips_of_whole_tables(spark, odd_docs, pieces):
    library = pieces[1]
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        want = []
        for i, text in rows_of(docs):
            ids = library.encode(text)
            back = library.decode(ids)
            want.append((i, len(text.encode()), len(ids), crc(ids), zlib.crc32(back.encode()), back == text))
        assert sorted(map(tuple, round_trips(docs, PIECES).collect()), key=str) == sorted(want, key=str)
    ids = {r["doc_id"]: r["ids"] for r in encode_documents(odd_docs, PIECES).collect()}
    assert ids[7] == library.encode("日本語 テキスト 😀 ▁ a\u0301  b") and ids[2] == []
    assert round_trips(odd_docs.limit(0), PIECES).collect() == []
