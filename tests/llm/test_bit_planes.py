"""Token ids against the tokenizer, files against their ids, and what is read back after lost and repeated tasks."""

import zlib

import numpy as np
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from pagelens.llm import bit_planes, queries

TEXTS = ["one two three. Five six\nseven", "one two three. Five six\nseven", "", None, "  \n", " a  b ", "it's WE'LL 12,5% #x <|endoftext|> end", "Ünï ß 日本語 한국어 😀 ͸x", "x" * 5000, "The quick\tbrown  fox! " * 3000, "a\n b \nc\t d", "\x85 \x1c x ", "tail "]
SCHEMA = "doc_id long, text string, start string, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(40 - 3 * k, t, "x", "y") for k, t in enumerate(TEXTS)] + [(40, TEXTS[0], None, None), (40, "other text", None, None), (None, "no id", None, None)], SCHEMA)


def expected(docs):
    tokenizer = Tokenizer.from_file(queries.byte_vocabulary_path())
    return sorted(((r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + (0,)) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_round_trip(spark, docs, unit):
    rows = sorted(bit_planes.round_trip(docs, queries.byte_vocabulary_path(), unit=unit).collect(), key=lambda r: r.start)
    ids = [(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows]
    assert [i for i, _ in ids] == [i for i, _ in expected(docs)]
    assert sorted(ids, key=repr) == sorted(expected(docs), key=repr)
    assert [r.n_tokens for r in rows] == [len(x) for _, x in ids]
    assert [r.start for r in rows] == [sum(len(x) for _, x in ids[:k]) for k in range(len(ids))]
    none = spark.createDataFrame([], SCHEMA)
    assert bit_planes.round_trip(none, queries.byte_vocabulary_path()).count() == 0


def test_query_digests(spark, docs, tmp_path):
    docs.filter("doc_id is not null and doc_id < 40").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.op12_bit_planes(spark, str(tmp_path)).collect())
    want, at = [], 0
    for i, ids in expected(docs.filter("doc_id is not null and doc_id < 40")):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_encoder_is_the_tokenizer(monkeypatch):
    """Whole texts and their words give the same ids, with memories that forget all the time too."""
    monkeypatch.setattr(bit_planes, "MOST_WORDS", 6)
    monkeypatch.setattr(bit_planes, "MOST_PARTS", 6)
    own = bit_planes.ByteEncoder(queries.byte_vocabulary_path())
    assert own.by_words
    rng = np.random.default_rng(1)
    pieces = ["a", "B", "ß", "7", "'", "s", "'ll", " ", " ", "\n", "\t", "\r\n", " ", " ", "日", "!", "--", "é", "٣", "\x1c", "͸", "𐐀"]
    for text in [*filter(None, TEXTS), *("".join(rng.choice(pieces, 30)) for _ in range(1500))]:
        assert own.ids(text) == own._whole(text), repr(text)


def test_any_stretch_of_a_file(monkeypatch, tmp_path):
    monkeypatch.setattr(bit_planes, "BLOCK_IDS", 100)
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 1 << k, n).astype("<u4") for k, n in ((1, 0), (7, 99), (9, 100), (17, 1), (32, 350), (16, 3), (31, 1000))]
    for unit in bit_planes.UNITS:
        path = str(tmp_path / unit)
        file = bit_planes.PlaneFile(fs.LocalFileSystem(), path, unit)
        for k, d in enumerate(docs):
            file.add(None if k == 2 else k, d.tobytes())
        file.close()
        whole, reader = np.concatenate(docs), bit_planes.PlaneReader(fs.LocalFileSystem(), path)
        assert reader.index[:, 1].tolist() == [100] * 15 + [len(whole) - 1500]
        for a, b in ((0, 0), (0, 1), (99, 101), (100, 200), (5, 1500), (0, len(whole)), (len(whole) - 1, len(whole))):
            assert (reader.ids(a, b) == whole[a:b]).all() and len(reader.ids(a, b)) == b - a
        for most in (1, 250, 10**6):
            assert b"".join(x for _, _, x in reader.documents(most)) == whole.tobytes()
        with open(path, "rb+") as f:
            f.seek(-3, 2)
            f.truncate()
        with pytest.raises(ValueError):
            bit_planes.PlaneReader(fs.LocalFileSystem(), path)


def test_only_listed_files_are_read(spark, docs, tmp_path, monkeypatch):
    """What a lost task left behind isn't read, and a second write replaces the first."""
    path = str(tmp_path / "set")
    ids = bit_planes.token_ids(docs, queries.byte_vocabulary_path())
    bit_planes.write_planes(ids, path)
    (tmp_path / "set" / "0-000000-9-000000.planes").write_bytes(b"half a file")
    assert bit_planes.read_planes(spark, path).count() == docs.count()
    bit_planes.write_planes(ids.filter("doc_id = 40"), f"file://{path}")
    assert bit_planes.read_planes(spark, path).count() == 3
