"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two of n's binary form, a power above
the longest allowed sequence counting as several of that length. Pieces of equal length form one bucket, so a
training step takes sequences of one length from one bucket, none of which crosses documents or needs padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

#: Words whose ids a worker remembers; beyond this many it begins anew.
REMEMBERED = 400_000
#: Latin letters in their composed form, then marks: normalising such a word changes its case only, and letters and marks are tokens apart.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,!?;:|%&$#*]*)\Z")
#: The byte-level spelling of such vocabularies: printable Latin-1 characters stand for their own byte, other bytes for 256 and up in order.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLING = {b: b for b in PRINTABLE} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*PRINTABLE}))}
#: What shows whether a tokenizer drops white space, folds case, and parts letters from marks as assumed.
PROBES = ("Two words", "two  WORDS\n\tand more ", " Ünïcode straße, ÉTÉ! naïve;", "marks... (here) 'quoted' a-b c_d 12,5% #x $y", "日本語 text ١٢ é e\u0301", "UPPER lower Mixed&more*", "")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of a whole text, put together from the ids of its words.

    White space only separates tokens in a vocabulary whose normaliser drops it, so the ids of a text are those of
    its words one after the other; most words come again and again and are looked up. Texts with a special
    token's string in them go to the tokenizer whole, and all texts do so with a tokenizer for which the two ways differ on PROBES.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.by_words = True
        self.by_words = all(self.ids(p) == self._whole(p) for p in PROBES)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        m = PLAIN.match(word)
        if not m or not (low := m[1].lower()).isalpha():
            return self._whole(word)
        return self._part(low) + self._part(m[2]) if m[2] else self._part(low)

    def _part(self, part: str) -> bytes:
        """Letters, or marks, as the model's own spelling."""
        if part not in self.parts:
            spelt = part if part.isascii() else part.encode().decode("latin-1").translate(SPELLING)
            self.parts[part] = np.array([x.id for x in self.tokenizer.model.tokenize(spelt)], dtype="<u4").tobytes()
        return self.parts[part]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.by_words or any(s in text for s in self.special):
            return self._whole(text)
        if text.isascii():
            text = text.lower()
        found = re.split("[ \n\t\r]+", text) if "\t" in text or "\r" in text else text.replace("\n", " ").split(" ")
        known = self.known
        try:
            return b"".join([known[w] for w in found])
        except KeyError:
            for memory in (known, self.parts):
                if len(memory) > REMEMBERED:
                    memory.clear()
            for w in found:
                if w not in known:
                    known[w] = self._word(w) if w else b""
            return b"".join([known[w] for w in found])


def encoder(path: str) -> WordEncoder:
    """One a worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def piece_lengths(n: int, longest: int) -> list[int]:
    """The lengths of the pieces of n tokens, largest first."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, longest: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and ids).

    Every piece is a sequence of its own; `bucket` is its length, to be batched with others of that length
    (`piece.repartition("bucket")` or a partitioned write gives the buckets' files). `longest` is a power of two.
    A null or empty text has the end token alone; a very long one gives as many pieces as it takes. A null doc_id is kept. Repeated rows are packed each for itself.
    Of the input only doc_id and text are read, so other columns, whatever their names, don't matter. Without rows
    the result is empty. `sequence_id` is the partition's number and the piece's place in it, so it is unique
    without a shuffle. `with_ids` adds the token ids.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids, rows, blobs = batch.column(0), [], []
            at = []
            for k, (text,) in enumerate(rows_of([batch], "text")):
                data = memoryview((enc.ids(text) if text else b"") + end)
                n, start = len(data) // 4, 0
                for length in piece_lengths(n, longest):
                    piece = data[start * 4 : (start + length) * 4]
                    at.append(k)
                    rows.append((start, length, zlib.crc32(piece), n))
                    if with_ids:
                        blobs.append(np.frombuffer(piece, "<u4").astype(np.int64))
                    start += length
            table = np.array(rows, dtype=np.int64).reshape(-1, 4)
            cols = [ids.take(pa.array(at, pa.int64())), *(pa.array(table[:, i]) for i in range(4))]
            if with_ids:
                cols.append(pa.array(blobs, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names + ["ids"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    pieces = docs.select("doc_id", "text").mapInArrow(run, schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.col("length")})
