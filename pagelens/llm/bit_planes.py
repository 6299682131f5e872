"""Token ids in files of bit planes.

The ids of documents, one document after the other, are cut into blocks of a fixed number of ids. A block is
transposed: its first plane holds the lowest bit (or byte) of every id, the next plane the next one, and so on. High planes
of small ids are all zero and take no room; the others are compressed with zstandard, each for itself. A file ends with
its chunk index (where each block begins, how many ids it has, how long each of its planes is) and the documents' ids and
lengths, so that any stretch of ids can be read by decoding the blocks that hold it.

Spark writes and reads such folders by the data source `bit_planes`. Each task writes files of its own and the driver
then writes the list of those that count, in order: files of a task that was lost or ran twice are never read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import _filesystem, rows_of, shared_dir
from .packing import SPELLING

MAGIC = b"BITPLN01"
LIST = "files.json"
#: Ids in a block; ids and documents after which a file ends (with the document that it is at).
BLOCK_IDS, FILE_IDS, FILE_DOCS = 1 << 16, 1 << 25, 1 << 20
#: Bits of a plane.
UNITS = {"bit": 1, "byte": 8}

#: How byte-level vocabularies of this kind part a text, for ASCII and for the letters below; fixed by the vocabulary. Alternatives that can't begin alike are in any order.
PARTS = r" ?{L}+| ?{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{S}{LN}]+|[{S}]+(?![^{S}])|[{S}]+"
ASCII_PARTS = re.compile(PARTS.format(L="[A-Za-z]", N="[0-9]", LN="A-Za-z0-9", S=r"\t-\r "))
OTHER_PARTS = regex.compile(PARTS.format(L=r"\p{L}", N=r"\p{N}", LN=r"\p{L}\p{N}", S=r"\p{White_Space}"))
#: Characters whose classes no version of Unicode since 5.0 has changed: Latin, Greek, Cyrillic, general punctuation, kana, common ideographs and syllables.
SETTLED = re.compile("[\x00-ɏΑ-ΡΣ-ωЀ-ҁҊ-ԓ‐-‧‰-⁞€、-】ぁ-ゖァ-ヺ一-龥가-힣！-～]*")
#: What most words are: letters, then marks that no letter joins.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)\Z")
#: A space between white space, or after it at the end, belongs to what is before it; any other space begins a part.
INNER_SPACE = re.compile(r" (?:\s(?<=\s..)|\Z(?<=\s.))", re.S)
PROBES = ("Two words", "two  WORDS\n\tand more \n", " it's we'll I'D 12,5% #x $y ...", "Ünïcode straße, É t naïve;\r\n\r\n x", "日本語 text, 한국어 Русский　¹²½", "a_b-c --- ''' \x1c\x1d x\x85y", "a\n b \nc\t d 𐐀 e", "   ", "", "x ", " y")
SPACE = " ".translate(SPELLING)
#: Words whose ids a worker remembers, and parts of words; bytes of text whose ids are put out together.
MOST_WORDS, MOST_PARTS, SLICE_BYTES = 800_000, 100_000, 2_000_000
_encoders: dict[str, ByteEncoder] = {}


class Memory(dict):
    """What `find` gives for a key, remembered: the last `most` / 2 new keys at least, `most` at most, of earlier ones those that came again since."""

    def __init__(self, find: Callable[[str], bytes], most: int):
        super().__init__()
        self.find, self.half, self.older = find, most // 2, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.find(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class ByteEncoder:
    """Token ids of a whole text from those of its words.

    A byte-level vocabulary cuts a text into parts by a fixed pattern and merges bytes within parts only. A space begins a part
    unless it stands between white space, so a text's ids are those of its words, each with the space before it; most words and parts come again
    and are looked up. Words with characters whose class depends on the version of Unicode, and texts with a special token's string
    or with spaces between white space, go to the tokenizer whole; all texts do so if the two ways differ on PROBES.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = Memory(self._part, MOST_PARTS)
        self.spaced = Memory(self._after_space, MOST_WORDS)
        self.by_words = True
        self.by_words = all(self.ids(p) == self._whole(p) for p in PROBES)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        return self._spelt(part.encode().decode("latin-1").translate(SPELLING))

    def _spelt(self, part: str) -> bytes:
        return array("I", [x.id for x in self.merge(part)]).tobytes()

    def _after_space(self, word: str) -> bytes:
        """The ids of a word after a space. Words that white space begins or ends depend on what is beside them: they aren't looked up."""
        if word.isascii() and word.isalpha():
            return self._spelt(SPACE + word)
        if LETTERS.fullmatch(word):
            return self._part(" " + word)
        if not word or word[0].isspace() or word[-1].isspace():
            raise LookupError
        return self._word(" " + word)

    def _word(self, word: str) -> bytes:
        if plain := PLAIN.match(word):
            space, letters, marks = plain.groups()
            found = self.spaced[letters] if space else self.parts[letters]
            return found + self.parts[marks] if marks else found
        if word.isascii():
            return b"".join(map(self.parts.__getitem__, ASCII_PARTS.findall(word)))
        if SETTLED.fullmatch(word):
            return b"".join(map(self.parts.__getitem__, OTHER_PARTS.findall(word)))
        return self._whole(word)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.by_words or any(s in text for s in self.special):
            return self._whole(text)
        first, *others = text.split(" ")
        try:
            return self._word(first) + b"".join(map(self.spaced.__getitem__, others))
        except LookupError:
            pass
        if INNER_SPACE.search(text):
            return self._word(text)
        return self._word(first) + b"".join([self._word(" " + w) for w in others])


def encoder(path: str) -> ByteEncoder:
    """One a worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def token_ids(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, the end id last) of all documents, in ascending order of doc_id.

    Null ids come first; rows with one id are ordered by a digest of their texts. Other columns of docs aren't read.
    Rows are dealt by range of (id, digest, row), so even a third of all rows under one id is spread over tasks.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            at, sizes = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
                ids = [(enc.ids(t) if t else b"") + end for t in batch.column(1).slice(at, to - at).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(ids, pa.binary())], ["doc_id", "ids"])
                at = to

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"_digest": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), F.asc("_digest"), F.asc("_row")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """The compressed planes of a block, lowest first; nothing for a plane of zeros."""
    size, press = UNITS[unit], zstandard.ZstdCompressor(level=1)
    used = max(1, (int(ids.max()).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)[:, :used]
    rows = np.ascontiguousarray(raw.T)
    if size == 1:
        rows = np.concatenate([np.packbits(r[None, :] >> np.arange(8, dtype=np.uint8)[:, None] & 1, axis=1, bitorder="little") for r in rows])
    return [press.compress(r.tobytes()) if r.any() else b"" for r in rows] + [b""] * (32 // size - len(rows))


def from_planes(data: memoryview, lengths: np.ndarray, count: int, unit: str) -> np.ndarray:
    """The ids of a block of `count`."""
    size, press, at = UNITS[unit], zstandard.ZstdDecompressor(), 0
    width = count if size == 8 else (count + 7) // 8
    found = np.zeros((count, 4), np.uint8)
    for k, n in enumerate(lengths.tolist()):
        if n:
            row = np.frombuffer(press.decompress(data[at : at + n], max_output_size=width), np.uint8)
            found[:, k * size // 8] |= row if size == 8 else np.unpackbits(row, count=count, bitorder="little") << np.uint8(k % 8)
            at += n
    return found.view("<u4").ravel()


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it of a URI or a plain path."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


class PlaneFile:
    """Writes one file: documents by add(), then close()."""

    def __init__(self, store: fs.FileSystem, path: str, unit: str):
        self.out, self.unit, self.at = store.open_output_stream(path), unit, len(MAGIC)
        self.out.write(MAGIC)
        self.waiting: list[bytes] = []
        self.held = 0
        self.docs: list[tuple[int | None, int]] = []
        self.index: list[list[int]] = []
        self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.waiting.append(ids)
        self.held += len(ids) // 4
        self.ids += len(ids) // 4
        if self.held >= BLOCK_IDS:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        whole = np.frombuffer(b"".join(self.waiting), "<u4")
        end = len(whole) if last else len(whole) // BLOCK_IDS * BLOCK_IDS
        for a in range(0, end, BLOCK_IDS):
            block = whole[a : min(a + BLOCK_IDS, end)]
            found = planes(block, self.unit)
            self.out.write(b"".join(found))
            self.index.append([self.at, len(block), *map(len, found)])
            self.at += sum(map(len, found))
        self.waiting, self.held = [whole[end:].tobytes()], len(whole) - end

    def close(self) -> None:
        self._blocks(True)
        ids, lengths = np.array([d or 0 for d, _ in self.docs], "<i8"), np.array([n for _, n in self.docs], "<i8")
        null = np.array([d is None for d, _ in self.docs], np.uint8)
        index = np.array(self.index, "<i8").reshape(len(self.index), 2 + 32 // UNITS[self.unit])
        foot = zstandard.compress(struct.pack("<qqq", len(self.index), len(self.docs), UNITS[self.unit]) + index.tobytes() + ids.tobytes() + lengths.tobytes() + null.tobytes())
        self.out.write(foot + struct.pack("<q", len(foot)) + MAGIC)
        self.out.close()


class PlaneReader:
    """Reads one file: its chunk index and documents at once, ids where they are asked for."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} isn't a whole file of bit planes")
        (n,) = struct.unpack("<q", tail[:8])
        foot = zstandard.decompress(self.file.read_at(n, size - 16 - n))
        blocks, docs, bits = struct.unpack_from("<qqq", foot)
        self.unit = {v: k for k, v in UNITS.items()}[bits]
        wide, at = 2 + 32 // bits, 24
        self.index = np.frombuffer(foot, "<i8", blocks * wide, at).reshape(blocks, wide)
        at += self.index.nbytes
        self.doc_ids, self.lengths = np.frombuffer(foot, "<i8", docs, at), np.frombuffer(foot, "<i8", docs, at + 8 * docs)
        self.null = np.frombuffer(foot, np.uint8, docs, at + 16 * docs).astype(bool)
        self.begins = np.concatenate(([0], np.cumsum(self.index[:, 1])))

    def block(self, k: int) -> np.ndarray:
        lengths = self.index[k, 2:]
        return from_planes(memoryview(self.file.read_at(int(lengths.sum()), int(self.index[k, 0]))), lengths, int(self.index[k, 1]), self.unit)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, by the blocks that hold them."""
        a, b = np.searchsorted(self.begins, start, "right") - 1, np.searchsorted(self.begins, stop, "left")
        found = [self.block(k) for k in range(a, b)]
        return np.concatenate(found)[start - self.begins[a] : stop - self.begins[a]] if found else np.zeros(0, "<u4")

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
        """first document, number of documents, their ids: some at a time, `most` ids or one document."""
        ends = np.cumsum(self.lengths)
        at = begin = next_block = 0
        held = np.zeros(0, "<u4")
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, begin + most, "right")))
            parts, have = [held], len(held)
            while have < ends[to - 1] - begin:
                parts.append(self.block(next_block))
                have += len(parts[-1])
                next_block += 1
            whole = np.concatenate(parts)
            cut = int(ends[to - 1] - begin)
            yield at, to - at, whole[:cut].tobytes()
            held, at, begin = whole[cut:], to, int(ends[to - 1])


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list  # name, ids, documents, bytes


@dataclass
class PlanePart(InputPartition):
    name: str
    start: int


class PlaneWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.unit, self.run = options["path"].rstrip("/"), options.get("unit", "bit"), uuid.uuid4().hex[:12]
        if self.unit not in UNITS:
            raise ValueError("unit is bit or byte")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, folder = place(self.path)
        store.create_dir(folder, recursive=True)
        done: list[list] = []
        file = name = None

        def close() -> None:
            file.close()
            done.append([name, file.ids, len(file.docs)])

        for doc_id, ids in rows_of(iterator, "doc_id", "ids"):
            if file is None:
                name = f"{self.run}-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):06d}.planes"
                file = PlaneFile(store, f"{folder}/{name}", self.unit)
            file.add(doc_id, ids or b"")
            if file.ids >= FILE_IDS or len(file.docs) >= FILE_DOCS:
                close()
                file = None
        if file is not None:
            close()
        return Written(task.partitionId(), done)

    def commit(self, messages: list) -> None:
        """Writes the list of files that count, in the order of partitions, and removes others of this run."""
        store, folder = place(self.path)
        store.create_dir(folder, recursive=True)
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.partition) for f in m.files]
        kept = {f[0] for f in files}
        for info in store.get_file_info(fs.FileSelector(folder)):
            if info.base_name.startswith(self.run) and info.base_name not in kept:
                store.delete_file(info.path)
        with store.open_output_stream(f"{folder}/{LIST}.{self.run}") as out:
            out.write(json.dumps({"unit": self.unit, "block_ids": BLOCK_IDS, "files": files}).encode())
        store.move(f"{folder}/{LIST}.{self.run}", f"{folder}/{LIST}")

    def abort(self, messages: list) -> None:
        store, folder = place(self.path)
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.startswith(self.run):
                store.delete_file(info.path)


class PlaneSource(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[PlanePart]:
        store, folder = place(self.path)
        with store.open_input_file(f"{folder}/{LIST}") as f:
            files, start, found = json.loads(f.read())["files"], 0, []
        for name, ids, _ in files:
            found.append(PlanePart(name, start))
            start += ids
        return found

    def read(self, partition: PlanePart) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, PlanePart):
            return
        store, folder = place(self.path)
        file = PlaneReader(store, f"{folder}/{partition.name}")
        starts = partition.start + np.concatenate(([0], np.cumsum(file.lengths)))
        for at, n, ids in file.documents():
            lengths = file.lengths[at : at + n]
            offsets = np.concatenate(([0], np.cumsum(lengths * 4))).astype(np.int32)
            blobs = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[at : at + n], mask=file.null[at : at + n]), pa.array(starts[at : at + n]), pa.array(lengths), blobs], ["doc_id", "start", "n_tokens", "ids"])


class BitPlanes(DataSource):
    """`df.write.format("bit_planes")` takes (doc_id long, ids binary) in the order in which they shall lie; `spark.read.format("bit_planes")` gives doc_id, start, n_tokens, ids.

    Options: path, and for writing unit ("bit" or "byte"). A folder holds one dataset: writing replaces its list of files. A document without ids is kept, a null ids counts as none; a
    dataset without rows has an empty list. Ids of documents are whole numbers or null. A document lies in one file, however long.
    """

    @classmethod
    def name(cls) -> str:
        return "bit_planes"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> PlaneSource:
        return PlaneSource(self.options)

    def writer(self, schema, overwrite: bool) -> PlaneWriter:
        return PlaneWriter(self.options)


def write_planes(ids: DataFrame, path: str, unit: str = "bit") -> None:
    ids.sparkSession.dataSource.register(BitPlanes)
    ids.write.format("bit_planes").option("unit", unit).mode("append").save(path)


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BitPlanes)
    return spark.read.format("bit_planes").load(path)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0, unit: str = "bit") -> DataFrame:
    """doc_id, start, n_tokens, ids of all documents, read back from the files that their ids were written to.

    Null and empty texts have the end id alone. Repeated rows are documents each for itself. Without rows the result is empty.
    The files lie in the shared folder and go when the driver ends.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/planes-{uuid.uuid4().hex}"
    write_planes(token_ids(docs, vocabulary, end_id), path, unit)
    store, target = _filesystem(spark, path)
    store.deleteOnExit(target)
    return read_planes(spark, path)
