"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes; where its low 16 bits (which depend on the last sixteen bytes alone) fall under a bound, a chunk may
begin or end, so an insertion moves no border but those next to it. A chunk reaches from a place that may begin one
to the first end LEAST_BYTES or more further on; chunks overlap. Where no place falls under the bound (in text that repeats itself, or by chance), after QUIET_BYTES
without one each place with the lowest hash of as many bytes counts. A text too short for any chunk is one itself. Chunks are deduplicated by digest over all
documents, and runs of repeated chunks are the passages.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import fresh

WINDOW = 16
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)
#: Mean distance of places where a chunk may begin and may end, and its shortest length in bytes.
BEGIN_EVERY, END_EVERY, LEAST_BYTES = 14, 5, 64
QUIET_BYTES = 64
#: Shortest passage, in words, that counts as repeated.
LEAST_WORDS = 25


def places(h: np.ndarray, every: int) -> np.ndarray:
    """Where the hash falls under the bound that one place in `every` does, and in quiet stretches its lowest places."""
    found = np.flatnonzero(h < 65536 // every)
    edges = np.concatenate(([-1], found, [len(h)]))
    forced = []
    for k in np.flatnonzero(np.diff(edges) > QUIET_BYTES):
        quiet = h[edges[k] + 1 : edges[k + 1]]
        if len(quiet) >= QUIET_BYTES:
            lowest = np.lib.stride_tricks.sliding_window_view(quiet, QUIET_BYTES).min(axis=1)
            forced.append(edges[k] + QUIET_BYTES + np.flatnonzero(quiet[QUIET_BYTES - 1 :] == lowest))
    return np.sort(np.concatenate([found, *forced])) if forced else found


def chunks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins, ends and digests of the chunks."""
    digest = xxhash.xxh3_64_intdigest
    begins = ends = np.zeros(0, np.int64)
    if len(data) >= LEAST_BYTES + WINDOW:
        gear = GEAR[np.frombuffer(data, np.uint8)]
        h = np.zeros(len(data) - WINDOW + 1, np.uint32)
        for j in range(WINDOW):
            h += gear[WINDOW - 1 - j : len(data) - j] << np.uint32(j)
        h &= np.uint32(0xFFFF)
        begins, ends = (places(h, every) + WINDOW for every in (BEGIN_EVERY, END_EVERY))
        at = np.searchsorted(ends, begins + LEAST_BYTES)
        begins, at = begins[at < len(ends)], at[at < len(ends)]
        ends = ends[at] if len(at) else ends[:0]
    if not len(begins) and data.strip():
        begins, ends = np.zeros(1, np.int64), np.array([len(data)])
    return begins, ends, np.array([digest(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], np.uint64)


def _of_block(rows: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    texts = [t.encode("utf-8", "surrogatepass") for t in rows["text"].to_pylist()]
    found = [chunks(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found]).astype(np.int64)
    return texts, doc, *(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


def _ask(rows: pa.Table, part: bool) -> list[tuple[int, np.ndarray, list[np.ndarray]]]:
    _, doc, begins, _, digests = _of_block(rows)
    ids = rows["doc_id"].to_numpy().astype(np.int64)[doc]
    order = np.lexsort((begins, doc, ids, digests))
    d, w = digests[order], doc[order]
    fresh = np.concatenate(([True], (d[1:] != d[:-1]) | (w[1:] != w[:-1]))) if len(d) else np.zeros(0, bool)
    keys, begin, n = np.unique(d[fresh], return_index=True, return_counts=True)
    first = order[fresh][begin]
    return [(0, keys, [n.astype(np.uint64), ids[first].view(np.uint64), begins[first].astype(np.uint64)])]


def _answer(level: int, keys: np.ndarray, values: list[list[np.ndarray]], parts: np.ndarray) -> list[list[np.ndarray]]:
    n, least, place = np.zeros(len(keys), np.uint64), np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.uint64).max)
    for places, count, first, begin in values:
        n[places] += count
        first = first.view(np.int64)
        fewer = (first < least[places]) | ((first == least[places]) & (begin < place[places]))
        least[places[fewer]], place[places[fewer]] = first[fewer], begin[fewer]
    n, least, place = np.where(n > 1, n, np.uint64(0)), np.where(n > 1, least, 0).view(np.uint64), np.where(n > 1, place, np.uint64(0))
    return [[n[v[0]], least[v[0]], place[v[0]]] for v in values]


def _whole(data: bytes, x: int, y: int) -> tuple[int, int]:
    """The part of data[x:y] that holds whole characters."""
    while x < y and data[x] & 0xC0 == 0x80:
        x += 1
    while y > x and y < len(data) and data[y] & 0xC0 == 0x80:
        y -= 1
    return x, y


def _passages(rows: pa.Table, part: bool, found: pd.DataFrame) -> pd.DataFrame:
    texts, doc, begins, ends, digests = _of_block(rows)
    out = []
    if len(digests):
        keys = np.unique(digests)
        copies, least, place = blocks.answers(found, 0)
        at = np.searchsorted(keys, digests)
        repeated = np.flatnonzero(copies[at] > 0)
        at, doc, begins, ends = at[repeated], doc[repeated], begins[repeated], ends[repeated]
        copies, least, place = copies[at], least[at].view(np.int64), place[at].view(np.int64)
        if len(doc):
            reach = ends + doc * (1 << 40)
            reach = np.maximum.accumulate(reach)
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (begins[1:] + doc[1:] * (1 << 40) > reach[:-1])))
            # Where the first document changes, or has the next chunk elsewhere, another piece of the run begins.
            shift, own = begins - place, rows["doc_id"].to_numpy().astype(np.int64)[doc] == least
            piece = new | np.concatenate(([True], (least[1:] != least[:-1]) | ((shift[1:] != shift[:-1]) & ~own[1:])))
            first, pieces = np.flatnonzero(new), np.flatnonzero(piece)
            last = np.concatenate((first[1:], [len(doc)]))
            ids = rows["doc_id"].to_pylist()
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                data = texts[doc[a]]
                x, y = _whole(data, int(begins[a]), int(ends[a:b].max()))
                if (x, y) != (0, len(data)) and len(data[x:y].decode("utf-8", "surrogatepass").split()) < LEAST_WORDS:
                    continue
                cuts = [*pieces[np.searchsorted(pieces, a) : np.searchsorted(pieces, b)].tolist(), b]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    x, y = _whole(data, int(begins[i]), int(ends[i:j].max()))
                    passage = data[x:y].decode("utf-8", "surrogatepass")
                    start = len(data[:x].decode("utf-8", "surrogatepass"))
                    out.append((ids[doc[a]], start, start + len(passage), len(passage.split()), int(copies[i:j].min()), int(least[i]), f"{xxhash.xxh3_64_intdigest(data[x:y]):016x}"))
    return pd.DataFrame(out, columns=["doc_id", "start", "end", "n_words", "copies", "first_doc_id", "digest"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (code points), n_words, copies, first_doc_id, digest: the passages that repeat across rows, of runs of LEAST_WORDS or more words; a whole text that repeats counts whatever its length.

    A run of touching repeated chunks is given in pieces, which overlap as chunks do and may be shorter than LEAST_WORDS: each piece lies in the document
    first_doc_id in one part, and no smaller doc_id has a chunk of it, so there it may stay. copies is the smallest number of rows that share a chunk of it.
    A passage is known by its chunks, so up to some dozen bytes at its ends may be missing. Rows whose text or doc_id (a whole number) is
    null have no passages, nor have empty and blank texts. A repeated row repeats its passages; of equal doc_ids the first place counts. A very long text is read whole, in a block of its own. What repeats within one text alone doesn't count. Other columns aren't read. Without rows the result is empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    corpus = blocks.gather(rows)
    replies = blocks.exchange(corpus, _ask, _answer, blocks.shard_count(corpus))
    return blocks.each(corpus, replies, _passages, "doc_id long, start long, end long, n_words long, copies long, first_doc_id long, digest string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with each repeated passage cut out of every document but the one with the smallest doc_id that holds it. Nulls stay; columns keep their order."""
    own = fresh(docs, "_cuts")
    cuts = repeated_passages(docs).filter("doc_id != first_doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(own))
    text, start = F.col("text"), F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    kept = F.aggregate(own, start, lambda acc, c: F.struct(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(c["start"] - acc["at"], F.lit(0)).cast("int"))).alias("out"), F.greatest(acc["at"], c["end"]).alias("at")), lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return docs.join(cuts, "doc_id", "left").withColumn("text", F.when(F.col(own).isNotNull(), kept).otherwise(text)).select(*docs.columns)
