"""Runs of repeated word sequences by maximal pairs.

A run is a longest stretch of words in which words a period apart are equal. For a run of period q from word s the suffixes
at s and s+q share exactly length-q words, and the words left of them differ: they are a maximal pair. So the pairs
are enumerated instead: the suffixes of a document, sorted by prefix doubling, form a tree of LCP intervals, which is walked
bottom-up. Each interval holds the places of its suffixes in order, with the left word that they share if they all share one. Where
intervals meet, a place of the smaller list and its neighbour in the larger one are a pair that shares exactly the
interval's length; if their left words differ and their distance suits the length, the pair is a run. Places between
the two would give the run a smaller period, so neighbours are enough, and no stretch is ever extended word by word.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

#: Words of documents whose suffixes are sorted together; a longer document is sorted alone.
BATCH_WORDS = 150_000
RUN = "struct<start: long, length: long, period: long>"


def sorted_suffixes(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that share `least` or more words with another, in sorted order, and how many each shares with the one before.

    Words are numbers; one that stands at one place only ends each document, so no suffix reaches beyond its own.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    begins = np.concatenate(([True], words[order][1:] != words[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    levels, width = [rank.astype(np.int32)], 1

    def shared(groups: np.ndarray) -> np.ndarray:
        """Which rows of a table sorted by group belong to a group of several."""
        same = groups[1:] == groups[:-1]
        return np.concatenate((same, [False])) | np.concatenate(([False], same))

    left = order[shared(rank[order])]
    several = left
    while len(left):
        by, then = rank[left], rank[left + width]
        at = np.lexsort((then, by))
        left, by, then = left[at], by[at], then[at]
        place = np.arange(len(left))
        new_group = np.concatenate(([True], by[1:] != by[:-1]))
        new_part = new_group | np.concatenate(([True], then[1:] != then[:-1]))
        rank = rank.copy()
        rank[left] = by + np.maximum.accumulate(np.where(new_part, place, 0)) - np.maximum.accumulate(np.where(new_group, place, 0))
        width *= 2
        levels.append(rank.astype(np.int32))
        left = left[shared(rank[left])]
        if width <= least:
            several = left
    final = several[np.argsort(rank[several])]
    length = np.zeros(len(final), np.int64)
    if len(final):
        a, b, common = final[:-1], final[1:], np.zeros(len(final) - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            common += np.where(levels[k][a + common] == levels[k][b + common], 1 << k, 0)
        length[1:] = common
    return final, length


class Places:
    """The places of an LCP interval's suffixes in order, and the left word that all share (None if they don't)."""

    __slots__ = ("left", "places")

    def __init__(self, place: int, left: int):
        self.places, self.left = [place], left


def maximal_pairs(words: list[int], suffixes: list[int], shared: list[int], least_shared: int, least_length: int, repeats: int) -> dict[tuple[int, int], int]:
    """(begin, end) -> smallest period of all maximal pairs whose distance suits: the runs of `repeats` periods or more."""
    found: dict[tuple[int, int], int] = {}

    def merged(one: Places, other: Places, length: int) -> Places:
        small, large = (one, other) if len(one.places) <= len(other.places) else (other, one)
        far = length // (repeats - 1)
        held = large.places
        if small.left is None or small.left != large.left:
            for p in small.places:
                k = bisect_left(held, p)
                for o in held[max(0, k - 1) : k + 1]:
                    q = abs(o - p)
                    if q <= far and q + length >= least_length and words[o - 1] != words[p - 1]:
                        key = (min(o, p), max(o, p) + length)
                        if q < found.get(key, q + 1):
                            found[key] = q
            large.left = None
        if len(small.places) * 8 < len(held):
            for p in small.places:
                insort(held, p)
        else:
            held += small.places
            held.sort()
        return large

    stack: list[tuple[int, Places]] = []
    child = None
    for place, length in zip(suffixes, shared, strict=True):
        while stack and stack[-1][0] > length:
            top, before = stack.pop()
            child = merged(before, child, top)
        if length >= least_shared:
            if stack and stack[-1][0] == length:
                stack[-1] = (length, merged(stack[-1][1], child, length))
            else:
                stack.append((length, child))
        child = Places(place, words[place - 1])
    while stack:
        top, before = stack.pop()
        child = merged(before, child, top)
    return found


def runs_of(texts: list[list[bytes]], repeats: int = 4, least_length: int = 6) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start and period."""
    number: dict[bytes, int] = {}
    flat, begins = [-1], []
    for k, own in enumerate(texts):
        begins.append(len(flat))
        flat += [number.setdefault(w, len(number)) for w in own]
        flat.append(-2 - k)
    size = len(number)
    words = np.array(flat, np.int64)
    # Equal words of different documents are different: no suffix group crosses documents.
    owner = np.zeros(len(flat), np.int64)
    owner[begins[1:]] = 1
    words = np.where(words >= 0, words + np.cumsum(owner) * size, words)
    least_shared = min(max(least_length - q, (repeats - 1) * q) for q in range(1, least_length + 1))
    suffixes, shared = sorted_suffixes(words, least_shared)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(suffixes):
        pairs = maximal_pairs(flat, suffixes.tolist(), shared.tolist(), least_shared, least_length, repeats)
        keys = sorted((b, q, e) for (b, e), q in pairs.items())
        for (b, q, e), k in zip(keys, (np.searchsorted(begins, [b for b, _, _ in keys], "right") - 1).tolist(), strict=True):
            out[k].append((b - begins[k], e - b, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what any run contains after its first period, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, repeats: int = 4, least_length: int = 6) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period), collapsed (the text without repeats) of every row.

    Words are what separates by U+0020 and U+0009 to U+000D, compared byte by byte. A run repeats its smallest period `repeats` (2 or more) times or more and
    has `least_length` words or more. A null or empty text has no runs and an empty collapsed text. Each row stands for itself, whether
    ids repeat or are null; only doc_id and text are read. No rows give no rows. Nothing is shuffled: a task holds some documents, or one very
    long one with four bytes a word for each doubling of its longest repeat.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                own, held, first = [], 0, at
                while at < batch.num_rows and held < BATCH_WORDS:
                    ((text,),) = rows_of([batch.slice(at, 1)], "text")
                    own.append(text.encode("utf-8", "surrogatepass").split() if text else [])
                    held += len(own[-1])
                    at += 1
                runs = runs_of(own, repeats, least_length)
                texts = [collapsed(w, r).decode("utf-8", "surrogatepass") for w, r in zip(own, runs, strict=True)]
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), pa.array(rows, pa.list_(struct)), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<{RUN}>, collapsed string")


def with_tail_repeated(docs: DataFrame) -> DataFrame:
    """doc_id, text: where crc32 of the id as text is divisible by ten, the words from one place on repeat the p words there.

    With h that number, g = h/10 and n words, the place is a = g%n and p = 1 + (n-a)/(3 + g%8), all in whole numbers. A null id or text stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.expr("crc32(cast(doc_id as string)) div 10")
    own = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    found = docs.select("doc_id", "text", own.alias("w"), g.alias("g")).withColumn("n", F.size("w"))
    p = F.expr("1 + (n - a) div (3 + g % 8)")
    told = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    placed = found.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", p)
    return placed.select("doc_id", F.when((h % 10 == 0) & (F.col("n") > 0), F.array_join(told, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """From periodic_runs: the number of runs, the run of greatest exact length/period (ties: smallest start, then period), digests."""
    more = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]
    best = F.aggregate("runs", F.lit(None).cast(RUN), lambda best, x: F.when(best.isNull() | more(x, best), x).otherwise(best))
    told = F.concat_ws("", F.transform("runs", lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
