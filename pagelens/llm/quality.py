"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed character trigrams and shape terms (binned shares of capitals, marks, repeated words and the like). Counts
are damped and weighted by inverse document frequencies over all documents; a singular value decomposition of a bounded sample
of labelled documents gives the latent space. The sample's vectors are broadcast, every document is compared with all of them
by blocked matrix products, and the nearest vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of

GRAM_BITS = 11
GRAMS, SHAPES, BINS = 1 << GRAM_BITS, 8, 12
TERMS = GRAMS + SHAPES * BINS
#: Weight of the shape terms against the trigrams, size of the latent space, of the labelled sample, and number of votes.
SHAPE_WEIGHT, RANK, MOST_SAMPLES, VOTES = 1.0, 48, 4096, 15
#: Documents whose vectors are built at once.
SLICE = 64


def shape(data: bytes) -> list[float]:
    """Eight figures between 0 and 1 of a text that isn't empty."""
    own = data.split()
    n, bytes_ = max(1, len(own)), max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, digits = counts[65:91].sum(), counts[48:58].sum()
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    lines = [x for x in data.split(b"\n") if x]
    same = sum(a == b for a, b in zip(own, own[1:], strict=False))
    odd = counts[[35, 36, 37, 38, 42, 33, 124]].sum()
    return [upper / bytes_ * 2, digits / bytes_ * 4, marks / bytes_ * 3, len({*own}) / n, same / n * 2, 1 - len({*lines}) / max(1, len(lines)), odd / n / 3, min(1.0, bytes_ / n / 20)]


def counts_of(texts: list[str | None]) -> np.ndarray:
    """Damped counts of the terms, a row for each text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        if len(b) > 2:
            code = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
            out[i, :GRAMS] = np.sqrt(np.bincount(code, minlength=GRAMS))
        for k, x in enumerate(shape(data)):
            place = min(max(x, 0.0), 1.0) * (BINS - 1)
            low = int(place)
            out[i, GRAMS + k * BINS + low] = 1 - (place - low)
            if place > low:
                out[i, GRAMS + k * BINS + low + 1] = place - low
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Trigrams and shapes, each part of length 1 (SHAPE_WEIGHT), as one unit vector."""
    x = counts * idf
    for part, weight in ((x[:, :GRAMS], 1.0), (x[:, GRAMS:], SHAPE_WEIGHT)):
        part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = weighted(counts, self.idf) @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        empty = ~counts.any(axis=1)
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        near = self.latent(counts) @ self.vectors.T
        k = min(VOTES, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0.0).astype(np.float64) ** 8
        votes = (weight * self.labels[top]).sum(axis=1) + 1e-6 * self.prior
        return np.where(empty, self.prior, votes / (weight.sum(axis=1) + 1e-6))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Over all documents: how many there are, and how many have each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                texts = batch.column(0).slice(at, SLICE).to_pylist()
                total += len(texts)
                found += (counts_of(texts) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(TERMS)], pa.int32()), pa.array([total, *found.tolist()], pa.int64())], ["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term
    by = {r["term"]: r["n"] for r in sums}
    return by.get(-1, 0), np.array([by.get(t, 0) for t in range(TERMS)], float)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_SAMPLES) -> Model:
    """Of more than `most_rows` labelled documents with distinct texts a sample by the ids' hash is taken. Equal texts are one sample with their mean label; of several labels
    of a doc_id the highest counts."""
    n, df = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 0.1
    idf[GRAMS:] = 1.0
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = marks.agg(F.count("*"), F.avg("quality")).first()
    prior = float(sizes[1]) if sizes[1] is not None else 0.5
    some = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, 1.3 * most_rows / max(sizes[0], 1)) * (1 << 20)))
    rows = docs.select("doc_id", "text").join(some, "doc_id").filter("text != ''")
    rows = rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.avg("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = weighted(counts_of(batch.column(0).to_pylist()), idf).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([v.tobytes() for v in vectors], pa.binary()), batch.column(2)], ["doc_id", "vector", "quality"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.select("text", "doc_id", "quality").mapInArrow(run, f"doc_id {kind}, vector binary, quality double")
    sample = made.orderBy(F.xxhash64("doc_id"), "doc_id", "vector").limit(most_rows).select("vector", "quality")
    found = sample.coalesce(1).mapInArrow(decomposed, "place int, latent binary, quality double").collect()  # at most most_rows vectors of RANK floats, and the axes
    if not found:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior)
    axes, *latent = sorted(found, key=lambda r: r["place"])
    basis = np.frombuffer(axes["latent"], np.float32).reshape(TERMS, -1)
    vectors = np.frombuffer(b"".join(r["latent"] for r in latent), np.float32).reshape(len(latent), -1)
    return Model(idf, basis, vectors, np.array([r["quality"] for r in latent], float), prior)


def decomposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, latent, quality: the sample's RANK axes at place -1, then the unit vectors of its rows on them. A task does this, as the decomposition takes more memory than a driver may have to spare."""
    parts, labels, gram = [], [], np.zeros((TERMS, TERMS), np.float32)
    for batch in batches:
        parts.append(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float16).reshape(-1, TERMS))
        labels += batch.column(1).to_pylist()
        for at in range(0, len(parts[-1]), 1024):
            x = parts[-1][at : at + 1024].astype(np.float32)
            gram += x.T @ x
    if not labels:
        return
    _, axes = np.linalg.eigh(gram)
    basis = np.ascontiguousarray(axes[:, ::-1][:, :RANK])
    y = np.concatenate([part.astype(np.float32) @ basis for part in parts])
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
    yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(y)), pa.int32()), pa.array([basis.tobytes(), *(v.tobytes() for v in y)], pa.binary()), pa.array([None, *labels], pa.float64())], ["place", "latent", "quality"])


def rated(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs, with the score of each row's text as a further column `name`. A null or empty text has the share of label 1 among the labels."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_SAMPLES vectors of RANK floats, and TERMS times RANK
    names, text = [*docs.columns, name], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(counts_of(part.column(text).to_pylist())), pa.float64())], names)

    return docs.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema.fields), T.StructField(name, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels of documents in the held-out fold (crc32 of the id modulo `folds`) aren't used.

    A null or empty text has the share of label 1 among the labels; a very long one is read whole. Repeated rows are scored each; a null doc_id is kept and isn't held out. Other
    columns aren't read. Without labels every score is one half. Without rows the result is empty.
    """
    model = train(docs, labels.filter(fold_of(F.col("doc_id"), folds) != held))
    found = rated(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
