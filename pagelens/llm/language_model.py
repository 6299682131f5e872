"""Scores by a deleted-interpolation n-gram model.

The probability of a word is a mixture of maximum-likelihood estimates of every order and of the uniform distribution. The
weights depend on how often the context was seen (buckets by powers of two) and are learned by expectation-maximisation on
tokens of training documents that are left out of the counts; afterwards these documents count too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import checkpoint, fold_of, words

BUCKETS = 48
#: One training document in so many is held out for the weights; the gain (in log10 for a token) under which expectation-maximisation ends.
EM_FOLDS, LEAST_GAIN = 35, 1e-4
# Words have no blanks, so these are no word's.
START, END = np.uint64(xxhash.xxh3_64_intdigest(b" start")), np.uint64(xxhash.xxh3_64_intdigest(b" end"))
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Tokens:
    """The tokens of some texts one after the other, with order - 1 start marks before each text, as 64-bit digests of all n-grams."""

    def __init__(self, texts: list[str], order: int):
        known: dict[bytes, int] = {}
        parts, sizes = [], []
        for text in texts:
            own = words(text)
            parts.append(np.array([known.setdefault(w, len(known)) for w in own], np.int64))
            sizes.append(len(own) + order)
        digests = np.array([xxhash.xxh3_64_intdigest(w) for w in known], np.uint64)
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        begins = np.cumsum([0, *sizes[:-1]])
        self.at = np.arange(len(self.doc)) - np.repeat(begins, sizes)
        stream = np.full(len(self.doc), START)
        stream[begins + np.array(sizes, np.int64) - 1] = END
        inner = self.at >= order - 1
        inner[begins + np.array(sizes, np.int64) - 1] = False
        stream[inner] = digests[np.concatenate(parts)] if parts else []
        self.token = self.at >= order - 1
        self.grams = [stream]
        for _ in range(1, order):
            x = np.empty_like(stream)
            x[0] = 0
            x[1:] = self.grams[-1][:-1] * MIX[0] + stream[1:] * MIX[1]
            x ^= x >> np.uint64(29)
            x *= MIX[2]
            self.grams.append(x ^ (x >> np.uint64(32)))

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the (k + 1)-grams: the distinct ones sorted, where they stand, and which one stands there."""
        where = np.flatnonzero(self.at >= k)
        distinct, which = np.unique(self.grams[k][where], return_inverse=True)
        return distinct, where, which


def counted(order: int):
    def ask(rows: pa.Table, part: bool) -> list[tuple[int, np.ndarray, list[np.ndarray]]]:
        tokens, train = Tokens(rows["text"].to_pylist(), order), rows["train"].to_numpy()
        out = []
        for k in range(order):
            distinct, where, which = tokens.level(k)
            out.append((k, distinct, [np.bincount(which, weights=train[tokens.doc[where]], minlength=len(distinct)).astype(np.uint64)]))
        return out

    def answer(level: int, keys: np.ndarray, values: list[list[np.ndarray]], parts: np.ndarray) -> list[list[np.ndarray]]:
        total, apart = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        for (places, n), part in zip(values, parts, strict=True):
            total[places] += n
            if part:
                apart[places] += n
        out = [[total[v[0]], apart[v[0]]] if part else [total[v[0]]] for v, part in zip(values, parts, strict=True)]
        if level == 0:
            real = keys != START
            out.append([np.array([total[real].sum(), (total[real] > 0).sum(), apart[real].sum(), (total[real] > apart[real]).sum()], np.uint64)])
        return out

    return ask, answer


def estimates(tokens: Tokens, counts: list[np.ndarray], levels: list[tuple], n: float, v: float, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its bucket, its estimates (uniform, then by order), its count."""
    full = []
    for k in range(order):
        c = np.zeros(len(tokens.at))
        c[levels[k][1]] = counts[k][levels[k][2]]
        full.append(c)
    here = np.flatnonzero(tokens.token)
    ml = np.zeros((len(here), order + 1))
    ml[:, 0] = 1 / (v + 1)
    ml[:, 1] = full[0][here] / max(n, 1)
    bucket = np.zeros(len(here), np.int64)
    for k in range(1, order):
        context = full[k - 1][here - 1]
        ml[:, k + 1] = np.divide(full[k][here], context, out=np.zeros(len(here)), where=context > 0)
        seen = np.ceil(np.log2(context + 1)).astype(np.int64)
        bucket = np.where(context > 0, k * (BUCKETS // max(1, order - 1)) - BUCKETS // max(1, order - 1) + np.minimum(seen, BUCKETS // max(1, order - 1) - 1), bucket)
    return bucket, ml, full[0][here]


def possible(order: int) -> np.ndarray:
    """Which orders (the uniform one first) can have an estimate in each bucket: those whose context was seen."""
    width = BUCKETS // max(1, order - 1)
    longest = np.array([1, *(2 + b // width for b in range(1, BUCKETS))])
    return np.arange(order + 1)[None, :] <= longest[:, None]


def learn_weights(left_out: DataFrame, order: int) -> np.ndarray:
    """Mixture weights by bucket from rows (bucket, ml) of packed tokens. Orders that a bucket can't have weigh nothing; a bucket without tokens has the weights of the nearest one of as long a context."""
    able = possible(order)
    weights = able / able.sum(axis=1, keepdims=True)
    before, seen = -np.inf, np.zeros(BUCKETS, bool)
    while True:

        def expect(batches: Iterator[pd.DataFrame], weights: np.ndarray = weights) -> Iterator[pd.DataFrame]:
            found, likely = np.zeros((BUCKETS, order + 1)), np.zeros(BUCKETS)
            for pdf in batches:
                for b, m in zip(pdf["bucket"], pdf["ml"], strict=True):
                    bucket, ml = np.frombuffer(b, np.uint8).astype(np.int64), np.frombuffer(m, np.float32).reshape(-1, order + 1)
                    share = weights[bucket] * ml
                    p = share.sum(axis=1)
                    for k in range(order + 1):
                        found[:, k] += np.bincount(bucket, weights=share[:, k] / p, minlength=BUCKETS)
                    likely += np.bincount(bucket, weights=np.log10(p), minlength=BUCKETS)
            yield pd.DataFrame({"bucket": np.arange(BUCKETS), "found": found.tolist(), "likely": likely})

        sums = left_out.mapInPandas(expect, "bucket int, found array<double>, likely double").groupBy("bucket").agg(*(F.sum(F.col("found")[k]).alias(f"f{k}") for k in range(order + 1)), F.sum("likely").alias("likely")).collect()
        if not sums:
            break
        weights = weights.copy()
        tokens = sum(r[f"f{k}"] for r in sums for k in range(order + 1))
        for r in sums:
            own = np.array([r[f"f{k}"] for k in range(order + 1)])
            own[0] += 0.01  # so that no text is impossible
            own *= able[r["bucket"]]
            if own.sum() > 1:
                weights[r["bucket"]], seen[r["bucket"]] = own / own.sum(), True
        now = sum(r["likely"] for r in sums) / max(tokens, 1)
        if now - before < LEAST_GAIN:
            break
        before = now
    for b in np.flatnonzero(~seen).tolist():
        alike = [k for k in np.flatnonzero(seen).tolist() if (able[k] == able[b]).all()]
        if alike:
            weights[b] = weights[min(alike, key=lambda k: abs(k - b))]
    return weights


def score(docs: DataFrame, folds: int = 7, held: int = 2, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Learns from the documents whose crc32(doc_id as text) modulo `folds` isn't `held`. A null text counts as empty and has the end token
    alone, as has a blank one. A null doc_id is training. A very long text is scored whole, in a block of its own. Repeated rows count and are scored each. Other columns aren't read. Without rows the result is
    empty; without training documents all words are unknown and equally likely. Distinct words and n-grams are told apart by
    64-bit digests.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (fold_of(F.col("doc_id"), folds) == held).alias("held_out"))
    rows = rows.withColumn("train", (~F.col("held_out")).cast("int")).withColumn("em", (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("em")), F.lit(EM_FOLDS)) == 0) & ~F.col("held_out"))
    corpus = blocks.gather(rows, "em")
    ask, answer = counted(order)
    replies = blocks.written(blocks.exchange(corpus, ask, answer, blocks.shard_count(corpus)))

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([blocks.unplanes(d[0]).tolist() for d in pdf["data"]], columns=list("nvab"), dtype=np.int64)

    n, v, n_apart, v_left = (int(x or 0) for x in replies.filter("block = -1").select("data").mapInPandas(totals, "n long, v long, a long, b long").agg(F.sum("n"), F.sum("v"), F.sum("a"), F.sum("b")).first())

    def left_out(rows: pa.Table, part: bool, found: pd.DataFrame) -> pd.DataFrame:
        tokens = Tokens(rows["text"].to_pylist(), order)
        levels = [tokens.level(k) for k in range(order)]
        both = [blocks.answers(found, k) for k in range(order)]
        bucket, ml, _ = estimates(tokens, [(t - a).astype(float) for t, a in both], levels, n - n_apart, v_left, order)
        return pd.DataFrame({"bucket": [bucket.astype(np.uint8).tobytes()], "ml": [ml.astype(np.float32).tobytes()]})

    weights = learn_weights(checkpoint(blocks.each(corpus.filter("part"), replies, left_out, "bucket binary, ml binary")), order)

    def scored(rows: pa.Table, part: bool, found: pd.DataFrame) -> pd.DataFrame:
        tokens = Tokens(rows["text"].to_pylist(), order)
        levels = [tokens.level(k) for k in range(order)]
        bucket, ml, c = estimates(tokens, [blocks.answers(found, k)[0].astype(float) for k in range(order)], levels, n, v, order)
        doc, size = tokens.doc[tokens.token], rows.num_rows
        add = lambda x: np.bincount(doc, weights=x, minlength=size)
        ids = rows["doc_id"].to_pylist()
        return pd.DataFrame({
            "doc_id": pd.Series(ids, dtype="Int64") if pa.types.is_integer(rows["doc_id"].type) else ids, "held_out": rows["held_out"].to_pylist(), "n_tokens": add(np.ones(len(doc))).astype(np.int64), "n_known": add(c > 0).astype(np.int64), "train_tokens": n,
            "base_score": add(np.log10((c + 1) / (n + v + 1))), "score": add(np.log10((weights[bucket] * ml).sum(axis=1))),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return blocks.each(corpus, replies, scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
