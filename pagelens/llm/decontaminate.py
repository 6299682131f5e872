"""Benchmark passages in documents, by latent semantic retrieval.

Passages are runs of WINDOW words. Their vectors hold the square roots of word counts times inverse document frequencies, over the
benchmark's words; other words only lengthen a vector. A passage whose part in these words is too small can't reach the
least cosine with any item (Cauchy-Schwarz) and is passed over, unless it has RUN words of an item in a row. A distributed randomised
singular value decomposition of the other passages and the items gives the latent space: one pass over the Gram matrix makes a sketch, a small
decomposition of it the singular vectors, cut where the singular values vanish. Passages near an item in it are candidates, and so are those
with a run of an item's words, however frequent these are. The longest common subsequence of words, plain or weighted by how rare they are, and the item's answer decide,
so a paraphrase with up to half of its words replaced, or with its clauses swapped, is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, rows_of, written

WINDOW, STRIDE = 32, 16
#: Least latent cosine of a candidate; shares of the item's words, or else of their weight by rareness, that the common subsequence must have; share of the answer's words.
LEAST_COSINE, LEAST_COMMON, LEAST_WEIGHT, LEAST_ANSWER = 0.33, 0.75, 0.4, 0.25
#: Singular values under this share of the largest one are cut off.
LEAST_SINGULAR = 1e-3
#: Items searched for at once, the bytes and pieces they may have, which bound what is broadcast; more are searched for in blocks. Dimensions beyond one for each piece.
MOST_ITEMS, MOST_BYTES, MOST_PIECES, SPARE_DIMENSIONS = 480, 4_000_000, 960, 32
#: Pairs of the benchmark's words that a task may count; beyond, a task multiplies passage by passage.
MOST_CELLS = 1 << 24
#: Passages multiplied with a matrix at once, so that what their words take stays in the processor's cache.
AT_ONCE = 32
#: What single precision may lose of a cosine.
SLACK = 1e-3
#: Words in a row that make a candidate besides those of the latent space.
RUN = 3
MIX = np.random.default_rng(5).integers(1, 2**63, RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Without an answer column the last words of an item are its answer.
ANSWER_WORDS = 8
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„…"
REMEMBERED = 400_000


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Vocabulary(dict):
    """Numbers of the benchmark's words, -1 for others, remembered by spelling."""

    def __init__(self, known: list[str]):
        super().__init__()
        self.known = {w: k for k, w in enumerate(known)}

    def __missing__(self, word: str) -> int:
        found = self[word] = self.known.get(word.strip(EDGE), -1)
        return found

    def numbers(self, own: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, own), np.int32, len(own))


def common_weight(item: np.ndarray, weight: np.ndarray, text: np.ndarray) -> float:
    """The largest weight of the item's words that stand in the text in the same order (a weighted longest common subsequence)."""
    best = np.zeros(len(text) + 1)
    for x, w in zip(item.tolist(), weight.tolist(), strict=True):
        taken = np.where(text == x, best[:-1] + w, 0.0)
        best[1:] = np.maximum(best[1:], taken)
        np.maximum.accumulate(best, out=best)
    return float(best[-1])


def windows(n: int) -> np.ndarray:
    """Where the passages of a text of n words begin; the last one reaches its end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else np.zeros(0, np.int64)


def run_keys(numbers: np.ndarray) -> np.ndarray:
    """A key of the RUN words from each place on."""
    n = max(0, len(numbers) - RUN + 1)
    x = (numbers.astype(np.int64) + 1).astype(np.uint64)
    return sum((x[k : n + k] * MIX[k] for k in range(RUN)), np.zeros(n, np.uint64))


class Items:
    """The benchmark's items, or a block of them."""

    def __init__(self, rows: list):
        self.ids = [r["item_id"] for r in rows]
        self.words = [[w for w in (t.strip(EDGE) for t in tokens(r["text"])) if w] for r in rows]
        self.vocabulary = sorted({w for ws in self.words for w in ws})
        number = {w: k for k, w in enumerate(self.vocabulary)}
        self.numbers = [[number[w] for w in ws] for ws in self.words]
        answers = [[w for w in (t.strip(EDGE) for t in tokens(r["answer"])) if w] for r in rows]
        self.answers = [{number.get(w, -1) for w in a} or set(n[-ANSWER_WORDS:]) for a, n in zip(answers, self.numbers, strict=True)]
        self.longest = max(map(len, self.words), default=0)
        runs = sorted({(int(x), k) for k, n in enumerate(self.numbers) for x in run_keys(np.array(n, np.int64))})
        self.run_keys, self.run_items = np.array([x for x, _ in runs], np.uint64), np.array([k for _, k in runs], np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.run_keys >> np.uint64(44)] = True
        self.pieces = [(k, np.array(n[a : a + WINDOW])) for k, n in enumerate(self.numbers) for a in windows(len(n)).tolist()]

    def hits(self, numbers: np.ndarray, sizes: np.ndarray) -> list[dict[int, list[int]]]:
        """For each of some texts, one after the other in `numbers`: by passage, the items of which it has a run."""
        keys = run_keys(numbers)
        begins = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(self.maybe[keys >> np.uint64(44)])
        at = at[row[at] == row[at + RUN - 1]]
        low, high = (np.searchsorted(self.run_keys, keys[at], side) for side in ("left", "right"))
        out: list[dict[int, set[int]]] = [{} for _ in sizes]
        for p, a, b in zip(at[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
            k = int(row[p])
            passage = min((p - int(begins[k])) // STRIDE, len(windows(int(sizes[k]))) - 1)
            out[k].setdefault(passage, set()).update(self.run_items[a:b].tolist())
        return [{i: sorted(x) for i, x in found.items()} for found in out]


def rows_times(numbers: np.ndarray, sizes: np.ndarray, weight: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The product of sparse passage vectors (word numbers one after the other, each token for itself) with a matrix.

    A word that comes t times weighs sqrt(t), so each of its tokens has 1 / sqrt(t) of it.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    out = np.empty((len(sizes), right.shape[1]), np.result_type(right, weight))
    for at in range(0, len(sizes), AT_ONCE):
        here = slice(begins[at], ends[min(at + AT_ONCE, len(sizes)) - 1])
        np.add.reduceat(right[numbers[here]] * weight[here, None], begins[at : at + AT_ONCE] - begins[at], axis=0, out=out[at : at + AT_ONCE])
    return out


def token_weights(numbers: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, which, times = np.unique(row * len(idf) + numbers, return_inverse=True, return_counts=True)
    return (idf[numbers] / np.sqrt(times[which])).astype(np.float32)


def may_reach(numbers: np.ndarray, sizes: np.ndarray, weight: np.ndarray, most: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Whether a passage can reach LEAST_COSINE with a piece: `most` has the largest part that each word can have in a cosine with any piece, and their sum is no less than each cosine."""
    return np.add.reduceat(most[numbers] * weight, np.cumsum(sizes) - sizes) >= (LEAST_COSINE - SLACK) * norm


def _count_pairs(total: np.ndarray, numbers: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> None:
    """Adds the Gram matrix of some passages (transposed times itself) to `total`, flat, each pair of words once: at the smaller word's row."""
    words = np.int64(len(idf))
    keys, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * words + numbers, return_counts=True)
    row, word = keys // words, keys % words
    weight = idf[word] * np.sqrt(times)
    at = np.arange(len(row))
    for k in range(len(row)):
        np.add.at(total, word[at] * words + word[at + k], weight[at] * weight[at + k])
        at = at[at < len(row) - k - 1]
        at = at[row[at] == row[at + k + 1]]
        if not len(at):
            break


def _pairs_times(total: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The product of the symmetric matrix whose upper half is `total` with `right`, some rows at a time."""
    out = np.empty(right.shape, np.float32)
    for at in range(0, len(total), 512):
        here = slice(at, at + 512)
        rows = total[here] + total[:, here].T
        rows[np.arange(len(rows)), np.arange(at, at + len(rows))] /= 2
        out[here] = rows.astype(np.float32) @ right
    return out


def _numbered(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id and numbers (binary): every text as the numbers of its words, -1 for words that no item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(items.vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words.numbers(tokens(text)).tobytes() for (text,) in rows_of([batch], "text")], pa.binary())], ["doc_id", "numbers"])

    return written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, numbers binary"))


def _frequencies(numbered: DataFrame, items: Items) -> tuple[int, np.ndarray]:
    size = len(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, np.zeros(size + 1, np.int64)
        for batch in batches:
            n += batch.num_rows
            for at in range(0, batch.num_rows, 256):
                own, sizes = _unpacked(batch.column(0).slice(at, 256))
                row = np.repeat(np.arange(len(sizes)), sizes)
                seen = np.zeros((len(sizes), size + 1), bool)
                seen[row, own] = True  # -1: the last place, which isn't read
                found += seen.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(size)], pa.int32()), pa.array([n, *found[:-1].tolist()], pa.int64())], ["word", "n"])

    sums = {r["word"]: r["n"] for r in numbered.select("numbers").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row for each word of the benchmark
    return sums.get(-1, 0), np.array([sums.get(k, 0) for k in range(size)], float)


def _passages(numbered: DataFrame, items: Items, idf: np.ndarray, other: float) -> DataFrame:
    """doc_id, at, norm, numbers, around, items: the passages that can reach LEAST_COSINE or have runs of `items`; `around` has the word numbers of the passage and as many before and behind it as the longest item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = np.append(idf.astype(float) ** 2, other**2)
        inside = np.append(np.ones(len(idf)), 0.0)
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            rows, cols, hits = [], [[], [], [], [], []], items.hits(*_unpacked(batch.column(1)))
            for k, (data,) in enumerate(rows_of([batch], "numbers")):
                own = np.frombuffer(data, np.int32)
                if not len(own):
                    continue
                mass = square[own]
                both = np.concatenate(([0.0], np.cumsum(mass))), np.concatenate(([0.0], np.cumsum(mass * inside[own])))
                begin = windows(len(own))
                end = np.minimum(begin + WINDOW, len(own))
                full, part = (c[end] - c[begin] for c in both)
                able = (part > 0) & (part >= LEAST_COSINE**2 * full)
                able[list(hits[k])] = True
                for i in np.flatnonzero(able).tolist():
                    a, b = int(begin[i]), int(end[i])
                    rows.append(k)
                    cols[0].append(a)
                    cols[1].append(float(np.sqrt(full[i])))
                    passage = own[a:b]
                    cols[2].append(passage[square[passage] * inside[passage] > 0].tobytes())
                    cols[3].append(own[max(0, a - items.longest) : b + items.longest].tobytes())
                    cols[4].append(np.array(hits[k].get(i, []), np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["doc_id", "at", "norm", "numbers", "around", "items"])

    return written(numbered.mapInArrow(run, f"doc_id {numbered.schema['doc_id'].dataType.simpleString()}, at long, norm double, numbers binary, around binary, items binary"))


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.int32), np.array([len(x) // 4 for x in data])


def _spread(total: np.ndarray, numbers: np.ndarray, sizes: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> None:
    """Adds the transposed matrix of some passages times `rows` (one for each of them) to `total`."""
    order = np.argsort(numbers, kind="stable")
    row = np.repeat(np.arange(len(sizes)), sizes)[order]
    word, begin = np.unique(numbers[order], return_index=True)
    total[word] += np.add.reduceat(rows[row] * weight[order][:, None], begin, axis=0)


def _gram_times(passages: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The passages' matrix, transposed, times itself times `right`: added in slices of the words, by trees of tasks none of which sees more than some dozens at once.

    A task counts the pairs of words in its passages and multiplies once, which takes a tenth of the time of multiplying each passage; beyond MOST_CELLS pairs it does the latter.
    """
    shared = passages.sparkSession.sparkContext.broadcast(right.astype(np.float32))
    slices = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = shared.value
        paired = len(right) ** 2 <= MOST_CELLS
        total = np.zeros(len(right) ** 2) if paired else np.zeros(right.shape, np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                numbers, sizes = _unpacked(batch.column(0).slice(at, 2048))
                if paired:
                    _count_pairs(total, numbers, sizes, idf)
                else:
                    weight = token_weights(numbers, sizes, idf)
                    _spread(total, numbers, sizes, weight, rows_times(numbers, sizes, weight, right))
        if paired:
            total = _pairs_times(total.reshape(len(right), len(right)), right)
        parts = np.array_split(total, slices)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([TaskContext.get().partitionId()] * slices, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "task", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["data"].iloc[0]) // 4)
        for d in pdf["data"]:
            total += np.frombuffer(d, np.float32)
        return pdf.iloc[:1].assign(data=[total.astype(np.float32).tobytes()])

    sums = passages.select("numbers").mapInArrow(run, "slice int, task long, data binary")
    for width in (1 << 7, 1):
        sums = sums.withColumn("task", F.col("task") % width).groupBy("slice", "task").applyInPandas(add, "slice int, task long, data binary")
    found = {r["slice"]: r["data"] for r in sums.collect()}  # of the size of `right`
    shapes = [len(p) for p in np.array_split(right, slices)]
    return np.concatenate([np.frombuffer(found[k], np.float32).reshape(n, right.shape[1]) if k in found else np.zeros((n, right.shape[1]), np.float32) for k, n in enumerate(shapes)]).astype(np.float64)


def latent_basis(passages: DataFrame, items: Items, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors (as columns) and singular values of the passages and items; items weigh as much as all passages together.

    One pass multiplies the Gram matrix with random columns; from that sketch alone its eigenvectors are found (the randomised Nystrom form of the singular value
    decomposition: the sketch, made orthogonal against the small core between it and the random columns, and the small decomposition of what comes out). Singular values under LEAST_SINGULAR of the largest are cut off.
    """
    size, words = min(len(items.pieces) + SPARE_DIMENSIONS, len(idf)), len(idf)
    numbers = np.concatenate([p for _, p in items.pieces])
    sizes = np.array([len(p) for _, p in items.pieces])
    weight = token_weights(numbers, sizes, idf)
    start = np.linalg.qr(np.random.default_rng(7).standard_normal((words, size)))[0]
    ours = np.zeros((words, size), np.float32)
    _spread(ours, numbers, sizes, weight, rows_times(numbers, sizes, weight, start.astype(np.float32)))
    sketch = _gram_times(passages, idf, start) + max(1.0, passages.count() / max(1, len(sizes))) * ours
    shift = 1e-6 * np.linalg.norm(sketch)  # more than what single precision loses
    sketch = sketch + shift * start
    core = start.T @ sketch
    values, turn = np.linalg.eigh((core + core.T) / 2)
    root = turn / np.sqrt(np.maximum(values, shift / 2))
    vectors, singular, _ = np.linalg.svd(sketch @ root, full_matrices=False)
    singular = np.sqrt(np.maximum(singular**2 - shift, 0.0))
    kept = max(1, int((singular > LEAST_SINGULAR * singular[0]).sum()))
    return np.ascontiguousarray(vectors[:, :kept]).astype(np.float32), singular[:kept]


def _search(docs: DataFrame, items: Items) -> DataFrame:
    numbered = _numbered(docs, items)
    n, df = _frequencies(numbered, items)
    # No word weighs nothing: in a corpus full of copies of an item, its words are those that every document has.
    idf = np.log((n + 1) / (df + 0.5)).astype(np.float32)
    passages = _passages(numbered, items, idf, float(np.quantile(idf, 0.9)))
    basis, _ = latent_basis(passages, items, idf)
    sizes = np.array([len(p) for _, p in items.pieces])
    numbers = np.concatenate([p for _, p in items.pieces])
    weight = token_weights(numbers, sizes, idf)
    latent = rows_times(numbers, sizes, weight, basis)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    owner = np.array([k for k, _ in items.pieces])
    most = np.maximum(basis @ latent.T, 0).max(axis=1)
    shared = passages.sparkSession.sparkContext.broadcast((basis, latent.T.copy(), most, items, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, right, most, items, idf = shared.value
        for batch in batches:
            rows, found = [], [[], [], []]
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                numbers, sizes = _unpacked(part.column(3))
                able = may_reach(numbers, sizes, token_weights(numbers, sizes, idf), most, part.column(2).to_numpy())
                able |= pc.binary_length(part.column(5)).to_numpy() > 0
                if not able.any():
                    continue
                kept = np.flatnonzero(able)
                part = part.take(pa.array(kept))
                numbers, sizes = _unpacked(part.column(3))
                x = rows_times(numbers, sizes, token_weights(numbers, sizes, idf), basis)
                near = (x @ right) / part.column(2).to_numpy().astype(np.float32)[:, None]
                best: dict[tuple[int, int], float] = {}
                for i, j in zip(*np.nonzero(near >= LEAST_COSINE), strict=True):
                    pair = int(i), int(owner[j])
                    best[pair] = max(best.get(pair, 0.0), float(near[i, j]))
                for i, data in enumerate(part.column(5).to_pylist()):
                    for k in np.frombuffer(data, np.int32).tolist():
                        best.setdefault((i, k), float(near[i, owner == k].max()))
                for (i, k), cosine in best.items():
                    around = np.frombuffer(part.column(4)[i].as_py(), np.int32)
                    present, answer, own = {*around.tolist()}, items.answers[k], np.array(items.numbers[k])
                    heavy, there = idf[own].astype(float), np.array([x in present for x in items.numbers[k]])
                    if there.mean() < LEAST_COMMON and heavy[there].sum() < LEAST_WEIGHT * heavy.sum():
                        continue  # no common subsequence has more
                    common = common_weight(own, np.ones(len(own)), around) / len(own)
                    if common < LEAST_COMMON and common_weight(own, heavy, around) < LEAST_WEIGHT * heavy.sum():
                        continue
                    if len(answer & present) >= LEAST_ANSWER * len(answer):
                        rows.append(at + int(kept[i]))
                        found[0].append(items.ids[k])
                        found[1].append(cosine)
                        found[2].append(common)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), pa.array(found[0], pa.int64()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.float64())], ["doc_id", "at", "item_id", "cosine", "common"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return passages.select("doc_id", "at", "norm", "numbers", "around", "items").mapInArrow(run, f"doc_id {kind}, at long, item_id long, cosine double, common double")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common, at: documents with a passage of a benchmark item, one row for each pair.

    cosine is the largest latent cosine (under LEAST_COSINE where a run of words alone made the candidate), common the largest share of the item's words, in order, in a passage's surroundings, at the first
    such passage's word number. benchmark has item_id, text and maybe answer; items without words find nothing. Null and empty texts have no
    passages, a very long text has as many as it takes, repeated rows and items count as one pair. Other columns aren't read. Without rows on either side the result is empty.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", (F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")).alias("answer")).filter("item_id is not null and text is not null")
    pieces = F.greatest(F.lit(1), F.ceil((F.size(F.split(F.trim("text"), "\\s+")) - WINDOW + STRIDE) / STRIDE))
    count, size, most = rows.agg(F.count("*"), F.sum(F.octet_length("text")), F.sum(pieces)).first()
    parts = max(1, -(-count // MOST_ITEMS), -(-(size or 0) // MOST_BYTES), -(-(most or 0) // MOST_PIECES))
    empty = docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, cosine double, common double, at long")
    found = []
    for k in range(parts):
        items = Items(rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).orderBy("item_id", "text").collect())
        if items.pieces:
            found.append(_search(docs, items))
    out = empty
    for f in found:
        out = out.unionByName(f.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("common").alias("common"), F.min("at").alias("at")))
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id has no benchmark passage, with all their columns. A null doc_id stays."""
    bad = checkpoint(contaminated(docs, benchmark).select("doc_id").distinct())
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
