"""Toxicity by maximum-scoring segments.

Every word has log-odds of standing in toxic rather than in clean documents, with Dirichlet priors: a word's prior
follows its stem's counts, a stem's the whole sample's. Words and stems whose odds are significant score; all other
words cost a little. The Ruzzo-Tompa algorithm finds all maximal scoring segments of a text in linear time. The
extreme-value law of Karlin and Altschul, fitted to the best scores of clean labelled texts that gave no odds, says how likely a segment of a score is in a clean
text of that length; their sum statistic aggregates all significant segments of a text, and a logistic curve turns that evidence into the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, rows_of, words

STEMS = (7, 6, 5, 4)
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»…“”„’‘–—¡¿·"
#: Prior weight of a word in documents of each class; significance (in standard deviations) and odds that let a word or stem score.
#: A stem scores only if no word has more than this share of its toxic documents: what one word says, a stem need not repeat.
PRIOR, LEAST_Z, LEAST_ODDS, ONE_WORD = 0.5, 3.5, 2.0, 0.6
#: What a word that doesn't score costs.
COST = 0.25
REMEMBERED = 300_000


def core(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(EDGE)


def features(word: str) -> list[str]:
    """The word and its stems, longest first; a stem ends in an asterisk."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) >= k)] if word else []


def log_odds(toxic: float, clean: float, n_toxic: float, n_clean: float, rate: float, weight: float = PRIOR) -> tuple[float, float]:
    """Log-odds and their standard deviation; the prior is worth `weight` documents of each class, leaning as `rate` (times the odds that chance would give)."""
    lean = math.sqrt(rate)
    a, b = toxic + weight * lean, clean + weight / lean
    return math.log(a / (n_toxic + 2 * weight) / (b / (n_clean + 2 * weight))), math.sqrt(1 / a + 1 / b)


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    log_k: float = 0.0
    a: float = -4.0
    b: float = 1.0

    def word_score(self, word: bytes) -> float:
        return next((self.terms[f] for f in features(core(word)) if f in self.terms), 0.0) - COST

    def normal(self, score: float, n: int) -> float:
        """The score of a segment in a text of n words as the law has it: a clean text has exp(-this) segments of as much, on average."""
        return self.decay * score - self.log_k - math.log(max(n, 1))

    def evidence(self, scores: list[float], n: int) -> float:
        """-log10 of how many clean texts of n words have, by chance, as much as the best r segments together, for the r that says most; 0 at least, 30 at most.

        The sum t of the normal scores of r segments is reached with a probability of about exp(-t) t^(r-1) / (r! (r-1)!); trying several r costs a factor of 2 for each.
        """
        best, total = 0.0, 0.0
        for r, x in enumerate(sorted((self.normal(s, n) for s in scores), reverse=True), 1):
            if x <= 0:
                break
            total += x
            best = max(best, total - (r - 1) * math.log(2 * total) + math.lgamma(r + 1) + math.lgamma(r))
        return min(30.0, best / math.log(10))

    def score(self, scores: list[float], n: int) -> float:
        return 1 / (1 + math.exp(-(self.a + self.b * self.evidence(scores, n))))


def extreme_law(best: np.ndarray, lengths: np.ndarray, typical: float) -> tuple[float, float]:
    """decay and log K of the law P(best score <= s) = exp(-K n exp(-decay s)) that texts' best scores (0: no segment at all) are likeliest under.

    One further text of mean length with a segment of the `typical` score stands for what wasn't seen, so that the law exists without any segment.
    """
    s, n = np.append(best, typical).astype(float), np.append(lengths, lengths.mean() if len(lengths) else 1).clip(min=1).astype(float)
    m, total = int((s > 0).sum()), float(s.sum())

    def slope(decay: float) -> float:
        w = n * np.exp(-decay * s)
        return m / decay - total + m * float((w * s).sum() / w.sum())

    low, high = 1e-3, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return low, math.log(m / float((n * np.exp(-low * s)).sum()))


class Memory(dict):
    """Scores of words seen before."""

    def of(self, own: list[bytes]) -> np.ndarray:
        """The words' scores; a word that only repeats the one before it adds no evidence."""
        s = np.fromiter(map(self.__getitem__, own), np.float64, len(own))
        for i in np.flatnonzero(s > 0).tolist():
            if i and own[i] == own[i - 1]:
                s[i] = -COST
        return s

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        found = self[word] = self.model.word_score(word)
        return found


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa): begin, end (exclusive), score. Linear in the number of scores above 0."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    found: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum after
    link: list[int] = []  # the nearest earlier segment with a smaller sum before, or -1
    for i in at.tolist():
        begin, end, left, right = i, i + 1, sums[i], sums[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = link[j]
            if j < 0 or found[j][3] >= right:
                found.append((begin, end, left, right))
                link.append(j)
                break
            begin, left = found[j][0], found[j][2]
            del found[j:], link[j:]
    return [(b, e, float(y - x)) for b, e, x, y in found]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for text, label in rows_of([batch], "text", "toxic"):
            (toxic if label else clean).update({f for w in set(words(text)) for f in features(core(w))})
        terms = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], ["term", "a", "b"])


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Model:
    """A model from labelled documents (doc_id, text; doc_id, toxic). Of more than `most_rows` labelled documents a sample by the
    ids' hash is taken. Equal texts count once, as toxic if any of them is; a doc_id with several labels is toxic if any says so. Rows without a label, id or text don't count.
    Four fifths give the words' odds, the rest (at most as many rows as the sample's fifth) the law and the calibration."""
    marks = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, most_rows / max(n, 1)) * (1 << 20)))
    rows = docs.select("doc_id", "text").join(marks, "doc_id").filter("text is not null").withColumn("digest", F.sha2("text", 256))
    rows = rows.groupBy("digest").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(5)))
    first, second = rows.filter("part > 0").select("text", "toxic"), rows.filter("part = 0").select("text", "toxic")
    sizes = {r["toxic"]: r["n"] for r in first.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    model = Model()
    if not n1 or not n0:
        return model
    counts = first.mapInArrow(_term_counts, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a > 1")
    # What could score at all: the odds with the prior of the strongest stem. The sample bounds how many there are.
    z = F.log((F.col("a") + PRIOR) / (F.col("b") + PRIOR) * F.lit(n0 / n1)) / F.sqrt(1 / (F.col("a") + PRIOR) + 1 / (F.col("b") + PRIOR))
    table = {r["term"]: (r["a"], r["b"]) for r in counts.filter(z >= LEAST_Z / 2).collect()}
    lead: dict[str, int] = {}
    for term, (a, _) in table.items():
        if not term.endswith("*"):
            for stem in features(term)[1:]:
                lead[stem] = max(lead.get(stem, 0), a)
    table = {t: x for t, x in table.items() if lead.get(t, 0) <= ONE_WORD * x[0]}
    for term, (a, b) in table.items():
        stem = next((s for s in features(term)[1:] if s in table), None) if not term.endswith("*") else None
        odds = log_odds(*table[stem], n1, n0, 1.0)[0] if stem else 0.0
        value, sd = log_odds(a, b, n1, n0, min(20.0, math.exp(max(0.0, odds))))
        if value >= LEAST_ODDS and value / sd >= LEAST_Z:
            model.terms[term] = value

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(model)
        for batch in batches:
            own = [(int(toxic), words(text)) for text, toxic in rows_of([batch], "text", "toxic")]
            found = [[x[2] for x in segments(memory.of(w))] for _, w in own]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in own], pa.int32()), pa.array([len(w) for _, w in own], pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    seen = second.mapInArrow(tallies, "toxic int, n long, scores array<double>").collect()
    clean = [r for r in seen if not r["toxic"]]
    typical = float(np.mean(list(model.terms.values()))) if model.terms else 1.0
    model.decay, model.log_k = extreme_law(np.array([max(r["scores"], default=0.0) for r in clean]), np.array([r["n"] for r in clean]), typical)
    model.a, model.b = logistic([(model.evidence(r["scores"], r["n"]), int(r["toxic"] > 0), 1.0) for r in seen])
    return model


def logistic(points: list[tuple[float, int, float]]) -> tuple[float, float]:
    """Intercept and slope (0.05 at least) by Newton's method on weighted points, with a weak prior."""
    x, y, w = (np.array([p[k] for p in points], float) for k in range(3))
    x, y, w = np.append(x, [0.0, 30.0]), np.append(y, [0, 1]), np.append(w, [1.0, 1.0])
    m, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(m @ beta, -30, 30)))
        step = np.linalg.solve((m * (w * q * (1 - q))[:, None]).T @ m + 1e-3 * np.eye(2), m.T @ (w * (y - q)) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
    return float(beta[0]), max(0.05, float(beta[1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages (begin, end: code points; score; p_value) of every document: all segments that a clean text of its length has with a probability under 1 %.

    A null, empty or blank text has no passage and the score of no evidence; a very long one is read whole, in time linear in its words. Repeated rows are scored each; a null
    doc_id is kept; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(model)
        for batch in batches:
            scores, passages = [], []
            for (text,) in rows_of([batch], "text"):
                if len(memory) > REMEMBERED:
                    memory.clear()
                own = words(text)
                found = segments(memory.of(own))
                scores.append(model.score([x[2] for x in found], len(own)))
                strong = [x for x in found if model.normal(x[2], len(own)) > math.log(100)]
                passages.append(_places(text, own, strong, model) if strong else [])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<begin:long,end:long,score:double,p_value:double>>")


def _places(text: str, own: list[bytes], found: list[tuple[int, int, float]], model: Model) -> list[dict]:
    data = text.encode("utf-8", "surrogatepass")
    lower, at, begins = data.lower(), 0, []
    for w in own:
        at = lower.index(w, at)
        begins.append(at)
        at += len(w)
    chars = lambda n: len(data[:n].decode("utf-8", "surrogatepass"))
    return [{"begin": chars(begins[b]), "end": chars(begins[e - 1] + len(own[e - 1])), "score": s, "p_value": -math.expm1(-math.exp(-model.normal(s, len(own))))} for b, e, s in found]


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages. Labels of documents in the held-out fold (crc32 of the id modulo `folds`) aren't used.

    A null, empty or blank text has the score of no evidence. Without labels of both kinds every score is the same, low one. Repeated rows come out each; a null doc_id is kept and isn't
    held out. Other columns aren't read. Without rows the result is empty.
    """
    model = train(docs, labels.filter(fold_of(F.col("doc_id"), folds) != held))
    found = score(docs, model)
    return found.select("doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
