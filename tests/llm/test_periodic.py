"""Runs against comparing every word with the one a period before, for every period; odd rows; the query's digests."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from pagelens.llm import periodic, queries

SCHEMA = "doc_id long, text string, runs string, start string"


def plain(words, repeats=4, least=6):
    found, n = {}, len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, repeats * q) and i > s:
                found.setdefault((s, i + q), q)
            i = max(i, s + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


def kept(words, runs):
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    return b" ".join(w for k, w in enumerate(words) if k not in dropped)


@pytest.mark.parametrize("repeats, least", [(4, 6), (2, 2), (3, 8)])
def test_runs_against_plain(repeats, least):
    r = random.Random(repeats)
    for _ in range(700):
        texts = []
        for _ in range(r.randint(1, 5)):
            letters = r.choice([1, 2, 2, 3, 6])
            w = [b"%d" % r.randrange(letters) for _ in range(r.randint(0, 30))]
            if w and r.random() < 0.6:
                a = r.randrange(len(w))
                p = 1 + (len(w) - a) // (2 + r.randrange(8))
                w = (w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]) * r.choice([1, 1, 2, 5])
            texts.append(w)
        got = periodic.runs_of(texts, repeats, least)
        assert got == [plain(w, repeats, least) for w in texts]
        assert [periodic.collapsed(w, x) for w, x in zip(texts, got, strict=True)] == [kept(w, x) for w, x in zip(texts, got, strict=True)]


def test_long_texts_of_few_words():
    assert periodic.runs_of([[b"a"] * 60_000]) == [[(0, 60_000, 1)]]
    assert periodic.runs_of([[b"%d" % (k % 999) for k in range(60_000)]]) == [[(0, 60_000, 999)]]
    fibonacci, after = [b"a"], [b"a", b"b"]
    while len(after) < 2500:
        fibonacci, after = after, after + fibonacci
    assert periodic.runs_of([after], 3) == [plain(after, 3)]


def test_rows(spark):
    texts = ["x y " * 9, None, "", " \t\n", "one two", "a\x0bb a\rb\x0ca b a b", "é é é é é é é é", "x y " * 9]
    docs = spark.createDataFrame([(k if k else None, t, "clash", "") for k, t in enumerate(texts)] + [(3, texts[0], "", "")], SCHEMA)
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()), key=repr)
    want = []
    for i, t in [(r.doc_id, r.text) for r in docs.collect()]:
        w = (t or "").encode().split()
        want.append((i, plain(w), kept(w, plain(w)).decode()))
    assert got == sorted(want, key=repr)
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, tmp_path):
    r = random.Random(4)
    docs = [(k, " ".join(r.choice("abcdefg") for _ in range(r.choice([0, 1, 5, 40, 300])))) for k in range(150)] + [(150, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, edited = [], 0
    for i, t in docs:
        w = (t or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            edited += 1
        runs = plain(w)
        best = min(((-Fraction(n, q), s, q, n) for s, n, q in runs), default=None)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *((best[1], best[3], best[2], 1000 * best[3] // best[2]) if best else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept(w, runs)).hexdigest()))
    assert edited > 5
    assert sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect())) == want
