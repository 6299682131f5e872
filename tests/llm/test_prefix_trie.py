"""The prefix trie against a plain version that walks every conversation, and on odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from pagelens.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, node string"


def plain(rows, rebuilt):
    """The nodes by a dictionary of paths."""
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            told = f"{len(r or '')}:{r or ''}{x or ''}"
            own[c].append(((t is not None, t or 0), hashlib.sha256(told.encode()).digest()[:16], len((x or "").encode())))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    paths = {c: rebuilt(c, own) for c in own}
    members = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(x[0] for x in p[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    size = {tuple(x[0] for x in p[:d]): p[d - 1][1] for p in paths.values() for d in range(1, len(p) + 1)}
    out = []
    for k, ms in members.items():
        below = [w for w in members if w[: len(k)] == k]
        ends = ",".join(str(m) for m in sorted(ms) if len(paths[m]) == len(k))
        out.append((min(ms), len(k), min(members[k[:-1]]) if k else None, len(ms), kids[k], sum(kids[w] == 0 for w in below), sum((len(members[w]) - 1) * size.get(w, 0) for w in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def contract(c, own):
    h = zlib.crc32(str(c).encode()) % 9
    return own.get(c - c % 5, [])[:h] + own[c][h:]


def found(df, **more):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **more).collect()), key=repr)


HEAD = dict(head=lambda c: queries.F.crc32(c.cast("string")) % 9, family=lambda c: c - c % 5)


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(0, 300), 60):
        rows += [(c, r.choice([k, k, None]), r.choice(["user", "assistant", None, ""]), r.choice(["hi", "hello there", "ü", None, "", str(r.random())])) for k in range(r.randint(1, 14))]
    rows += [x for x in rows[:20]] + [(None, 1, "user", "lost"), (7, 0, "user", "hi"), (2**40, 1, "user", "hi")]
    rows += [(c, k, "user", "copy") for c in (1000, 1005, 1010, 1015) for k in range(3)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], SCHEMA)
    assert found(df, **HEAD) == plain(rows, contract)
    assert found(df) == plain(rows, lambda c, own: own[c])


def test_small_sketch_gives_the_same_rows(spark, monkeypatch):
    """With few cells nearly every estimate is two or more, so nearly all is grouped exactly; with many, hardly anything is."""
    r = random.Random(9)
    rows = [(c, k, "user", str(r.randint(0, 2)) if k < 2 else str(r.random())) for c in range(80) for k in range(6)]
    df = spark.createDataFrame([(*x, "") for x in rows], SCHEMA)
    want = plain(rows, contract)
    assert found(df, **HEAD) == want
    monkeypatch.setattr(prefix_trie, "BLOCK_CELLS", 64)
    assert prefix_trie.sketch_width(10**6, 64) == 64
    assert found(df, sketch_bytes=64, **HEAD) == want


def test_sketch_never_counts_too_few(spark):
    digests = [hashlib.sha256(str(k % 700).encode()).digest()[:16] for k in range(1000)]
    sketch = prefix_trie.sketch_of(spark.createDataFrame([(bytearray(d),) for d in digests], "node binary").repartition(5), 1 << 16)
    estimate = sketch[prefix_trie.cells(digests, 1 << 16)].min(axis=1)
    twice = np.array([k % 700 < 300 for k in range(1000)])
    assert (estimate[twice] == 2).all() and (estimate[~twice] == 1).mean() > 0.99


def test_long_conversation_is_cut_between_tasks(spark, monkeypatch, request):
    """One conversation with most of the rows: the range partition cuts it, and digests are carried on."""
    rows = [(5, k, "user", f"t{k}") for k in range(3000)] + [(c, k, "user", f"t{k}") for c in (6, 7, 8) for k in range(20)]
    df = spark.createDataFrame([(*x, "") for x in rows], SCHEMA)
    monkeypatch.setattr(prefix_trie, "WAYS", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    turns = prefix_trie.turns_of(df)
    assert turns.filter("conv_id = 5").select("part").distinct().count() > 1
    got = {(r[0], r[1]): r for r in prefix_trie.prefix_trie(df, **HEAD).collect()}
    assert len([k for k in got if k[0] == 5]) == 3001 == len(got)
    assert [got[5, d][3] for d in (0, 1, 20, 21, 3000)] == [4, 4, 4, 1, 1] and [got[5, d][4] for d in (0, 20, 2999, 3000)] == [1, 1, 1, 0]
    assert {r[2] for r in got.values()} == {None, 5} and got[5, 20][7] == hashlib.sha256(b"6,7,8").hexdigest() and got[5, 3000][7] == hashlib.sha256(b"5").hexdigest()
    assert got[5, 0][6] == 3 * sum(len(f"t{k}") for k in range(20))


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(none) == [] and found(none, **HEAD) == []
    lone = spark.createDataFrame([(None, 1, "user", "x", "")], SCHEMA)
    assert found(lone) == []
