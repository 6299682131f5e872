"""The pipeline, stage by stage, on planted documents."""

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _quality int"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Prose and junk with labels; near copies; a benchmark passage; a secret; nulls, blanks, a repeated id, a clashing column."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rng = np.random.default_rng(5)
    lexicon = ["".join(rng.choice(list("aeiourstlnmd"), int(rng.integers(2, 9)))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(lexicon, n)) + "."
    junk = lambda n: " ".join(rng.choice(["BUY!!!", "$$$", "click", "4u", "###", "WIN", "100%"], n))
    rows = {k: prose(120) for k in range(60)} | {k: junk(80) for k in range(60, 100)}
    item = " ".join(rng.choice(lexicon, 30))
    rows[100] = rows[0].replace(rows[0].split()[50], "changed", 1)
    rows[101] = rows[1].upper()
    rows[102] = f"{prose(60)} {item} {prose(60)}"
    rows[103] = f"{prose(80)} password = hunter2hunter2 {prose(20)}"
    docs = [(k, t, "en", "s", len(t), 1) for k, t in rows.items()] + [(104, None, "en", "s", None, 1), (105, "", "en", "s", 0, 1), (106, " \n", "en", "s", 2, 1), (0, prose(90), "en", "s", None, 1)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(0, 100, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, made)
        if name != "packing":
            assert after.schema.names == docs.schema.names
            after = spark.createDataFrame(after.collect(), docs.schema)
        left[name] = after.collect()
        docs = after
    good = set(range(60)) | {100, 101, 102, 103, 0}
    assert {r.doc_id for r in left["quality classifier"]} - {106} == good
    assert {r.doc_id for r in left["SimHash near-dedup"]} - {106} == good - {100, 101} and sum(r.doc_id == 0 for r in left["SimHash near-dedup"]) == 2
    assert {r.doc_id for r in left["benchmark decontamination"]} - {106} == good - {100, 101, 102}
    secret = next(r for r in left["secret scans"] if r.doc_id == 103)
    assert "hunter2" not in secret.text and secret.n_chars == len(secret.text) and len(left["secret scans"]) == len(left["benchmark decontamination"])
    same = lambda name: sorted((r.doc_id, r.text) for r in left[name] if r.doc_id != 103)
    assert same("secret scans") == same("benchmark decontamination")
    pieces = left["packing"]
    assert {p.doc_id for p in pieces} == {r.doc_id for r in left["secret scans"]} and all(p.length & (p.length - 1) == 0 for p in pieces)


def test_run(spark, made):
    whole = corpus_pipeline.run(spark, made)
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} - {106} == set(range(60)) | {103}
    assert corpus_pipeline.ORACLE_SQL is None


def test_wide_links_keep_every_pair_that_may_be_similar():
    from pagelens.llm.simhash import LOOSE, SURE, wide_links

    def bits(n):
        """2,048 bits of which the first n are set."""
        return np.packbits(np.arange(2048) < n).view(np.int64)

    between = (SURE + LOOSE) // 2
    rows = [(0, 0, 0, 0), (1, 10, 1, between), (2, 10, 1, between + 1), (3, 20, 1, SURE), (4, 20, 1, between), (5, 30, 1, LOOSE + 1)]
    found = wide_links(pd.DataFrame([{"key": 1, "node": n, "label": label, "bits": bits(k), "block": block} for n, label, block, k in rows]))
    assert sorted(zip(found["a"], found["b"], found["d"], strict=True)) == [(0, 1, between), (0, 2, between + 1), (0, 3, SURE)]
    alone = wide_links(pd.DataFrame([{"key": 1, "node": n, "label": n % 2, "bits": bits(k), "block": 0} for n, k in ((0, 0), (1, between), (2, 1), (3, between + 2))]))
    assert sorted(zip(alone["a"], alone["b"], strict=True)) == [(0, 1), (0, 3), (1, 2), (2, 3)]
