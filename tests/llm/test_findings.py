"""Findings of reviews, one test each."""

import numpy as np

from pyspark.sql import functions as F

from lodestrata.llm import decontam, langid, neardup, vec


def edited(rng, words, n, new):
    """``words`` with ``n`` of them changed to words that occur nowhere else."""
    out = list(words)
    for k in rng.choice(len(words), n, replace=False).tolist():
        out[k] = f"e{next(new)}"
    return " ".join(out)


def test_near_copies_of_a_large_group_are_one_class(spark):
    """F1 of round 2: copies with 4 % of their words changed, in a group of half of the table."""
    rng, new = np.random.default_rng(1), iter(range(10**9))
    base = [f"w{k}" for k in rng.integers(0, 20000, 300)]
    rows = [edited(rng, base, 12, new) for _ in range(300)] + [" ".join(f"w{k}" for k in rng.integers(0, 20000, 300)) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate([" ".join(base), *rows])), "doc_id long, text string")
    cls = {r["doc_id"]: r["class_id"] for r in neardup.classes(d).collect()}
    assert {cls[i] for i in range(301)} == {0}
    assert all(cls[i] == i for i in range(301, 601))


def test_pairs_of_small_buckets_follow_their_nodes(spark, monkeypatch):
    """Check of round 2: candidate pairs grew with the square of a bucket's nodes."""
    rng, new = np.random.default_rng(2), iter(range(10**9))
    bases = [[f"w{k}" for k in rng.integers(0, 20000, 300)] for _ in range(10)]
    rows = [edited(rng, b, 2, new) for b in bases for _ in range(30)]
    asked, plain = [], neardup.agreeing
    monkeypatch.setattr(neardup, "agreeing", lambda pairs, *more: asked.append(pairs.count()) or plain(pairs, *more))
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    cls = {r["doc_id"]: r["class_id"] for r in neardup.classes(d).collect()}
    assert all(cls[i] == i // 30 * 30 for i in range(300))
    assert sum(asked) <= 5 * 300


def test_index_of_passages_is_fitted_on_all_of_them(spark, monkeypatch):
    """F2 of round 2: the index was fitted on about 50,000 passages."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 5000, (1600, 1600))
    d = spark.createDataFrame([(k, " ".join(f"word{x}" for x in row)) for k, row in enumerate(words.tolist())], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(decontam, "latent_space", lambda table, idf: seen.append(table.count()))
    decontam.fit(d)
    assert seen == [1600 * 50]


def test_gram_matrix_against_brute_force(spark, monkeypatch):
    """F2 of round 2: the sum over all distinct passages, in several parts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(4)
    idf, q = rng.random(decontam.DIM).astype(np.float32), rng.standard_normal((decontam.DIM, 3))
    monkeypatch.setattr(decontam, "PART_PASSAGES", 500)
    texts = [r["text"] or "" for r in docs.collect()]
    w = vec.Words(texts)
    p, s = decontam.passages(w), decontam.slot(w.h)
    distinct = {tuple(x.tolist()) for x in np.split(s, np.flatnonzero(p[1:] != p[:-1]) + 1)}
    a = np.zeros((len(distinct), decontam.DIM))
    for k, x in enumerate(distinct):
        np.add.at(a[k], list(x), idf[list(x)])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    table = decontam.surveyed(docs, "text").where("slots is not null").select("slots").distinct()
    assert table.count() == len(distinct) > 1000
    got = decontam.gram_times(decontam.gram(table, idf), q)
    assert np.allclose(got, a.T @ (a @ q), rtol=1e-3, atol=1e-3)


def test_language_model_follows_all_training_rows(spark):
    """F3 of round 2: centroids and floors came from a sample; here they are those of all rows, whatever the sample."""
    rng = np.random.default_rng(5)
    words = {k: ["".join(rng.choice(list(a), 5)) for _ in range(300)] for k, a in (("x", "abcdefgh"), ("y", "mnopqrst"))}
    rows = [(i, " ".join(rng.choice(words["xy"[i % 2]], 40)), "xy"[i % 2]) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d, F.lit(True), sample=20, centroids=1)
    tf, _ = langid.counts([t for _, t, _ in rows])
    x = langid.unit(np.log1p(tf).astype(np.float32) * model.idf)
    want = langid.unit(np.stack([x[k::2].mean(axis=0) for k in range(2)]))
    assert model.langs == ["x", "y"] and np.allclose(model.centroids, want, atol=1e-5)
    half = np.array(langid.vector_keys(tf)[1]) & 1
    learned = {k: [langid.unit(x[(np.arange(600) % 2 == j) & keep].mean(axis=0, keepdims=True)) for keep in (half > -1, half == 0, half == 1)] for j, k in enumerate("xy")}
    assert langid.held_cosines(d, model.idf, learned).sum() == 600
