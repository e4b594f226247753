import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import descent, estimator, fuzzy, hierarchy as H, initial, knn, labelprop, layout, mst, quality, spatial
from lodestrata.plans import catalogue

from lodestrata.sources import vectors

SF = "/root/testdata/sf0.01"
#: A line of 17 points: gaps make three to five groups and one outlier.
LINE = [0, 1, 2, 4, 10, 11, 12, 13, 14, 40, 41, 43, 44, 52, 53, 54, 100]


def line_linkage():
    i = np.arange(len(LINE) - 1)
    return H.linkage(i, i + 1, np.diff(LINE).astype(float))


def test_line_tree_and_condensed():
    link = line_linkage()
    assert link[:, 2].sum() == 100
    assert [tuple(r) for r in link[-4:]] == [(27, 22, 6, 9), (28, 26, 8, 7), (30, 29, 26, 16), (31, 16, 46, 17)]
    c = H.condense(link, 3)
    chosen = H.leaf_clusters(c)
    assert chosen == [20, 21, 22, 23]
    label = H.labels(c, chosen)
    groups = {frozenset(np.flatnonzero(label == k).tolist()) for k in range(4)}
    assert groups == {frozenset(range(9, 13)), frozenset(range(13, 16)), frozenset(range(4)), frozenset(range(4, 9))}
    assert label[16] == -1
    s = H.strengths(c, chosen, label)
    assert s[3] == 0.5 and s[16] == 0 and (np.delete(s, [3, 16]) == 1).all()
    births, deaths, _ = H.barcode(c, 3)
    assert sorted(births) == [3, 3, 3, 3, 3, 4, 7] and sorted(deaths) == [3, 3, 4, 4, 7, 7, 17]


def test_six_points():
    link = np.array([(0, 1, 0.1, 2), (2, 3, 0.2, 2), (6, 7, 0.3, 4), (8, 4, 0.4, 5), (9, 5, 0.5, 6)], float)
    c = H.condense(link, 2)
    assert sorted(zip(c.parent, c.child, c.lam.round(4), c.size)) == [(6, 4, 2.5, 1), (6, 5, 2, 1), (6, 7, 3.3333, 2), (6, 8, 3.3333, 2), (7, 0, 10, 1), (7, 1, 10, 1), (8, 2, 5, 1), (8, 3, 5, 1)]
    label = H.labels(c, [7, 8])
    assert label.tolist() == [0, 0, 1, 1, -1, -1]
    one = H.condense(link, 3)
    assert H.leaf_clusters(one) == [6] and H.labels(one, [6]).tolist() == [0, 0, 0, 0, -1, -1]


def test_peaks():
    for x, want in (([0, 1, 0], [1]), ([0, 2, 2, 1], [1]), ([0, 2, 2, 2, 1, 3, 0], [2, 5]), ([0, 1, 0, 5, 5, 0], [1, 3]), ([1, 0], []), ([3, 1, 2], []), ([0, 3, 3], []), ([], [])):
        assert H.peaks(np.array(x)) == want


def test_bandwidths(spark):
    rows = [(0, i, i, d) for i, d in enumerate([0, 0.5, 1, 1.5, 2])] + [(1, i, 10 + i, d) for i, d in enumerate([0, 0, 0.2, 0.4, 0.8])] + [(2, i, 20 + i, d) for i, d in enumerate([0, 1, 1, 1, 1.0])]
    g = spark.createDataFrame([(a, b, c, float(d)) for a, b, c, d in rows], "src long, rank int, dst long, dist double")
    got = {r["src"]: (r["rho"], r["sigma"]) for r in fuzzy.bandwidths(g, 5).collect()}
    assert got[0] == pytest.approx((0.5, 1.131805), abs=1e-4)
    assert got[1] == pytest.approx((0.2, 0.164284), abs=1e-4)
    assert got[2] == pytest.approx((1, 0.0008), abs=1e-6)


def test_symmetric_union(spark):
    e = spark.createDataFrame([(0, 1, 0.8), (1, 0, 0.5), (2, 3, 0.8)], "src long, dst long, weight double")
    got = {(r["src"], r["dst"]): round(r["weight"], 9) for r in fuzzy.symmetrised(e).collect()}
    assert got == {(0, 1): 0.9, (1, 0): 0.9, (2, 3): 0.8, (3, 2): 0.8}


def test_duplicates_rule(spark):
    inds, dists = [[0, 1, 2], [1, 0, 2], [2, 0, 1], [3, 0, 1]], [[0, 0.5, 1], [0.5, 0, 1], [1, 0.5, 0], [0.8, 0, 0]]
    g = spark.createDataFrame([(i, k, inds[i][k], float(dists[i][k])) for i in range(4) for k in range(3)], "src long, rank int, dst long, dist double")
    assert {tuple(r) for r in knn.duplicates(g).collect()} == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)}


def test_knn_blocks_and_edges(spark):
    v = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.0, 0.0]), (2, [2.0, 2.0])], "id long, vec array<double>")
    got = {(r["src"], r["rank"]): (r["dst"], r["dist"]) for r in knn.published(knn.exact(v, 2)).collect()}
    assert got[1, 0] == (1, 0.0) and got[0, 0] == (0, 0.0) and got[0, 1][0] == 2
    e = vectors.read(spark, f"{SF}/embeddings.parquet")
    a, b = (knn.exact(e, 5, block=n).orderBy("src", "rank").toPandas() for n in (2048, 100))
    assert (a.dst == b.dst).all() and np.allclose(a.raw, b.raw)
    assert knn.exact(e.where("id < 0"), 5).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "int8", "bits"])
def test_descent_recall(spark, metric):
    v = catalogue.typed(spark, SF)[metric]
    exact = knn.exact(v, 15, metric)
    edge = exact.groupBy("src").agg(F.min("raw").alias("edge"))
    got = descent.search(v, 15, metric, leaf=20, cell=100)  # several cells, leaves far smaller than the lists
    assert got.groupBy("src").count().where("count = 15").count() == 500
    assert got.join(edge, "src").where("raw >= edge - 1e-9").count() / (500 * 15) >= 0.9
    if metric == "cosine":
        assert got.where("rank = 0 and src = dst and raw = 1").count() == 500


def test_descent_of_few_and_equal_rows(spark):
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "id long, vec array<double>")
    assert descent.search(few, 15).count() == 16
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "id long, vec array<double>")
    assert descent.search(same, 5, leaf=10, cell=50).groupBy("src").count().where("count = 5").count() == 300
    assert descent.search(few.where("id < 0"), 5).count() == 0


def test_sides_are_never_empty():
    rng = np.random.default_rng(2)
    for metric in ("cosine", "int8", "bits", "euclid"):
        x = np.ones((20, 4))
        left = descent.sides(x, x[0], x[1], metric, rng)
        assert 0 < left.sum() < 20
    rows = np.concatenate(descent.leaves_of(rng.standard_normal((500, 8)), 30, "cosine", rng, 200))
    assert sorted(rows.tolist()) == list(range(500))
    assert max(map(len, descent.leaves_of(rng.standard_normal((500, 8)), 30, "cosine", rng, 1))) <= 30


def test_box_bounds():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((50, 3)), rng.standard_normal((40, 3)) + 2
    b = spatial.Boxes(np.array([0, 1]), np.stack([x.min(0), y.min(0)]), np.stack([x.max(0), y.max(0)]), np.zeros(2))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    assert (b.least(x, np.array([1]))[:, 0] <= d.min(axis=1) + 1e-12).all() and (b.most(x, np.array([1]))[:, 0] >= d.max(axis=1) - 1e-12).all()
    assert b.apart(0)[1] <= d.min() and b.apart(0)[0] == 0


def test_pruned_search_compares_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((16, 3)) * 40
    x = centres[rng.integers(0, 16, 1600)] + rng.standard_normal((1600, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    asked = []
    meet = spatial.meet
    monkeypatch.setattr(spatial, "meet", lambda asking, *a: asked.append(asking) or meet(asking, *a))
    got = {r["id"]: r["core"] for r in mst.core_distances(df, 5, 100).collect()}
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, 5]
    assert np.allclose([got[i] for i in range(1600)], d)
    pairs = asked[0].count() * 100 + 1600 * 100
    assert pairs < 0.3 * 1600 * 1600


def test_tree_paths_agree(spark):
    e = vectors.read(spark, f"{SF}/embeddings.parquet").where("id < 80")
    one, many = mst.spanning_tree(e, 3).toPandas(), mst.spanning_tree(e, 3, block=40, local_rows=1).toPandas()
    assert len(one) == len(many) == 79 and np.allclose(np.sort(one.weight), np.sort(many.weight))
    assert mst.spanning_tree(e.where("id = 0"), 3).count() == 0


def test_layout_paths_agree(spark, monkeypatch):
    e = spark.createDataFrame([(a, b, 0.5 + 0.1 * ((a * b) % 5)) for a in range(20) for b in range(20) if a != b and (a + b) % 3 == 0], "src long, dst long, weight double")
    n = spark.range(20)
    local = {r["id"]: r["pos"] for r in layout.embed(e, n, 3, 3).collect()}
    monkeypatch.setattr(layout, "LOCAL_EDGES", 0)  # joins of positions to edges
    far = {r["id"]: r["pos"] for r in layout.embed(e, n, 3, 3).collect()}
    assert all(np.allclose(local[i], far[i], atol=1e-6) for i in local)


def test_sweep_rules(spark):
    def run(*edges):
        e = spark.createDataFrame([(9, d, w) for d, w in edges], "src long, dst long, weight double")
        lab = spark.createDataFrame([(9, -1), (0, 5), (1, 5), (2, 3)], "id long, label long")
        return {r["id"]: r["label"] for r in labelprop.sweep(e, lab).collect()}[9]

    assert run((0, 0.6), (1, 0.5), (2, 1.0)) == 5
    assert run((0, 0.6)) == -1
    assert run((0, 1.0)) == 5
    assert run((0, 1.0), (2, 1.0)) == 3


def test_estimator_finds_blobs(spark):
    b = vectors.blobs(spark, SF).withColumnRenamed("label", "truth")
    model = estimator.LayeredClusters(vecCol="vec", idCol="id", nEpochs=20).fit(b)
    got = model.transform(b).where("label >= 0")
    assert got.count() > 400
    assert quality.adjusted_rand(got, "label", "truth").first()[0] >= 0.9
    assert model.result.scores.count() >= 1 and model.cluster_tree.count() >= 1


def test_layer_limits_and_base_clusters():
    rng = np.random.default_rng(5)
    x = np.sort(np.concatenate([rng.normal(c, s, 40) for c, s in ((0, 1), (8, 1), (40, 1), (48, 1), (120, 2), (135, 2))]))
    i = np.arange(len(x) - 1)
    link = H.linkage(i, i + 1, np.diff(x))
    for most in (1, 2, 3):
        assert len(H.layers(link, 3, most=most)) <= most
    assert len(H.layers(link, 3, most=1)) == 1
    assert H.diverse([1], np.array([0, 1.0, 0]), np.arange(3.0), np.zeros(3), np.ones(3), most=0) == []
    base = H.layers(link, 3, n_clusters=6)
    assert base[0][0].max() + 1 == 6 and len(H.layers(link, 3, n_clusters=6, single=True)) == 1
    size = H.size_for(link, 6)
    first = H.labels(H.condense(link, size), H.leaf_clusters(H.condense(link, size)))
    again = max(1, int(np.bincount(first[first >= 0]).min()))
    births = H.barcode(H.condense(link, again), again)[0]
    assert births.min() >= again


def test_strengths_by_hand_and_at_size():
    c = H.condense(line_linkage(), 3)
    for chosen in ([20, 21, 22, 23], [18, 19], [18], []):
        label = H.labels(c, chosen)
        point = c.child < c.n
        lam = dict(zip(c.child[point].tolist(), c.lam[point].tolist(), strict=True))
        want = []
        for i in range(c.n):
            if label[i] < 0:
                want.append(0.0)
                continue
            own = [v for p, x, v in zip(c.parent.tolist(), c.child.tolist(), c.lam.tolist(), strict=True) if x < c.n and p == chosen[label[i]]]
            top = max(own, default=0.0)
            want.append(1.0 if not top or np.isinf(lam[i]) else min(lam[i], top) / top)
        assert H.strengths(c, chosen, label).tolist() == want


def test_merging_below_a_distance():
    c = H.condense(line_linkage(), 3)
    chosen = H.leaf_clusters(c)
    assert H.merge_below(c, chosen, 0.5) == chosen
    assert H.merge_below(c, chosen, 7.0) == [19, 20, 21]
    assert H.merge_below(c, chosen, 10.0) == [18, 19]
    assert H.merge_below(c, chosen, 30.0) == [17]


def test_mass_against_every_choice():
    from itertools import combinations

    rng = np.random.default_rng(6)
    for _ in range(20):
        x = np.sort(rng.normal(0, 10, 40))
        i = np.arange(39)
        c = H.condense(H.linkage(i, i + 1, np.diff(x)), 4)
        score, k = H.node_scores(c), c.cluster_rows()
        up = dict(zip(k.child.tolist(), k.parent.tolist(), strict=True))
        above = {y: H.ancestors({a: (b, 0) for a, b in up.items()}, y) - {y} for y in score}
        own = [y for y in score if y != c.n]
        best = max((sum(score[y] for y in s) for r in range(len(own) + 1) for s in combinations(own, r) if not any(b in above[a] for a in s for b in s)), default=0)
        if len(own) <= 12:
            assert sum(score[y] for y in H.mass_clusters(c)) == pytest.approx(best)


def test_neighbor_scale(spark):
    g = spark.createDataFrame([(0, i, i, float(d)) for i, d in enumerate([0, 0.5, 1, 1.5, 2])], "src long, rank int, dst long, dist double")
    for scale in (1.0, 1.4):
        w = fuzzy.memberships(g, fuzzy.bandwidths(g, 5, scale))
        assert w.agg(F.sum("weight")).first()[0] == pytest.approx(np.log2(5 * scale), abs=1e-4)


def test_bad_vectors(spark):
    v = spark.createDataFrame([(0, [float("nan")])], "id long, vec array<double>")
    with pytest.raises(Exception, match="non-finite"):
        vectors.checked(v).collect()


def test_agreement_measures(spark):
    t = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "a int, b int")
    assert quality.adjusted_rand(t, "a", "b").first()[0] == 1.0
    assert quality.adjusted_mutual_information(t, "a", "b") == pytest.approx(1.0)
    assert len(LINE) == 17 and F is not None


def test_separation_by_hand(spark):
    rows = [(0, [0.0, 0.0], 0), (1, [0.0, 2.0], 0), (2, [6.0, 0.0], 1), (3, [6.0, 2.0], 1), (4, [99.0, 99.0], -1)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    index, ratio = quality.separation(df).first()
    assert index == pytest.approx(36 * 2 / 4) and ratio == pytest.approx(2 / 6)
    assert tuple(quality.separation(df.where("label < 1")).first()) == (None, None)
    assert tuple(quality.separation(df.where("id in (0, 2)")).first()) == (1.0, 0.0)
    t = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (-1, 1)], "a int, b int")
    assert quality.clustering_score(t, "a", "b").first()[0] == pytest.approx(0.75 ** (1 / 3))


def test_queries_do_the_whole_job(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(catalogue.estimator, "cluster", lambda df, **options: seen.append(options))
    catalogue.fitted(spark, SF)
    assert "n_epochs" not in seen[0]
    monkeypatch.setattr(catalogue.layout, "embed", lambda edges, nodes, dims, *more: seen.append((edges, more)))
    catalogue.node_layout(spark, SF)
    edges, more = seen[1]
    assert more == ()  # the default epochs
    g = knn.published(knn.exact(vectors.read(spark, f"{SF}/embeddings.parquet")))
    want = fuzzy.symmetrised(fuzzy.memberships(g, fuzzy.bandwidths(g, 15)))
    assert edges.count() == want.count() and edges.agg(F.sum("weight")).first()[0] == pytest.approx(want.agg(F.sum("weight")).first()[0])


def test_sweeps_agree(spark):
    rng = np.random.default_rng(7)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (400, 2)) if a != b}
    pairs |= {(b, a) for a, b in pairs}
    weight = {tuple(sorted(p)): float(rng.integers(1, 9)) / 8 for p in pairs}
    rows = [(a, b, weight[tuple(sorted((a, b)))]) for a, b in sorted(pairs)]
    label = np.where(rng.random(60) < 0.2, rng.integers(0, 6, 60), -1)
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    table = spark.createDataFrame([(i, int(x)) for i, x in enumerate(label)], "id long, label long")
    src, dst, w = (np.array(c) for c in zip(*rows, strict=True))
    for _ in range(3):
        table = labelprop.sweep(edges, table)
        label = labelprop.swept(src, dst, w, label)
        assert [r["label"] for r in table.orderBy("id").collect()] == label.tolist()


def test_revoting_sweep(spark):
    e = spark.createDataFrame([(9, 0, 1.5), (9, 1, 0.5), (8, 0, 1.0), (7, 1, 0.4)], "src long, dst long, weight double")
    lab = spark.createDataFrame([(9, 3), (8, 3), (7, -1), (0, 5), (1, 6)], "id long, label long")
    assert {r["id"]: r["label"] for r in labelprop.sweep(e, lab, revote=True).collect()} == {9: 5, 8: 3, 7: -1, 0: 5, 1: 6}


@pytest.mark.parametrize("base", ["random", "pca", "spectral", "mds"])
@pytest.mark.parametrize("upscaling", ["partition_expander", "jitter_expander", "jitter"])
def test_initial_places(spark, base, upscaling, monkeypatch):
    b = vectors.blobs(spark, SF).select("id", "vec")
    g = knn.published(knn.exact(b, 10))
    edges = fuzzy.symmetrised(fuzzy.memberships(g, fuzzy.bandwidths(g, 10)))
    for limit in ([initial.LOCAL_EDGES] if upscaling != "partition_expander" or base != "pca" else [initial.LOCAL_EDGES, 0]):  # 0: one level in joins
        monkeypatch.setattr(initial, "LOCAL_EDGES", limit)
        rows = initial.places(edges, b, 3, 64, base=base, upscaling=upscaling).collect()
        pos = np.array([r["pos"] for r in rows])
        assert len(rows) == 500 and pos.shape == (500, 3) and np.isfinite(pos).all() and np.allclose(pos.mean(axis=0), 0, atol=1e-9)
        truth = dict(vectors.blobs(spark, SF).select("id", "label").collect())
        label = np.array([truth[r["id"]] for r in rows])
        within = np.mean([pos[label == k].std() for k in set(label.tolist())])
        assert within < pos.std()


def test_model_is_saved_with_its_parameters(spark, tmp_path):
    b = vectors.blobs(spark, SF)
    fitted = estimator.LayeredClusters(vecCol="vec", idCol="id", nEpochs=5, approximate=1, nodeEmbeddingInit="random").fit(b)
    path = str(tmp_path / "model")
    fitted.write().overwrite().save(path)
    fitted.write().overwrite().save(path)
    with pytest.raises(Exception, match="exists"):
        fitted.save(path)
    again = estimator.LayeredClustersModel.load(path)
    assert again.getOrDefault("idCol") == "id" and again.getOrDefault("nEpochs") == 5
    assert sorted(map(tuple, again.labels.collect())) == sorted(map(tuple, fitted.labels.collect()))
    with pytest.raises(RuntimeError, match="not fitted"):
        estimator.LayeredClustersModel().transform(b)
    e = estimator.LayeredClusters(vecCol="vec", minSamples=3)
    e.save(str(tmp_path / "estimator"))
    assert estimator.LayeredClusters.load(str(tmp_path / "estimator")).getOrDefault("minSamples") == 3
