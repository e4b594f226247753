"""The registered queries of the clustering operators and the SQL they are checked against."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.functions import metrics
from lodestrata.operators import descent, estimator, fuzzy, hierarchy, knn, labelprop, layout, mst, quality
from lodestrata.operators.store import stored
from lodestrata.sources import vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.read(spark, f"{sf_dir}/embeddings.parquet")


def six(c: str):
    return F.round(c, 6).alias(c)


# SQL parts -------------------------------------------------------------------------------------------------------

V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
U = V + ", u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v)"


def knn_sql(k: int, pairs: str, base: str = U) -> str:
    return f"{base}, p AS ({pairs}), g AS (SELECT src, rank, dst, raw FROM (SELECT src, dst, raw, row_number() OVER (PARTITION BY src ORDER BY raw DESC, dst) - 1 AS rank FROM p) WHERE rank < {k})"


COS = "SELECT a.id AS src, b.id AS dst, CASE WHEN a.id = b.id THEN 1.0 ELSE list_inner_product(a.e, b.e) END AS raw FROM u a, u b"
DIST = "CASE WHEN raw > 0 THEN greatest(0.0 - log2(raw), 0.0) ELSE 126.0 END"
EUC = "SELECT a.id AS src, b.id AS dst, CASE WHEN a.id = b.id THEN 0.0 ELSE -sqrt(greatest(list_inner_product(a.e, a.e) + list_inner_product(b.e, b.e) - 2 * list_inner_product(a.e, b.e), 0)) END AS raw FROM v a, v b"
Q8 = V + ", q AS (SELECT id, list_transform(e, lambda x: CAST(round(127 * x) AS INTEGER)) AS e FROM v)"
BITS = V + ", i AS (SELECT id, e, unnest(range(1, 65)) AS k FROM v), b AS (SELECT id, CAST(sum(CASE WHEN e[k] > 0 AND k < 64 THEN CAST(pow(2, k - 1) AS HUGEINT) WHEN e[k] > 0 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE 0 END) AS BIGINT) AS w FROM i GROUP BY id)"
GRAPH = f"d AS (SELECT src, rank, dst, {DIST} AS dist FROM g)"


@query(f"WITH {knn_sql(15, COS)} SELECT src, CAST(rank AS INTEGER) AS rank, dst, round({DIST}, 6) AS dist FROM g")
def knn_cosine_topk(spark, sf_dir):
    return knn.published(knn.exact(emb(spark, sf_dir))).select("src", "rank", "dst", six("dist"))


@query(f"WITH {knn_sql(10, 'SELECT a.id AS src, b.id AS dst, CAST(list_inner_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS DOUBLE) AS raw FROM q a, q b', Q8)} SELECT src, CAST(rank AS INTEGER) AS rank, dst, raw, round(1 / raw, 6) AS dist FROM g")
def knn_int8_ip_topk(spark, sf_dir):
    v = emb(spark, sf_dir).select("id", F.transform(metrics.quantised(F.col("vec")), lambda x: x.cast("double")).alias("vec"))
    g = knn.exact(v, 10, "int8")
    return g.join(knn.published(g, "int8").select("src", "rank", "dist"), ["src", "rank"]).select("src", "rank", "dst", "raw", six("dist"))


@query(f"WITH {knn_sql(10, 'SELECT a.id AS src, b.id AS dst, CASE WHEN (a.w | b.w) = 0 THEN 0.0 ELSE CAST(bit_count(a.w & b.w) AS DOUBLE) / bit_count(a.w | b.w) END AS raw FROM b a, b b', BITS)} SELECT src, CAST(rank AS INTEGER) AS rank, dst, round(0.0 - log2(raw), 6) AS dist FROM g")
def knn_bit_jaccard_topk(spark, sf_dir):
    v = emb(spark, sf_dir).select("id", F.array(metrics.sign_word(F.col("vec"))).alias("vec"))
    return knn.published(knn.exact(v, 10, "bits"), "bits").select("src", "rank", "dst", six("dist"))


@query(f"WITH {knn_sql(15, COS)} SELECT dst AS id, count(*) AS degree FROM g WHERE src <> dst GROUP BY dst")
def reverse_knn_degree(spark, sf_dir):
    return knn.exact(emb(spark, sf_dir)).where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


@query("SELECT vec_id AS lo, vec_id + 1000000 AS hi FROM embeddings WHERE vec_id % 10 = 0")
def duplicates(spark, sf_dir):
    v = emb(spark, sf_dir)
    twice = v.union(v.where("id % 10 = 0").select((F.col("id") + 1_000_000).alias("id"), "vec"))
    near = knn.published(stored(knn.exact(twice))).select("src", "rank", "dst", F.round("dist", 9).alias("dist"))
    return knn.duplicates(near)


RHO = f"WITH {knn_sql(15, COS)}, {GRAPH}, r AS (SELECT src, coalesce(min(CASE WHEN dist > 0 THEN dist END), 0.0) AS rho FROM d GROUP BY src)"


@query(f"{RHO} SELECT src, round(rho, 6) AS rho FROM r")
def knn_rho(spark, sf_dir):
    g = knn.published(stored(knn.exact(emb(spark, sf_dir))))
    return fuzzy.bandwidths(g, 15).select("src", six("rho"))


# sigma is checked by what defines it: the memberships of ranks 1.. sum to log2(k) within the tolerance
@query(f"{RHO} SELECT src, TRUE AS reaches FROM r")
def knn_sigma_target(spark, sf_dir):
    g = knn.published(stored(knn.exact(emb(spark, sf_dir))))
    w = fuzzy.memberships(g, fuzzy.bandwidths(g, 15))
    return w.groupBy("src").agg((F.abs(F.sum("weight") - float(np.log2(15))) < 1e-3).alias("reaches"))


def fuzzy_edges(spark, sf_dir) -> DataFrame:
    """Directed edges for queries on graphs: weights by rank, so that SQL can say them."""
    return stored(knn.exact(emb(spark, sf_dir), 8)).where("rank > 0").select("src", "dst", (1.0 / (F.col("rank") + 1)).alias("weight"))


EDGES = f"WITH {knn_sql(8, COS)}, e AS (SELECT src, dst, 1.0 / CAST(rank + 1 AS DOUBLE) AS weight FROM g WHERE rank > 0)"
SYM = EDGES + ", s AS (SELECT coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst, coalesce(a.weight, 0) + coalesce(b.weight, 0) - coalesce(a.weight, 0) * coalesce(b.weight, 0) AS weight FROM e a FULL OUTER JOIN e b ON a.src = b.dst AND a.dst = b.src)"
PARTS = "m AS (SELECT vec_id AS id, vec_id % 8 AS part FROM embeddings)"


@query(SYM + " SELECT src, dst, round(weight, 6) AS weight FROM s")
def fuzzy_symmetric(spark, sf_dir):
    return fuzzy.symmetrised(fuzzy_edges(spark, sf_dir)).select("src", "dst", six("weight"))


@query(SYM + " SELECT src, dst, round(50 / greatest(50 * weight / (SELECT max(weight) FROM s), 1.0), 6) AS epochs_per_sample FROM s")
def epochs_per_sample(spark, sf_dir):
    return fuzzy.epochs_per_sample(fuzzy.symmetrised(fuzzy_edges(spark, sf_dir)), 50).select("src", "dst", six("epochs_per_sample"))


@query(f"WITH {knn_sql(6, EUC, V)} SELECT src AS id, round(max(-raw), 6) AS core FROM g GROUP BY src")
def core_distance(spark, sf_dir):
    return mst.core_distances(emb(spark, sf_dir), 5).select("id", six("core"))


@query(f"WITH {knn_sql(6, EUC, V)}, c AS (SELECT src AS id, max(-raw) AS core FROM g GROUP BY src) SELECT g.src, g.dst, round(greatest(-g.raw, a.core, b.core), 6) AS weight FROM g JOIN c a ON a.id = g.src JOIN c b ON b.id = g.dst WHERE g.src <> g.dst")
def mutual_reachability_edges(spark, sf_dir):
    g = stored(knn.exact(emb(spark, sf_dir), 6, "euclid"))
    core = g.groupBy(F.col("src").alias("id")).agg(F.max(-F.col("raw")).alias("core"))
    both = g.where("src <> dst").join(core.select(F.col("id").alias("src"), F.col("core").alias("ca")), "src").join(core.select(F.col("id").alias("dst"), F.col("core").alias("cb")), "dst")
    return both.select("src", "dst", F.round(F.greatest(-F.col("raw"), "ca", "cb"), 6).alias("weight"))


# A line: the distinct balances of all customers, in 2048ths of a cent's hundred, so that differences are exact.
BAL = "b AS (SELECT min(c_custkey) AS id, CAST(round(c_acctbal * 100) AS BIGINT) / 2048.0 AS x FROM customer GROUP BY CAST(round(c_acctbal * 100) AS BIGINT))"


def line(spark, sf_dir) -> DataFrame:
    cents = F.round(F.col("c_acctbal") * 100).cast("long").alias("cents")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(cents).agg(F.min("c_custkey").alias("id"))
    return c.select("id", F.array(F.col("cents") / 2048.0).alias("vec"))


@query(f"WITH {BAL} SELECT count(*) AS edges, round(sum(gap), 3) AS total FROM (SELECT x - lag(x) OVER (ORDER BY x) AS gap FROM b) WHERE gap IS NOT NULL")
def mst_1d_gaps(spark, sf_dir):
    return mst.spanning_tree(line(spark, sf_dir), 1).agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 3).alias("total"))


@query(f"WITH {BAL}, j AS (SELECT id, x, CASE WHEN x - lag(x) OVER (ORDER BY x) < 1.25 THEN 0 ELSE 1 END AS new FROM b), r AS (SELECT id, sum(new) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS run FROM j), s AS (SELECT run, min(id) AS least, count(*) AS n FROM r GROUP BY run), k AS (SELECT run, row_number() OVER (ORDER BY least) - 1 AS label FROM s WHERE n >= 3) SELECT r.id, CAST(coalesce(k.label, -1) AS INTEGER) AS label FROM r LEFT JOIN k ON r.run = k.run")
def cut_labels_1d(spark, sf_dir):
    rows = stored(line(spark, sf_dir))
    return mst.cut_labels(mst.spanning_tree(rows, 1), rows, 1.25, 3)


# Kruskal's components cannot be grown in SQL; a tree is checked by what defines its weight: for each of some cuts, the
# edges below it leave as many components as the whole graph of mutual reachability does.
@query(f"WITH RECURSIVE {knn_sql(6, EUC, V)}, c AS (SELECT src AS id, max(-raw) AS core FROM g GROUP BY src), q AS (SELECT unnest([1.0, 1.15, 1.25, 1.35]) AS share), m AS (SELECT avg(core) AS core FROM c), e AS (SELECT share, a.id AS src, b.id AS dst FROM q, m, v a JOIN c x ON x.id = a.id JOIN v b ON a.id <> b.id JOIN c y ON y.id = b.id WHERE x.core < share * m.core AND y.core < share * m.core AND sqrt(greatest(list_inner_product(a.e, a.e) + list_inner_product(b.e, b.e) - 2 * list_inner_product(a.e, b.e), 0)) < share * m.core), r AS (SELECT share, id AS node, id AS label FROM q, v UNION SELECT e.share, e.dst, r.label FROM r JOIN e ON e.share = r.share AND e.src = r.node WHERE r.label < e.dst), l AS (SELECT share, node, min(label) AS label FROM r GROUP BY share, node) SELECT share, count(DISTINCT label) AS components FROM l GROUP BY share")
def mst_components(spark, sf_dir):
    rows = stored(emb(spark, sf_dir))
    tree, core = stored(mst.spanning_tree(rows, 5, local_rows=1)), mst.core_distances(rows, 5)
    cuts = core.agg(F.avg("core").alias("m"), F.count(F.lit(1)).alias("n")).select("n", F.explode(F.array(*[F.struct(F.lit(s).alias("share"), (F.col("m") * s).alias("cut")) for s in (1.0, 1.15, 1.25, 1.35)])).alias("c")).select("n", "c.*")
    return tree.join(F.broadcast(cuts), F.col("weight") < F.col("cut"), "right").groupBy("share", "n").agg(F.count("weight").alias("edges")).select("share", (F.col("n") - F.col("edges")).alias("components"))


@query()
def mst_weight_total(spark, sf_dir):
    return mst.spanning_tree(emb(spark, sf_dir), 5).agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 5).alias("total"))


SWEEP = SYM + ", l AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN vec_id % 16 ELSE -1 END AS label FROM embeddings), v2 AS (SELECT s.src AS id, l.label AS vote, sum(s.weight) AS w FROM s JOIN l ON l.id = s.dst WHERE l.label >= 0 GROUP BY s.src, l.label HAVING round(sum(s.weight), 9) >= 1), t AS (SELECT id, vote, row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, vote) AS r FROM v2)"


@query(SWEEP + " SELECT l.id, CASE WHEN l.label >= 0 THEN l.label ELSE coalesce(t.vote, -1) END AS label FROM l LEFT JOIN t ON t.id = l.id AND t.r = 1")
def labelprop_one_sweep(spark, sf_dir):
    edges = fuzzy.symmetrised(fuzzy_edges(spark, sf_dir)).select("src", "dst", F.round("weight", 9).alias("weight"))
    ids = emb(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 16).otherwise(-1).cast("long").alias("label"))
    return labelprop.sweep(edges, ids)


@query("SELECT vec_id % 8 AS part, k - 1 AS i, round(avg(CAST(embedding[k] AS DOUBLE)), 6) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS k FROM embeddings) GROUP BY vec_id % 8, k")
def partition_centroids(spark, sf_dir):
    v = emb(spark, sf_dir)
    found = labelprop.centroids(v, v.select("id", (F.col("id") % 8).alias("part")))
    return found.select("part", F.posexplode("vec").alias("i", "x")).select("part", F.col("i").cast("long").alias("i"), six("x"))


@query(SYM + f", {PARTS}, z AS (SELECT part, count(*) AS n FROM m GROUP BY part) SELECT a.part AS src, b.part AS dst, round(least(1.0, greatest(0.0, sum(s.weight) / sqrt(max(z.n)))), 6) AS weight FROM s JOIN m a ON a.id = s.src JOIN m b ON b.id = s.dst JOIN z ON z.part = a.part GROUP BY a.part, b.part")
def coarse_graph(spark, sf_dir):
    v = emb(spark, sf_dir)
    return labelprop.coarse(fuzzy.symmetrised(fuzzy_edges(spark, sf_dir)), v.select("id", (F.col("id") % 8).alias("part"))).select("src", "dst", six("weight"))


# Hierarchies of the line ---------------------------------------------------------------------------------------------

# The line's tree joins neighbours, so its condensed tree follows from cutting a stretch at its largest gap (of equal ones
# at the last in the order of merging), which SQL can do level by level: rows of (lo, hi) stretches of places, with the
# cluster (a, b) that each belongs to.
#: Least size of a cluster in the queries below.
LEAST = 5
TREE = (
    f"WITH RECURSIVE {BAL}, p AS (SELECT id, x, row_number() OVER (ORDER BY x) AS i FROM b), n AS (SELECT max(i) AS n FROM p), "
    "o AS (SELECT q.i, q.x - p.x AS gap, row_number() OVER (ORDER BY q.x - p.x, least(p.id, q.id), greatest(p.id, q.id)) AS o FROM p JOIN p q ON q.i = p.i + 1), "
    "s AS (SELECT CAST(1 AS BIGINT) AS lo, n AS hi, CAST(1 AS BIGINT) AS a, n AS b, CAST(0 AS BIGINT) AS depth FROM n UNION ALL SELECT * FROM ("
    "WITH w AS (SELECT s.lo, s.hi, s.a, s.b, s.depth, max(o.o) AS o FROM s JOIN o ON o.i > s.lo AND o.i <= s.hi GROUP BY ALL), "
    "c AS (SELECT w.*, o.i AS cut FROM w JOIN o ON o.o = w.o), "
    f"k AS (SELECT c.*, cut - lo >= {LEAST} AS l, hi - cut + 1 >= {LEAST} AS r FROM c) "
    "SELECT lo, cut - 1 AS hi, CASE WHEN r THEN lo ELSE a END AS a, CASE WHEN r THEN cut - 1 ELSE b END AS b, depth + 1 AS depth FROM k WHERE l "
    "UNION ALL SELECT cut, hi, CASE WHEN l THEN cut ELSE a END, CASE WHEN l THEN hi ELSE b END, depth + 1 FROM k WHERE r) WHERE hi > lo), "
    "w AS (SELECT s.lo, s.hi, s.a, s.b, max(o.o) AS o FROM s JOIN o ON o.i > s.lo AND o.i <= s.hi GROUP BY ALL), "
    f"e AS (SELECT w.lo, w.hi, w.a, w.b, o.i AS cut, o.gap, o.i - w.lo AS nl, w.hi - o.i + 1 AS nr, o.i - w.lo >= {LEAST} AS l, w.hi - o.i + 1 >= {LEAST} AS r FROM w JOIN o ON o.o = w.o), "
    "cl AS (SELECT a AS pa, b AS pb, lo AS a, cut - 1 AS b, nl AS size, gap, least(nl, nr) AS small FROM e WHERE l AND r UNION ALL SELECT a, b, cut, hi, nr, gap, least(nl, nr) FROM e WHERE l AND r), "
    "pt AS (SELECT p.id, e.a, e.b, e.gap FROM e JOIN p ON p.i BETWEEN e.lo AND e.hi WHERE NOT (l AND r) AND (CASE WHEN p.i < e.cut THEN NOT l ELSE NOT r END)), "
    "lf AS (SELECT a, b FROM cl UNION SELECT 1, n FROM n EXCEPT SELECT pa, pb FROM cl), "
    "sc AS (SELECT c.a, c.b, coalesce(x.s, 0) + coalesce(y.s, 0) - coalesce(z.size / z.gap, 0) AS score FROM (SELECT a, b FROM cl UNION SELECT 1, n FROM n) c LEFT JOIN (SELECT a, b, sum(1 / gap) AS s FROM pt GROUP BY a, b) x ON x.a = c.a AND x.b = c.b LEFT JOIN (SELECT pa, pb, sum(size / gap) AS s FROM cl GROUP BY pa, pb) y ON y.pa = c.a AND y.pb = c.b LEFT JOIN cl z ON z.a = c.a AND z.b = c.b), "
    f"iv AS (SELECT c.a, c.b, c.size, CAST(coalesce((SELECT max(d.small) FROM cl d WHERE d.pa >= c.a AND d.pb <= c.b), {LEAST}) AS DOUBLE) AS birth, CAST(c.small AS DOUBLE) AS death, exp(-c.gap) AS w FROM cl c), "
    f"rt AS (SELECT CAST(coalesce(max(small), {LEAST}) AS DOUBLE) AS birth FROM cl)"
)


def on_tree(spark, sf_dir, rows, schema: str) -> DataFrame:
    """``rows(condensed tree of the line, ids)`` as a table, made in one task from the stored tree."""
    nodes = stored(line(spark, sf_dir))
    return estimator.in_one_task(mst.spanning_tree(nodes, 1), nodes, lambda link, ids: rows(hierarchy.condense(link, LEAST), ids), schema)


def by_cluster(c: hierarchy.Condensed) -> dict[int, tuple[float, int, int]]:
    """cluster -> (distance of birth, size, parent) of all clusters but the root."""
    k = c.cluster_rows()
    return {x: (1 / lam, s, p) for x, lam, s, p in zip(k.child.tolist(), k.lam.tolist(), k.size.tolist(), k.parent.tolist(), strict=True)}


def size_of(c: hierarchy.Condensed, x: int, own: dict) -> int:
    return own[x][1] if x in own else c.n


@query(f"{TREE} SELECT size, coalesce(pb - pa + 1, 0) AS parent_size, round(gap, 11) AS distance FROM cl")
def condensed_clusters(spark, sf_dir):
    def rows(c, ids):
        own = by_cluster(c)
        return [(s, size_of(c, p, own), round(d, 11)) for d, s, p in own.values()]

    return on_tree(spark, sf_dir, rows, "size long, parent_size long, distance double")


@query(f"{TREE} SELECT lf.b - lf.a + 1 AS size, round(coalesce(cl.gap, 0), 11) AS distance FROM lf LEFT JOIN cl ON cl.a = lf.a AND cl.b = lf.b")
def leaves(spark, sf_dir):
    def rows(c, ids):
        own = by_cluster(c)
        return [(size_of(c, x, own), round(own[x][0], 11) if x in own else 0.0) for x in hierarchy.leaf_clusters(c)]

    return on_tree(spark, sf_dir, rows, "size long, distance double")


@query(f"{TREE}, q AS (SELECT pt.*, min(gap) OVER (PARTITION BY a, b) AS top FROM pt JOIN lf USING (a, b)) SELECT p.id, round(coalesce(q.top / q.gap, 0), 6) AS strength, q.id IS NULL AS noise FROM p LEFT JOIN q ON q.id = p.id")
def strengths(spark, sf_dir):
    def rows(c, ids):
        chosen = hierarchy.leaf_clusters(c)
        label = hierarchy.labels(c, chosen)
        s = hierarchy.strengths(c, chosen, label)
        return [(i, round(v, 6), n < 0) for i, v, n in zip(ids.tolist(), s.tolist(), label.tolist(), strict=True)]

    return on_tree(spark, sf_dir, rows, "id long, strength double, noise boolean")


@query(f"{TREE} SELECT b - a + 1 AS size, round(score, 5) AS score FROM sc")
def eom_scores(spark, sf_dir):
    def rows(c, ids):
        own = by_cluster(c)
        return [(size_of(c, x, own), round(v, 5)) for x, v in hierarchy.node_scores(c).items()]

    return on_tree(spark, sf_dir, rows, "size long, score double")


# Excess of mass is checked by what defines its choice: chosen clusters are disjoint, and no single cluster outweighs the
# chosen ones under it.
@query("SELECT TRUE AS disjoint, TRUE AS heaviest")
def eom_clusters(spark, sf_dir):
    def rows(c, ids):
        return [hierarchy.mass_is_best(c, hierarchy.mass_clusters(c))]

    return on_tree(spark, sf_dir, rows, "disjoint boolean, heaviest boolean")


@query(f"{TREE} SELECT size, birth, death, round(w, 6) AS weight FROM iv")
def barcode(spark, sf_dir):
    def rows(c, ids):
        births, deaths, lam = hierarchy.barcode(c, LEAST)
        own = by_cluster(c)
        return [(own[x][1], float(births[x - c.n]), float(deaths[x - c.n]), round(float(lam[x - c.n]), 6)) for x in own]

    return on_tree(spark, sf_dir, rows, "size long, birth double, death double, weight double")


@query(f"{TREE}, bs AS (SELECT DISTINCT birth FROM iv UNION SELECT birth FROM rt) SELECT bs.birth AS size, round(coalesce(sum((iv.death - iv.birth) * iv.w), 0), 6) AS persistence FROM bs LEFT JOIN iv ON bs.birth >= iv.birth AND bs.birth < iv.death GROUP BY bs.birth")
def total_persistence(spark, sf_dir):
    def rows(c, ids):
        at, score = hierarchy.total_persistence(*hierarchy.barcode(c, LEAST))
        return [(float(x), round(float(v), 6)) for x, v in zip(at, score, strict=True)]

    return on_tree(spark, sf_dir, rows, "size double, persistence double")


# Merging below a distance is checked by what defines it: no cluster that stays was born nearer than that, unless none above.
@query("SELECT TRUE AS far")
def epsilon_clusters(spark, sf_dir):
    def rows(c, ids):
        own = by_cluster(c)
        edge = float(np.median([d for d, *_ in own.values()])) if own else 0.0
        return [(all(x not in own or own[x][0] >= edge for x in hierarchy.merge_below(c, hierarchy.leaf_clusters(c), edge)),)]

    return on_tree(spark, sf_dir, rows, "far boolean")


def table(spark, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("WITH x AS (SELECT l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY l_linenumber), w AS (SELECT k, n, lag(n) OVER (ORDER BY k) AS a, lead(n) OVER (ORDER BY k) AS b FROM x) SELECT k FROM w WHERE n > a AND n > b")
def find_peaks(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n")).orderBy("l_linenumber").collect()  # at most seven
    return table(spark, [(int(rows[i][0]),) for i in hierarchy.peaks(np.array([r["n"] for r in rows]))], "k int")


LABELS2 = "(SELECT vec_id AS id, vec_id % 12 AS f, vec_id % 4 AS c FROM embeddings)"


@query(f"SELECT CAST(1 AS INTEGER) AS parent_layer, CAST(c AS INTEGER) AS parent_cluster, CAST(0 AS INTEGER) AS child_layer, CAST(f AS INTEGER) AS child_cluster FROM {LABELS2} GROUP BY f, c UNION ALL SELECT 2, 0, 1, CAST(c AS INTEGER) FROM {LABELS2} GROUP BY c")
def cluster_tree(spark, sf_dir):
    ids = emb(spark, sf_dir).select("id")
    fine = ids.select(F.lit(0).alias("layer"), "id", (F.col("id") % 12).cast("int").alias("label"))
    return quality.cluster_tree(fine.union(ids.select(F.lit(1), "id", (F.col("id") % 4).cast("int"))))


@query("WITH t AS (SELECT label AS a, vec_id % 7 AS b FROM embeddings), n AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY a, b), c AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM n), r AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM n GROUP BY a)), k AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM n GROUP BY b)) SELECT round((c.s - r.s * k.s / (c.n * (c.n - 1) / 2)) / ((r.s + k.s) / 2 - r.s * k.s / (c.n * (c.n - 1) / 2)), 6) AS ari FROM c, r, k")
def adjusted_rand(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", (F.col("vec_id") % 7).alias("b"))
    return quality.adjusted_rand(t, "label", "b").select(six("ari"))


@query("WITH t AS (SELECT label AS a, vec_id % 7 AS b FROM embeddings), c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS c FROM t GROUP BY a, b), x AS (SELECT a, sum(c) AS s FROM c GROUP BY a), y AS (SELECT b, sum(c) AS t FROM c GROUP BY b), n AS (SELECT sum(s) AS n FROM x), m AS (SELECT sum(c / n * ln(c * n / (s * t))) AS m FROM c JOIN x USING (a) JOIN y USING (b), n), h AS (SELECT ((SELECT -sum(s / n * ln(s / n)) FROM x, n) + (SELECT -sum(t / n * ln(t / n)) FROM y, n)) / 2 AS h), k AS (SELECT s, t, n, unnest(generate_series(CAST(greatest(1, s + t - n) AS BIGINT), CAST(least(s, t) AS BIGINT))) AS k FROM x, y, n), e AS (SELECT sum(k / n * ln(n * k / (s * t)) * exp(lgamma(s + 1) + lgamma(t + 1) + lgamma(n - s + 1) + lgamma(n - t + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(s - k + 1) - lgamma(t - k + 1) - lgamma(n - s - t + k + 1))) AS e FROM k) SELECT round((m - e) / (h - e), 6) AS ami FROM m, e, h")
def adjusted_mutual_information(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", (F.col("vec_id") % 7).alias("b"))
    return table(spark, [(round(quality.adjusted_mutual_information(t, "label", "b"), 6),)], "ami double")


@query("WITH t AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.id, a.label, b.label AS other, greatest(list_inner_product(a.e, a.e) + list_inner_product(b.e, b.e) - 2 * list_inner_product(a.e, b.e), 0) AS d FROM t a, t b WHERE a.id <> b.id), m AS (SELECT id, label, other, avg(d) AS m FROM p GROUP BY id, label, other), s AS (SELECT id, label, min(CASE WHEN other <> label THEN m END) AS b, max(CASE WHEN other = label THEN m END) AS a FROM m GROUP BY id, label) SELECT label, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s GROUP BY label")
def silhouette(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = t.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return quality.silhouette(rows).select("label", six("silhouette"))


@query("WITH t AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT id, label, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM t), m AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM x GROUP BY label, i), g AS (SELECT i, avg(v) AS g FROM x GROUP BY i), b AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM m JOIN g USING (i)), d AS (SELECT x.id, x.label, sum((v - m) * (v - m)) AS d FROM x JOIN m ON x.label = m.label AND x.i = m.i GROUP BY x.id, x.label), s AS (SELECT label, avg(sqrt(d)) AS s, sum(d) AS w, count(*) AS n FROM d GROUP BY label), c AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS c FROM m a JOIN m b ON a.i = b.i AND a.label <> b.label GROUP BY a.label, b.label), r AS (SELECT a, max((x.s + y.s) / c) AS r FROM c JOIN s x ON x.label = a JOIN s y ON y.label = b GROUP BY a) SELECT round((SELECT b FROM b) * (sum(n) - count(*)) / (sum(w) * (count(*) - 1)), 6) AS calinski_harabasz, (SELECT round(avg(r), 6) FROM r) AS davies_bouldin FROM s")
def separation(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = t.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return quality.separation(rows).select(six("calinski_harabasz"), six("davies_bouldin"))


@query("WITH p AS (SELECT CAST(vec_id % 7 AS INTEGER) - 1 AS a, label AS b FROM embeddings), t AS (SELECT * FROM p WHERE a >= 0), n AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY a, b), c AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM n), r AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM n GROUP BY a)), k AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM n GROUP BY b)), i AS (SELECT (c.s - r.s * k.s / (c.n * (c.n - 1) / 2)) / ((r.s + k.s) / 2 - r.s * k.s / (c.n * (c.n - 1) / 2)) AS ari FROM c, r, k) SELECT round(cbrt(ari * ari * (SELECT avg(CASE WHEN a >= 0 THEN 1.0 ELSE 0.0 END) FROM p)), 6) AS score FROM i")
def clustering_score(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(((F.col("vec_id") % 7).cast("int") - 1).alias("a"), F.col("label").alias("b"))
    return quality.clustering_score(t, "a", "b").select(six("score"))


# No SQL form ---------------------------------------------------------------------------------------------------------


@query()
def knn_approx(spark, sf_dir):
    return knn.published(descent.search(emb(spark, sf_dir))).select("src", "rank", "dst", six("dist"))


def typed(spark, sf_dir) -> dict[str, DataFrame]:
    """The embeddings as vectors of each metric."""
    v = emb(spark, sf_dir)
    return {"cosine": v, "int8": v.select("id", F.transform(metrics.quantised(F.col("vec")), lambda x: x.cast("double")).alias("vec")), "bits": v.select("id", F.array(metrics.sign_word(F.col("vec"))).alias("vec"))}


# A share of at least 0.9 of the entries of each list is as near as the exact list's last.
@query("SELECT metric, TRUE AS recalled FROM (VALUES ('bits'), ('cosine'), ('int8')) AS t(metric)")
def knn_recall(spark, sf_dir):
    out = None
    for metric, v in typed(spark, sf_dir).items():
        exact = stored(knn.exact(v, 15, metric))
        edge = exact.groupBy("src").agg(F.min("raw").alias("edge"), F.count(F.lit(1)).alias("n"))
        near = descent.search(v, 15, metric).join(edge, "src").groupBy("src", "n").agg(F.sum((F.col("raw") >= F.col("edge") - 1e-9).cast("long")).alias("hit"))
        row = near.select(F.lit(metric).alias("metric"), "hit", "n").groupBy("metric").agg((F.sum("hit") >= 0.9 * F.sum("n")).alias("recalled"))
        out = row if out is None else out.union(row)
    return out


@query()
def partitions(spark, sf_dir):
    v = emb(spark, sf_dir)
    return labelprop.partitions(stored(fuzzy.symmetrised(fuzzy_edges(spark, sf_dir))), v.select("id"), 32)


@query()
def node_layout(spark, sf_dir):
    v = emb(spark, sf_dir)
    g = knn.published(stored(knn.exact(v)))
    return layout.embed(fuzzy.symmetrised(fuzzy.memberships(g, fuzzy.bandwidths(g, 15))), v.select("id"), 4)


def fitted(spark, sf_dir, **options):
    b = vectors.blobs(spark, sf_dir)
    return estimator.cluster(b.select("id", "vec"), **options), b


@query()
def fit_layers(spark, sf_dir):
    out, _ = fitted(spark, sf_dir)
    return out.layers.select("layer", "id", "label", six("strength"))


@query("SELECT 0 AS layer, 10 AS n_clusters, 0.0 AS persistence")
def fit_n_clusters(spark, sf_dir):
    out, _ = fitted(spark, sf_dir, approx_n_clusters=10)
    return out.scores


# What a fit must keep: every row once in each layer, clusters numbered without gaps, strengths of 0 to 1 and 0 for noise,
# layers by falling number of clusters.
@query("SELECT count(*) AS row_count, TRUE AS whole, TRUE AS dense, TRUE AS bounded, TRUE AS falling FROM embeddings")
def fit_invariants(spark, sf_dir):
    out, b = fitted(spark, sf_dir)
    rows, layers = stored(out.layers), F.col("layer")
    per = rows.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), (F.max("label") + 1).alias("k"), F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("seen"), F.min(((F.col("strength") >= 0) & (F.col("strength") <= 1) & ((F.col("label") >= 0) | (F.col("strength") == 0))).cast("int")).alias("ok"))
    n = b.agg(F.count(F.lit(1)).alias("row_count"))
    order = F.array_sort(F.collect_list(F.struct(layers.alias("layer"), "k")))
    falls = F.forall(F.sequence(F.lit(2), F.greatest(F.size("o"), F.lit(2))), lambda i: F.coalesce(F.try_element_at("o", i)["k"] <= F.try_element_at("o", i - 1)["k"], F.lit(True)))
    one = per.join(F.broadcast(n)).groupBy("row_count").agg(F.min(((F.col("n") == F.col("row_count")) & (F.col("ids") == F.col("n"))).cast("int")).alias("w"), F.min((F.col("k") == F.col("seen")).cast("int")).alias("d"), F.min("ok").alias("s"), order.alias("o"))  # one row beside a layer each
    return one.select("row_count", (F.col("w") == 1).alias("whole"), (F.col("d") == 1).alias("dense"), (F.col("s") == 1).alias("bounded"), falls.alias("falling"))


# What a partition must keep: every row in one part, parts numbered without gaps.
@query("SELECT count(*) AS row_count, TRUE AS dense FROM embeddings")
def partition_invariants(spark, sf_dir):
    p = partitions(spark, sf_dir)
    return p.agg(F.count(F.lit(1)).alias("row_count"), (F.max("part") + 1 == F.countDistinct("part")).alias("dense"))
