"""Agreement of labellings and separation of clusters, by group-bys on contingency counts and cluster sums."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row, ari: adjusted Rand index of columns a and b."""
    two = lambda n: n * (n - 1) / 2
    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    cell = cells.agg(F.sum(two(F.col("n"))).alias("cells"), F.sum("n").alias("all"))
    row = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("rows"))
    col = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("cols"))
    one = cell.crossJoin(row).crossJoin(col)  # three single rows
    expected = F.col("rows") * F.col("cols") / two(F.col("all"))
    most = (F.col("rows") + F.col("cols")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("cells") - expected) / (most - expected)).alias("ari"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 1, by Stirling's series eight places up."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def expected_information(a: list[tuple[int, int]], b: list[tuple[int, int]], n: int) -> float:
    """Expected mutual information of labellings with cluster sizes (size, how many clusters) over n rows."""
    out = 0.0
    for s, ms in a:
        for t, mt in b:
            k = np.arange(max(1, s + t - n), min(s, t) + 1)
            p = log_gamma(s + 1) + log_gamma(t + 1) + log_gamma(n - s + 1) + log_gamma(n - t + 1) - log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(s - k + 1) - log_gamma(t - k + 1) - log_gamma(n - s - t + k + 1)
            out += ms * mt * float((k / n * np.log(n * k / (s * t)) * np.exp(p)).sum())
    return out


def adjusted_mutual_information(pairs: DataFrame, a: str, b: str) -> float:
    """AMI with the arithmetic mean. Information and entropies are group-bys; the driver gets how often each cluster size
    occurs, at most sqrt(2 n) numbers a side."""
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    ra, rb = (cells.groupBy(x).agg(F.sum("c").alias(f"n{x}")) for x in "ab")
    sizes = [sorted((r[0], r[1]) for r in s.groupBy(f"n{x}").agg(F.count(F.lit(1))).collect()) for x, s in (("a", ra), ("b", rb))]
    n = sum(s * m for s, m in sizes[0])
    if not n:
        return 1.0
    h = [-sum(m * s / n * math.log(s / n) for s, m in side) for side in sizes]
    term = F.col("c") / n * F.log(F.col("c") * float(n) / (F.col("na") * F.col("nb")))
    mi = cells.join(ra, "a").join(rb, "b").agg(F.sum(term)).first()[0]
    expected, mean = expected_information(*sizes, n), sum(h) / 2
    return 1.0 if abs(mean - expected) < 1e-15 else (mi - expected) / (mean - expected)


def clustered_share(labels: DataFrame, label: str = "label") -> DataFrame:
    """One row, share: rows that are not noise."""
    return labels.agg(F.avg((F.col(label) >= 0).cast("double")).alias("share"))


def silhouette(df: DataFrame) -> DataFrame:
    """(label, silhouette): mean silhouette by cluster for squared Euclidean distance, over (id, vec, label >= 0).

    Mean squared distances to a cluster follow from its size, sum vector and sum of squares, so no pair is formed.
    """
    from lodestrata.functions.metrics import dot

    rows = df.where("label >= 0").select("id", "vec", "label", dot(F.col("vec"), F.col("vec")).alias("sq"))
    sums = rows.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))
    stats = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("sq").alias("squares")).join(sums, "label").select(F.col("label").alias("other"), "n", "squares", "total")
    dist = rows.crossJoin(stats)  # clusters are few; each row meets each cluster, not each row
    whole = F.col("n") * F.col("sq") + F.col("squares") - 2 * dot(F.col("vec"), F.col("total"))
    own = F.col("label") == F.col("other")
    mean = F.when(own, whole / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(whole / F.col("n"))
    per = dist.select("id", "label", own.alias("own"), mean.alias("m"), F.when(own, F.col("n")).alias("size"))
    s = per.groupBy("id", "label").agg(F.min(F.when(~F.col("own"), F.col("m"))).alias("b"), F.max(F.when(F.col("own"), F.col("m"))).alias("a"), F.max("size").alias("size"))
    value = F.when((F.col("size") == 1) | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return s.groupBy("label").agg(F.avg(value).alias("silhouette"))


def clustering_score(pairs: DataFrame, label: str, truth: str) -> DataFrame:
    """One row, score: cube root of (ARI squared x share of rows that are not noise), ARI over the latter."""
    ari = adjusted_rand(pairs.where(F.col(label) >= 0), label, truth)
    return ari.crossJoin(clustered_share(pairs, label)).select(F.cbrt(F.col("ari") * F.col("ari") * F.col("share")).alias("score"))  # two single rows


def separation(df: DataFrame) -> DataFrame:
    """One row (calinski_harabasz, davies_bouldin) over (id, vec, label >= 0).

    Fewer than two clusters give nulls; clusters without spread give a Calinski-Harabasz index of 1; clusters with
    the same centre are not compared.
    """
    from lodestrata.functions.metrics import squared_distance

    rows = df.where("label >= 0").select("vec", "label")
    sums = rows.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    centres = sums.groupBy("label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("t"))
    centres = centres.select("label", "n", F.transform("t", lambda s: s["x"] / F.col("n")).alias("centre"))
    whole = sums.groupBy("i").agg((F.sum("x") / F.sum("n")).alias("m"))
    whole = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("whole"))
    gap = squared_distance(F.col("vec"), F.col("centre"))
    spread = rows.join(centres.select("label", "centre"), "label").groupBy("label").agg(F.sum(gap).alias("within"), F.avg(F.sqrt(gap)).alias("s"))
    stats = centres.join(spread, "label").crossJoin(whole)  # one row
    total = stats.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("within").alias("w"), F.sum(F.col("n") * squared_distance(F.col("centre"), F.col("whole"))).alias("b"))
    a = stats.select(F.col("label").alias("a"), F.col("s").alias("sa"), F.col("centre").alias("ca"))
    b = stats.select(F.col("label").alias("b"), F.col("s").alias("sb"), F.col("centre").alias("cb"))
    apart = F.sqrt(squared_distance(F.col("ca"), F.col("cb")))
    ratio = F.when(apart > 0, (F.col("sa") + F.col("sb")) / apart).otherwise(0.0)
    worst = a.join(b, F.col("a") != F.col("b")).groupBy("a").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))  # clusters only, no rows
    index = F.when(F.col("k") < 2, None).when(F.col("w") == 0, 1.0).otherwise(F.col("b") * (F.col("n") - F.col("k")) / (F.col("w") * (F.col("k") - 1)))
    return total.crossJoin(worst).select(index.alias("calinski_harabasz"), "davies_bouldin")  # two single rows


def cluster_tree(layers: DataFrame) -> DataFrame:
    """(parent_layer, parent_cluster, child_layer, child_cluster) from (layer, id, label), layer 0 finest.

    A cluster's parent is the cluster of most common rows in the nearest higher layer that shares any (ties: least
    label); clusters without one hang under the root (number of layers, 0).
    """
    from pyspark.sql import Window

    kept = layers.where("label >= 0")
    child = kept.select(F.col("layer").alias("child_layer"), F.col("label").alias("child_cluster"), "id")
    parent = kept.select(F.col("layer").alias("parent_layer"), F.col("label").alias("parent_cluster"), "id")
    common = child.join(parent, "id").where("parent_layer > child_layer").groupBy("child_layer", "child_cluster", "parent_layer", "parent_cluster").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("child_layer", "child_cluster").orderBy("parent_layer", F.desc("n"), "parent_cluster")
    first = common.select("*", F.row_number().over(w).alias("r")).where("r = 1")
    every = child.select("child_layer", "child_cluster").distinct()
    top = layers.agg((F.max("layer") + 1).alias("top"))
    found = every.join(first, ["child_layer", "child_cluster"], "left").join(F.broadcast(top))  # one row
    return found.select(F.coalesce("parent_layer", "top").cast("int").alias("parent_layer"), F.coalesce("parent_cluster", F.lit(0)).cast("int").alias("parent_cluster"), F.col("child_layer").cast("int").alias("child_layer"), F.col("child_cluster").cast("int").alias("child_cluster"))
