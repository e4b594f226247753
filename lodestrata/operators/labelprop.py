"""Label propagation and coarsening on edge tables (src, dst, weight), by joins and group-bys.

Randomness is a hash of (seed, id), so results do not depend on how rows are dealt.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from lodestrata.operators.store import stored

UNLABELLED = -1


def seeds(nodes: DataFrame, parts: int, seed: int = 42) -> DataFrame:
    """(id, label): each of ``parts`` draws gives its number to a node by hash; a later draw wins, others stay -1.

    A node draws by the rank of its hash among all nodes; with fewer nodes than parts each gets its own label.
    """
    picked = nodes.select("id").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(parts)
    number = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "id"), "id")) - 1  # over at most `parts` rows
    return nodes.select("id").join(picked.select("id", number.cast("long").alias("l")), "id", "left").select("id", F.coalesce("l", F.lit(UNLABELLED)).cast("long").alias("label"))


def sweep(edges: DataFrame, labels: DataFrame, revote: bool = False, seed: int = 42) -> DataFrame:
    """One synchronous sweep: an unlabelled node takes the label of most neighbour weight, if that is 1 or more; ties
    go to the least label. With ``revote`` a labelled node, too, takes a label of more weight than 1, ties by hash."""
    known = labels.where(F.col("label") >= 0).select(F.col("id").alias("dst"), F.col("label").alias("vote"))
    votes = edges.join(known, "dst").groupBy("src", "vote").agg(F.round(F.sum("weight"), 9).alias("w")).where("w >= 1")
    tie = F.xxhash64(F.lit(seed), "src", "vote") if revote else F.col("vote")
    won = votes.groupBy(F.col("src").alias("id")).agg(F.min_by(F.struct("vote", "w"), F.struct((-F.col("w")).alias("w"), tie.alias("tie"), "vote")).alias("best"))
    stays = F.col("label") >= 0
    if revote:
        stays = stays & ~F.coalesce(F.col("best.w") > 1, F.lit(False))
    return labels.join(won, "id", "left").select("id", F.when(stays, F.col("label")).otherwise(F.coalesce("best.vote", "label")).alias("label"))


def swept(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, label: np.ndarray) -> np.ndarray:
    """``sweep`` on arrays: ends as places in ``label``."""
    use = (label[dst] >= 0) & (label[src] < 0)
    if not use.any():
        return label
    width = int(label.max()) + 1
    key, inverse = np.unique(src[use] * width + label[dst[use]], return_inverse=True)
    w = np.round(np.bincount(inverse, weight[use]), 9)
    key, w = key[w >= 1], w[w >= 1]
    node, vote = key // width, key % width
    order = np.lexsort((vote, -w, node))
    first = order[np.flatnonzero(np.append(True, node[order][1:] != node[order][:-1]))] if len(order) else order
    out = label.copy()
    out[node[first]] = vote[first]
    return out


def outliers(edges: DataFrame, labels: DataFrame, parts: int, rounds: int = 64, seed: int = 42) -> DataFrame:
    """Nodes still unlabelled take the least label among those nearest by hops; beyond ``rounds`` hops one by hash."""
    waiting = None
    for _ in range(rounds):
        known = labels.where(F.col("label") >= 0).select(F.col("id").alias("dst"), F.col("label").alias("vote"))
        near = edges.join(known, "dst").groupBy(F.col("src").alias("id")).agg(F.min("vote").alias("vote"))
        labels = stored(labels.join(near, "id", "left").select("id", F.when(F.col("label") >= 0, F.col("label")).otherwise(F.coalesce("vote", "label")).alias("label")))
        left = labels.where(F.col("label") < 0).count()
        if left in (0, waiting):  # a round that reaches nobody repeats itself
            break
        waiting = left
    return labels.select("id", F.when(F.col("label") >= 0, F.col("label")).otherwise(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(parts))).alias("label"))


def partitions(edges: DataFrame, nodes: DataFrame, parts: int, sweeps: int = 20, seed: int = 42, revote: bool = False) -> DataFrame:
    """(id, part) with parts numbered from 0 without gaps. With ``revote`` nodes change sides and a quarter more seeds
    are drawn."""
    labels = seeds(nodes, parts * 5 // 4 if revote else parts, seed)
    waiting = None
    for turn in range(sweeps):
        labels = stored(sweep(edges, labels, revote, seed + turn))
        left = labels.where(F.col("label") < 0).count()
        if not revote and left in (0, waiting):  # a sweep that labels nothing repeats itself
            break
        waiting = left
    labels = outliers(edges, labels, parts, seed=seed)
    # distinct labels are at most `parts`
    dense = labels.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("part"))
    return labels.join(dense, "label").select("id", "part")


def centroids(df: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, vec): the mean vector of each part of (id, vec)."""
    mean = df.join(parts, "id").select("part", F.posexplode("vec").alias("i", "x")).groupBy("part", "i").agg(F.avg("x").alias("m"))
    return mean.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vec"))


def coarse(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(src, dst, weight) between parts: summed weights over the root of the source part's size, cut to [0, 1]."""
    a, b = parts.select(F.col("id").alias("src"), F.col("part").alias("pa")), parts.select(F.col("id").alias("dst"), F.col("part").alias("pb"))
    size = parts.groupBy(F.col("part").alias("pa")).agg(F.count(F.lit(1)).alias("n"))
    w = edges.join(a, "src").join(b, "dst").groupBy("pa", "pb").agg(F.sum("weight").alias("w")).join(size, "pa")
    return w.select(F.col("pa").alias("src"), F.col("pb").alias("dst"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("w") / F.sqrt("n"))).alias("weight"))


def expanded(edges: DataFrame, parts: DataFrame, layout: DataFrame) -> DataFrame:
    """(id, pos): half the part's place, half the mean of the neighbours' parts' places weighted by the product of both
    directions' weights over the root of the part's size."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("w2"))
    size = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    to = parts.join(size, "part").select(F.col("id").alias("dst"), F.col("part").alias("to"), "n")
    w = edges.join(back, ["src", "dst"]).join(to, "dst").groupBy("src", "to").agg(F.sum(F.col("weight") * F.col("w2") / F.sqrt("n")).alias("w"))
    share = w.join(w.groupBy("src").agg(F.sum("w").alias("all")), "src").select("src", "to", (F.col("w") / F.col("all")).alias("s"))
    place = layout.select(F.col("part").alias("to"), F.posexplode("pos").alias("i", "x"))
    mean = share.join(place, "to").groupBy(F.col("src").alias("id"), "i").agg(F.sum(F.col("s") * F.col("x")).alias("m"))
    own = parts.join(layout, "part").select("id", F.posexplode("pos").alias("i", "x"))
    both = own.join(mean, ["id", "i"], "left").select("id", "i", ((F.col("x") + F.coalesce("m", F.lit(0.0))) / 2).alias("p"))
    return both.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("pos"))
