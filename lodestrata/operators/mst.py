"""Minimum spanning trees on mutual-reachability distance, by rounds that merge components.

Up to LOCAL_ROWS rows (counted first) one task grows the tree from dense distances. Beyond that rows lie in space-partitioned
blocks. Core distances: each row's nearest rows of its own block bound its distance, and it asks only blocks whose box is
nearer. Rounds: each component's least edge within blocks (or, where a block holds one component only, the farthest corner
of another box) bounds its weight, and a row asks only blocks that hold another component and whose box is not beyond the
bound, if its own core distance is not. The least edge of each component under the order (weight, low id, high id) joins
the tree, and components are contracted. Rounds are at most log2(rows).

Boxes rule nothing out beyond a few dimensions. There (BOXED_DIMS) core distances and lists of LISTED neighbours come from the
exact search of all pairs. A component whose least listed edge is nearer than the end of each of its rows' lists takes it; if
fewer than half can, the rows whose lists end too soon, but those of the largest component, are compared with all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestrata.operators import knn, spatial
from lodestrata.operators.store import forget, stored


#: Rows up to which one task builds the tree; its memory is a few arrays of this length beside the vectors.
LOCAL_ROWS = 16_384
#: Dimensions up to which rows lie in blocks with boxes, and neighbours listed beyond.
BOXED_DIMS, LISTED = 10, 16


def nearest(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The k least distances of each row of a from rows of b, ascending; infinite where there are fewer."""
    out = np.full((len(a), k), np.inf)
    for lo in range(0, len(a), 1024):
        d = -knn.similarity(a[lo : lo + 1024], b, "euclid")
        m = min(k, d.shape[1])
        out[lo : lo + 1024, :m] = np.sort(np.partition(d, m - 1, axis=1)[:, :m], axis=1) if m else d
    return out


def dims_of(df: DataFrame) -> int:
    return (df.select(F.size("vec").alias("d")).first() or {"d": 1})["d"]


def core_distances(df: DataFrame, min_samples: int = 5, block: int = spatial.BLOCK) -> DataFrame:
    """id, core: Euclidean distance to the min_samples-th other row (of all rows, if fewer); 0 for min_samples <= 1."""
    if min_samples <= 1:
        return df.select("id", F.lit(0.0).alias("core"))
    rows = df.count()
    if not rows:
        return df.select("id", F.lit(0.0).alias("core"))
    k = min(min_samples + 1, rows)  # a row is its own nearest
    if dims_of(df) > BOXED_DIMS:
        return knn.exact(df, k, "euclid", rows).groupBy(F.col("src").alias("id")).agg(F.max(-F.col("raw")).alias("core"))
    table = spatial.blocked(df.select("id", "vec"), rows, block)
    boxes = spatial.boxes_of(table)
    shared = df.sparkSession.sparkContext.broadcast(boxes)

    def within(t: pa.Table) -> pa.Table:
        b, x, own = shared.value, knn.matrix(t, "euclid"), t.column("block")[0].as_py()
        near = nearest(x, x, k)
        far = near[:, -1]
        place = int(np.searchsorted(b.ids, own))
        others = np.flatnonzero((b.apart(place) < far.max()) & (b.ids != own))
        targets = [[]] * len(x)
        for lo in range(0, len(x), 256):
            reach = b.least(x[lo : lo + 256], others) < far[lo : lo + 256, None]
            targets[lo : lo + 256] = [b.ids[others[r]].tolist() for r in reach]
        return pa.table({"id": t.column("id"), "vec": t.column("vec"), "near": pa.array(list(near), pa.list_(pa.float64())), "targets": pa.array(targets, pa.list_(pa.int64()))})

    local = stored(table.groupBy("block").applyInArrow(within, "id long, vec array<double>, near array<double>, targets array<long>"))

    def beyond(ask: pa.Table, held: pa.Table) -> pa.Table:
        if not ask.num_rows or not held.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.float64()))})
        near = nearest(knn.matrix(ask, "euclid"), knn.matrix(held, "euclid"), k)
        return pa.table({"id": ask.column("id"), "near": pa.array(list(near), pa.list_(pa.float64()))})

    asking = local.where(F.size("targets") > 0).select("id", "vec", F.explode("targets").alias("target"))
    more = spatial.meet(asking, table, beyond, "id long, near array<double>")
    each = local.select("id", "near").unionByName(more)
    # a row asks the few blocks around it, so its lists are few
    return each.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near")))[k - 1].alias("core"))


def best_edges(ids: np.ndarray, comp: np.ndarray, weight: np.ndarray, to: np.ndarray) -> pa.Table:
    """The least edge of each component, of one candidate a row, by (weight, low id, high id)."""
    keep = np.isfinite(weight)
    ids, comp, weight, to = ids[keep], comp[keep], weight[keep], to[keep]
    lo, hi = np.minimum(ids, to), np.maximum(ids, to)
    order = np.lexsort((hi, lo, weight, comp))
    first = order[np.flatnonzero(np.append(True, comp[order][1:] != comp[order][:-1]))] if len(order) else order
    return pa.table({"comp": comp[first], "weight": weight[first], "lo": lo[first], "hi": hi[first]})


def foreign(ids: np.ndarray, x: np.ndarray, core: np.ndarray, comp: np.ndarray, other: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Weight and end of each row's least edge to a row of another component, ties by (low id, high id)."""
    oid, ox, ocore, ocomp = other
    weight, to = np.full(len(ids), np.inf), np.full(len(ids), -1, np.int64)
    for lo in range(0, len(ids), 1024):
        s = slice(lo, lo + 1024)
        d = np.maximum(np.maximum(-knn.similarity(x[s], ox, "euclid"), core[s][:, None]), ocore[None])
        d[comp[s][:, None] == ocomp[None]] = np.inf
        weight[s] = d.min(axis=1, initial=np.inf)
        tied = (d == weight[s][:, None]) & np.isfinite(d)
        for i in np.flatnonzero(tied.any(axis=1)).tolist():
            own, ends = ids[lo + i], oid[tied[i]]
            to[lo + i] = ends[np.lexsort((np.maximum(ends, own), np.minimum(ends, own)))[0]] if len(ends) > 1 else ends[0]
    return weight, to


def columns_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return t.column("id").to_numpy(), knn.matrix(t, "euclid"), t.column("core").to_numpy(), t.column("comp").to_numpy()


def candidate_edges(state: DataFrame, boxes: spatial.Boxes) -> DataFrame:
    """(comp, weight, lo, hi): the least edge of every component of (id, vec, core, comp, block) to another one."""
    spark = state.sparkSession
    pure = state.groupBy("block").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a = b").collect()  # a row a block at most
    only = np.full(len(boxes.ids), -1, np.int64)  # the component of a block that has one
    for r in pure:
        only[np.searchsorted(boxes.ids, r["block"])] = r["a"]
    shared = spark.sparkContext.broadcast((boxes, only))
    schema = "comp long, weight double, lo long, hi long"

    def within(t: pa.Table) -> pa.Table:
        """Least edges inside a block; a block of one component gives a bound without an edge instead."""
        b, pure = shared.value
        ids, x, core, comp = columns_of(t)
        place = int(np.searchsorted(b.ids, t.column("block")[0].as_py()))
        if pure[place] < 0:
            return best_edges(ids, comp, *foreign(ids, x, core, comp, (ids, x, core, comp)))
        others = np.flatnonzero(pure != pure[place])
        bound = np.inf
        if len(others):
            near = others[np.argsort(b.apart(place)[others], kind="stable")[:64]]  # any box gives a bound; the nearest give good ones
            for lo in range(0, len(x), 1024):
                most = np.maximum(np.maximum(b.most(x[lo : lo + 1024], near), core[lo : lo + 1024, None]), b.core[near][None])
                bound = min(bound, float(most.min()))
        return pa.table({"comp": pa.array([comp[0]], pa.int64()), "weight": pa.array([bound], pa.float64()), "lo": pa.array([None], pa.int64()), "hi": pa.array([None], pa.int64())})

    local = stored(state.groupBy("block").applyInArrow(within, schema))
    bounds = local.groupBy("comp").agg(F.min("weight").alias("bound"))

    def asks(t: pa.Table) -> pa.Table:
        b, pure = shared.value
        ids, x, core, comp = columns_of(t)
        bound, own = t.column("bound").to_numpy(), t.column("block")[0].as_py()
        able = np.flatnonzero(core <= bound)
        targets: list = [[]] * len(ids)
        if len(able):
            reach = bound[able].max()
            others = np.flatnonzero((b.apart(int(np.searchsorted(b.ids, own))) <= reach) & (b.ids != own))
            for lo in range(0, len(able), 256):
                at = able[lo : lo + 256]
                hit = (b.least(x[at], others) <= bound[at][:, None]) & (pure[others][None] != comp[at][:, None])
                for i, row in zip(at.tolist(), hit, strict=True):
                    targets[i] = b.ids[others[row]].tolist()
        return pa.table({"id": t.column("id"), "vec": t.column("vec"), "core": t.column("core"), "comp": t.column("comp"), "targets": pa.array(targets, pa.list_(pa.int64()))})

    bounded = state.join(bounds, "comp")
    asking = bounded.groupBy("block").applyInArrow(asks, "id long, vec array<double>, core double, comp long, targets array<long>")
    asking = asking.select("id", "vec", "core", "comp", F.explode("targets").alias("target"))

    def beyond(ask: pa.Table, held: pa.Table) -> pa.Table:
        if not ask.num_rows or not held.num_rows:
            return pa.table({"comp": pa.array([], pa.int64()), "weight": pa.array([], pa.float64()), "lo": pa.array([], pa.int64()), "hi": pa.array([], pa.int64())})
        mine = columns_of(ask)
        return best_edges(mine[0], mine[3], *foreign(*mine, columns_of(held)))

    more = spatial.meet(asking, state, beyond, schema)
    every = local.where("lo is not null").unionByName(more)
    return every.groupBy("comp").agg(F.min(F.struct("weight", "lo", "hi")).alias("e")).select("comp", "e.*")


def least_labels(edges: DataFrame, nodes: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(node, label): the least node of each component of (a, b) over ``nodes`` (column node)."""
    nodes = stored(nodes.select("node"))
    if nodes.count() <= local_rows:
        both = stored(edges.select("a", "b").union(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))))

        def run(batches):
            t = pa.Table.from_batches(list(batches), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
            a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
            ids = np.unique(a[a == b])
            label = np.arange(len(ids))
            a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
            while True:
                low = np.minimum(label[a], label[b])
                then = label.copy()
                np.minimum.at(then, label[a], low)
                np.minimum.at(then, label[b], low)
                then = then[then]
                if (then == label).all():
                    break
                label = then
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["node", "label"])

        return both.coalesce(1).mapInArrow(run, "node long, label long")
    # Each component takes its first edge in the order of a hash, so that components at least halve in a round.
    place = stored(nodes.select("node", F.col("node").alias("comp")))
    ends = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not ends.isEmpty():
        order = F.struct(F.xxhash64("a", "b").alias("h"), "a", "b").alias("o")
        picks = ends.select(F.col("a").alias("comp"), F.col("b").alias("to"), order).union(ends.select("b", "a", order))
        picks = stored(picks.groupBy("comp").agg(F.min_by("to", "o").alias("to")))
        back = picks.select(F.col("comp").alias("to"), F.col("to").alias("again"))
        first = (F.col("again") == F.col("comp")) & (F.col("comp") < F.col("to"))  # of two that take the same edge
        up = picks.join(back, "to").select("comp", F.when(first, F.col("comp")).otherwise(F.col("to")).alias("to"))
        up = stored(up)
        far = stored(up.join(up.select(F.col("comp").alias("to"), F.col("to").alias("then")), "to").select("comp", F.col("then").alias("to")))
        top = stored(far.join(far.select(F.col("comp").alias("to"), F.col("to").alias("then")), "to").select("comp", F.col("then").alias("to")))
        # a component four steps below its root at most is named by the root; edges keep what is deeper together
        moved = stored(place.join(top, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
        a, b = (top.select(F.col("comp").alias(c), F.col("to").alias(f"{c}2")) for c in "ab")
        then = ends.join(a, "a").join(b, "b").where("a2 <> b2")
        then = stored(then.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        forget(picks, up, far, top, place, ends)
        place, ends = moved, then
    least = place.groupBy("comp").agg(F.min("node").alias("label"))
    labels = stored(place.join(least, "comp").select("node", "label"))
    forget(place, ends)
    return labels


def grown(ids: np.ndarray, x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's tree on mutual-reachability distance, one row of distances at a time."""
    n = len(ids)
    far, via = np.full(n, np.inf), np.zeros(n, np.int64)
    out = np.empty((n - 1, 2), np.int64), np.empty(n - 1)
    here, todo = 0, np.ones(n, bool)
    for k in range(n - 1):
        todo[here] = False
        d = np.maximum(np.maximum(np.sqrt(((x - x[here]) ** 2).sum(axis=1)), core), core[here])
        near = todo & (d < far)
        far[near], via[near] = d[near], here
        here_next = int(np.where(todo, far, np.inf).argmin())
        out[0][k], out[1][k] = (ids[via[here_next]], ids[here_next]), far[here_next]
        here = here_next
    return out[0].min(axis=1), out[0].max(axis=1), out[1]


def local_tree(rows: DataFrame) -> DataFrame:
    def run(batches):
        got = pa.Table.from_batches(list(batches))
        ids, core = (np.array(got.column(c).to_pylist(), t) for c, t in (("id", np.int64), ("core", float)))
        order = np.argsort(ids)
        x = knn.matrix(got, "euclid")[order]
        lo, hi, w = grown(ids[order], x, core[order])
        yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.array(w)], names=["src", "dst", "weight"])

    return stored(rows).coalesce(1).mapInArrow(run, "src long, dst long, weight double")


def spanning_tree(df: DataFrame, min_samples: int = 5, block: int = spatial.BLOCK, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(src, dst, weight) of the tree over (id, vec): rows - 1 edges."""
    rows = df.count()
    empty = df.sparkSession.createDataFrame([], "src long, dst long, weight double")
    if rows < 2:
        return empty
    if rows > local_rows and dims_of(df) > BOXED_DIMS:
        return tree_by_lists(df, min_samples, rows, local_rows)
    with_core = df.join(core_distances(df, min_samples, block), "id").select("id", "vec", "core")
    if rows <= local_rows:
        return local_tree(with_core)
    base = spatial.blocked(with_core, rows, block)
    boxes = spatial.boxes_of(base)
    place, tree, parts = stored(base.select("id", F.col("id").alias("comp"))), [], rows
    while parts > 1:
        state = stored(base.join(place, "id"))
        best = stored(candidate_edges(state, boxes))
        new = stored(best.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight").distinct())
        tree.append(new)
        ends = new.join(place.select(F.col("id").alias("src"), F.col("comp").alias("a")), "src").join(place.select(F.col("id").alias("dst"), F.col("comp").alias("b")), "dst").select("a", "b")
        labels = least_labels(ends, place.select(F.col("comp").alias("node")).distinct(), local_rows)
        then = stored(place.join(labels, F.col("comp") == F.col("node")).select("id", F.col("label").alias("comp")))
        left = then.select("comp").distinct().count()
        if left >= parts:
            raise RuntimeError("a round added no edge")
        forget(state, best, place)
        place, parts = then, left
    out = empty
    for new in tree:  # as many as rounds
        out = out.unionByName(new)
    return out


def least_foreign(ids: np.ndarray, x: np.ndarray, core: np.ndarray, comp: np.ndarray, bound: np.ndarray, other: tuple) -> pa.Table:
    """(comp, weight, lo, hi, far): the least edge of each component of rows to rows of others, if not above its bound, by
    (weight, low id, high id); weights are those of the pair of rows alone."""
    oid, ox, ocore, ocomp = other
    off = 1e-12 * max(1.0, float((x * x).sum(axis=1).max(initial=0)), float((ox * ox).sum(axis=1).max(initial=0)))
    found = []
    for lo in range(0, len(ids), knn.TILE[0]):
        s = slice(lo, lo + knn.TILE[0])
        best = bound[s].copy()
        for at in range(0, len(oid), knn.TILE[1]):
            t = slice(at, at + knn.TILE[1])
            d = knn.similarity(x[s], ox[t], "euclid")
            w = np.maximum(np.maximum(np.sqrt(np.maximum(d * d - off, 0)), core[s][:, None]), ocore[t][None])  # never above
            w[comp[s][:, None] == ocomp[t][None]] = np.inf

            def true(i, j, s=s, t=t):
                return np.maximum(np.maximum(-knn.alone(x[s][i], ox[t][j], "euclid"), core[s][i]), ocore[t][j])

            i, j = np.arange(len(w)), w.argmin(axis=1)
            some = np.isfinite(w[i, j]) & (w[i, j] <= best)
            best[some] = np.minimum(best[some], true(i[some], j[some]))
            i, j = np.nonzero((w <= best[:, None]) & some[:, None] & np.isfinite(w))
            for z in range(0, len(i), 65536):
                a, b = i[z : z + 65536], j[z : z + 65536]
                v = true(a, b)
                own, end = ids[s][a], oid[t][b]
                lows, highs = np.minimum(own, end), np.maximum(own, end)
                order = np.lexsort((highs, lows, v, comp[s][a]))
                first = order[np.flatnonzero(np.append(True, comp[s][a][order][1:] != comp[s][a][order][:-1]))]
                found.append((comp[s][a][first], v[first], lows[first], highs[first], ocomp[t][b][first]))
    c, v, lows, highs, far = (np.concatenate(z) for z in zip(*found, strict=True)) if found else [np.zeros(0, np.int64), np.zeros(0), *[np.zeros(0, np.int64)] * 3]
    order = np.lexsort((highs, lows, v, c))
    first = order[np.flatnonzero(np.append(True, c[order][1:] != c[order][:-1]))] if len(order) else order
    return pa.table({"comp": c[first], "weight": v[first], "lo": lows[first], "hi": highs[first], "far": far[first]})


def searched(asks: DataFrame, held: DataFrame, asking: int, rows: int, dims: int) -> DataFrame:
    """``least_foreign`` of rows (id, vec, core, comp, bound) against all rows: every block of theirs meets every block."""
    qs, ds = knn.sides(asking, dims), knn.sides(rows, dims)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asks.select("id", "vec", "core", "comp", "bound", block(qs).alias("a"), every(ds).alias("b"))
    d = held.select("id", "vec", "core", "comp", every(qs).alias("a"), block(ds).alias("b"))

    def run(ask: pa.Table, own: pa.Table) -> pa.Table:
        if not ask.num_rows or not own.num_rows:
            return least_foreign(*[np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)], (np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64)))
        return least_foreign(*columns_of(ask), ask.column("bound").to_numpy(), columns_of(own))

    return q.groupBy("a", "b").cogroup(d.groupBy("a", "b")).applyInArrow(run, "comp long, weight double, lo long, hi long, far long")


def tree_by_lists(df: DataFrame, min_samples: int, rows: int, local_rows: int) -> DataFrame:
    """The tree of (id, vec) from exact neighbour lists, and comparisons of all that lists leave open. Of equal vectors the
    least id stands for all; each other one hangs on it by its core distance, the least weight it can have."""
    dims = dims_of(df)
    heads = stored(df.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"))
    n = heads.count()
    k = min(max(min_samples + 1, LISTED), n)
    lists = stored(knn.exact(heads, k, "euclid", n))
    if min_samples <= 1:
        core = heads.select("id", F.lit(0.0).alias("core"))
    elif n == rows:
        core = lists.where(F.col("rank") == min(min_samples, n - 1)).select(F.col("src").alias("id"), (-F.col("raw")).alias("core"))
    else:
        core = core_distances(df, min_samples)
    core = stored(core)
    tree = []
    if n < rows:
        copies = df.join(heads.select(F.col("id").alias("head"), "vec"), "vec").where("id <> head").join(core, "id")
        tree.append(stored(copies.select(F.col("head").alias("src"), F.col("id").alias("dst"), F.col("core").alias("weight"))))
    ends = lists.groupBy(F.col("src").alias("id")).agg(F.max(-F.col("raw")).alias("last"))
    ends = ends.withColumn("last", F.lit(float("inf"))) if k == n else ends
    table = stored(heads.join(core, "id").join(ends, "id").select("id", "vec", "core", F.greatest("last", "core").alias("end")))
    a, b = (core.select(F.col("id").alias(x), F.col("core").alias(f"c_{x}")) for x in ("src", "dst"))
    edges = lists.where("src <> dst").join(a, "src").join(b, "dst").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.greatest(-F.col("raw"), "c_src", "c_dst").alias("weight"))
    edges = stored(edges.distinct().select("lo", "hi", "weight", F.col("lo").alias("a"), F.col("hi").alias("b")))
    forget(lists)
    place, parts = stored(heads.select("id", F.col("id").alias("comp"))), n
    while parts > 1:
        edge = F.struct("weight", "lo", "hi", "far").alias("e")
        best = edges.select(F.col("a").alias("comp"), "weight", "lo", "hi", F.col("b").alias("far")).union(edges.select("b", "weight", "lo", "hi", "a"))
        best = stored(best.groupBy("comp").agg(F.min(edge).alias("e")))
        rest = table.select("id", "end").join(place, "id").join(best, "comp", "left")
        # a row whose list ends before its component's least listed edge may have a nearer one
        open_rows = rest.where(F.col("end") <= F.coalesce("e.weight", F.lit(float("inf")))).select("id", "comp", F.coalesce("e.weight", F.lit(float("inf"))).alias("bound"))
        open_rows = stored(open_rows)
        left = open_rows.select("comp").distinct()
        sure = best.join(left, "comp", "left_anti")
        if 2 * left.count() > parts:
            largest = place.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "comp").first()["comp"]
            asks = stored(open_rows.where(F.col("comp") != largest).join(table.select("id", "vec", "core"), "id"))
            more = searched(asks, table.join(place, "id"), asks.count(), n, dims)
            asked = asks.select("comp").distinct()
            more = more.select("comp", edge).union(best.join(asked, "comp", "left_semi").select("comp", "e"))
            sure = sure.union(more.groupBy("comp").agg(F.min("e").alias("e")))
        picks = stored(sure.select("comp", "e.*"))
        new = stored(picks.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight").distinct())
        tree.append(new)
        labels = stored(least_labels(picks.select(F.col("comp").alias("a"), F.col("far").alias("b")), place.select(F.col("comp").alias("node")).distinct(), local_rows))
        then = stored(place.join(labels, F.col("comp") == F.col("node")).select("id", F.col("label").alias("comp")))
        a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}2")) for x in "ab")
        fewer = stored(edges.join(a, "a").join(b, "b").where("a2 <> b2").select("lo", "hi", "weight", F.col("a2").alias("a"), F.col("b2").alias("b")))
        now = then.select("comp").distinct().count()
        if now >= parts:
            raise RuntimeError("a round added no edge")
        forget(best, open_rows, picks, place, edges, labels)
        place, edges, parts = then, fewer, now
    out = df.sparkSession.createDataFrame([], "src long, dst long, weight double")
    for new in tree:  # as many as rounds
        out = out.unionByName(new)
    return out


def cut_labels(tree: DataFrame, nodes: DataFrame, cut: float, min_size: int) -> DataFrame:
    """(id, label): components of edges with weight < cut and at least min_size nodes, numbered from 0 by least id;
    all others -1."""
    found = least_labels(tree.where(F.col("weight") < cut).select(F.col("src").alias("a"), F.col("dst").alias("b")), nodes.select(F.col("id").alias("node")))
    sizes = found.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    kept = sizes.where(F.col("n") >= min_size)
    # clusters are few against rows, and are numbered after their rows are counted
    number = kept.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("number"))
    return found.join(number, "label", "left").select(F.col("node").alias("id"), F.coalesce("number", F.lit(-1)).alias("label"))
