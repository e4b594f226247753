"""Node embedding: attraction along sampled edges, repulsion from hashed others, epoch by epoch.

Graphs of up to LOCAL_EDGES edges and LOCAL_NODES nodes run all epochs in one task, CHUNK edges at a time. In larger ones an epoch joins the places
of both ends to its due edges and of hashed others to their repulsions, sums moves by node and writes the next places:
nothing is broadcast or collected, whatever the number of nodes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lodestrata.operators.store import forget, stored

#: Edges and nodes up to which one task runs all epochs, and edges that it moves at a time. It holds 24 bytes an edge.
LOCAL_EDGES, LOCAL_NODES, CHUNK = 20_000_000, 1_000_000, 500_000
#: Intervals of an edge between its repulsions.
REPULSION = 1.5


def unit_noise(ids: np.ndarray, salt: int, width: int) -> np.ndarray:
    """Hash-seeded numbers in [0, 1) by id: (len(ids), width)."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(width, dtype=np.uint64)[None] + np.uint64(salt) * np.uint64(65537)) * np.uint64(0xD1342543DE82EF95)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def moves(a: np.ndarray, b: np.ndarray, noise_level: float) -> np.ndarray:
    """Attraction of places a towards b."""
    d2 = ((a - b) ** 2).sum(axis=1)
    d = np.sqrt(d2)
    coef = np.where(d2 > 0, (-2 * noise_level * d - 2) / (2 * d2 - 0.5 * d + 1), 0.0)
    return coef[:, None] * (a - b)


def pushes(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """Repulsion of places a from b, for places more than 0.1 apart."""
    d2 = ((a - b) ** 2).sum(axis=1)
    coef = np.where(d2 > 0.01, gamma * 4 / ((1 + 0.25 * d2) * np.maximum(d2, 1e-12)), 0.0)
    return np.clip(coef[:, None] * (a - b), -4, 4)


def pushed(epoch: np.ndarray | int, every: np.ndarray) -> np.ndarray:
    """Repulsions an edge has had by an epoch: one for each 1.5 intervals after the first."""
    return np.maximum(np.floor(epoch / (REPULSION * every)) - 1, 0)


def epoch_moves(ids: np.ndarray, pos: np.ndarray, src: np.ndarray, dst: np.ndarray, every: np.ndarray, epoch: int, gamma: float, noise_level: float, seed: int) -> np.ndarray:
    """Summed moves of all nodes by the edges due in an epoch (src and dst are places in ids)."""
    total = np.zeros_like(pos)
    for lo in range(0, len(src), CHUNK):
        own = slice(lo, lo + CHUNK)
        nth = np.floor(epoch / every[own])
        due = np.flatnonzero(nth > np.floor((epoch - 1) / every[own]))
        if not len(due):
            continue
        a, b, e, nth = src[own][due], dst[own][due], every[own][due], nth[due]
        step = moves(pos[a], pos[b], noise_level)
        times = pushed(epoch, e) - np.where(nth > 1, pushed(np.ceil((nth - 1) * e), e), 0)
        key = ids[a] * np.int64(1_000_003) + ids[b]
        draws = unit_noise(key, seed + epoch + 1, int(times.max()))
        for k in range(draws.shape[1]):
            at = np.flatnonzero(times > k)
            step[at] += pushes(pos[a[at]], pos[(draws[at, k] * len(ids)).astype(np.int64)], gamma)
        for k in range(pos.shape[1]):
            total[:, k] += np.bincount(a, step[:, k], len(ids))
    return total


def advance(pos: np.ndarray, momentum: np.ndarray, delta: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions after an epoch, and the part of its moves that the next epoch repeats."""
    step = momentum + rate * np.round(delta, 9)  # the order of sums must not show
    return pos + step, step * ((1 - rate) ** 2 * 0.5)


def schedule(epochs: int, alpha: float) -> tuple[list[float], list[float]]:
    """Strength of repulsion and rate of moves by epoch."""
    return [0.5 + e / max(1, epochs - 1) for e in range(epochs)], [alpha * (1 - max(e - 1, 0) / epochs) for e in range(epochs)]


def local_embed(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, ids: np.ndarray, pos: np.ndarray, epochs: int, alpha: float, noise_level: float, seed: int) -> np.ndarray:
    """All epochs on arrays; ends are places in ``ids``, edges in the order of their ends."""
    if not len(src):
        return pos
    every = 1 / np.maximum(weight / weight.max(), 1.0 / epochs)
    gammas, rates = schedule(epochs, alpha)
    momentum = np.zeros_like(pos)
    for e in range(epochs):
        pos, momentum = advance(pos, momentum, epoch_moves(ids, pos, src, dst, every, e, gammas[e], noise_level, seed), rates[e])
    return pos


def embed(edges: DataFrame, nodes: DataFrame, dims: int, epochs: int = 50, start: DataFrame | None = None, alpha: float = 0.5, noise_level: float = 0.5, seed: int = 42) -> DataFrame:
    """(id, pos). ``start`` gives first places (id, pos); without it they are noise of a quarter."""
    rows = nodes.count()
    edges = stored(edges.select("src", "dst", "weight"))
    if start is None:
        begin = nodes.select("id", F.lit(None).cast("array<double>").alias("pos"))
    else:
        begin = nodes.select("id").join(start.select("id", "pos"), "id", "left")

    def placed(t):
        ids = t.column("id").to_numpy()
        pos = (unit_noise(ids, seed, dims) - 0.5) * 0.5
        have = np.flatnonzero(np.array(t.column("pos").is_valid()))
        if len(have):
            pos[have] = np.array(t.column("pos").take(have).to_pylist(), float).reshape(len(have), dims)
        return ids, pos

    if edges.count() <= LOCAL_EDGES and rows <= LOCAL_NODES:
        return local_layout(edges, begin, placed, epochs, alpha, noise_level, seed)
    return joined_layout(edges, begin, placed, dims, epochs, alpha, noise_level, seed)


def local_layout(edges: DataFrame, begin: DataFrame, placed, epochs: int, alpha: float, noise_level: float, seed: int) -> DataFrame:
    def whole(e, v):
        import pyarrow as pa

        ids, pos = placed(v)
        order = np.argsort(ids)
        ids, pos = ids[order], pos[order]
        src, dst = (np.searchsorted(ids, e.column(c).to_numpy()) for c in ("src", "dst"))
        order = np.argsort(src * len(ids) + dst)
        src, dst, weight = src[order].astype(np.int32), dst[order].astype(np.int32), e.column("weight").to_numpy()[order]
        del e, v, order
        pos = local_embed(src, dst, weight, ids, pos, epochs, alpha, noise_level, seed)
        return pa.table({"id": ids, "pos": pa.array(list(pos), pa.list_(pa.float64()))})

    e, v = stored(edges.withColumn("one", F.lit(0))), stored(begin.withColumn("all", F.lit(0)))
    return e.groupBy("one").cogroup(v.groupBy("all")).applyInArrow(whole, "id long, pos array<double>")


def numbered(begin: DataFrame) -> tuple[DataFrame, int]:
    """(place, id, pos) with places from 0 by id, and their number: counts by range of ids, then rows in each range."""
    ranged = stored(begin.repartitionByRange("id").withColumn("range", F.spark_partition_id()))
    counts = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before, total = [], 0
    for k, n in counts:
        before.append((k, total))
        total += n
    offsets = F.broadcast(ranged.sparkSession.createDataFrame(before, "range int, before long"))
    from pyspark.sql import Window

    inner = F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1
    return ranged.withColumn("inner", inner).join(offsets, "range").select((F.col("before") + F.col("inner")).alias("place"), "id", "pos"), total


def joined_layout(edges: DataFrame, begin: DataFrame, placed, dims: int, epochs: int, alpha: float, noise_level: float, seed: int) -> DataFrame:
    import pyarrow as pa

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                _, pos = placed(t)
                yield pa.RecordBatch.from_arrays([t.column("place").combine_chunks(), t.column("id").combine_chunks(), pa.array(list(pos), pa.list_(pa.float64()))], names=["place", "id", "pos"])

    table, n = numbered(begin)
    state = stored(table.mapInArrow(first, "place long, id long, pos array<double>").withColumn("momentum", F.array(*[F.lit(0.0)] * dims)))
    top = edges.agg(F.max("weight")).first()[0]
    if top is None:
        return state.select("id", "pos")
    number = state.select("place", "id")
    # merged: tables of nodes under the limit of broadcasts would go through the driver in every epoch
    ends = edges.join(number.select(F.col("id").alias("src"), F.col("place").alias("a")).hint("merge"), "src").join(number.select(F.col("id").alias("dst"), F.col("place").alias("b")).hint("merge"), "dst")
    ends = stored(ends.select("src", "dst", "a", "b", (1 / F.greatest(F.col("weight") / top, F.lit(1.0 / epochs))).alias("every")))
    gammas, rates = schedule(epochs, alpha)
    for epoch in range(epochs):
        rate = rates[epoch]

        def due(batches, epoch=epoch):
            """The due edges, and a row for each of their repulsions with the place of the other node."""
            for batch in batches:
                src, dst, a, b, every = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
                nth = np.floor(epoch / every)
                at = np.flatnonzero(nth > np.floor((epoch - 1) / every))
                if not len(at):
                    continue
                every, nth = every[at], nth[at]
                times = pushed(epoch, every) - np.where(nth > 1, pushed(np.ceil((nth - 1) * every), every), 0)
                draws = unit_noise(src[at] * np.int64(1_000_003) + dst[at], seed + epoch + 1, int(times.max()))
                who, to, kind = [a[at]], [b[at]], [np.zeros(len(at), np.int32)]
                for k in range(draws.shape[1]):
                    some = np.flatnonzero(times > k)
                    who.append(a[at[some]])
                    to.append((draws[some, k] * n).astype(np.int64))
                    kind.append(np.ones(len(some), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (who, to, kind)], names=["a", "b", "push"])

        def moved(batches, epoch=epoch):
            for batch in batches:
                if batch.num_rows:
                    p, q = (np.array(batch.column(i).to_pylist(), float) for i in (2, 3))
                    push = batch.column(1).to_numpy(zero_copy_only=False) > 0
                    step = np.where(push[:, None], pushes(p, q, gammas[epoch]), moves(p, q, noise_level))
                    yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(step[:, k].copy()) for k in range(dims)]], names=["place", *[f"d{k}" for k in range(dims)]])

        pos = state.select("place", "pos")
        pairs = ends.mapInArrow(due, "a long, b long, push int")
        pairs = pairs.join(pos.select(F.col("place").alias("b"), F.col("pos").alias("q")).hint("merge"), "b").join(pos.select(F.col("place").alias("a"), F.col("pos").alias("p")).hint("merge"), "a")
        steps = pairs.select("a", "push", "p", "q").mapInArrow(moved, "place long, " + ", ".join(f"d{k} double" for k in range(dims)))
        sums = steps.groupBy("place").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(dims)])
        delta = F.array(*[F.coalesce(F.round(f"d{k}", 9), F.lit(0.0)) for k in range(dims)])
        step = F.zip_with("momentum", delta, lambda m, d: m + rate * d)
        then = state.join(sums.hint("merge"), "place", "left").withColumn("step", step)
        then = stored(then.select("place", "id", F.zip_with("pos", "step", lambda x, s: x + s).alias("pos"), F.transform("step", lambda s: s * ((1 - rate) ** 2 * 0.5)).alias("momentum")))
        if epoch:
            forget(state)  # the first is read for its numbers
        state = then
    return state.select("id", "pos")
