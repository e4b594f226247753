"""Nearest-neighbour graphs: (src, rank, dst, raw), rank 0 first; raw is a similarity, larger is nearer.

The exact search deals rows to blocks, SIDE of them (fewer of small tables, more only where a block would have over NUMBERS
numbers), so that what is shuffled grows with the rows while the comparisons grow with their square. A task compares two
blocks tile by tile, for both of them, keeping k a row; a second grouping keeps k of those. Memory is bounded by two blocks
and a tile, nothing is broadcast or collected. Values are those of a pair of rows alone, whatever their places in a matrix,
so that equal vectors tie, and ties go by id. The approximate search is in ``descent``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodestrata.functions import metrics

#: Rows of a block at least, blocks of larger tables, numbers of a block at most, and rows of a tile of the matrix.
BLOCK, SIDE, NUMBERS, TILE = 2048, 16, 8_000_000, (512, 8192)
METRICS = ("cosine", "int8", "bits", "euclid")


def prepared(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n)
    if metric == "bits":
        return np.unpackbits(x.astype(np.int64).view(np.uint8), axis=1).astype(np.float64)
    return x


def matrix(table: pa.Table, metric: str) -> np.ndarray:
    """The column vec as a matrix (words of bits need all 64 of theirs)."""
    flat = table.column("vec").combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64 if metric == "bits" else np.float64, copy=False).reshape(table.num_rows, -1)


def similarity(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Rows of a against rows of b (both prepared)."""
    common = a @ b.T
    if metric == "bits":
        either = a.sum(1)[:, None] + b.sum(1)[None] - common
        return np.where(either > 0, common / np.where(either > 0, either, 1), 0.0)
    if metric == "euclid":
        return -np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * common, 0))
    return common


def best(sim: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, ties by id; one cut by value first."""
    n = sim.shape[1]
    if n <= k:
        return np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)
    edge = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(sim), k), np.int64)
    for i in range(len(sim)):
        c = np.flatnonzero(sim[i] >= edge[i])
        out[i] = c[np.lexsort((ids[c], -sim[i, c]))[:k]]
    return out


def alone(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of each row of a to the same row of b (both prepared)."""
    common = (a * b).sum(axis=1)
    if metric == "bits":
        either = a.sum(1) + b.sum(1) - common
        return np.where(either > 0, common / np.where(either > 0, either, 1), 0.0)
    if metric == "euclid":
        return -np.sqrt(np.maximum((a * a).sum(axis=1) + (b * b).sum(axis=1) - 2 * common, 0))
    return common


def least_of_equals(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by id without those that k equal rows of lower ids come before in every list."""
    order = np.argsort(ids)
    ids, x = ids[order], np.ascontiguousarray(x[order] + 0.0)  # one zero
    _, group, count = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True, return_counts=True)
    if count.max(initial=0) <= k:
        return ids, x
    order = np.argsort(group, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
    return ids[place < k], x[place < k]


def nearest(ids: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, raw): the k nearest rows y of each row x (prepared), ties by id; for cosine and euclid not itself."""
    itself = metric not in ("cosine", "euclid")
    other, y = least_of_equals(other, y, k + 1)
    # matrix products of floats are off by their last digits; what is within that of the k-th is looked at alone
    off = 0.0 if itself else 1e-12 * (1.0 if metric == "cosine" else max(1.0, float((x * x).sum(axis=1).max(initial=0)), float((y * y).sum(axis=1).max(initial=0))))
    out = []
    for lo in range(0, len(ids), TILE[0]):
        own, q = ids[lo : lo + TILE[0]], x[lo : lo + TILE[0]]
        row, to, raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        edge = np.full(len(own), -np.inf)
        for at in range(0, len(other), TILE[1]):
            d = y[at : at + TILE[1]]
            sim = similarity(q, d, metric)
            if metric == "euclid":
                sim = -sim * sim
            if not itself:  # ids ascend
                place = np.minimum(np.searchsorted(other[at : at + TILE[1]], own), len(d) - 1)
                hit = np.flatnonzero(other[at + place] == own)
                sim[hit, place[hit]] = -np.inf
            if at == 0 and len(d) > k:
                edge = np.partition(sim, len(d) - k, axis=1)[:, len(d) - k]
                more = sim >= edge[:, None] - off
            else:
                more = sim > edge[:, None] if itself else sim >= edge[:, None] - off
            i, j = np.nonzero(more & (sim > -np.inf) if not itself else more)
            if not len(i):
                continue
            v = np.concatenate([alone(q[i[z : z + 65536]], d[j[z : z + 65536]], metric) for z in range(0, len(i), 65536)])
            row, to, raw = np.append(row, i), np.append(to, at + j), np.append(raw, v)
            order = np.lexsort((to, -raw, row))
            row, to, raw = row[order], to[order], raw[order]
            head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            count = np.diff(np.append(head, len(row)))
            keep = np.arange(len(row)) - np.repeat(head, count) < k
            full = count >= k
            last = raw[head[full] + k - 1]
            edge[row[head[full]]] = -last * last if metric == "euclid" else last
            row, to, raw = row[keep], to[keep], raw[keep]
        out.append((own[row], other[to], raw))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def narrowed(df: DataFrame) -> DataFrame:
    """Vectors of doubles as floats where that loses nothing: half the bytes to shuffle."""
    if dict(df.dtypes)["vec"] != "array<double>":
        return df
    loses = ~F.forall("vec", lambda x: x.cast("float").cast("double") == x)
    return df.withColumn("vec", F.col("vec").cast("array<float>")) if df.where(loses).isEmpty() else df


def sides(rows: int, dims: int, block: int | None = None) -> int:
    """Blocks that rows are dealt to; each row meets every block once, so it is shuffled as often."""
    return max(1, -(-rows // block) if block else min(-(-rows // BLOCK), max(SIDE, -(-rows * dims // NUMBERS))))


def block_pairs(df: DataFrame, blocks: int) -> DataFrame:
    """Each row in every pair (a, b) of blocks, a <= b, that has its own."""
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    base = df.select("id", "vec", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    return base.select("id", "vec", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def exact(df: DataFrame, k: int = 15, metric: str = "cosine", rows: int | None = None, block: int | None = None) -> DataFrame:
    """k nearest rows of every row of (id, vec), itself among them; for cosine itself has similarity 1."""
    rows = rows if rows is not None else df.count()
    dims = (df.select(F.size("vec").alias("d")).first() or {"d": 1})["d"] * (64 if metric == "bits" else 1)
    blocks = sides(rows, dims, block)
    itself = {"cosine": 1.0, "euclid": 0.0}.get(metric)

    def run(table: pa.Table) -> pa.Table:
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        ids, own = table.column("id").to_numpy(), table.column("own").to_numpy()
        x = prepared(matrix(table, metric), metric)
        first, second = own == a, own == b
        found = [nearest(ids[first], x[first], ids[second], x[second], k, metric)]
        if a != b:
            found.append(nearest(ids[second], x[second], ids[first], x[first], k, metric))
        elif itself is not None:
            found.append((ids, ids, np.full(len(ids), itself)))
        src, dst, raw = (np.concatenate(z) for z in zip(*found, strict=True))
        return pa.table({"src": src, "dst": dst, "raw": raw.astype(float)})

    local = block_pairs(narrowed(df), blocks).groupBy("a", "b").applyInArrow(run, "src long, dst long, raw double")
    return ranked(local, k)


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy(F.desc("raw"), "dst")
    return candidates.select("*", (F.row_number().over(w) - 1).alias("rank")).where(F.col("rank") < k).select("src", "rank", "dst", "raw")


def published(graph: DataFrame, metric: str = "cosine") -> DataFrame:
    """src, rank, dst, dist with the distance that users see."""
    raw = F.col("raw")
    bits = F.when(raw == 0, float("inf")).otherwise(0.0 - F.log2(raw))
    dist = {"cosine": metrics.published_cosine(raw), "int8": metrics.published_product(raw), "bits": bits, "euclid": 0.0 - raw}[metric]
    return graph.select("src", "rank", "dst", dist.alias("dist"))


def duplicates(graph: DataFrame) -> DataFrame:
    """(lo, hi) of neighbour pairs (src, rank, dst, dist) at most as far as the largest distance of rank 0."""
    edge = graph.agg(F.max(F.when(F.col("rank") == 0, F.col("dist"))).alias("edge"))
    near = graph.join(F.broadcast(edge)).where((F.col("dist") <= F.col("edge")) & (F.col("src") != F.col("dst")))  # one row
    return near.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
