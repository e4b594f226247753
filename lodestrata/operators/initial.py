"""First places of a layout: label propagation coarsens the graph level by level, the smallest graph is placed by its
vectors, and places come back up, laid out at each level.

Graphs of up to LOCAL_EDGES edges and LOCAL_NUMBERS numbers of vectors go through all levels in one task. Larger ones are
coarsened once by joins (to 16,384 parts at most), which leaves such a graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestrata.operators import knn, labelprop, layout
from lodestrata.operators.store import stored

LOCAL_EDGES, LOCAL_NUMBERS = 2_000_000, 20_000_000
#: Rows below which a graph is placed by its vectors.
BASE_ROWS = 64
#: Epochs of the layout of parts.
EPOCHS = 50
#: Spread of the noise that jittered rows get, and the scale of all places.
NOISE, SCALING = 0.1, 0.5
BASES = ("random", "pca", "spectral", "mds")
UPSCALINGS = ("partition_expander", "jitter_expander", "jitter")


def normal(ids: np.ndarray, salt: int, width: int) -> np.ndarray:
    """Hash-seeded normal numbers by id."""
    u = np.clip(layout.unit_noise(ids, salt, 2 * width), 1e-12, 1)
    return np.sqrt(-2 * np.log(u[:, :width])) * np.cos(2 * np.pi * u[:, width:])


def halved_range(p: np.ndarray) -> np.ndarray:
    p = p - p.mean()
    return p / max((p.max() - p.min()) / 2, 1e-12)


def leading(m: np.ndarray, dims: int, order: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvalues and vectors of a symmetric matrix, largest first (``order`` 1: least first), signs fixed."""
    values, v = np.linalg.eigh(m)
    at = np.argsort(order * values, kind="stable")[:dims]
    v = v[:, at]
    return values[at], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)


def base_places(ids: np.ndarray, x: np.ndarray, dims: int, base: str, seed: int) -> np.ndarray:
    """Places of a few rows: on a sphere by chance, principal components, spectral embedding or classical scaling."""
    n = len(ids)
    if base == "random" or n < 3:
        p = normal(ids, seed, dims)
        return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    if base == "spectral":
        d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        near = np.exp(-d / max(np.median(d[d > 0]) if (d > 0).any() else 1.0, 1e-12))
        root = 1 / np.sqrt(near.sum(axis=1))
        _, v = leading(np.eye(n) - root[:, None] * near * root[None], dims + 1, 1)
        found = (v * root[:, None])[:, 1:]
    else:
        y = x - x.mean(axis=0)
        gram = y @ y.T  # of a distance matrix's double centring, too
        values, v = leading(gram, dims)
        found = v * np.sqrt(np.maximum(values, 0))
    p = np.zeros((n, dims))
    p[:, : found.shape[1]] = found[:, :dims]
    return halved_range(p)


def local_parts(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, ids: np.ndarray, parts: int, sweeps: int, seed: int) -> np.ndarray:
    """Part of each node, without gaps: seeds by hash, sweeps, then the least label of the nearest by hops, then hash."""
    n = len(ids)
    label = np.full(n, -1, np.int64)
    drawn = np.lexsort((ids, layout.unit_noise(ids, seed, 1)[:, 0]))[:parts]
    label[drawn] = np.arange(len(drawn))
    for _ in range(sweeps):
        then = labelprop.swept(src, dst, weight, label)
        if (then == label).all():
            break
        label = then
    for _ in range(64):
        use = (label[dst] >= 0) & (label[src] < 0)
        if not use.any():
            break
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, src[use], label[dst[use]])
        label = np.where((label < 0) & (least < np.iinfo(np.int64).max), least, label)
    lost = label < 0
    label[lost] = (layout.unit_noise(ids[lost], seed + 1, 1)[:, 0] * parts).astype(np.int64)
    return np.unique(label, return_inverse=True)[1]


def local_places(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, ids: np.ndarray, x: np.ndarray, dims: int, parts: int, sweeps: int, noise_level: float, base: str, upscaling: str, seed: int) -> np.ndarray:
    """Places of all nodes (ends are places in ``ids``)."""
    if len(ids) < BASE_ROWS:
        return base_places(ids, x, dims, base, seed)
    part = local_parts(src, dst, weight, ids, max(2, parts), sweeps, seed)
    size = np.bincount(part)
    m = len(size)
    if m >= len(ids):  # nothing to join
        return base_places(ids, x, dims, base, seed)
    centre = np.stack([np.bincount(part, x[:, k], m) for k in range(x.shape[1])], axis=1) / size[:, None]
    key, inverse = np.unique(part[src] * m + part[dst], return_inverse=True)
    a, b = key // m, key % m
    w = np.clip(np.bincount(inverse, weight) / np.sqrt(size[a]), 0, 1)
    first = local_places(a, b, w, np.arange(m), centre, dims, parts // 4, sweeps, noise_level, base, upscaling, seed)
    apart = a != b
    placed = layout.local_embed(a[apart], b[apart], w[apart], np.arange(m), first, EPOCHS, 0.001 * EPOCHS, noise_level, seed)
    return shifted(upscaled(src, dst, weight, ids, part, size, placed, upscaling, seed))


def shifted(p: np.ndarray) -> np.ndarray:
    return SCALING * (p - p.mean(axis=0))


def upscaled(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, ids: np.ndarray, part: np.ndarray, size: np.ndarray, placed: np.ndarray, upscaling: str, seed: int) -> np.ndarray:
    """Places of nodes from those of their parts: by the parts of neighbours, with noise, or both."""
    n, m, dims = len(ids), len(size), placed.shape[1]
    jitter = normal(ids, seed + 7, dims) * NOISE
    if upscaling == "jitter":
        return placed[part] + jitter
    back = np.lexsort((src, dst))  # edges by (dst, src) meet edges by (src, dst)
    there = np.lexsort((dst, src))
    forward, backward = src[there] * n + dst[there], dst[back] * n + src[back]
    at = np.minimum(np.searchsorted(backward, forward), len(backward) - 1) if len(backward) else forward
    both = backward[at] == forward if len(backward) else np.zeros(0, bool)
    s, d = src[there][both], dst[there][both]
    w = weight[there][both] * weight[back][at[both]] / np.sqrt(size[part[d]])
    total = np.bincount(s, w, n)
    out = placed[part].copy()
    for k in range(dims):
        mean = np.bincount(s, w * placed[part[d], k], n) / np.where(total > 0, total, 1)
        out[:, k] = (out[:, k] + mean) / 2
    if upscaling == "jitter_expander":
        out = (out + placed[part] + jitter / 4) / 2
    return out


def places(edges: DataFrame, data: DataFrame, dims: int, parts: int, sweeps: int = 20, noise_level: float = 0.5, base: str = "pca", upscaling: str = "partition_expander", seed: int = 42) -> DataFrame:
    """(id, pos) of every row of ``data`` (id, vec), from ``edges`` (src, dst, weight) of its graph."""
    if base not in BASES or upscaling not in UPSCALINGS:
        raise ValueError(f"unknown initialisation {base!r} or upscaling {upscaling!r}")
    rows, numbers = data.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    spark = data.sparkSession
    if not rows:
        return spark.createDataFrame([], "id long, pos array<double>")
    if rows < BASE_ROWS or edges.count() <= LOCAL_EDGES and numbers <= LOCAL_NUMBERS or rows <= 2 * parts:
        return in_one_task(edges, data, dims, parts, sweeps, noise_level, base, upscaling, seed)
    nodes = data.select("id")
    part = stored(labelprop.partitions(edges, nodes, parts, sweeps, seed))
    centre = stored(labelprop.centroids(data, part).withColumnRenamed("part", "id"))
    small = stored(labelprop.coarse(edges, part))
    first = in_one_task(small, centre, dims, parts // 4, sweeps, noise_level, base, upscaling, seed)
    placed = stored(layout.embed(small.where("src <> dst"), centre.select("id"), dims, EPOCHS, first, 0.001 * EPOCHS, noise_level, seed)).withColumnRenamed("id", "part")
    if upscaling == "partition_expander":
        out = labelprop.expanded(edges, part, placed)
    else:
        noise = F.transform("pos", lambda x, i: x + NOISE / (4 if upscaling == "jitter_expander" else 1) * F.sqrt(-2 * F.log((F.pmod(F.xxhash64("id", i), F.lit(1 << 30)) + 1) / float(1 << 30))) * F.cos(2 * np.pi * F.pmod(F.xxhash64(i, "id"), F.lit(1 << 30)) / float(1 << 30)))
        out = part.join(placed, "part").select("id", noise.alias("pos"))
        if upscaling == "jitter_expander":
            both = out.join(labelprop.expanded(edges, part, placed).withColumnRenamed("pos", "q"), "id")
            out = both.select("id", F.zip_with("pos", "q", lambda x, y: (x + y) / 2).alias("pos"))
    out = stored(out)
    mean = out.agg(F.array(*[F.avg(F.col("pos")[i]) for i in range(dims)]).alias("mean"))
    return out.join(F.broadcast(mean)).select("id", F.transform("pos", lambda x, i: (x - F.col("mean")[i]) * SCALING).alias("pos"))  # one row


def in_one_task(edges: DataFrame, data: DataFrame, dims: int, parts: int, sweeps: int, noise_level: float, base: str, upscaling: str, seed: int) -> DataFrame:
    def run(e: pa.Table, v: pa.Table) -> pa.Table:
        ids, x = v.column("id").to_numpy(), knn.prepared(knn.matrix(v, "cosine"), "cosine")
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        src, dst, w = (e.column(c).to_numpy() for c in ("src", "dst", "weight"))
        order = np.lexsort((dst, src))
        src, dst = np.searchsorted(ids, src[order]), np.searchsorted(ids, dst[order])
        p = local_places(src, dst, w[order], ids, x, dims, parts, sweeps, noise_level, base, upscaling, seed)
        return pa.table({"id": ids, "pos": pa.array(list(shifted(p)) if len(ids) < BASE_ROWS else list(p), pa.list_(pa.float64()))})

    one = F.lit(0).alias("one")
    e, v = stored(edges.select("src", "dst", "weight", one)), stored(data.select("id", F.col("vec").cast("array<double>").alias("vec"), F.lit(0).alias("all")))
    return e.groupBy("one").cogroup(v.groupBy("all")).applyInArrow(run, "id long, pos array<double>")
