"""The clustering pipeline as a function and as a pyspark.ml Estimator and Model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.ml.param import Param, Params, TypeConverters as T
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestrata.operators import descent, fuzzy, hierarchy, initial, knn, layout, mst, quality
from lodestrata.operators.store import stored

#: Rows of a spanning tree that one task turns into a hierarchy (24 bytes an edge).
HIERARCHY_ROWS = 20_000_000
#: Rows up to which a fit takes exact neighbours where it is not told which; approximate ones beyond. All pairs cost less CPU
#: than the approximate search up to about so many rows (8 ns a pair; 7 ms a row).
EXACT_ROWS = 800_000


@dataclass
class Result:
    """layers: (layer, id, label, strength); scores: (layer, n_clusters, persistence); graph: (src, rank, dst, dist);
    duplicates: (lo, hi); layout: (id, pos); tree: (src, dst, weight)."""

    layers: DataFrame
    scores: DataFrame
    graph: DataFrame
    duplicates: DataFrame
    layout: DataFrame
    tree: DataFrame


def in_one_task(tree: DataFrame, nodes: DataFrame, make, schema: str) -> DataFrame:
    """``make(linkage, ids)`` rows, in one task over the stored edges of a tree over ``nodes``. Merging edges in order is
    sequential; the table is written before, so that only reading it is one task's work."""
    alone = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(-1.0).alias("weight"))
    edges = stored(tree.select("src", "dst", "weight").union(alone))
    names = [f.name for f in edges.sparkSession.createDataFrame([], schema).schema]

    def run(batches):
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.concat_tables(parts)
        src, dst, w = (t.column(c).to_numpy() for c in ("src", "dst", "weight"))
        ids, real = np.unique(src[w < 0]), w >= 0
        link = hierarchy.linkage(np.searchsorted(ids, src[real]), np.searchsorted(ids, dst[real]), w[real])
        got = make(link, ids)
        for columns in got if isinstance(got, Iterator) else [list(zip(*got, strict=True))]:
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    kinds = [f.type for f in to_arrow_schema(edges.sparkSession.createDataFrame([], schema).schema)]
    return edges.coalesce(1).mapInArrow(run, schema)


def hierarchy_layers(tree: DataFrame, nodes: DataFrame, min_size: int, n_clusters: int | None, single: bool, similar: float, most: int) -> DataFrame:
    """(layer, id, label, strength, persistence) in one task over the tree's edges."""

    def make(link, ids):
        if len(ids) == 1:
            got = [(np.array([-1]), np.zeros(1), 0.0)]
        else:
            got = hierarchy.layers(link, min_size, n_clusters, single, similar, most)
        for k, (label, strength, score) in enumerate(got):
            yield np.full(len(ids), k, np.int32), ids, label.astype(np.int32), strength.astype(float), np.full(len(ids), score, float)

    return in_one_task(tree, nodes, make, "layer int, id long, label int, strength double, persistence double")


def cluster(df: DataFrame, metric: str = "cosine", noise_level: float = 0.5, base_min_cluster_size: int = 5, base_n_clusters: int | None = None, approx_n_clusters: int | None = None, n_neighbors: int = 15, min_samples: int = 5, n_epochs: int = 50, node_embedding_init: str | None = "label_prop", symmetrize_graph: bool = True, node_embedding_dim: int | None = None, neighbor_scale: float = 1.0, random_state: int = 42, min_similarity_threshold: float = 0.2, max_layers: int = 10, n_label_prop_iter: int = 20, approximate: bool | None = None, base_init: str = "pca", upscaling: str = "partition_expander") -> Result:
    """Cluster (id, vec) at several granularities."""
    df = stored(df.select("id", "vec"))
    nodes = df.select("id")
    n = nodes.count()
    if approximate is None:
        approximate = n > EXACT_ROWS
    raw = stored(descent.search(df, n_neighbors, metric, seed=random_state) if approximate else knn.exact(df, n_neighbors, metric, n))
    graph = knn.published(raw, metric)
    finite = graph.where(~F.isnan("dist") & (F.abs(F.col("dist")) < float("inf")))
    directed = fuzzy.memberships(finite, fuzzy.bandwidths(finite, n_neighbors, neighbor_scale))
    edges = stored(fuzzy.symmetrised(directed) if symmetrize_graph else directed)
    dims = node_embedding_dim or min(max(n_neighbors // 4, 4), 15)
    start = None
    if node_embedding_init == "label_prop":
        parts = min(max(int(8 * n**0.5), 256), 16384)
        start = stored(initial.places(edges, df if metric != "bits" else unpacked(df), dims, parts, n_label_prop_iter, noise_level, base_init, upscaling, random_state))
    elif node_embedding_init is not None:
        raise ValueError(f"unknown initialisation {node_embedding_init!r}")
    placed = stored(layout.embed(edges, nodes, dims, n_epochs, start, 0.1, noise_level, random_state))
    tree = stored(mst.spanning_tree(placed.select("id", F.col("pos").alias("vec")), min_samples))
    if n > HIERARCHY_ROWS:
        raise ValueError(f"{n} rows; the hierarchy takes at most {HIERARCHY_ROWS}")
    whole = stored(hierarchy_layers(tree, nodes, base_min_cluster_size, approx_n_clusters or base_n_clusters, bool(approx_n_clusters), min_similarity_threshold, max_layers))
    scores = whole.groupBy("layer").agg((F.max("label") + 1).alias("n_clusters"), F.max("persistence").alias("persistence"))
    return Result(whole.drop("persistence"), scores, graph, knn.duplicates(graph), placed, tree)


def unpacked(df: DataFrame) -> DataFrame:
    """Words of bits as vectors of 0 and 1."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = knn.prepared(knn.matrix(pa.Table.from_batches([batch]).select(["vec"]), "bits"), "bits")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "vec"])

    return df.select("id", "vec").mapInArrow(run, "id long, vec array<double>")


class _Shared(Params):
    vecCol = Param(Params._dummy(), "vecCol", "column of vectors", T.toString)
    idCol = Param(Params._dummy(), "idCol", "column of ids", T.toString)
    metric = Param(Params._dummy(), "metric", "cosine, int8 or bits", T.toString)
    noiseLevel = Param(Params._dummy(), "noiseLevel", "scale of attraction", T.toFloat)
    baseMinClusterSize = Param(Params._dummy(), "baseMinClusterSize", "minimum cluster size of the finest layer", T.toInt)
    baseNClusters = Param(Params._dummy(), "baseNClusters", "clusters of the finest layer, 0 for none", T.toInt)
    approxNClusters = Param(Params._dummy(), "approxNClusters", "clusters of the only layer, 0 for none", T.toInt)
    nNeighbors = Param(Params._dummy(), "nNeighbors", "neighbours, the row itself among them", T.toInt)
    minSamples = Param(Params._dummy(), "minSamples", "order of core distances", T.toInt)
    nEpochs = Param(Params._dummy(), "nEpochs", "epochs of the layout", T.toInt)
    nodeEmbeddingInit = Param(Params._dummy(), "nodeEmbeddingInit", "label_prop or random", T.toString)
    symmetrizeGraph = Param(Params._dummy(), "symmetrizeGraph", "fuzzy union of both directions", T.toBoolean)
    nodeEmbeddingDim = Param(Params._dummy(), "nodeEmbeddingDim", "dimensions of the layout, 0 for automatic", T.toInt)
    neighborScale = Param(Params._dummy(), "neighborScale", "factor of the bandwidth target", T.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of hashes", T.toInt)
    minSimilarityThreshold = Param(Params._dummy(), "minSimilarityThreshold", "largest overlap of kept layers", T.toFloat)
    maxLayers = Param(Params._dummy(), "maxLayers", "layers at most", T.toInt)
    nLabelPropIter = Param(Params._dummy(), "nLabelPropIter", "sweeps of label propagation", T.toInt)
    approximate = Param(Params._dummy(), "approximate", "neighbours by descent: 1 always, 0 never, -1 beyond EXACT_ROWS rows", T.toInt)
    baseInit = Param(Params._dummy(), "baseInit", "places of the smallest graph: pca, random, spectral or mds", T.toString)
    upscaling = Param(Params._dummy(), "upscaling", "partition_expander, jitter_expander or jitter", T.toString)


_DEFAULTS = {"vecCol": "embedding", "idCol": "vec_id", "metric": "cosine", "noiseLevel": 0.5, "baseMinClusterSize": 5, "baseNClusters": 0, "approxNClusters": 0, "nNeighbors": 15, "minSamples": 5, "nEpochs": 50, "nodeEmbeddingInit": "label_prop", "symmetrizeGraph": True, "nodeEmbeddingDim": 0, "neighborScale": 1.0, "seed": 42, "minSimilarityThreshold": 0.2, "maxLayers": 10, "nLabelPropIter": 20, "approximate": -1, "baseInit": "pca", "upscaling": "partition_expander"}


class LayeredClusters(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator: fit(df) gives a model with label layers of df's rows."""

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._setDefault(**_DEFAULTS)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LayeredClustersModel:
        from lodestrata.sources.vectors import checked

        g = lambda p: self.getOrDefault(p)
        kind = "array<long>" if g("metric") == "bits" else "array<double>"
        df = dataset.select(F.col(g("idCol")).cast("long").alias("id"), F.col(g("vecCol")).cast(kind).alias("vec"))
        df = checked(df) if g("metric") != "bits" else df
        init = None if g("nodeEmbeddingInit") == "random" else g("nodeEmbeddingInit")
        out = cluster(df, g("metric"), g("noiseLevel"), g("baseMinClusterSize"), g("baseNClusters") or None, g("approxNClusters") or None, g("nNeighbors"), g("minSamples"), g("nEpochs"), init, g("symmetrizeGraph"), g("nodeEmbeddingDim") or None, g("neighborScale"), g("seed"), g("minSimilarityThreshold"), g("maxLayers"), g("nLabelPropIter"), None if g("approximate") < 0 else bool(g("approximate")), g("baseInit"), g("upscaling"))
        model = LayeredClustersModel(out)
        self._copyValues(model)
        return model


class _Writer(MLWriter):
    """Parameters as metadata, then the tables of the fit."""

    def __init__(self, model: LayeredClustersModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        for name in Result.__dataclass_fields__:
            getattr(self.model.tables, name).write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def load(self, path: str) -> LayeredClustersModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = LayeredClustersModel(Result(*[self.sparkSession.read.parquet(f"{path}/{name}") for name in Result.__dataclass_fields__]))
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


class LayeredClustersModel(Model, _Shared, MLWritable, MLReadable):
    """Tables of a fit. Only fitted rows have labels; transform adds those of the most persistent layer."""

    def __init__(self, result: Result | None = None):
        super().__init__()
        self._setDefault(**_DEFAULTS)
        self.result = result

    @property
    def tables(self) -> Result:
        if self.result is None:
            raise RuntimeError("this model is not fitted")
        return self.result

    @property
    def labels(self) -> DataFrame:
        best = self.tables.scores.orderBy(F.desc("persistence"), "layer").limit(1).select("layer")
        return self.tables.layers.join(F.broadcast(best), "layer").select("id", "label", "strength")  # one row

    @property
    def cluster_tree(self) -> DataFrame:
        return quality.cluster_tree(self.tables.layers)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name = self.getOrDefault("idCol")
        return dataset.join(self.labels.withColumnRenamed("id", name), name, "left")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()
