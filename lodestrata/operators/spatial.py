"""Space-partitioned blocks of rows: a KD-tree's splits over a bounded sample deal rows to blocks, and the blocks' boxes
bound distances from below, so that a row meets only blocks that can hold something near enough.

The tree has at most 2**LEVELS leaves and the boxes are as many rows, so both are broadcast with a fixed bound. Blocks that
turn out crowded (equal rows) are cut by hash; their boxes overlap, which costs work and loses nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestrata.operators import knn
from lodestrata.operators.store import stored

#: Rows of a block, of the sample that the splits are taken from, and levels of the tree.
BLOCK, SAMPLE, LEVELS = 2048, 65_536, 14
#: Rows that ask of a block in one task.
ASKING = 8192


@dataclass
class Boxes:
    """Ids of blocks with the corners of their rows, and the largest core distance in each (0 without core distances)."""

    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    core: np.ndarray

    def least(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Distance of each row of x from each of some boxes."""
        gap = np.maximum(np.maximum(self.low[which][None] - x[:, None], x[:, None] - self.high[which][None]), 0)
        return np.sqrt((gap * gap).sum(axis=2))

    def most(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Distance of each row of x from the farthest corner of each of some boxes."""
        gap = np.maximum(np.abs(x[:, None] - self.low[which][None]), np.abs(x[:, None] - self.high[which][None]))
        return np.sqrt((gap * gap).sum(axis=2))

    def apart(self, own: int) -> np.ndarray:
        """Distance of one box from every box."""
        gap = np.maximum(np.maximum(self.low - self.high[own], self.low[own] - self.high), 0)
        return np.sqrt((gap * gap).sum(axis=1))


def splits(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and threshold of each node of a complete tree: the median along the axis of largest spread."""
    axis, cut = np.zeros((1 << levels) - 1, np.int64), np.full((1 << levels) - 1, np.inf)
    nodes, at = [x], 0
    for _ in range(levels):
        then = []
        for rows in nodes:
            if len(rows):
                axis[at] = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
                cut[at] = np.median(rows[:, axis[at]])
            right = rows[:, axis[at]] > cut[at]
            then += [rows[~right], rows[right]]
            at += 1
        nodes = then
    return axis, cut


def leaf_of(x: np.ndarray, axis: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for _ in range(levels):
        node = 2 * node + 1 + (x[np.arange(len(x)), axis[node]] > cut[node])
    return node - ((1 << levels) - 1)


def blocked(df: DataFrame, rows: int, block: int = BLOCK) -> DataFrame:
    """(block and all columns) of a table with id and vec, stored."""
    levels = min(LEVELS, max(0, math.ceil(math.log2(max(1, rows / block)))))
    some = df.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) <= int(min(1.0, SAMPLE / max(rows, 1)) * (1 << 30))).select("vec").limit(2 * SAMPLE).toArrow()
    axis, cut = splits(knn.matrix(some, "euclid"), levels) if levels and some.num_rows else (np.zeros(0, np.int64), np.zeros(0))
    shared = df.sparkSession.sparkContext.broadcast((axis, cut, levels if len(axis) else 0))
    names = df.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = knn.matrix(pa.Table.from_batches([batch]).select(["vec"]), "euclid")
                yield pa.RecordBatch.from_arrays([pa.array(leaf_of(x, *shared.value)), *batch.columns], names=["block", *names])

    schema = "block long, " + ", ".join(f"{c} {k}" for c, k in df.dtypes)
    dealt = stored(df.mapInArrow(run, schema))
    sizes = dealt.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (2 * block)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    return stored(dealt.join(F.broadcast(sizes.where("parts > 1")), "block", "left").withColumn("block", F.col("block") * (1 << 20) + part).drop("parts"))


def boxes_of(table: DataFrame) -> Boxes:
    """The boxes of the blocks of (block, vec and, if there, core): a row a block on the driver."""
    core = F.max("core") if "core" in table.columns else F.lit(0.0)
    dims = table.select(F.size("vec").alias("d")).first()["d"]
    corner = lambda f: F.array(*[f(F.col("vec")[i]) for i in range(dims)])
    got = table.groupBy("block").agg(corner(F.min).alias("low"), corner(F.max).alias("high"), core.alias("core")).orderBy("block").collect()
    return Boxes(np.array([r["block"] for r in got], np.int64), np.array([r["low"] for r in got], float), np.array([r["high"] for r in got], float), np.array([r["core"] for r in got], float))


def meet(asking: DataFrame, table: DataFrame, make, schema: str) -> DataFrame:
    """``make(asking rows, a block's rows)`` for every block that is asked; ``asking`` has the block in ``target``.

    Blocks that many rows ask of answer in several tasks of about ASKING rows each.
    """
    asking = stored(asking)
    parts = asking.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("parts"))
    parts = F.broadcast(parts)  # a row a block at most
    dealt = asking.join(parts, "target").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")
    held = table.join(parts.withColumnRenamed("target", "block"), "block").withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.groupBy("target", "part").cogroup(held.groupBy("block", "part2")).applyInArrow(make, schema)
