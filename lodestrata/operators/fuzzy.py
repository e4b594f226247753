"""Weighted neighbour graphs: local bandwidths, memberships, symmetric union. All in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bandwidths(graph: DataFrame, k: int, scale: float = 1.0, steps: int = 64) -> DataFrame:
    """src, rho, sigma from (src, rank, dst, dist): rho is the first distance above 0, and sigma makes the memberships
    of ranks 1 and up sum to log2(scale * k), by bisection, with a floor of a thousandth of the mean distance."""
    rows = graph.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dist"))), lambda x: x["dist"]).alias("d"))
    mean = F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d")
    rows = rows.select("src", "d", mean.alias("mean"), F.coalesce(F.try_element_at(F.filter("d", lambda x: x > 0), F.lit(1)), F.lit(0.0)).alias("rho"))
    whole = graph.agg(F.avg("dist").alias("all_mean"))
    target = F.log2(F.lit(float(scale * k)))
    inf = F.lit(float("inf"))

    def step(s, _):
        total = F.aggregate(F.slice("d", 2, 1_000_000), F.lit(0.0), lambda t, x: t + F.exp(-F.greatest(x - F.col("rho"), F.lit(0.0)) / s["mid"]))
        done = s["done"] | (F.abs(total - target) < 1e-5)
        high = total > target
        lo = F.when(done | high, s["lo"]).otherwise(s["mid"])
        hi = F.when(~done & high, s["mid"]).otherwise(s["hi"])
        mid = F.when(done, s["mid"]).when(high, (s["lo"] + s["mid"]) / 2).when(s["hi"] == inf, s["mid"] * 2).otherwise((s["mid"] + s["hi"]) / 2)
        return F.struct(lo.alias("lo"), hi.alias("hi"), mid.alias("mid"), done.alias("done"))

    start = F.struct(F.lit(0.0).alias("lo"), inf.alias("hi"), F.lit(1.0).alias("mid"), F.lit(False).alias("done"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["mid"])
    rows = rows.select("src", "rho", "mean", found.alias("s")).join(F.broadcast(whole))  # one row
    floor = 1e-3 * F.when(F.col("rho") > 0, F.col("mean")).otherwise(F.col("all_mean"))
    return rows.select("src", "rho", F.greatest("s", floor).alias("sigma"))


def memberships(graph: DataFrame, widths: DataFrame) -> DataFrame:
    """src, dst, weight > 0 of all neighbours but the row itself."""
    w = F.when((F.col("dist") <= F.col("rho")) | (F.col("sigma") == 0), 1.0).otherwise(F.exp(-(F.col("dist") - F.col("rho")) / F.col("sigma")))
    return graph.join(widths, "src").where("src <> dst").select("src", "dst", w.alias("weight")).where("weight > 0")


def symmetrised(edges: DataFrame) -> DataFrame:
    """a + b - a*b of both directions of every edge, in both directions."""
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    s = F.sum("weight")
    return both.groupBy("src", "dst").agg((s - F.when(F.count(F.lit(1)) > 1, F.product("weight")).otherwise(0.0)).alias("weight"))


def epochs_per_sample(edges: DataFrame, epochs: int) -> DataFrame:
    top = edges.agg(F.max("weight").alias("top"))
    share = epochs * F.col("weight") / F.col("top")
    return edges.join(F.broadcast(top)).select("src", "dst", (epochs / F.greatest(share, F.lit(1.0))).alias("epochs_per_sample"))  # one row
