"""Connected components by alternating large and small stars, each half round one written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, scratch: Scratch, name: str, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest node in reach. `edges` has v < u.

    The minima are written first, so that the join back is between two exchanges and a node of very many links is
    split by adaptive execution.
    """
    if large:
        edges = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = F.least(F.min("v"), F.col("u")) if large else F.min("v")
    minima = scratch.write(edges.groupBy("u").agg(least.alias("least")), f"{name}_minima")
    near = edges.join(minima, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = near.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")),
                                            F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.*")
    return scratch.write(out.where("u <> v").distinct(), name)


def components(links: DataFrame, scratch: Scratch, label: str = "edges") -> DataFrame:
    """(node, root) for every node that has a link; links are (a, b) of non-null longs, root is the smallest reachable.
    What is written is named by `label`."""
    edges = scratch.write(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}_0")
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before, turn = state(edges), 0
    while before[0]:
        turn += 1
        large = _star(edges, scratch, f"{label}_large_{turn}", True)
        edges = _star(large, scratch, f"{label}_{turn}", False)
        scratch.drop(f"{label}_{turn - 1}", f"{label}_large_{turn}", f"{label}_large_{turn}_minima", f"{label}_{turn}_minima")
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
