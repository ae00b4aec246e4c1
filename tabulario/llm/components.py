"""Connected components by rounds of joins over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulario.llm.workspace import Workspace


def _mark(edges: DataFrame) -> tuple:
    """A mark of a set of edges: their number and the sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node it is connected to.

    Rounds of two steps: each node tells its larger neighbours the smallest one
    it knows, then its smaller ones. Both keep the number of edges and roughly
    halve the depth, so rounds grow with the logarithm of the longest chain.
    The smallest neighbours are written before they are joined, so both sides of
    the join are plain shuffles and adaptive execution can split a node with
    very many edges.
    """
    work = Workspace(edges.sparkSession)
    e = work.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges0")
    mark, turn = _mark(e), 0
    while mark[0]:
        turn += 1
        # Large step: all larger neighbours of a node point to the smallest of its neighbours and itself.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"least{turn}")
        large = work.keep(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"large{turn}")
        # Small step: the smaller neighbours of a node and itself point to the smallest.
        least = work.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"lesser{turn}")
        told = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = work.keep(told.select("e.*").where(F.col("u") != F.col("v")).distinct(), f"edges{turn}")
        work.drop(f"edges{turn - 1}", f"least{turn}", f"large{turn}", f"lesser{turn}")
        e, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
