"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _toward_least(pairs: DataFrame, whole: bool) -> DataFrame:
    """(u, v) with neighbours v of u: links them all to the least of u and its neighbours.

    whole: large star, which links only the neighbours above u; else small star,
    whose input holds neighbours below u only.  The least neighbour comes from a
    map-side combined aggregate, so a node with a third of all edges costs one
    row per task; the join back to its edges is one that Spark can split.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    linked = pairs.join(least, "u").withColumn("m", F.least("m", "u"))
    if whole:
        return linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def _settled(e: DataFrame) -> bool:
    """Whether edges u > v are stars: every u has one v, and no v is a u."""
    several = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    inner = e.select("u").join(e.select(F.col("v").alias("u")), "u", "left_semi")
    return several.unionByName(inner).isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, label): every node of edges with the least node of its component.

    Alternating large and small stars until the edges are stars, whose centres
    are their least nodes; each round's edges are written to the shared folder.  Nulls and
    loops are ignored; repeated edges count once.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
    e = scratch.keep(e.distinct())
    while not _settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both, whole=True).where("u <> v").distinct()
        new = scratch.keep(_toward_least(large, whole=False).where("u <> v").distinct())
        scratch.drop(e)
        e = new
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out = scratch.keep(nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
    scratch.drop(e)
    return out
