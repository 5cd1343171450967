"""Connected components by alternating large-star and small-star."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import attach


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that occurs in ``links``; a component is named by its smallest node.

    Large-star hangs each larger neighbour of a node on the smallest node of its neighbourhood, small-star does so with the
    smaller neighbours; repeated, every component becomes a star around its smallest node. Each step is an aggregate and
    a join, both on rows of two numbers, and a node with very many neighbours is dealt over many tasks. The edges of each
    round are written to the shared folder, so the lineage stays short. Links with a null end and links of a node
    with itself are left out; no links give no rows.
    """
    edges = staged(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col("u").isNotNull() & (F.col("u") > F.col("v")) & F.col(a).isNotNull() & F.col(b).isNotNull())
        .distinct(),
        "cc",
    )
    before = _fingerprint(edges)
    while before[0]:
        edges = staged(_small_star(_large_star(edges)), "cc")
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    # Every edge now leads from a node to the smallest of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _fingerprint(edges):
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.min("v"), F.max("v")).first()
    return tuple(row)


def _large_star(edges):
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return attach(both, least, "u", spread="v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges):
    # Large-star leaves edges from a node to a smaller one only.
    edges = edges.distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = attach(edges, least, "u", spread="v").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
