"""Connected components of an edge table, with joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.plans.durable import durable


def _stars(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on its least neighbour."""
    both = edges.union(edges.select("dst", "src"))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    hung = both.where("dst > src").join(least, "src")
    return hung.select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()


def _shrink(edges: DataFrame) -> DataFrame:
    """Hang every node and its smaller neighbours on the least of them. Edges point down."""
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    moved = edges.join(least, "src").where("dst <> least")
    return (
        moved.select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        .union(least.select("src", F.col("least").alias("dst")))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.xxhash64("src", "dst") % 1_000_003)).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node that is not the least of its component.

    ``edges`` has the columns src and dst of one orderable type; loops and repeats are ignored.
    Large and small stars alternate; the edges never outnumber those given, a node's neighbours are
    never gathered, and each round is a table in the shared folder.
    """
    edges = durable(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )
    state = _state(edges)
    while state[0]:
        edges = durable(_shrink(_stars(edges)))
        last, state = state, _state(edges)
        if state == last:
            break
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
