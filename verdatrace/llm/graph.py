"""Connected components of an edge table, by alternating large and small stars.

Every round is two joins and two map-side combined minima over the edges; the
edge table is written to the shared folder after each round, so plans stay
short and a lost executor costs one round at most.  A hub with many neighbours
is met by a broadcast, not dealt by key (:func:`~verdatrace.llm.common.join_keyed`).
Nothing is collected but some numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdatrace.llm.common import drop_path, gathered, join_keyed, settle


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """From edges ``u``, ``v`` (loops and repeats allowed) to ``node``, ``root``: the least node of its component.

    Roots themselves have no row.  Nulls are no nodes.  The edges are counted
    first, so they should be a stored table.
    """
    spark = edges.sparkSession
    total = edges.count()
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, path = settle(gathered(edges, total), "edges")
    before = _signature(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Every edge once, from its lesser end: the greater end moves to the least neighbour of the lesser.
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = join_keyed(up, least, "u", total=before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_keyed(large, lower, "u", total=before[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        made, made_path = settle(gathered(small.unionAll(lower.select("u", F.col("m").alias("v"))).distinct(), before[0]), "edges")
        after = _signature(made)
        drop_path(spark, path)
        edges, path = made, made_path
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
