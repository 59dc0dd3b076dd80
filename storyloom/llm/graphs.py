"""Connected components of undirected edge tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm._common import cut, drop


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Per node of an edge: id, label, where label is the smallest node reachable.

    Each round hangs every neighbour larger than a node on the node's smallest neighbour (large star), then every
    smaller neighbour on the smallest one (small star); a component ends as one star round its smallest node after
    a logarithmic number of rounds. Only edges are moved; minima are pre-aggregated, and the joins back are plain
    equi-joins, which adaptive execution splits where a node has very many edges. Loops and null ends are left
    out; an empty table gives an empty result.
    """
    e = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    e, seen = cut(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("label")).unionByName(
                e.select(F.col("lo").alias("id"), F.col("lo").alias("label")).distinct()
            )
        seen = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = cut(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        drop(e)
        e = after
