"""Connected components by alternating large and small stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (a, b of one comparable type) to (node, root): root is the least node reachable. Nodes without
    a link to another node are left out; so are links with a null end. Repeated links count once. Other
    columns aren't read. Without links the result is empty.

    A node's neighbours are never gathered: stars are built by a minimum with map-side combination and
    a join. At the end of a large class all its links share their root; the join on it is a sort-merge
    join, whose hot side adaptive execution splits over tasks (spark.sql.adaptive.skewJoin, on unless
    switched off) and which spills otherwise. Each round is written and the one before it deleted, so
    lineage stays short; the driver gets a count and a checksum a round.
    """
    a, b = F.col("a"), F.col("b")
    edges = written(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u != v").distinct(), "edges", edges)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
