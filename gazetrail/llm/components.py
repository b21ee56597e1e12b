"""Connected components of an edge table, by alternating large and small stars.

Each round lets every node point its larger neighbours, then its smaller ones, at the
smallest node it sees.  A node's neighbourhood is never gathered: its minimum is
a map-side combined aggregate that is joined back to the edges, a join whose hot side
adaptive execution may split.  Each round is written to the shared folder, and the one before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetrail.llm import storage

FILE_EDGES = 200_000


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """edges u > v; large stars if `both`, small ones otherwise."""
    if both:
        arrows = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = arrows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = arrows.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionAll(low.select("u", F.col("m").alias("v")))
    return out.distinct()


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of one ordered type, no nulls -> (node, root), a row for each node that has an edge
    to another, where root is the smallest node of its component.  No edges: no rows."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = storage.written(edges, "edges")
    sign = _sign(edges)
    while sign[0]:
        # files in proportion to the edges, which only become fewer, whatever the number of shuffle partitions
        last, edges = edges, storage.written(_stars(_stars(edges, True), False).coalesce(1 + sign[0] // FILE_EDGES), "edges")
        storage.discard(edges.sparkSession, last)
        if (now := _sign(edges)) == sign:
            break
        sign = now
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select("v", "v").distinct().toDF("node", "root"))
    out._written_to = edges._written_to
    return out
