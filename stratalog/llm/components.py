"""Connected components of a link table by large and small stars.

Each round hangs every node's greater neighbours under its least neighbour, then every node and its lesser neighbours under the
least of these, until nothing moves; stars of any size settle in two or three rounds. Minima come from aggregates that combine
before the shuffle and are joined back, so no neighbourhood is gathered in one task. Each round ends in a table in the shared
folder; the driver sees one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import through_table


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); label is the least node of its component. Loops and repeats are allowed, nulls are not."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, last = through_table(edges, "edges"), None
    while (now := _checksum(edges)) != last and now[0]:
        last = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = through_table(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = through_table(small, "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
