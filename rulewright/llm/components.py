"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT_KEYS, dropped, written

#: Rows of one node that meet in a task.
TOGETHER = 512


def beside(pairs: DataFrame, values: DataFrame, own: str, other: str) -> DataFrame:
    """pairs with the values of their node ``own`` (one row for each node there). A node of more than TOGETHER pairs has its values
    in several places, and ``other`` chooses among them, so that no task gets all its pairs."""
    places = F.ceil(F.col("n") / TOGETHER).cast("int")
    wide = pairs.groupBy(F.col(own).alias("_wide")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TOGETHER).select("_wide", places.alias("_places"))
    n = wide.count()
    if not n:
        return pairs.join(values, own)
    wide = written(wide, "wide")
    send = F.broadcast if n <= SENT_KEYS else (lambda df: df)
    dealt = pairs.join(send(wide), F.col(own) == F.col("_wide"), "left").withColumn("_place", F.coalesce(F.pmod(F.xxhash64(other), "_places").cast("int"), F.lit(0)))
    copied = values.join(send(wide), F.col(own) == F.col("_wide"), "left").withColumn("_place", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_places") - 1, F.lit(0)))))
    return dealt.drop("_wide", "_places").join(copied.drop("_wide", "_places"), [own, "_place"]).drop("_place")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are led to its least neighbour (or itself)."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return beside(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are led to the least of these. Edges come with v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = beside(edges, least, "u", "v")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for each node of the edges (u, v: longs), apart from the roots themselves."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        before, now = now, written(_small_star(_large_star(now)), "edges")
        dropped(before)
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (mark["n"], mark["h"])
