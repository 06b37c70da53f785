"""Class features from a table of parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_ancestors(df: DataFrame, word: str, parents: DataFrame, levels: int = 4, name: str = "ancestors") -> DataFrame:
    """df with the distinct parents of its word up to so many levels, nearest first, from ``parents`` (child, parent): a join
    for each level over the distinct words."""
    at = df.select(F.col(word).alias("word")).distinct().withColumn("node", F.col("word"))
    found = None
    for level in range(1, levels + 1):
        at = at.join(parents, F.col("node") == F.col("child")).select("word", F.col("parent").alias("node")).distinct()
        one = at.withColumn("level", F.lit(level))
        found = one if found is None else found.unionByName(one)
    nearest = found.groupBy("word", "node").agg(F.min("level").alias("level"))
    lists = nearest.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "node"))), lambda x: x["node"]).alias(name)).withColumnRenamed("word", "_word")
    return df.join(lists, F.col(word) == F.col("_word"), "left").drop("_word").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
