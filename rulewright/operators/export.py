"""Samples as sparse vectors of the templates' instances, for learners elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import with_word_lists
from ..plans.spec import Templates
from .learn import instances


def feature_rows(df: DataFrame, templates: Templates, nulls: tuple[str, ...] = (), vocabulary: DataFrame | None = None, bigrams: DataFrame | None = None) -> DataFrame:
    """seq, pos and feature (template number and values) for each instance in each sample."""
    df = with_word_lists(df, [a for t in templates.items for a in t.atoms], vocabulary, bigrams)
    out = None
    for number, t in enumerate(templates.items):
        part = instances(df, templates, number, t, nulls).select("seq", "pos", F.concat_ws(" ", F.col("template").cast("string"), "tokens").alias("feature")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def feature_ids(features: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """feature, n and id. Ids are the order by feature, dense, from 1; ``known`` ids are kept and new features left out.

    Ranks come from range partitions: the count of each range's features moves the ranks of those after it.
    """
    counts = features.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    if known is not None:
        return counts.join(known.select("feature", "id"), "feature")
    ranged = counts.repartitionByRange("feature").sortWithinPartitions("feature").withColumn("place", F.monotonically_increasing_id())
    from ..shared import written

    kept = written(ranged, "features")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return kept.withColumn("part", part).join(F.broadcast(starts), "part").select("feature", "n", (F.col("start") + row + 1).alias("id"))  # a row for each range


def vectors(df: DataFrame, features: DataFrame, ids: DataFrame, truth: str, style: str = "snow") -> DataFrame:
    """seq, pos and line: ``class, id, id:`` (style snow, class by number) or ``CLASS id id`` (style maxent)."""
    lists = features.join(ids.select("feature", "id"), "feature").groupBy("seq", "pos").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    rows = df.select("seq", "pos", F.col(truth).alias("cls")).join(lists, ["seq", "pos"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    if style == "maxent":
        return rows.select("seq", "pos", F.concat_ws(" ", "cls", F.transform("ids", lambda x: x.cast("string"))).alias("line"))
    classes = df.select(F.col(truth).alias("cls")).distinct().withColumn("number", F.row_number().over(Window.orderBy("cls")) - 1)  # a row for each class
    rows = rows.join(F.broadcast(classes), "cls")
    return rows.select("seq", "pos", F.concat(F.concat_ws(", ", F.col("number").cast("string"), F.transform("ids", lambda x: x.cast("string"))), F.lit(":")).alias("line"))
