"""Sharding along a Hilbert curve: quantised metadata dimensions, sorted by curve index, cut into runs.

Neighbours on the curve are near in every dimension, so each run of rows spans a small range of each of them and a
reader can skip whole shards by the minima and maxima of any dimension.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import pick, shuffle_partitions, table, written

BITS, SHARDS = 4, 40
#: Accuracy of the quantiles that cut a dimension; only the curve's fairness depends on it.
ACCURACY = 1000


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of coordinates below 2**bits (rows x dimensions), by bit-plane exchange and Gray code."""
    x = axes.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap if i else np.uint64(0)
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = one << np.uint64(bits - 1)
    while q > one:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def text_limits(df: DataFrame, col: str, n: int) -> list[str]:
    """Up to n values that cut a text dimension into parts of like size: those at n places of all whole values in order. Counts of
    values are sorted by ranges; a row for each range says how many rows stand before it."""
    spark = df.sparkSession
    counts = df.select(F.col(col).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange(shuffle_partitions(spark), "v").sortWithinPartitions("v")
    kept = written(ranged.withColumn("place", F.monotonically_increasing_id()), "values").withColumn("part", F.shiftright("place", 33))
    sizes = kept.groupBy("part").agg(F.sum("n").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy("place"))
    summed = kept.join(F.broadcast(starts), "part").withColumn("upto", upto).crossJoin(F.broadcast(total))
    held = F.expr(f"exists(sequence(1L, {n}L), i -> (total * i) div {n + 1} >= upto - n and (total * i) div {n + 1} < upto)")
    return sorted((r["v"] for r in summed.where(held).select("v").collect()), key=str.encode)  # n rows at most


def _number(df: DataFrame, col: str, kind: T.DataType, parts: int) -> Column:
    """A number that keeps the order; of text, how many limits lie at or below the whole value."""
    if isinstance(kind, T.StringType):
        reached = [F.when(F.col(col) >= F.lit(x), 1).otherwise(0) for x in text_limits(df, col, parts - 1)]
        return F.when(F.col(col).isNotNull(), sum(reached, F.lit(0)) + 1).cast("double")
    return F.col(col).cast("double")


def hilbert_shards(df: DataFrame, id_col: str, text_col: str, dims: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """A row for each row of df: id, size (UTF-8 bytes of the text, 16 more), text_crc32, hilbert, shard and slot.

    Law ``rows``: shards hold equally many rows, or one more. Each dimension is cut at its quantiles into up to 2**bits
    parts; nulls (and NaN) come first, in a part with the least values. Rows of equal index are ordered by the text's
    crc32, then id, so equal texts of equal metadata stay together. Null text: no bytes, crc32 0; null ids and repeated
    rows are rows like others; fewer rows than shards leave shards empty; an empty table gives an empty one. Other
    columns are ignored.
    """
    spark = df.sparkSession
    got = pick(df, id_col, text_col, *dims).toDF("id", "text", *[f"d{i}" for i in range(len(dims))])
    kinds = [got.schema[f"d{i}"].dataType for i in range(len(dims))]
    rows = got.select(
        "id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        *[F.nanvl(_number(got.drop("text"), f"d{i}", k, 1 << bits), F.lit(None).cast("double")).alias(f"d{i}") for i, k in enumerate(kinds)],
    )
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = rows.agg(*[F.percentile_approx(f"d{i}", at, ACCURACY).alias(f"q{i}") for i in range(len(dims))]).first()
    cuts = [np.unique(np.array(q if q is not None else [], float)) for q in cuts]

    @F.pandas_udf("long")
    def curve(*dim: pd.Series) -> pd.Series:
        axes = np.stack([np.where(np.isnan(v), 0, np.searchsorted(q, v, "right")) for v, q in zip((d.to_numpy(float, na_value=np.nan) for d in dim), cuts)], axis=1)
        return pd.Series(hilbert_index(np.minimum(axes, (1 << bits) - 1), bits))

    placed = rows.select("id", "size", "text_crc32", curve(*[f"d{i}" for i in range(len(dims))]).alias("hilbert"))
    # The row's number in its range, and the range's, are kept with it in the written table; sums of the ranges' sizes make them ranks.
    order = ["hilbert", "text_crc32", "id", F.xxhash64("id", "size")]
    ranged = placed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    kept = written(ranged.withColumn("place", F.monotonically_increasing_id()), "hilbert")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    ranked = kept.withColumn("part", part).join(F.broadcast(starts), "part").crossJoin(F.broadcast(total)).withColumn("rank", F.col("start") + row)
    shard = F.expr(f"(rank * {shards}) div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select(
        F.col("id").alias(id_col), "size", "text_crc32", "hilbert", F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot")
    )


def write_shards(df: DataFrame, layout: DataFrame, id_col: str, path: str) -> None:
    """The rows of df as Parquet, a folder for each shard, in the order of the slots. Ids have to be unique and not null."""
    at = layout.select(F.col(id_col).alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    joined = df.join(at, F.col(id_col) == F.col("_id")).drop("_id")
    joined.repartitionByRange(SHARDS, "_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot").withColumnRenamed("_shard", "shard").write.partitionBy("shard").parquet(path)


def shard_ranges(df: DataFrame, layout: DataFrame, id_col: str, dims: list[str]) -> DataFrame:
    """Least and greatest value of each dimension by shard: what a reader prunes files with."""
    values = pick(df, id_col, *dims).toDF("_id", *[f"d{i}" for i in range(len(dims))])
    found = [f(f"d{i}").alias(f"{n}_{d}") for i, d in enumerate(dims) for n, f in (("min", F.min), ("max", F.max))]
    at = layout.select(F.col(id_col).alias("_of"), "shard")
    return values.join(at, F.col("_id") == F.col("_of")).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *found)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hilbert_shards(table(spark, sf_dir, "documents"), "doc_id", "text", ["doc_id", "source", "lang", "n_chars"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
