"""Hard negatives for anchors among labelled vectors: exact search by inner product over k-means inverted lists.

A row's score for an anchor is the inner product of both vectors' integer components. A list holds the rows nearest to
one centroid, the centroid c and the largest distance r of its rows from it, so by Cauchy and Schwarz all its scores lie within
a.c - |a| r and a.c + |a| r. Anchors visit lists by that upper bound, first few, then more: a list whose range misses the
window of scores asked for is skipped, and one whose upper bound is strictly below the kth score found so far can't change anything
(an equal one can: ties go to the smaller id). What is left is compared, block by block, so results are exact.

First each anchor looks for its best rows of the same label, then, for each of these, for the best rows of other labels whose
scores lie in a window below the positive's.

Centroids come from a bounded sample (``FIT_ROWS`` rows, ``FIT_CELLS`` numbers at most), there are ``LISTS`` at most, and every row is
in a list. Lists are cut into blocks of about ``BLOCK_ROWS`` rows, so a list that holds a third of all rows is spread over tasks.

Rows without an id, label or vector, or with a null or non-finite component, take no part. Rows of the same id are different
rows; an anchor is no positive of itself, but its copy is. Shorter vectors count as filled up with zeros, and an empty one scores
0. Scores must fit into 63 bits. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, packed, pick, table, unpacked, written

FIT_ROWS, FIT_CELLS, FIT_TURNS = 16_384, 1 << 22, 8
LISTS = 1024
BLOCK_ROWS = 8192
#: Lists that an anchor visits in its first wave, and how many times as many until the end of each later one.
FIRST, GROWTH = 4, 16
#: Anchors, and goals of anchors, that are compared at once.
ANCHORS_AT_ONCE, GOALS_AT_ONCE = 1024, 64
LOW, HIGH = -(1 << 62), 1 << 62

FOUND = "key bigint, goal int, score bigint, vec_id bigint"


def usable(df: DataFrame) -> DataFrame:
    """vec_id, label and integer vector q of the rows that take part."""
    rows = pick(df, "vec_id", "label", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # Spark holds NaN for more than infinity
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.transform("embedding", lambda x: F.floor(x * 256)).alias("q"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width) if width else np.zeros((len(column), 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; by floating point where all sums are below 2**53."""
    largest = lambda x: float(np.abs(x).max(initial=0))
    if largest(a) * largest(b) * max(1, a.shape[1]) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance from it."""
    near = np.argmin((centroids**2).sum(axis=1) - 2 * (x @ centroids.T), axis=1)
    return near, np.sqrt(((x - centroids[near]) ** 2).sum(axis=1))


def bounds(anchors: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each anchor can have with rows of each list; room for rounding, and none for empty lists."""
    a = anchors.astype(np.float64)
    norm, at = np.sqrt((a**2).sum(axis=1))[:, None], a @ centroids.T
    wide = norm * radius * (1 + 1e-9) + 1e-9 * norm * np.sqrt((centroids**2).sum(axis=1)) + 1e-3
    return np.where(radius < 0, np.inf, at - wide), np.where(radius < 0, -np.inf, at + wide)


def fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids by Lloyd's method; one without rows stays where it is."""
    x = sample.astype(np.float64)
    centroids = np.unique(x[np.random.default_rng(7).permutation(len(x))[:lists]], axis=0)
    for _ in range(FIT_TURNS):
        near, _ = nearest(x, centroids)
        count, sums = np.bincount(near, minlength=len(centroids)), np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return centroids


class Index:
    """Rows by list (``rows``: key, vec_id, label, q, list), packed blocks of them, and each list's centroid, radius and number of blocks."""

    def __init__(self, spark: SparkSession, found: DataFrame, lists: int | None = None):
        total = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("width")).first()
        self.width, n = int(total["width"]), int(total["n"])
        filled = found.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("bigint"), self.width - F.size("q"))))
        sampled = filled.orderBy(F.xxhash64("vec_id", "q")).limit(max(1, min(FIT_ROWS, FIT_CELLS // max(1, self.width)))).select("q").toArrow()
        sample = matrix(sampled.column("q").combine_chunks(), self.width)
        lists = lists or max(1, min(LISTS, len(sample) // 4, round(n**0.5)))
        self.centroids = fitted(sample, lists) if len(sample) and self.width else np.zeros((1, self.width))
        sent, width = spark.sparkContext.broadcast(self.centroids), self.width

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near, far = nearest(matrix(b.column("q"), width).astype(np.float64), sent.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(far)], [*b.schema.names, "list", "far"])

        keyed = filled.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", "q")
        self.rows = written(keyed.mapInArrow(assigned, "key bigint, vec_id bigint, label bigint, q array<bigint>, list int, far double"), "vectors")
        self.radius, self.blocks_of = np.full(len(self.centroids), -1.0), [0] * len(self.centroids)
        for r in self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # LISTS rows at most
            self.radius[r["list"]], self.blocks_of[r["list"]] = r["far"], -(-r["n"] // BLOCK_ROWS)
        of_list = F.get(F.from_json(F.lit(json.dumps(self.blocks_of)), "array<int>"), F.col("list"))
        dealt = self.rows.withColumn("part", F.pmod(F.xxhash64("key"), of_list).cast("int")).repartition("list", "part").sortWithinPartitions("list", "part")
        self.blocks = written(dealt.select("list", "part", "key", "vec_id", "label", "q").mapInArrow(_blocks, "list int, part int, rows binary"), "blocks")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list and part, packed by these."""
    held: list[pa.RecordBatch] = []

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        arrays = [t.column(c).to_numpy() for c in ("key", "vec_id", "label")]
        q = t.column("q").combine_chunks().flatten().to_numpy() if len(t) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([t.column("list").combine_chunks()[:1], t.column("part").combine_chunks()[:1], pa.array([packed(*arrays, q)], pa.binary())], ["list", "part", "rows"])

    now = None
    for b in batches:
        both = np.stack([b.column("list").to_numpy(), b.column("part").to_numpy()])
        cuts = [0, *(np.flatnonzero((np.diff(both) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if held and now != both[:, lo].tolist():
                yield block(held)
                held = []
            now = both[:, lo].tolist()
            held.append(b.slice(lo, hi - lo))
    if held:
        yield block(held)


def _asks(index: Index, first: int, last: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For blocks of the lists that are first to last in an anchor's order: the anchors and goals that need them."""
    centroids, radius, blocks_of, width = index.centroids, index.radius, index.blocks_of, index.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ANCHORS_AT_ONCE):
                b = whole.slice(at, ANCHORS_AT_ONCE)
                key, label, q = b.column("key").to_numpy(), b.column("label").to_numpy(), matrix(b.column("q"), width)
                goals = b.column("goals").flatten()
                low, high, number = (goals.field(n).to_numpy() for n in ("low", "high", "goal"))
                owner = np.repeat(np.arange(len(key)), b.column("goals").value_lengths().to_numpy())
                least, most = bounds(q, centroids, radius)
                order = np.argsort(-most, axis=1, kind="stable")[:, first:last]
                lists, parts, asks = [], [], []
                for k in np.unique(order).tolist():
                    near = (order == k).any(axis=1)
                    need = np.flatnonzero(near[owner] & (low <= high) & (most[owner, k] >= low) & (least[owner, k] <= high))
                    if not len(need):
                        continue
                    own, place = np.unique(owner[need], return_inverse=True)
                    value = packed(key[own], label[own], q[own].reshape(-1), place.astype(np.int64), number[need].astype(np.int64), low[need], high[need])
                    lists += [k] * blocks_of[k]
                    parts += range(blocks_of[k])
                    asks += [value] * blocks_of[k]
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(parts, pa.int32()), pa.array(asks, pa.binary())], ["list", "part", "asks"])

    return run


def _hits(width: int, same: bool, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best rows of a block for each goal that needs it."""

    def best(key, label, q, owner, number, low, high, row, vec_id, row_label, x) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(owner), GOALS_AT_ONCE):
            part = slice(at, at + GOALS_AT_ONCE)
            own, place = np.unique(owner[part], return_inverse=True)
            score = products(q.reshape(-1, width)[own], x)[place]
            mine = owner[part]
            fits = (score >= low[part, None]) & (score <= high[part, None]) & ((row_label == label[mine, None]) == same) & (row != key[mine, None])
            goal, j = np.nonzero(fits)
            s = score[goal, j]
            order = np.lexsort((vec_id[j], -s, goal))
            goal, j, s = goal[order], j[order], s[order]
            rank = np.arange(len(goal)) - np.searchsorted(goal, goal)
            top = rank < k
            yield pa.RecordBatch.from_arrays([pa.array(key[mine[goal[top]]]), pa.array(number[part][goal[top]].astype(np.int32)), pa.array(s[top]), pa.array(vec_id[j[top]])], ["key", "goal", "score", "vec_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asks, rows in zip(b.column("asks"), b.column("rows")):
                row, vec_id, row_label, x = unpacked(rows.as_py(), *[np.int64] * 4)
                yield from best(*unpacked(asks.as_py(), *[np.int64] * 7), row, vec_id, row_label, x.reshape(len(row), width))

    return run


def searched(index: Index, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """key, goal, score, vec_id and rank: the k best rows of the same label, or of others, for each goal of the anchors.

    anchors: key, label, q and goals, each with its number and the least and greatest score that it takes.
    """
    best = Window.partitionBy("key", "goal").orderBy(F.desc("score"), "vec_id")
    found, first, last = None, 0, FIRST
    while first < len(index.centroids):
        asking = anchors
        if found is not None:  # what isn't as good as the kth so far is of no use
            kth = found.groupBy("key", "goal").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
            bars = kth.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("goal", "kth"))).alias("bars"))
            raised = F.transform("goals", lambda g: F.struct(g["goal"].alias("goal"), F.greatest(g["low"], F.try_element_at("bars", g["goal"])).alias("low"), g["high"].alias("high")))
            asking = anchors.join(bars, "key", "left").withColumn("goals", raised)
        asks = asking.select("key", "label", "q", "goals").mapInArrow(_asks(index, first, last), "list int, part int, asks binary")
        hits = asks.join(index.blocks, ["list", "part"]).select("asks", "rows").mapInArrow(_hits(index.width, same, k), FOUND)
        hits = hits if found is None else hits.unionByName(found.drop("rank"))
        before, found = found, written(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "found")
        if before is not None:
            dropped(before)
        first, last = last, last * GROWTH
    return found


def hard_negatives(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80, lists: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    df: vec_id, label and embedding; ``is_anchor`` says of a row's vec_id and label whether it is an anchor. Of each anchor the best
    ``positives`` other rows of its label, and for each of these the best ``negatives`` rows of other labels with
    least_percent * positive_score <= 100 * negative_score <= 100 * positive_score. ``lists``: how many, by default the root of the rows.
    """
    index = Index(df.sparkSession, usable(df), lists)
    anchors = index.rows.where(is_anchor).select("key", "vec_id", "label", "q")
    bound = lambda v, name: F.lit(v).cast("bigint").alias(name)
    any_score = F.array(F.struct(F.lit(0).alias("goal"), bound(LOW, "low"), bound(HIGH, "high")))
    near = searched(index, anchors.withColumn("goals", any_score), True, positives)
    low = F.expr(f"CAST(-floor(-score * {least_percent}BD / 100) AS BIGINT)")  # decimals: exact
    pairs = near.select("key", F.col("rank").alias("goal"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), low.alias("low"))
    goals = pairs.groupBy("key").agg(F.collect_list(F.struct("goal", "low", F.col("positive_score").alias("high"))).alias("goals"))
    found = searched(index, anchors.join(goals, "key"), False, negatives)
    out = found.select("key", "goal", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["key", "goal"]).join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_inverted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: every hundredth id. Of every seventh id the label is one off, modulo ten."""
    rows = pick(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP12_SQL = """WITH rows_ AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, row_number() OVER () AS key
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.key, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.key <> b.key
), positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS "rank", n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.key = p.key AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.key, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 5"""
