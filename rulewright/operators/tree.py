"""Class probabilities from rule traces: samples are split by which rules fired, large leaves further by single features."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import dropped, written


@dataclass
class Node:
    """A split (``rule``: did it fire; or ``feature`` and ``value``: are they equal) with yes and no, or a leaf with counts."""

    rule: int | None = None
    feature: str | None = None
    value: str | None = None
    yes: Node | None = None
    no: Node | None = None
    leaf: int | None = None
    counts: dict[str, int] = field(default_factory=dict)

    def probabilities(self, classes: int, smooth: float = 0.1, least: float = 1e-6) -> dict[str, float]:
        total = sum(self.counts.values())
        p = {c: (n + smooth) / (total + classes * smooth) for c, n in self.counts.items()}
        return dict(sorted(((c, x) for c, x in p.items() if x >= least), key=lambda x: (-x[1], x[0])))

    def to_json(self) -> str:
        """A line for each node, its children by number: rule lists make trees too deep to be written one within the other."""
        nodes = _nodes(self)
        at = {id(n): i for i, n in enumerate(nodes)}
        return json.dumps([{k: at[id(v)] if isinstance(v, Node) else v for k, v in n.__dict__.items() if v not in (None, {})} for n in nodes])

    @classmethod
    def from_json(cls, text: str) -> Node:
        rows = json.loads(text)
        nodes = [cls() for _ in rows]
        for node, row in zip(nodes, rows):
            node.__dict__.update({k: nodes[v] if k in ("yes", "no") else v for k, v in row.items()})
        return nodes[0]


def _nodes(root: Node) -> list[Node]:
    """All nodes, each before what is below it, yes before no."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [n for n in (node.no, node.yes) if n is not None]
    return out


def leaf_of(node: Node) -> Column:
    """The number of the leaf that a row (with ``trace`` and features) comes to: a CASE for each run of no-branches."""
    found = None
    while node.leaf is None:
        test = F.array_contains("trace", node.rule) if node.rule is not None else F.col(node.feature) == node.value
        found = F.when(test, leaf_of(node.yes)) if found is None else found.when(test, leaf_of(node.yes))
        node = node.no
    return F.lit(node.leaf) if found is None else found.otherwise(F.lit(node.leaf))


def _leaves(root: Node) -> list[Node]:
    return [n for n in _nodes(root) if n.leaf is not None]


def _number(root: Node) -> dict[int, Node]:
    found = _leaves(root)
    for i, x in enumerate(found):
        x.leaf = i
    return dict(enumerate(found))


def _split_rules(df: DataFrame, least: int) -> Node:
    """Samples split by rules in order, where both sides have ``least`` samples or more.

    A round splits all open leaves at once, each by the first rule after its last one that can; so there are as many
    rounds as a sample has splits at most. Rounds run over distinct traces with their counts, which stay in Spark: what
    comes back is a rule for each leaf that is split.
    """
    spark, root = df.sparkSession, Node(leaf=0)
    used = df.select(F.explode(F.array_distinct("trace")).alias("_rule")).groupBy("_rule").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("_rule")
    raw = df.groupBy(F.array_sort(F.array_distinct("trace")).alias("_raw")).agg(F.count(F.lit(1)).alias("n"))
    marked = raw.select("_raw", "n", F.explode("_raw").alias("_rule")).join(used, "_rule").groupBy("_raw", "n").agg(F.sort_array(F.collect_list("_rule")).alias("t"))
    traces = marked.groupBy("t").agg(F.sum("n").alias("n"))
    every = df.count()
    traces = written(traces.withColumn("leaf", F.lit(0)), "traces")  # samples without such a rule only count
    open_leaves, sizes, number = {0: root}, {0: every}, 0
    while open_leaves:
        fired = traces.select("leaf", "n", F.explode("t").alias("rule")).groupBy("leaf", "rule").agg(F.sum("n").alias("yes"))
        total = spark.createDataFrame(list(sizes.items()), "leaf int, total long")
        can = fired.join(total, "leaf").where((F.col("yes") >= least) & (F.col("total") - F.col("yes") >= least))
        splits = can.groupBy("leaf").agg(F.min_by(F.struct("rule", "yes"), "rule").alias("s")).select("leaf", "s.*").collect()
        moves, open_next, sizes_next = [], {}, {}
        for r in splits:
            node = open_leaves[r.leaf]
            node.leaf, node.rule, node.yes, node.no = None, r.rule, Node(leaf=-1), Node(leaf=-1)
            for side, n in ((node.yes, r.yes), (node.no, sizes[r.leaf] - r.yes)):
                number += 1
                open_next[number], sizes_next[number] = side, n
            moves.append((r.leaf, r.rule, number - 1, number))
        if moves:
            # Rows of leaves that aren't split any more, and rules up to a leaf's last one, are done with.
            table = spark.createDataFrame(moves, "leaf int, rule int, yes int, no int")
            moved = traces.join(table, "leaf").select(
                F.filter("t", lambda x: x > F.col("rule")).alias("t"), "n", F.when(F.array_contains("t", F.col("rule")), F.col("yes")).otherwise(F.col("no")).alias("leaf")
            ).where(F.size("t") > 0)
            after = written(moved.groupBy("leaf", "t").agg(F.sum("n").alias("n")).select("t", "n", "leaf"), "traces")
            dropped(traces)
            traces = after
        open_leaves, sizes = open_next, sizes_next
    dropped(traces)
    return root


def grow(df: DataFrame, truth: str, n_rules: int, features: list[str] = (), least: int = 10, least_feature: int = 10, gain: float = 0.05, depth: int = 3) -> Node:
    """A tree for samples with ``trace``: split by rules, then by features. Each round of the latter finds, in one
    aggregation over all leaves, the feature value that lowers each leaf's entropy most, and splits there if by at least
    ``gain`` bits. Gains are compared to nine places; of equal ones the last feature and value count. Null features,
    states and traces: a null equals no value, and a null trace has no rule. No samples: one leaf without counts.
    ``n_rules`` isn't needed and stays for callers' sake."""
    root = _split_rules(df, least)
    for _ in range(depth if features else 0):
        leaves = _number(root)
        at = df.withColumn("leaf", leaf_of(root))
        cls = at.groupBy("leaf", F.col(truth).alias("cls")).agg(F.count(F.lit(1)).alias("all"))
        pairs = at.select("leaf", F.col(truth).alias("cls"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in features])).alias("x"))
        yes = pairs.groupBy("leaf", "x", "cls").agg(F.count(F.lit(1)).alias("yes"))
        sizes = yes.groupBy("leaf", "x").agg(F.sum("yes").alias("t_yes")).join(cls.groupBy("leaf").agg(F.sum("all").alias("t")), "leaf")
        sizes = sizes.where((F.col("t_yes") >= least_feature) & (F.col("t") - F.col("t_yes") >= least_feature))
        cells = sizes.join(cls, "leaf").join(yes, ["leaf", "x", "cls"], "left").withColumn("yes", F.coalesce("yes", F.lit(0)))
        part = lambda n, t: F.sum(F.when(F.col(n) > 0, F.col(n) * F.log2(F.col(t) / F.col(n))).otherwise(0.0))
        cells = cells.withColumn("no", F.col("all") - F.col("yes")).withColumn("t_no", F.col("t") - F.col("t_yes"))
        gains = cells.groupBy("leaf", "x", "t").agg(((part("all", "t") - part("yes", "t_yes") - part("no", "t_no")) / F.first("t")).alias("_g")).withColumn("gain", F.round("_g", 9))
        best = gains.groupBy("leaf").agg(F.max_by(F.struct("x", "gain"), F.struct("gain", "x")).alias("b")).where(F.col("b.gain") >= gain).collect()
        for r in best:
            n = leaves[r.leaf]
            n.leaf, n.feature, n.value, n.yes, n.no = None, r.b.x.f, r.b.x.v, Node(leaf=-1), Node(leaf=-1)
        if not best:
            break
    leaves = _number(root)
    for r in df.groupBy(leaf_of(root).alias("leaf"), F.col(truth).alias("cls")).agg(F.count(F.lit(1)).alias("n")).collect():
        leaves[r.leaf].counts[r.cls] = r.n
    return root


def classified(df: DataFrame, root: Node, classes: int, smooth: float = 0.1) -> DataFrame:
    """df with ``leaf`` and ``probabilities`` (class to p)."""
    spark = df.sparkSession
    table = spark.createDataFrame([(x.leaf, x.probabilities(classes, smooth)) for x in _leaves(root)], "leaf int, probabilities map<string,double>")
    return df.withColumn("leaf", leaf_of(root)).join(F.broadcast(table), "leaf")  # a row for each leaf of a tree that the driver holds
