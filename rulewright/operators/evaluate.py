"""Evaluation: accuracy, precision and recall of spans, marks and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import by_seq, is_right
from ..plans.spec import TaskSchema


def accuracy(df: DataFrame, schema: TaskSchema) -> DataFrame:
    """state, total, correct and accuracy (percent; null without rows) of each state."""
    rows = None
    for s, t in zip(schema.states, schema.truths):
        right = F.coalesce(is_right(schema, F.col(s), t), F.lit(False))
        one = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(right).alias("correct")).select(F.lit(s).alias("state"), "total", "correct", (F.when(F.col("total") > 0, 100.0 * F.col("correct") / F.col("total"))).alias("accuracy"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def spans(df: DataFrame, label: str) -> DataFrame:
    """seq, first and last of each span: it begins at the first label other than O, or at one that begins with B, and ends
    before O or the next beginning; what follows the B or I doesn't matter."""
    own, before = F.col(label), F.lag(label).over(by_seq())
    inside = own != "O"
    begins = inside & (before.isNull() | (before == "O") | own.startswith("B"))
    runs = df.select("seq", "pos", inside.alias("inside"), begins.cast("int").alias("begins")).withColumn("span", F.sum("begins").over(by_seq()))
    return runs.where("inside").groupBy("seq", "span").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("span")


def f_measure(df: DataFrame, guess: str, truth: str) -> DataFrame:
    """guessed, expected, correct, precision, recall and f (percent) over all spans."""
    found, real = spans(df, guess), spans(df, truth)
    both = found.join(real, ["seq", "first", "last"], "left_semi").agg(F.count(F.lit(1)).alias("correct"))
    sums = found.agg(F.count(F.lit(1)).alias("guessed")).crossJoin(real.agg(F.count(F.lit(1)).alias("expected"))).crossJoin(both)  # a row each
    p, r = 100.0 * F.col("correct") / F.col("guessed"), 100.0 * F.col("correct") / F.col("expected")
    some = lambda n, c: F.when(F.col(n) > 0, c).otherwise(0.0)
    sums = sums.withColumn("precision", some("guessed", p)).withColumn("recall", some("expected", r))
    return sums.withColumn("f", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def marked(df: DataFrame, schema: TaskSchema, right: str = "1", wrong: str = "0") -> DataFrame:
    """df with ``mark``: are all states of the row right?"""
    ok: Column = F.lit(True)
    for s, t in zip(schema.states, schema.truths):
        ok = ok & F.coalesce(is_right(schema, F.col(s), t), F.lit(False))
    return df.withColumn("mark", F.when(ok, right).otherwise(wrong))


def numbered_samples(df: DataFrame, start: int = 0) -> DataFrame:
    """df with ``sample``: the row's number in its sequence."""
    return df.withColumn("sample", F.row_number().over(by_seq()) - 1 + start)


def trace_counts(df: DataFrame) -> DataFrame:
    """rule and n: on how many rows each rule fired, from the traces."""
    return df.select(F.explode("trace").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def numbered_rules(lines: DataFrame) -> DataFrame:
    """rule (as traces have it) and value of the lines of a rule file (file, line and value; # begins a comment, as in rule files)."""
    rules = lines.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    return rules.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1).alias("rule"), "value")
