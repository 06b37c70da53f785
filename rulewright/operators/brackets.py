"""Spans from the probabilities of an opening and a closing bracket at each token."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import by_seq


#: Logarithms of probabilities that differ by less are equal: sums of the same ones in another order do.
TIE = 1e-9


def shortest_spans(df: DataFrame, weight: float = 0.5) -> DataFrame:
    """df (seq, pos, p_open, p_close) with ``label`` (O, B, I, E): a token with p_close of at least ``weight`` closes the last
    token that could open since the close before it."""
    opens, closes = F.col("p_open") >= weight, F.col("p_close") >= weight
    before = by_seq().rowsBetween(Window.unboundedPreceding, -1)
    segment = F.coalesce(F.count_if(closes).over(before), F.lit(0))
    rows = df.withColumn("_seg", segment)
    upto = Window.partitionBy("seq", "_seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.max(F.when(opens, F.col("pos"))).over(upto)
    end = F.max(F.when(closes, F.col("pos"))).over(upto)
    rows = rows.withColumns({"_start": start, "_end": end})
    inside = F.col("_end").isNotNull() & (F.col("pos") >= F.col("_start"))
    label = F.when(~F.coalesce(inside, F.lit(False)), "O").when(F.col("pos") == F.col("_start"), "B").when(F.col("pos") == F.col("_end"), "E").otherwise("I")
    return rows.withColumn("label", label).drop("_seg", "_start", "_end")


def best_spans(df: DataFrame, lengths: dict[int, float] | None = None, longest: int | None = None) -> DataFrame:
    """df with ``label``: the most probable set of spans that don't overlap, by one sweep over each sequence.

    A span costs its opening, its closing and what lies inside without brackets, times the prior of its length; other
    tokens their having none. Spans have at most ``longest`` tokens; None: any number. Without prior and limit, the best opening
    so far is kept, which is linear; else all starts are tried. Of equally probable ones, no span comes before a span and a longer
    span before a shorter one. A sequence is the unit of work.
    """

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", ignore_index=True)
        p, q, n = group["p_open"].clip(1e-12, 1 - 1e-12), group["p_close"].clip(1e-12, 1 - 1e-12), len(group)
        lo, lc = [math.log(x) for x in p], [math.log(x) for x in q]
        no, nc = [math.log(1 - x) for x in p], [math.log(1 - x) for x in q]
        free = [0.0]
        for a, b in zip(no, nc):
            free.append(free[-1] + a + b)
        best, came = [0.0] + [-math.inf] * n, [-1] * (n + 1)
        start, value = -1, -math.inf  # the best opening at least two tokens back, but for what follows it
        for j in range(1, n + 1):  # best labelling of the first j tokens
            best[j], came[j] = best[j - 1] + no[j - 1] + nc[j - 1], -1
            if lengths is None and longest is None:
                if j > 1 and best[j - 2] + lo[j - 2] + nc[j - 2] - free[j - 1] > value + TIE:
                    start, value = j - 2, best[j - 2] + lo[j - 2] + nc[j - 2] - free[j - 1]
                starts = [start, j - 1] if start >= 0 else [j - 1]
            else:
                starts = range(0 if longest is None else max(0, j - longest), j)
            for i in starts:
                prior = 0.0 if lengths is None else math.log(max(lengths.get(j - i, 0.0), 1e-12))
                ends = lo[i] + lc[i] if j - i == 1 else lo[i] + nc[i] + no[j - 1] + lc[j - 1] + free[j - 1] - free[i + 1]
                if best[i] + ends + prior > best[j] + TIE:
                    best[j], came[j] = best[i] + ends + prior, i
        labels, j = ["O"] * n, n
        while j > 0:
            if came[j] < 0:
                j -= 1
                continue
            i = came[j]
            labels[i:j] = ["B"] + ["I"] * max(0, j - i - 2) + (["E"] if j - i > 1 else [])
            j = i
        group["label"] = labels
        return group

    from pyspark.sql import types as T

    return df.groupBy("seq").applyInPandas(solve, T.StructType([*df.schema.fields, T.StructField("label", T.StringType())]))
