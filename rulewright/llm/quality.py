"""Quality rules with risk-controlled thresholds.

The rules reject a document of which some measure lies above its cutoff. Cutoffs are tried together, in a fixed order of levels
from lenient to strict. Labelled documents are the holdout: for each stratum and level an exact binomial test asks whether the
rules falsely reject good documents at a rate above RISK. In a stratum levels are tested in their order until one fails, which
needs no correction among them (fixed sequence); over strata the level of the tests is corrected by Holm's steps: it is shared
out evenly, and what a stratum has that passes all its levels goes to the others. So with confidence 1 - DELTA, in every
stratum the rules reject at most the share RISK of good documents, whichever of the levels that passed is taken: the one with
the most rejected bad documents for its good ones. A stratum with too few labels for a bound has no cutoffs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, Words, appended, buffers, mix, pick, restored, rolling, span_hash, steps, table, written

RISK, DELTA = 0.05, 0.05
#: A falsely rejected good document weighs as much as so many rejected bad ones.
WEIGHT = 10
#: Cutoffs of each measure at each level, the most lenient first.
CUTOFFS = {
    "symbol_share": [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35],
    "repeat_share": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "mean_word_chars": [30.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.0, 8.0],
}
LEVELS = 8
#: Strata that are few enough to send their cutoffs to every task; with more, a shuffle brings them together.
FEW_STRATA = 10_000
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """COUNTS of each text, by column."""
    n = len(at) - 1
    w = Words(raw, at, SPACED, lower=False)
    by_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    chars, symbols = by_text(((raw & 0xC0) != 0x80) & w.inside), by_text(_SYMBOL[raw])
    # windows of three words that their text has twice
    three = rolling(w.hash, 3)
    own = np.flatnonzero(w.doc[: len(three)] == w.doc[len(w.doc) - len(three) :]) if len(three) else np.zeros(0, np.int64)
    keys = mix(three[own] + mix(w.doc[own].astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = own[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(order) else own
    repeated = np.zeros(len(w.start) + 2, bool)
    for j in range(3):
        repeated[twice + j] = True
    repeats = np.bincount(w.doc[repeated[: len(w.start)]], minlength=n)
    # lines with a word
    begin = np.unique(np.concatenate([at[:-1], np.flatnonzero(raw == 10) + 1]))
    begin = begin[begin < len(raw)]
    end = np.concatenate([begin[1:], [len(raw)]]).astype(np.int64)
    if len(begin):
        end -= raw[end - 1] == 10
    full = np.unique(np.searchsorted(begin, w.start, "right") - 1)
    lines = span_hash(raw, begin[full], end[full] - begin[full])
    line_doc = np.searchsorted(at, begin[full], "right") - 1
    n_lines = np.bincount(line_doc, minlength=n)
    _, first = np.unique(mix(lines + mix(line_doc.astype(np.uint64))), return_index=True)
    dups = n_lines - np.bincount(line_doc[first], minlength=n)
    return np.stack([w.count, chars, symbols, dups, repeats, n_lines])


def _measures(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return df.select(
        "*", share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"), share("word_chars", "n_words").alias("mean_word_chars")
    )


def _texts_counts(texts: pa.Array) -> list[pa.Array]:
    raw, at = buffers(texts)
    found = [_counts(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for lo, hi in steps(at)]
    counts = np.concatenate(found, axis=1) if found else np.zeros((len(COUNTS), 0), np.int64)
    return [pa.array(c.astype(np.int64)) for c in counts]


def counted(df: DataFrame, text_col: str) -> DataFrame:
    """df's columns as c0, c1 .., the counts of COUNTS and the measures of CUTOFFS. Null or empty text: all 0."""
    return _measures(appended(df, text_col, _texts_counts, ", ".join(f"{c} long" for c in COUNTS)))


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum, counts and measures for each row."""
    found = counted(pick(df, id_col, stratum_col, text_col), text_col)
    return found.select(F.col("c0").alias(id_col), F.col("c1").alias("stratum"), *COUNTS, *CUTOFFS)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_tail(k: int, n: int, p: float) -> float:
    """ln P(X <= k) for X binomial of n and p; 0 where k lies at the mean or above, as no bound can pass there."""
    if n <= 0 or k >= n * p:
        return 0.0
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total = term = 1.0
    for i in range(k, 0, -1):  # each term is smaller than the one before
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < 1e-18 * total:
            break
    return top + math.log(total)


def thresholds(measures: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """A row for each stratum: n_good, n_bad, and a cutoff for each measure (null where no level passes).

    ``labels`` may repeat an id: one good label makes it good. Null ids and null labels don't count. Only documents that
    pass the base rules take part, as only they can be rejected by a cutoff.
    """
    known = pick(labels, id_col, good_col).toDF("_id", "good").where("_id is not null and good is not null").groupBy("_id").agg(F.max("good").alias("good"))
    held = measures.where(~base_failed()).join(known, F.col(id_col) == F.col("_id"))
    good = F.col("good") > 0
    rejects = [reduce(Column.__or__, [F.col(m) > cuts[i] for m, cuts in CUTOFFS.items()]) for i in range(LEVELS)]
    counts = [F.count_if(good).alias("n_good"), F.count_if(~good).alias("n_bad")]
    counts += [F.count_if(good & x).alias(f"good_{i}") for i, x in enumerate(rejects)] + [F.count_if(~good & x).alias(f"bad_{i}") for i, x in enumerate(rejects)]
    tallies = held.groupBy("stratum").agg(*counts)
    kind = tallies.schema["stratum"].dataType.simpleString()

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["stratum", "n_good", "n_bad"]].copy()
            # a level passes if it and all before it do
            worst = np.maximum.accumulate([[log_tail(int(g), int(n), risk) for g, n in zip(b[f"good_{i}"], b["n_good"])] for i in range(LEVELS)], axis=0)
            for i in range(LEVELS):
                out[f"log_p_{i}"] = worst[i]
                out[f"gain_{i}"] = b[f"bad_{i}"] - WEIGHT * b[f"good_{i}"]
            yield out

    kept = written(tallies.mapInPandas(tested, f"stratum {kind}, n_good long, n_bad long, " + ", ".join(f"log_p_{i} double, gain_{i} long" for i in range(LEVELS))), "tallies")
    strata, through, before = max(1, kept.count()), 0, -1
    while through not in (before, strata):  # Holm: strata that pass all levels leave their share to the others
        before, through = through, kept.where(F.col(f"log_p_{LEVELS - 1}") <= math.log(delta / (strata - through))).count()
    bound = math.log(delta / max(1, strata - through))
    gains = F.array(*[F.when((F.col(f"log_p_{i}") <= bound) & (F.col(f"gain_{i}") > 0), F.struct(F.col(f"gain_{i}").alias("gain"), F.lit(-i).alias("level"))) for i in range(LEVELS)])
    level = -F.array_max(gains)["level"]
    cut = lambda cuts: F.coalesce(*[F.when(level == i, F.lit(c)) for i, c in enumerate(cuts)])
    found = kept.select("stratum", "n_good", "n_bad", *[cut(cuts).alias(f"cut_{m}") for m, cuts in CUTOFFS.items()])
    return F.broadcast(found) if strata <= FEW_STRATA else found


def judged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, counts, measures, base_failed, rejected_by (the first measure above its cutoff) and kept for each row of df.

    Base rules: under 50 words, or over half of the words in repeated windows of three. Null or empty texts fail them.
    A null stratum is a stratum like others; null ids have no label but are judged; repeated rows are judged alike; no
    labels: base rules only; an empty table gives an empty one. Other columns are ignored.
    """
    rows = written(measured(df, id_col, text_col, stratum_col), "measures")
    cuts = thresholds(rows, labels, id_col).withColumnRenamed("stratum", "_stratum").drop("n_good", "n_bad")
    joined = rows.join(cuts, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    first = F.coalesce(*[F.when(F.col(m) > F.col(f"cut_{m}"), F.lit(m)) for m in CUTOFFS])
    return joined.select(id_col, "stratum", *COUNTS, *CUTOFFS, base_failed().alias("base_failed"), first.alias("rejected_by"), (~base_failed() & first.isNull()).alias("kept"))


def cleaned(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of df that judged() keeps, with all their columns."""
    names = list(df.columns)
    cuts = thresholds(written(measured(df, id_col, text_col, stratum_col), "measures"), labels, id_col).drop("n_good", "n_bad")
    stratum = F.col(f"c{names.index(stratum_col)}")
    joined = counted(df, text_col).join(cuts, stratum.eqNullSafe(F.col("stratum")), "left")
    over = F.coalesce(*[F.when(F.col(m) > F.col(f"cut_{m}"), F.lit(m)) for m in CUTOFFS])
    return restored(joined.where(~base_failed() & over.isNull()), names)


def op1_risk_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
