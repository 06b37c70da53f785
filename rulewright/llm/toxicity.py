"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

Every labelled text for learning counts, over all its n-grams, in how many toxic and other texts each hashed n-gram stands.
The scale of a feature is the log of the ratio of these counts to those that would be expected if it told nothing, toxic
against other; SMOOTH is added to each count. No n-gram is left out. Logistic regression on the scaled features, with equal
weight for both classes, is fitted to a bounded sample of the same labelled texts, in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, doc_remainder, packed, pick, restored, table, unpacked

ORDERS, BITS = (3, 4, 5), 20
#: Added to the counts of an n-gram and to those expected: n-grams of few texts are drawn to a ratio of 1.
SMOOTH = 32.0
#: Labelled texts that the regression is fitted to, at most (a quarter toxic), and n-grams of these texts: a hash of the id chooses them.
FIT_ROWS, FIT_GRAMS = 1_600, 6_000_000
#: Labels that are sent to every task; with more, labels and texts are shuffled together.
SENT_LABELS = 1_000_000
PENALTY, ROUNDS, PARTS = 1e-4, 40, 64
#: Characters of a text that are worked on at once.
PIECE = 1 << 19
_K = np.uint64(0x9E3779B97F4A7C15)


def _grams(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    found, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * _K + c[n - 1 :]
        if n in ORDERS:
            x = h ^ (h >> np.uint64(29))
            found.append((x * _K >> np.uint64(64 - BITS)).astype(np.int32))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def grams(text: str | None) -> np.ndarray:
    """The different hashes (below 2**BITS) of the character n-grams of a text, in lower case and with single spaces around words."""
    text = text or ""
    found, tail, gap = [], "", True
    for lo in range(0, max(1, len(text)), PIECE):
        piece = text[lo : lo + PIECE]
        words = " ".join(piece.lower().split())
        between = " " if gap or piece[:1].isspace() else ""
        gap, end = piece[-1:].isspace(), " " if lo + PIECE >= len(text) else ""
        if words:
            joined = tail + between + words
            found.append(_grams(joined + end))
            tail = joined[1 - max(ORDERS) :]
        elif end:
            found.append(_grams(tail + end) if tail else _grams("  "))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, text and toxic (0 or 1) of the rows to learn from: those with a label and a remainder other than 0."""
    known = pick(labels, id_col, label_col).toDF("_id", "toxic").where("_id is not null and toxic is not null").groupBy("_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    if known.count() <= SENT_LABELS:
        known = F.broadcast(known)
    rows = pick(docs, id_col, text_col).toDF("id", "text").where(doc_remainder(F.col("id"), 5) != 0)
    return rows.join(known, F.col("id") == F.col("_id")).select("id", "text", "toxic")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int32)
    for b in batches:
        for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
            counts[toxic, grams(text.as_py())] += 1
    size = (1 << BITS) // PARTS
    at = [np.flatnonzero(counts[:, p * size : (p + 1) * size].any(axis=0)).astype(np.int32) for p in range(PARTS)]
    blobs = [packed(x, *(counts[k, p * size : (p + 1) * size][x] for k in (0, 1))) for p, x in enumerate(at)]
    yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], ["part", "counts"])


def log_ratio(other: np.ndarray, toxic: np.ndarray, n_other: int, n_toxic: int) -> np.ndarray:
    """The scale of n-grams that stand in so many other and toxic texts of all those labelled."""
    both, n = other + toxic, n_other + n_toxic
    return np.log((toxic + SMOOTH) / (both * (n_toxic / n) + SMOOTH)) - np.log((other + SMOOTH) / (both * (n_other / n) + SMOOTH))


def ratios(rows: DataFrame, n_other: int, n_toxic: int) -> DataFrame:
    """part and ratios (packed: features and their ratios) of all n-grams, from counts over all rows."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, sums = (1 << BITS) // PARTS, {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1)):
                at, other, toxic = unpacked(blob.as_py(), np.int32, np.int32, np.int32)
                s = sums.setdefault(part, np.zeros((2, size), np.int64))
                s[0, at] += other
                s[1, at] += toxic
        for part, (other, toxic) in sums.items():
            at = np.flatnonzero(other + toxic)
            ratio = log_ratio(other[at], toxic[at], n_other, n_toxic)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed((at + part * size).astype(np.int32), ratio)], pa.binary())], ["part", "ratios"])

    counts = rows.select("text", "toxic").mapInArrow(_counted, "part int, counts binary")
    return counts.repartition(PARTS, "part").mapInArrow(summed, "part int, ratios binary")


def _fitted(y: np.ndarray, weight: np.ndarray, size: np.ndarray, col: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with a quadratic penalty, by limited-memory BFGS. Rows of ``size`` features each
    (col, end to end) whose values are their ratios."""
    # features are numbered by a table of all of them: sorting their places would take many times the memory of these
    held = np.zeros(len(ratio), bool)
    held[col] = True
    used, at = np.flatnonzero(held), (np.cumsum(held, dtype=np.int32) - np.int32(1))[col]
    scale, n_all = ratio[used], len(ratio)
    end = np.cumsum(size)
    # rows by slices: what a step needs beside the features themselves is small
    cuts = np.unique([0, *np.searchsorted(end, np.arange(1 << 19, len(at), 1 << 19), "right"), len(y)])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, margin, gradient = x[:-1], np.full(len(y), x[-1]), np.zeros(len(used))
        scaled = w * scale
        error = np.zeros(len(y))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = at[end[lo] - size[lo] : end[hi - 1]]
            row = np.repeat(np.arange(hi - lo), size[lo:hi])
            margin[lo:hi] += np.bincount(row, scaled[own], minlength=hi - lo)
            error[lo:hi] = weight[lo:hi] * (1 / (1 + np.exp(-np.clip(margin[lo:hi], -700, 700))) - y[lo:hi])
            gradient += np.bincount(own, error[lo:hi][row], minlength=len(used))
        return float(weight @ (np.logaddexp(0, margin) - y * margin) + PENALTY / 2 * (w @ w)), np.append(gradient * scale + PENALTY * w, error.sum())

    x, moved = np.zeros(len(used) + 1), []
    now, slope = loss(x)
    for _ in range(ROUNDS):
        step, rates = slope.copy(), []
        for s, t in reversed(moved):
            rates.append((s @ step) / (s @ t))
            step -= rates[-1] * t
        step *= (moved[-1][0] @ moved[-1][1]) / (moved[-1][1] @ moved[-1][1]) if moved else 1 / max(np.linalg.norm(slope), 1e-12)
        for (s, t), a in zip(moved, reversed(rates)):
            step += s * (a - (t @ step) / (s @ t))
        rate = 1.0
        after, slope_after = loss(x - step)
        while after > now - 1e-4 * rate * (slope @ step) and rate > 1e-6:
            rate /= 2
            after, slope_after = loss(x - rate * step)
        s, t = -rate * step, slope_after - slope
        moved = [*moved, (s, t)][-4:] if s @ t > 1e-14 else moved
        done = now - after < 1e-7 * max(now, 1e-9)
        x, now, slope = x + s, after, slope_after
        if done:
            break
    weights = np.zeros(n_all)
    weights[used] = x[:-1]
    return weights, float(x[-1])


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Weight of each hashed n-gram (its regression weight times its log ratio) and the bias.

    A label of several for one id: toxic if one says so. Null ids, labels and rows held out teach nothing. Without
    toxic or without other texts only the bias is learned; without any label it is below even odds.
    """
    rows = labelled(docs, labels, id_col, text_col, label_col)
    tally = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_other, n_toxic = tally.get(0, 0), tally.get(1, 0)
    weights = np.zeros(1 << BITS, np.float32)
    if not n_other or not n_toxic:
        return weights, math.log((n_toxic + 0.5) / (n_other + 1))
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [packed(np.diff(grams(x.as_py()), prepend=np.int32(0))) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(blobs, pa.binary())], ["toxic", "place", "grams"])

    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    share = F.when(F.col("toxic") == 1, F.lit(int(min(1.0, FIT_ROWS / 4 / n_toxic) * (1 << 30)))).otherwise(F.lit(int(min(1.0, FIT_ROWS * 3 / 4 / n_other) * (1 << 30))))
    sample = rows.withColumn("place", place).where(F.col("place") < share).select("text", "toxic", "place")
    # the ratios come before all texts
    parts = ratios(rows, n_other, n_toxic).select(F.col("part").alias("toxic"), F.lit(-1).cast("long").alias("place"), F.col("ratios").alias("grams"))
    texts = sample.mapInArrow(features, "toxic int, place long, grams binary")
    first = parts.unionByName(texts).orderBy("place", "toxic", "grams").limit(PARTS + 2 * FIT_ROWS)
    found = first.mapInArrow(_model, "weights binary, bias double").first()
    if found is None:
        return weights, math.log((n_toxic + 0.5) / (n_other + 1))
    at, w = unpacked(bytes(found["weights"]), np.int32, np.float32)
    weights[at] = w
    return weights, found["bias"]


def _model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model from rows in order: all ratios (place -1), then the n-grams of the texts to fit to, a bounded number. The fit is a
    task's work, so that the driver holds nothing but the model."""
    ratio, toxic, sets, held = np.zeros(1 << BITS), [], [], 0
    for kind, place, blob in ((k, p, x) for b in batches for k, p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))):
        if place < 0:
            at, own = unpacked(blob.as_py(), np.int32, float)
            ratio[at] = own
            continue
        step = unpacked(blob.as_py(), np.int32)[0]
        held += len(step)
        if held > FIT_GRAMS and len(set(toxic)) == 2:
            break
        toxic.append(kind)
        sets.append(np.cumsum(step, dtype=np.int32))
    y, size = np.array(toxic, float), np.array([len(x) for x in sets])
    if not 0 < y.sum() < len(y):
        return
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    col = np.concatenate([*sets, np.zeros(0, np.int32)])
    del sets
    w, bias = _fitted(y, weight, size, col, ratio)
    w = (w * ratio).astype(np.float32)
    at = np.flatnonzero(w).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([packed(at, w[at])], pa.binary()), pa.array([bias])], ["weights", "bias"])


def _scores(sent):
    def make(texts: pa.Array) -> list[pa.Array]:
        weights, bias = sent.value
        out = []
        for x in texts:
            s = bias + float(weights[grams(x.as_py())].sum(dtype=float))
            out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, s)))))
        return [pa.array(out, pa.float64())]

    return make


def scored(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) for each row; null and empty texts get the score of no n-gram; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return appended(pick(docs, id_col, text_col), text_col, _scores(sent), "score double").select(F.col("c0").alias(id_col), "score")


def cleaned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with a score under 0.5, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, id_col, text_col))
    return restored(appended(docs, text_col, _scores(sent), "score double").where("score < 0.5"), list(docs.columns))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (null ids: false), score and predicted for each row of docs; an empty table gives an empty one."""
    found = scored(docs, trained(docs, labels))
    return found.select("doc_id", F.coalesce(doc_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_nb_char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
