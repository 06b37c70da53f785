"""Periodic run detection: every text's words compared with themselves at all lags, and texts without the repeats.

A run is a stretch of consecutive words in which words ``period`` apart are identical, at least ``LEAST`` words and ``EXPONENT``
periods long, that no neighbouring word extends; its period is the smallest one that holds. The word ids of many texts stand in
one array and are compared with that array shifted by each lag up to a quarter of the longest text; texts too short for a lag
fall out at its end. Stretches of equal places give the runs. At multiples of its period a run shows again with the
same start and length, so of equal stretches the one with the least lag counts.

Texts with more than ``LAGS`` lags are dealt to tasks by text and range of lags; the ranges' runs meet by text.

Null and empty texts have no runs, and nothing is left of them. Rows with a null id and repeated rows are treated one by one
like others. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, written

LEAST, EXPONENT = 6, 4
#: Lags of a text that one task compares.
LAGS = 4096
#: Words that are compared at once (texts aren't cut).
STEP_WORDS = 1 << 16
#: Separators of words, as characters (fixed values).
BLANKS = " \t\n\x0b\x0c\r"

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def word_ids(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word of all texts, the same for equal words of one text only."""
    codes = pa.array([w for words in texts for w in words], pa.large_binary()).dictionary_encode()
    kinds = len(codes.dictionary)
    width = np.int32 if len(texts) * kinds < 1 << 31 else np.int64
    return codes.indices.to_numpy().astype(width) + np.repeat(np.arange(len(texts), dtype=width) * width(kinds), [len(t) for t in texts])


def stretches(ids: np.ndarray, ends: np.ndarray, lags: range) -> np.ndarray:
    """Start, length and lag of the runs at these lags. ids: of texts one after another, the longest first; ends: of the texts."""
    sizes = np.diff(ends, prepend=0)
    found = []
    for lag in range(lags.start, min(lags.stop, int(sizes[0]) // EXPONENT + 1) if len(sizes) else 0):
        texts = np.searchsorted(-sizes, -lag * EXPONENT, "right")
        last, least = int(ends[texts - 1]), max(LEAST - lag, (EXPONENT - 1) * lag)
        same = ids[lag:last] == ids[: last - lag]
        if not same[least - 1 :: least].any():  # a stretch of so many places holds one of these
            continue
        edges = np.flatnonzero(np.diff(same, prepend=False, append=False))
        start, size = edges[::2], edges[1::2] - edges[::2]
        long = size >= least
        found.append(np.stack([start[long], size[long] + lag, np.full(int(long.sum()), lag)]))
    return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)


def runs_of(found: np.ndarray) -> np.ndarray:
    """Of stretches of equal start and length the one of the least lag, by start, then period."""
    found = found[:, np.lexsort((found[2], found[1], found[0]))]
    first = np.concatenate([[True], (np.diff(found[:2]) != 0).any(axis=0)]) if found.shape[1] else np.zeros(0, bool)
    found = found[:, first]
    return found[:, np.lexsort((found[2], found[0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that stand in no run after its first period, joined by blanks."""
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[0] + runs[2], 1)
    np.add.at(gone, runs[0] + runs[1], -1)
    return b" ".join(compress(words, (np.cumsum(gone[:-1]) == 0).tolist())) if runs.shape[1] else b" ".join(words)


def _lists(runs: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([r.shape[1] for r in runs])]).astype(np.int32)
    flat = np.concatenate([np.zeros((3, 0), np.int64), *runs], axis=1).astype(np.int64)
    return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([*flat], ["start", "length", "period"]))


def _texts(b: pa.RecordBatch, prepare: Prepare | None) -> Iterator[list[bytes]]:
    """Words of each row's text. bytes.split() cuts at just these separators."""
    for i, text in zip(b.column("doc_id"), b.column("text").cast(pa.large_binary())):
        words = (text.as_py() or b"").split()
        yield prepare(i.as_py(), words) if prepare else words


def _whole(prepare: Prepare | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All lags of each text in one go, many texts at once."""

    def step(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        ends = np.cumsum([len(texts[i]) for i in order])
        found = stretches(word_ids([texts[i] for i in order]), ends, range(1, 1 << 62))
        text = np.searchsorted(ends, found[0], "right")
        runs: list[np.ndarray] = [found[:, :0]] * len(texts)
        for k in np.unique(text).tolist():
            own = found[:, text == k]
            runs[order[k]] = runs_of(own - np.array([[ends[k] - len(texts[order[k]])], [0], [0]]))
        return pa.RecordBatch.from_arrays([ids, _lists(runs), pa.array([collapsed(w, r) for w, r in zip(texts, runs)], pa.string())], ["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size, lo = [], 0, 0
            for i, words in enumerate(_texts(b, prepare)):
                held.append(words)
                size += len(words)
                if size >= STEP_WORDS or i + 1 == b.num_rows:
                    yield step(b.column("doc_id").slice(lo, len(held)), held)
                    held, size, lo = [], 0, i + 1

    return run


def _ranges(prepare: Prepare | None, lags: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A range of lags of one text in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, words in enumerate(_texts(b, prepare)):
                first = 1 + lags * b.column("part")[i].as_py()
                runs = runs_of(stretches(word_ids([words]), np.array([len(words)]), range(first, first + lags)))
                yield pa.RecordBatch.from_arrays([b.column("key").slice(i, 1), _lists([runs])], ["key", "found"])

    return run


def _joined(prepare: Prepare | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the ranges of a text found, as its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, words in enumerate(_texts(b, prepare)):
                flat = b.column("found")[i].values
                found = np.stack([flat.field(k).to_numpy() for k in range(3)]) if len(flat) else np.zeros((3, 0), np.int64)
                runs = runs_of(found)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), _lists([runs]), pa.array([collapsed(words, runs)], pa.string())], ["doc_id", "runs", "collapsed"])

    return run


def lag_ranges(text: str, lags: int) -> Column:
    """How many ranges of lags a text may need, by its number of separators; short texts aren't looked at."""
    blanks = F.length(text) - F.length(F.translate(F.col(text), BLANKS, ""))
    return F.when(F.octet_length(text) < 2 * EXPONENT * lags, 1).otherwise(F.ceil((blanks + 1) / (EXPONENT * lags))).cast("int")


def periodic_runs(df: DataFrame, prepare: Prepare | None = None, lags: int = LAGS) -> DataFrame:
    """doc_id, runs (start and length in words, and period, by start, then period) and the collapsed text of each row of df (doc_id, text).

    ``prepare`` may change a text's words before they are compared. A text of more than ``lags`` lags is compared in ranges of so many.
    """
    rows, schema = pick(df, "doc_id", "text"), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, runs {RUNS}, collapsed string"
    parts = F.coalesce(lag_ranges("text", lags), F.lit(1))
    short = rows.where(parts == 1).mapInArrow(_whole(prepare), schema)
    # keys of the few long texts are written, so that they are the same however often they are read
    long = written(rows.where(parts > 1).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", parts.alias("parts")), "long-texts")
    dealt = long.select("key", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).repartition("key", "part")
    found = dealt.mapInArrow(_ranges(prepare, lags), f"key bigint, found {RUNS}").groupBy("key").agg(F.flatten(F.collect_list("found")).alias("found"))
    return short.unionByName(long.join(found, "key").select("doc_id", "text", "found").mapInArrow(_joined(prepare), schema))


def with_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's texts: of a tenth of the ids (h % 10 = 0), words from one on repeat a stretch of the text."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digests(found: DataFrame) -> DataFrame:
    """Of each row of periodic_runs(): the run of the greatest length, the runs' digest, and the digest of what is left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
        F.floor(best["length"] * 1000 / -best["period"]).cast("long").alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(table(spark, sf_dir, "documents"), with_repeats))
