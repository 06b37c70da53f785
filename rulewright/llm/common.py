"""What the operators share: column picking, shared storage, word splitting over Arrow buffers, packed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import dropped, shared_dir, written  # noqa: F401  the operators' modules take them from here

#: Bytes of text that one numpy step works on; a longer single text is one step of its own, or several pieces.
STEP_BYTES = 2 << 20
#: Bytes of words that are hashed at once.
HASH_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns with exactly these names; others (also ones that differ in case only) don't get in the way."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


def appended(df: DataFrame, text_col: str, make: Callable[[pa.Array], list[pa.Array]], kinds: str) -> DataFrame:
    """df with its columns named c0, c1 .. in order, and the columns (``kinds``) that ``make`` gives for the texts."""
    plain, at = df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns.index(text_col)
    schema = T.StructType([*plain.schema.fields, *T.StructType.fromDDL(kinds).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *make(b.column(at))], schema.names)

    return plain.mapInArrow(run, schema)


def restored(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of what appended() gave, under their own names again."""
    return df.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


#: Rows of a few numbers that are sent to every task; with more, both sides are shuffled.
SENT_KEYS = 500_000


def without(df: DataFrame, id_col: str, text_col: str, gone: DataFrame) -> DataFrame:
    """df without the rows whose id and text hash stand in gone (id, key)."""
    names = list(df.columns)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    i, key = F.col(f"c{names.index(id_col)}"), F.xxhash64(f"c{names.index(text_col)}")
    gone = gone.select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct()
    gone = F.broadcast(gone) if gone.count() <= SENT_KEYS else gone
    return restored(plain.join(gone, i.eqNullSafe(F.col("_id")) & (key == F.col("_key")), "left_anti"), names)


def doc_remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- words of UTF-8 buffers -------------------------------------------------------------------------------------------

_BYTES = np.arange(256)
#: Bytes of words [^\x20\x09-\x0D]+; all separators are ASCII, so bytes decide.
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_RANDOM = np.random.default_rng(20240607)
_CODE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and where each text begins (and the last ends); null as empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(at: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many bytes together."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def pieces(raw: np.ndarray, at: np.ndarray, kind: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """Like steps, but a longer single text comes in several pieces, cut at separators: texts lo to hi, bytes a to b."""
    for lo, hi in steps(at, most):
        a, end = int(at[lo]), int(at[hi])
        while end - a > most and hi == lo + 1:
            gaps = np.flatnonzero(~kind[LOWER[raw[a : a + most]]])
            b = a + int(gaps[-1]) + 1 if len(gaps) else a + most
            while b < end and not len(gaps):  # a word of more bytes than a piece
                gaps = np.flatnonzero(~kind[LOWER[raw[b : b + most]]])
                b = b + int(gaps[0]) + 1 if len(gaps) else min(b + most, end)
            yield lo, hi, a, b
            a = b
        yield lo, hi, a, end


def span_hash(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; sizes above 0."""
    if not len(size):
        return np.zeros(0, np.uint64)
    out, ends = np.empty(len(size), np.uint64), np.cumsum(size)
    lo = 0
    while lo < len(size):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + HASH_BYTES, "right")))
        out[lo:hi] = _long_hash(data[start[lo] : start[lo] + size[lo]]) if size[lo] > HASH_BYTES else _span_hash(data, start[lo:hi], size[lo:hi])
        lo = hi
    return out


def _span_hash(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    value = _CODE[data[np.repeat(start, size) + place]] * np.cumprod(np.full(int(size.max()), _STEP))[place]
    return mix(np.add.reduceat(value, at) + size.astype(np.uint64))


def _long_hash(span: np.ndarray) -> np.uint64:
    """As _span_hash for one span, in parts."""
    powers, total, factor = np.cumprod(np.full(HASH_BYTES, _STEP)), np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for lo in range(0, len(span), HASH_BYTES):
        part = span[lo : lo + HASH_BYTES]
        total += (_CODE[part] * powers[: len(part)]).sum(dtype=np.uint64) * factor
        factor = factor * powers[-1]
    return mix(total + np.uint64(len(span)))[0]


class Words:
    """Words of texts: doc (index of the text), start and end (bytes, in raw), and a 64-bit hash of each."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, kind: np.ndarray = SPACED, lower: bool = True, hashes: bool = True):
        low = LOWER[raw] if lower else raw
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = kind[low]
        begins = inside[1:-1] & ~inside[:-2]
        edges = at[1:-1]
        edges = edges[edges < len(raw)]
        begins[edges] = inside[1:-1][edges]  # a new text ends a word
        ends = inside[1:-1] & ~inside[2:]
        before = edges[edges > 0] - 1
        ends[before] = inside[1:-1][before]
        self.raw, self.low, self.inside = raw, low, inside[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(at, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(at) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.count)])  # of each text's words
        if hashes:
            self.hash = span_hash(self.low, self.start, self.end - self.start)

    def text(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k neighbours; those that cross from one text into the next are the caller's to leave out."""
    n = max(0, len(hashes) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = mix(total * _STEP + hashes[j : j + n])
    return total


def ordered(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by doc (from 0), then key; rows equal in both stand in any order."""
    order = np.argsort(key)
    by = doc[order]
    return order[np.argsort(by.astype(np.uint16) if len(by) and by.max() < 1 << 16 else by, kind="stable")]


# -- packed rows: many small rows of one hash bucket travel as one binary value ---------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: how long each is, then its bytes by plane, so that equal high bytes stand together."""
    parts = [np.array([len(a) for a in arrays], np.int64).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    data = b"".join(parts)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(value: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(memoryview(value)[8:], int.from_bytes(value[:8], "little"), "zstd", asbytes=True), np.uint8)
    sizes, at, found = raw[: 8 * len(kinds)].view(np.int64).tolist(), 8 * len(kinds), []
    for kind, n in zip(kinds, sizes):
        width = np.dtype(kind).itemsize
        found.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return found


def dealt(bucket: np.ndarray, n: int, *arrays: np.ndarray) -> Iterable[tuple[int, list[np.ndarray]]]:
    """Arrays by their bucket of 0 to n - 1."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        part = order[cuts[b] : cuts[b + 1]]
        yield int(b), [a[part] for a in arrays]
