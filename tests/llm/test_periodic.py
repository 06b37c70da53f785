"""Periodic runs against a version that tries every start and period."""

import hashlib
import zlib

import fixtures as fx
import numpy as np
import pytest

from rulewright.llm import periodic


def brute_runs(words):
    """(start, length, period) by the definition, stretch by stretch."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                found.add((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs))


def brute_row(doc_id, text):
    words = fx.SPACED.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(brute_collapsed(words, runs)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def repeated(seed):
    """Prose with stretches of several periods, next to each other and one in another."""
    a, b = fx.prose(seed, 3, 5), fx.prose(seed + 1, 2, 3)
    return " ".join([fx.prose(seed + 2, 20), *[a] * (4 + seed % 4), *[b] * 6, "x x x x x x x", " ".join([*["y"] * 6, "z"] * 5), fx.prose(seed + 3, 9), *["t"] * (seed % 9)])


def rows():
    odd = [r for r in fx.odd_rows() if len(r[1] or "") < 3000 or r[0] in (71,)]
    return [*odd, *((200 + i, repeated(i), "en") for i in range(12)), *((300 + i, fx.prose(i, 150, 2), "en") for i in range(12)), *((400 + i, fx.prose(i, 5 + i % 4, 1), "en") for i in range(30)), (90, "same " * 300, "en")]


@pytest.mark.parametrize("lags", [4096, 4])
def test_runs(spark, docs, lags):
    """All lags in one go, and longer texts by ranges of four lags."""
    df = fx.documents(spark, rows())
    got = [tuple(r[n] for n in NAMES) for r in periodic.digests(periodic.periodic_runs(df, periodic.with_repeats, lags)).collect()]
    assert sorted(map(str, got)) == sorted(str(brute_row(i, t)) for i, t, _ in rows())
    assert sum(r[1] > 2 for r in got) > 5


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert periodic.op13_periodic_runs(spark, str(tmp_path)).collect() == []


def test_collapsed_text(spark):
    """The operator's own result: runs and the text without them, texts as they are."""
    df = spark.createDataFrame([(1, "p a b a b a b a b q"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.periodic_runs(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 8, 2)] and got[1].collapsed == "p a b q"
    assert got[2].runs == [] and got[2].collapsed == ""


def test_long_text():
    """A text of 40,000 words: ranges of lags find what all lags in one go find."""
    words = [w.encode() for w in (fx.prose(7, 15_000, 9000) + " " + fx.prose(8, 5000, 9000) + (" " + fx.prose(9, 4000, 9000)) * 5).split()]
    ids, ends = periodic.word_ids([words]), np.array([len(words)])
    whole = periodic.runs_of(periodic.stretches(ids, ends, range(1, 1 << 62)))
    parts = [periodic.stretches(ids, ends, range(lo, lo + 4096)) for lo in range(1, len(words) // 4 + 1, 4096)]
    assert whole.tolist() == periodic.runs_of(np.concatenate(parts, axis=1)).tolist() == [[20_000], [20_000], [4000]]
