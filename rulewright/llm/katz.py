"""Katz back-off language model: Good-Turing discounted bigrams over Good-Turing discounted words.

    p(w | h) = d(c) c(h w) / c(h)    where the bigram was seen
             = alpha(h) p(w)         where it wasn't, or p(w) after a history never seen
    p(w)     = d(n) n / N            for a word seen n times; words never seen are one event, with what the discounts leave

d is Katz's discount for counts up to a cutoff, and alpha(h) is what the discounts leave of h over what the words not seen
after h have of p, so each history is exactly normalised. Where the discounts leave nothing of a history (or of the words),
one count more than all is divided by.

Words are known by 64-bit hashes, and every word seen in training has bigrams of its own. A task cuts its texts into chunks
of HELD tokens and counts each chunk's bigrams, so a bigram stands in a chunk once, however frequent. Bigrams are dealt as
packed rows to buckets of their history, one for about BUCKET tokens, so that no task holds many of them; words that are
histories of a good part of a bucket are spread over several by their second word. A bucket knows its bigrams' and histories'
counts. It asks the buckets of words for p, once for each word, and gets back counts in the order in which it asked. So it has
alpha, and what is left to score: each chunk's texts get their sums from all buckets. Sums are of whole numbers (logarithms in
units of 2**-36), so they don't depend on the order in which tasks end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, Words, buffers, doc_remainder, dropped, mix, packed, pick, pieces, shuffle_partitions, table, unpacked, written

#: Counts up to this one are discounted, or up to a lesser one if only that gives discounts between 0 and 1.
CUT = 5
#: Tokens of a chunk, about.
HELD = 1_200_000
#: Tokens of a bucket, about.
BUCKET = 1_500_000
#: Words with a lower share of all training tokens are never spread over buckets, so 1 / SPREAD_SHARE at most are sent to all tasks.
SPREAD_SHARE = 4e-6
END, START = np.uint64(0x0E4D), np.uint64(0x57A7)  # a word's hash equals one of them once in 2**62
UNIT = float(1 << 36)
#: Sums of a text: score but for discounts, base score, known tokens, seen bigrams of count 1 .. CUT, and what the score gets less where the history's least count is 2 .. CUT + 1 and the discounts end below it.
SUMS = 3 + CUT + CUT
#: What a row of the tables is about.
PAIRS, SUMMED, ASKED, HISTORIES, UNSEEN, OPEN, LEVELS, TEXT, ANSWER, WEIGHT = range(10)
BINARIES = ["a", "b"]
ROW = "kind int, bucket int, key long, a binary, b binary, levels array<long>"
ROW_NAMES = ["kind", "bucket", "key", "a", "b", "levels"]


def discounts(n: np.ndarray) -> np.ndarray:
    """d of counts 0 to CUT from n, the numbers of types with counts 0 to CUT + 1: Katz's for the greatest cutoff for which all lie
    between 0 and 1; if there is none, half of a count of 1."""
    d = np.ones(CUT + 1)
    for k in range(CUT, 1, -1):
        beyond = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        if beyond >= 1 or not all(n[1 : k + 1]):
            continue
        r = np.arange(1, k + 1)
        katz = ((r + 1) * n[2 : k + 2] / n[1 : k + 1] / r - beyond) / (1 - beyond)
        if (katz > 0).all() and (katz < 1).all():
            d[1 : k + 1] = katz
            return d
    d[1] = 0.5
    return d


def cutoff(d: np.ndarray) -> int:
    """The greatest count that is discounted."""
    return max((r for r in range(1, CUT + 1) if d[r] < 1), default=0)


def _units(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT).astype(np.int64)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _schema(*more: pa.Field) -> pa.Schema:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.schema([*(pa.field(n, k) for n, k in zip(ROW_NAMES, kinds)), *more])


def _tokens(texts: pa.Array) -> Iterator[tuple[int, int, Words, bool, bool]]:
    """Texts lo to hi, their words, and whether this is a text's beginning and end; long texts come in pieces."""
    raw, at = buffers(texts)
    for lo, hi, a, b in pieces(raw, at, SPACED):
        yield lo, hi, Words(raw[a:b], at[lo : hi + 1].clip(a, b) - a, SPACED), a == at[lo], b == at[hi]


# -- words ------------------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash) and n over the rows of (text): counted in each task, then summed. Ends are counted too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def out():
            words, n = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n = np.bincount(n, np.concatenate([c for _, c in held]), minlength=len(words)).astype(np.int64)
            return words, n

        for b in batches:
            ends += b.num_rows
            for _, _, w, _, _ in _tokens(b.column(0)):
                held.append((w.hash, np.ones(len(w.hash))))
                size += len(w.hash)
                if size > HELD:
                    held, size = [out()], 0
                    if len(held[0][0]) > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["word", "n"])
                        held = []
        if ends:
            held.append((np.array([END]), np.array([float(ends)])))
            words, n = out()
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def among(words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in the sorted words, and whether it stands there."""
    if not len(words):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return at, words[at] == hashes


class Totals:
    """What every task knows: totals over all words, their discounts, and which words are spread over how many buckets."""

    def __init__(self, tokens: int, types: int, of_counts: np.ndarray, n_end: int, buckets: int, wide: np.ndarray, n_wide: np.ndarray):
        self.tokens, self.types, self.d, self.n_end, self.buckets = tokens, types, discounts(of_counts), n_end, buckets
        # p(never seen) is what the discounts leave; with nothing left, one count more than all
        kept = tokens - sum((1 - self.d[r]) * r * of_counts[r] for r in range(1, CUT + 1))
        self.total = float(tokens) if 0 < kept < tokens else float(tokens + 1)
        self.unseen = max(1 - kept / self.total, 0.0) if tokens else 1.0
        order = np.argsort(np.append(wide, START))
        self.wide, self.n_wide = np.append(wide, START)[order], np.append(n_wide, n_end)[order]
        self.spread = np.maximum(2, np.ceil(4 * buckets * self.n_wide / max(tokens, 1))).astype(np.uint64)

    def word_p(self, n: np.ndarray) -> np.ndarray:
        """p of words with these counts; 0: the one event of a word never seen."""
        d = np.where(n <= CUT, self.d[np.minimum(n, CUT).astype(int)], 1.0)
        return np.where(n > 0, d * n / self.total, self.unseen)

    def bucket(self, word: np.ndarray) -> np.ndarray:
        return (mix(word) % np.uint64(self.buckets)).astype(np.int32)

    def pair_bucket(self, h: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Buckets of bigrams, b being those of their histories."""
        at, wide = among(self.wide, h)
        spread = mix(mix(h[wide]) + mix(w[wide]) % self.spread[at[wide]] + np.uint64(1)) % np.uint64(self.buckets)
        b = b.copy()
        b[wide] = spread.astype(np.int32)
        return b


def totals(counts: DataFrame) -> Totals:
    """From (word, n); at most 1 / SPREAD_SHARE rows reach the driver."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("types"), F.coalesce(F.sum(F.when(F.col("word") == int(END), F.col("n"))), F.lit(0)).alias("n_end"), *[F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, CUT + 2)]).first()
    tokens = sums["tokens"]
    buckets = max(shuffle_partitions(counts.sparkSession), math.ceil(tokens / BUCKET))
    least = max(1, math.ceil(SPREAD_SHARE * tokens), tokens // (4 * buckets))
    wide = counts.where((F.col("n") >= least) & (F.col("word") != int(END))).toPandas()
    words = wide["word"].to_numpy(np.int64).view(np.uint64)
    return Totals(tokens, sums["types"], np.array([0, *(sums[f"n{r}"] for r in range(1, CUT + 2))]), sums["n_end"], buckets, words, wide["n"].to_numpy(np.int64))


# -- bigrams ----------------------------------------------------------------------------------------------------------


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _changes(*arrays: np.ndarray) -> np.ndarray:
    """Where any of the arrays has a new value."""
    new = np.ones(len(arrays[0]), bool)
    new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in arrays])
    return np.flatnonzero(new)


def _dealt_chunk(held: list, v: Totals) -> Iterator[dict]:
    """A chunk's bigrams by bucket. a: histories, how many words each has, words, each bigram's word, its number of texts and its
    count in training; b: for each text of each bigram its row from the chunk's first on, and how often the bigram stands there."""
    word, hist, row, learns = (np.concatenate([x[i] for x in held]) for i in range(4))
    base = int(row[0])
    # each word is the next one's history, but where a text begins or goes on from another piece
    apart = np.flatnonzero(np.concatenate([[True], hist[1:] != word[:-1]]))
    known, number = np.unique(np.concatenate([word, hist[apart]]), return_inverse=True)
    w_id, h_id = number[: len(word)], np.empty(len(word), np.int64)
    h_id[1:], h_id[apart] = w_id[:-1], number[len(word) :]
    del word, hist, number
    pair = h_id * len(known) + w_id
    del h_id, w_id
    order = np.argsort(pair, kind="stable")  # rows ascend
    pair, row, learns = pair[order], row[order] - base, learns[order]
    del order
    entry = _changes(pair, row)
    n = np.diff(np.append(entry, len(pair)))
    pair, row, learns = pair[entry], row[entry].astype(np.uint32), learns[entry]
    first = _changes(pair)
    texts, taught = np.diff(np.append(first, len(pair))), np.add.reduceat(n * learns, first)
    h_id, w_id = np.divmod(pair[first], len(known))
    bucket = v.pair_bucket(known[h_id], known[w_id], v.bucket(known)[h_id])
    by = np.argsort(bucket, kind="stable")
    bucket, h_id, w_id, texts, taught, first = (x[by] for x in (bucket, h_id, w_id, texts, taught, first))
    begin = np.cumsum(texts) - texts
    place = np.repeat(first - begin, texts) + np.arange(len(row))
    row, n = row[place], n[place].astype(np.uint32)
    begin = np.append(begin, len(row))
    cuts = np.append(_changes(bucket), len(bucket))
    for s, t in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        h = _changes(h_id[s:t])
        words, at = np.unique(w_id[s:t], return_inverse=True)
        a = packed(_deltas(known[h_id[s:t][h]]), np.diff(np.append(h, t - s)).astype(np.uint32), _deltas(known[words]), at.astype(np.uint32), texts[s:t].astype(np.uint32), taught[s:t].astype(np.uint64))
        e = slice(int(begin[s]), int(begin[t]))
        yield {"kind": PAIRS, "bucket": int(bucket[s]), "key": base, "a": a, "b": packed(row[e], n[e])}


def occurrences(texts: DataFrame, sent) -> DataFrame:
    """Of (id, held_out, learns, text): rows of PAIRS, and a row TEXT of each text: key (its number), id, held_out and n_tokens.
    Texts are numbered by task and place, so one run's rows only go together with each other."""
    id_kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Totals = sent.value
        held, size, carry, n_text = [], 0, None, 0
        at_row, schema = TaskContext.get().partitionId() << 33, None
        for b in batches:
            schema = schema or _schema(pa.field("id", b.schema.field(0).type), pa.field("held_out", pa.bool_()), pa.field("n_tokens", pa.int64()))
            teach = b.column(2).to_numpy(zero_copy_only=False)
            n_tokens = np.ones(b.num_rows, np.int64)
            for lo, hi, w, begins, ends in _tokens(b.column(3)):
                n = w.count.copy()
                n_tokens[lo:hi] += n
                n += ends
                doc = np.repeat(np.arange(lo, hi), n)
                first = np.cumsum(n) - n
                word, hist = np.full(len(doc), END), np.full(len(doc), START)
                word[np.arange(len(w.hash)) + (w.doc if ends else 0)] = w.hash
                hist[1:] = word[:-1]
                if begins:
                    hist[first[n > 0]] = START
                elif len(hist):
                    hist[0] = carry
                carry = word[-1] if len(word) else START if begins else carry
                held.append((word, hist, at_row + doc, teach[doc]))
                size += len(doc)
                if size > HELD:
                    yield _batch(list(_dealt_chunk(held, v)), schema)
                    held, size = [], 0
            rows = at_row + np.arange(b.num_rows)
            nulls = [pa.nulls(b.num_rows, k) for k in (pa.binary(), pa.binary(), pa.list_(pa.int64()))]
            spread = (mix(rows.astype(np.uint64)) % np.uint64(v.buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, TEXT, np.int32)), pa.array(spread), pa.array(rows), *nulls, b.column(0), b.column(1), pa.array(n_tokens)], schema=schema)
            at_row += b.num_rows
        if size:
            yield _batch(list(_dealt_chunk(held, v)), schema)

    return texts.select("id", "held_out", "learns", "text").mapInArrow(run, f"{ROW}, id {id_kind}, held_out boolean, n_tokens long")


def _by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """A partition for each bucket."""
    return df.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")


def _whole_sums(row: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of n times x by row, exact: in two halves, as bincount adds in doubles."""
    if x.dtype != np.int64:
        return np.bincount(row, x * n.astype(float)).astype(np.int64)
    high, low = x >> 24, x & 0xFFFFFF
    return (np.bincount(row, high * n.astype(float)).astype(np.int64) << 24) + np.bincount(row, low * n.astype(float)).astype(np.int64)


def _text_sums(row: np.ndarray, n: np.ndarray, *values: np.ndarray | None) -> bytes:
    """The sums of n times each value by text (row)."""
    rows = np.flatnonzero(np.bincount(row))
    none = [np.zeros(0, np.int64)] * (SUMS - len(values))
    return packed(_deltas(rows), *(_whole_sums(row, x, n)[rows] if x is not None else np.zeros(0, np.int64) for x in values), *none)


def _count_bucket(packs: list, v: Totals, bucket: int) -> Iterator[dict]:
    """What one bucket's packs (first row, a, b) give: counts, sums, questions for words' counts, and what is left to score."""
    read = [unpacked(a, np.uint64, np.uint32, np.uint64, np.uint32, np.uint32, np.uint64) for _, a, _ in packs]
    h_all = [np.cumsum(x[0], dtype=np.uint64) for x in read]
    w_all = [np.cumsum(x[2], dtype=np.uint64) for x in read]
    hists, h_no = np.unique(np.concatenate(h_all), return_inverse=True)
    words, w_no = np.unique(np.concatenate(w_all), return_inverse=True)
    h_cut = np.cumsum([0, *(len(x) for x in h_all)])
    w_cut = np.cumsum([0, *(len(x) for x in w_all)])
    pair = np.concatenate([np.repeat(h_no[h_cut[i] : h_cut[i + 1]], x[1]) * len(words) + w_no[w_cut[i] : w_cut[i + 1]][x[3]] for i, x in enumerate(read)])
    texts, taught = np.concatenate([x[4] for x in read]), np.concatenate([x[5] for x in read])
    p_cut = np.cumsum([0, *(len(x[3]) for x in read)])
    del read, h_all, w_all, h_no, w_no
    pairs, back = np.unique(pair, return_inverse=True)
    count = np.bincount(back, taught, minlength=len(pairs)).astype(np.int64)
    del pair, taught
    h_of, w_of = np.divmod(pairs, len(words))
    seen = count > 0
    levels = np.bincount(np.minimum(count[seen], CUT + 2), minlength=CUT + 3)[1 : CUT + 2]
    yield {"kind": LEVELS, "levels": levels.tolist()}
    # histories: their counts, and the numbers of words seen once, twice .. after them
    n_h = np.bincount(h_of, count, minlength=len(hists)).astype(np.int64)
    of_count = [np.bincount(h_of[count == r], minlength=len(hists)) for r in range(1, CUT + 1)]
    at, wide = among(v.wide, hists)
    n_h[wide] = v.n_wide[at[wide]]
    least = np.full(len(hists), CUT + 1)
    for r in range(CUT, 0, -1):
        least[of_count[r - 1] > 0] = r
    open_h = wide & (least > 1)  # other buckets may have what this one lacks
    closed = ~open_h[h_of]
    log_n, log_more = (np.log10(np.maximum(n_h + more, 1)) for more in (0, 1))
    score = np.where(seen, np.log10(np.maximum(count, 1)) - np.where(closed, log_n[h_of], 0.0), 0.0)
    word_base = np.where(hists == START, 0.0, np.log10(n_h + 0.1))
    # the end is no history: it joins the sums with its texts' beginnings
    word_base[hists == START] = math.log10(v.n_end + 0.1)
    is_known = np.where(hists == START, v.n_end > 0, n_h > 0).astype(np.int8)
    values = [_units(score), _units(word_base)[h_of], is_known[h_of], *(np.where(count == r, 1, 0).astype(np.int8) for r in range(1, CUT + 1))]
    values += [np.where(seen & closed & (least[h_of] == r), _units(log_more - log_n)[h_of], 0) for r in range(2, CUT + 2)]
    values = [x if x.any() else None for x in values]
    left = []
    for i, (base, _, b) in enumerate(packs):
        row, n = unpacked(b, np.uint32, np.uint32)
        own = np.repeat(back[p_cut[i] : p_cut[i + 1]], texts[p_cut[i] : p_cut[i + 1]])
        yield {"kind": SUMMED, "key": base, "a": _text_sums(row, n, *(x[own] if x is not None else None for x in values))}
        later = ~seen[own] | ~closed[own]
        if later.any():
            left.append((base, own[later], row[later], n[later]))
    # words that are asked for: those seen, and those to score that were not seen after their history
    wanted = np.zeros(len(words), bool)
    wanted[w_of[seen]] = True
    for _, own, _, _ in left:
        wanted[w_of[own[~seen[own]]]] = True
    asked = np.flatnonzero(wanted)
    to = v.bucket(words[asked])
    by = np.argsort(to, kind="stable")
    asked, to = asked[by], to[by]
    place = np.zeros(len(words), np.int64)
    place[asked] = np.arange(len(asked))
    cuts = np.append(_changes(to), len(to)) if len(to) else [0]
    for s, t in zip(cuts[:-1], cuts[1:]):
        yield {"kind": ASKED, "bucket": int(to[s]), "key": bucket, "a": packed(_deltas(words[asked[s:t]]))}
    # histories with their words seen, and what is left
    per = np.bincount(h_of[seen], minlength=len(hists))
    yield {"kind": HISTORIES, "bucket": bucket, "key": -1, "a": packed(_deltas(hists), n_h, per.astype(np.uint32)), "b": packed(place[w_of[seen]].astype(np.uint32), count[seen].astype(np.uint64))}
    for base, own, row, n in left:
        yield {"kind": UNSEEN, "bucket": bucket, "key": base, "a": packed(row, h_of[own].astype(np.uint32), place[w_of[own]].astype(np.uint32), n, seen[own].astype(np.uint8))}


def counted(found: DataFrame, sent, buckets: int) -> DataFrame:
    """Rows of what each bucket's bigrams give; rows of texts go through."""
    kind = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, bucket, schema = [], None, None
        for b in batches:
            schema = schema or b.schema
            is_text = np.asarray(b.column(0)) == TEXT
            yield b.filter(pa.array(is_text))
            for i in np.flatnonzero(~is_text).tolist():
                now = b.column(1)[i].as_py()
                if now != bucket and packs:
                    yield from _out(_count_bucket(packs, sent.value, bucket), schema)
                    packs = []
                bucket = now
                packs.append((b.column(2)[i].as_py(), b.column(3)[i].as_py(), b.column(4)[i].as_py()))
        if packs:
            yield from _out(_count_bucket(packs, sent.value, bucket), schema)

    return _by_bucket(found, buckets).mapInArrow(run, f"{ROW}, id {kind}, held_out boolean, n_tokens long")


def _out(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(r.get(x) or b"") for x in BINARIES)
        if size > 4 << 20:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def answered(counts: DataFrame, found: DataFrame, sent, buckets: int) -> DataFrame:
    """For each question the counts of its words, in its order; 0: never seen in training."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            word, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            to = sent.value.bucket(word)
            order = np.lexsort((word, to))
            word, n, to = word[order], n[order], to[order]
            cuts = np.append(_changes(to), len(to)) if len(to) else [0]
            yield from _out(({"kind": -1, "bucket": int(to[s]), "a": packed(_deltas(word[s:t]), n[s:t])} for s, t in zip(cuts[:-1], cuts[1:])), _schema())

        held = []
        for b in batches:
            held.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()))
            if sum(len(x[0]) for x in held) > HELD // 2:
                yield from out()
                held = []
        if held:
            yield from out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, [], None
        for b in batches:
            out = []
            for i in range(b.num_rows):
                kind, bucket, value = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(3)[i].as_py()
                if bucket != now:
                    now, held, known = bucket, [], None
                if kind == -1:
                    step, n = unpacked(value, np.uint64, np.int64)
                    held.append((np.cumsum(step, dtype=np.uint64), n))
                    continue
                if known is None:
                    words = np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in held)])
                    order = np.argsort(words)
                    known = words[order], np.concatenate([np.zeros(0, np.int64), *(x[1] for x in held)])[order]
                at, there = among(known[0], np.cumsum(unpacked(value, np.uint64)[0], dtype=np.uint64))
                n = np.where(there, known[1][at], 0) if len(known[1]) else np.zeros(len(at), np.int64)
                out.append({"kind": ANSWER, "bucket": b.column(2)[i].as_py(), "key": now, "a": packed(n)})
            if out:
                yield _batch(out, _schema())

    words = counts.select("word", "n").mapInArrow(dealt, ROW)
    asked = found.where(F.col("kind") == ASKED).select(*ROW_NAMES)
    return _by_bucket(words.unionByName(asked), buckets).mapInArrow(run, ROW)


def resolved(found: DataFrame, answers: DataFrame, sent, d: np.ndarray, buckets: int) -> DataFrame:
    """Rows WEIGHT (a: histories that one bucket has wholly, their counts, what they are divided by, alpha), sums of what backs off,
    and of histories spread over buckets: OPEN, b: texts' tokens that wait for them, or their own sums (a)."""
    k = cutoff(d)

    def one(answer: list, packs: list, waiting: list, v: Totals, bucket: int) -> Iterator[dict]:
        n_w = np.concatenate([np.zeros(0, np.int64), *(unpacked(a, np.int64)[0] for _, a in sorted(answer))])
        p = v.word_p(n_w)
        step, n_h, per = unpacked(packs[0], np.uint64, np.int64, np.uint32)
        place, count = unpacked(packs[1], np.uint32, np.uint64)
        hists = np.cumsum(step, dtype=np.uint64)
        wide = among(v.wide, hists)[1]
        h_of = np.repeat(np.arange(len(hists)), per)
        small = np.minimum(count, CUT + 1).astype(int)
        freed = np.bincount(h_of, np.where(small <= k, (1 - d[np.minimum(small, CUT)]) * count, 0.0), minlength=len(hists))
        taken = np.bincount(h_of, p[place], minlength=len(hists))
        own = np.flatnonzero(~wide & (n_h > 0))
        div, alpha = weights(n_h, freed, taken, v.unseen)
        yield {"kind": WEIGHT, "bucket": bucket, "a": packed(_deltas(hists[own]), n_h[own], div[own], alpha[own])}
        some = np.flatnonzero(wide)
        if len(some):
            yield {"kind": OPEN, "bucket": bucket, "a": packed(hists[some], n_h[some], freed[some], taken[some])}
        alpha = np.where(n_h > 0, alpha, 1.0)
        for base, a in waiting:
            row, h, w, n, seen = unpacked(a, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8)
            fresh = seen == 0
            score = np.where(fresh, np.log10(np.maximum(p[w] if len(p) else 1.0, 1e-300)) + np.where(wide[h], 0.0, np.log10(alpha[h])), 0.0)
            yield {"kind": SUMMED, "key": base, "a": _text_sums(row, n, _units(score))}
            later = wide[h]
            if later.any():
                yield {"kind": OPEN, "key": base, "b": packed(row[later], hists[h[later]], n[later], seen[later])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answer, packs, waiting = None, [], None, []
        for b in batches:
            for i in range(b.num_rows):
                kind, bucket, key, x, y = (b.column(c)[i].as_py() for c in range(5))
                if bucket != now:
                    if packs:
                        yield from _out(one(answer, packs, waiting, sent.value, now), _schema())
                    now, answer, packs, waiting = bucket, [], None, []
                if kind == ANSWER:
                    answer.append((key, x))
                elif kind == HISTORIES:
                    packs = (x, y)
                else:
                    waiting.append((key, x))
        if packs:
            yield from _out(one(answer, packs, waiting, sent.value, now), _schema())

    rows = found.where(F.col("kind").isin(HISTORIES, UNSEEN)).select(*ROW_NAMES)
    return _by_bucket(rows.unionByName(answers), buckets).mapInArrow(run, ROW)


def weights(n_h: np.ndarray, freed: np.ndarray, taken: np.ndarray, unseen: float) -> tuple[np.ndarray, np.ndarray]:
    """What counts after histories are divided by, and alpha: n_h their counts, freed what discounts leave of these, taken the p of
    the words seen after them, of which p of the words never seen is always left."""
    div = np.where(freed > 1e-9, n_h, n_h + 1).astype(float)
    left = np.where(freed > 1e-9, freed, 1.0) / np.maximum(div, 1)
    return div, left / np.maximum(1 - taken, max(unseen, 1e-300))


def text_sums(found: DataFrame, open_: dict, d: np.ndarray) -> DataFrame:
    """row, score, base and known of each text, from rows of SUMMED and OPEN."""
    k, log_d = cutoff(d), _units(np.log10(d[1:]))
    sent = found.sparkSession.sparkContext.broadcast(open_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        now, held = None, []

        def out() -> pa.RecordBatch:
            rows = np.concatenate([x[0] for x in held])
            no, back = np.unique(rows, return_inverse=True)
            sums = []
            for i in range(1, 4):
                total = np.zeros(len(no), np.int64)
                np.add.at(total, back, np.concatenate([x[i] for x in held]))
                sums.append(pa.array(total))
            return pa.RecordBatch.from_arrays([pa.array(now + no.astype(np.int64)), *sums], ["row", "score", "base", "known"])

        for b in batches:
            for i in range(b.num_rows):
                kind, key, x, y = (b.column(c)[i].as_py() for c in range(4))
                if key != now and held:
                    yield out()
                    held = []
                now = key
                if kind == SUMMED:
                    step, *sums = unpacked(x, np.int64, *[np.int64] * SUMS)
                    rows = np.cumsum(step)
                    full = [s if len(s) else np.zeros(len(rows), np.int64) for s in sums]
                    score = full[0] + sum(full[3 + r] * int(log_d[r]) for r in range(CUT)) - sum(full[3 + CUT + r - 2] for r in range(2, CUT + 2) if r > k)
                    held.append((rows, score, full[1], full[2]))
                else:
                    row, h, n, seen = unpacked(y, np.uint32, np.uint64, np.uint32, np.uint8)
                    at = among(v["h"], h)[0]
                    score = np.where(seen > 0, -v["div"][at], v["alpha"][at]) * n
                    held.append((row.astype(np.int64), score.astype(np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)))
                if sum(len(x[0]) for x in held) > HELD // 2:
                    yield out()
                    held = []
        if held:
            yield out()

    rows = found.where((F.col("kind") == SUMMED) | F.col("kind").eqNullSafe(OPEN) & F.col("b").isNotNull()).select("kind", "key", "a", "b")
    parts = shuffle_partitions(found.sparkSession)
    # a chunk's rows in several tasks: few chunks may have most of the rows
    sums = rows.repartition(parts, "key", F.pmod(F.xxhash64("a", "b"), F.lit(8))).sortWithinPartitions("key").mapInArrow(run, "row long, score long, base long, known long")
    return sums.groupBy(F.col("row").alias("_row")).agg(*[F.sum(c).alias(c) for c in ("score", "base", "known")])


def spread_weights(found: DataFrame, v: Totals) -> dict:
    """Of histories spread over buckets, which the driver may hold: hash, and the logarithms of what they're divided by and of alpha."""
    n = len(v.wide)
    freed, taken = np.zeros(n), np.zeros(n)
    for r in found.where((F.col("kind") == OPEN) & F.col("a").isNotNull()).select("bucket", "a").orderBy("bucket").toLocalIterator():
        h, _, f, t = unpacked(bytes(r["a"]), np.uint64, np.int64, np.float64, np.float64)
        at = among(v.wide, h)[0]
        freed[at] += f
        taken[at] += t
    div, alpha = weights(v.n_wide, freed, taken, v.unseen)
    return {"h": v.wide, "div": _units(np.log10(np.maximum(div, 1))), "alpha": _units(np.where(v.n_wide > 0, np.log10(alpha), 0.0))}


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 p of the text with its end) by row.

    Learns from rows whose crc32(id as text) mod ``folds`` isn't 0; a null id teaches nothing and isn't held out. Null
    texts are empty: an end alone. Repeated rows count and are scored each. Nothing to learn from: all words are one
    event, of probability 1. An empty table gives an empty one. Other columns are ignored.
    """
    spark = docs.sparkSession
    rest = doc_remainder(F.col("id"), folds)
    text = pick(docs, id_col, text_col).toDF("id", "text").select("id", (F.coalesce(rest, F.lit(-1)) == 0).alias("held_out"), F.coalesce(rest > 0, F.lit(False)).alias("learns"), "text")
    counts = written(word_counts(text.where("learns")), "words")
    v = totals(counts)
    sent = spark.sparkContext.broadcast(v)
    found = written(counted(occurrences(text, sent), sent, v.buckets), "bigrams", "kind")
    types = found.where(F.col("kind") == LEVELS).select(F.posexplode("levels").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()
    d = discounts(np.array([0, *(n for _, n in sorted((t["r"], t["n"]) for t in types)), *[0] * (CUT + 1)])[: CUT + 2])
    rest = written(resolved(found, answered(counts, found, sent, v.buckets), sent, d, v.buckets), "weights", "kind")
    dropped(counts)
    sums = text_sums(found.select("kind", "key", "a", "b").unionByName(rest.select("kind", "key", "a", "b")), spread_weights(rest, v), d)
    texts = found.where(F.col("kind") == TEXT).select("key", "id", "held_out", "n_tokens")
    joined = texts.join(sums, F.col("key") == F.col("_row"))  # each text has an end, so sums
    scale = math.log10(v.tokens + 0.1 * (v.types + 1))
    return joined.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") / UNIT - F.col("n_tokens") * scale).alias("base_score"), (F.col("score") / UNIT).alias("score"),
    )


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
