"""N-gram Jaccard join of all documents by parity sketches.

A document is its set of distinct 5-word shingles. Texts of equal sets are one node. A set's hashes fall into the blocks
of a sketch, and each block keeps the exclusive or of its hashes: a shingle that only one of two sets has changes one
block, so the number of blocks that differ is at most the size of the symmetric difference. For sizes a <= b and a Jaccard
index of at least 3/4 that is at most (a + b) / 7, or a third of either size. By the pigeonhole principle two such sets of
a size band agree in a block among the first d + 1 in any common order of their non-empty blocks (fullest first, then by
hash), and in r blocks among the first d + r. These blocks are the join keys.

Keys that more than FEW nodes share are hot. Other keys give all their pairs. As r keys agree, either a quarter of them are
not hot, so a pair has to share so many such keys; or hot ones matter, but only for pairs of nodes that both have three
quarters of r of them, and of these nodes only the rarest ones. Each such key first pairs its nodes
with the one that has the most hot keys for its size, which links most copies of one text. What remains apart is compared
across components, in blocks of CHUNK nodes, by the parity bits of the sketches; nodes already in one component need no
further link. Every candidate pair is verified on its texts' whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SENT_KEYS, SPACED, Words, buffers, dealt, dropped, mix, ordered, packed, pick, restored, rolling, shuffle_partitions, steps, table, unpacked, without, written
from .components import beside, components

SHINGLE = 5
#: Nodes that share a key up to which it gives all pairs.
FEW = 8
#: Nodes of a hot key that are compared at once.
CHUNK = 4096
#: Keys that a task holds before it deals them out.
HELD = 500_000
#: Bytes of text whose keys meet in one task, about.
BUCKET_BYTES = 32 << 20
#: Tasks for keys at least, if the session's shuffles have as many.
LEAST_BUCKETS = 16
#: Pairs that one text is compared in at once.
PARTNERS = 64
#: Places of the bit table that chooses rows: 8 MB.
SLOTS = 1 << 26
#: Words of sketches that a comparison of nodes holds at once.
HELD_WORDS = 2_000_000
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A5A5A5A5A5A5A5)


def least_blocks(size: np.ndarray) -> np.ndarray:
    """d: blocks that differ at most between a set of this size and any that links to it."""
    return size // 3


def spare_blocks(size: np.ndarray) -> np.ndarray:
    """r: blocks that agree at least among the first d + r."""
    return size // 8 + 2


def shingle_sets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct shingle, by text and hash."""
    w = Words(raw, at, SPACED)
    h = rolling(w.hash, SHINGLE)
    own = np.flatnonzero(w.doc[: len(h)] == w.doc[len(w.doc) - len(h) :]) if len(h) else np.zeros(0, np.int64)
    doc, h = w.doc[own], h[own]
    short = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
    if len(short):
        whole = [mix(rolling(w.hash[w.first[i] : w.first[i + 1]], int(w.count[i])) + np.uint64(w.count[i])) for i in short.tolist()]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, *whole])
    order = ordered(doc, h)
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    return doc[new], h[new]


def node_of(size: np.ndarray, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A 64-bit number of each non-empty set; equal sets have equal ones."""
    total = np.zeros(len(size), np.uint64)
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        total[doc[first]] = np.add.reduceat(mix(h ^ _A), first)
    return mix(total + size.astype(np.uint64)).view(np.int64)


def parity_bits(h: np.ndarray) -> bytes:
    """A bit for each of 256, 512 .. (not fewer than four times the set's size) places: is the number of hashes there odd?"""
    m = max(256, 4 << (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1, bitorder="little").tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of one length, folded to so many bytes, which keeps parities; as 64-bit words by sketch."""
    parts = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1, size // 8)
    return np.bitwise_xor.reduce(parts, axis=1)


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two parity sketches; the longer one is folded to the other's length."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded([a], size) ^ folded([b], size)).sum())


def block_keys(size: np.ndarray, doc: np.ndarray, h: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, 40-bit key) of the first d + r blocks of each set, in the band of sizes up to ``bound`` of its text; 0: none."""
    use = bound[doc] > 0
    doc, h = doc[use], h[use]
    top = bound[doc].astype(np.uint64)
    blocks = top - top // np.uint64(4)  # enough that over d + r of them are not empty
    block = np.where(top > 64, (mix(h ^ _B) >> np.uint64(32)) * blocks >> np.uint64(32), h)  # small sets: a block for each hash
    order = ordered(doc, block)
    doc, h, block, top = doc[order], h[order], block[order], top[order]
    if not len(h):
        return doc, h
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])]))
    n = np.diff(np.concatenate([first, [len(h)]]))
    key = mix(np.bitwise_xor.reduceat(h, first) ^ mix(block[first] + mix(top[first]))) >> np.uint64(24)
    doc = doc[first]
    order = ordered(doc, np.uint64((1 << 23) - 1) - np.minimum(n, (1 << 23) - 1).astype(np.uint64) << np.uint64(40) | key)  # fullest first
    doc, key = doc[order], key[order]
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    rank = np.arange(len(doc)) - np.repeat(start, np.diff(np.concatenate([start, [len(doc)]])))
    keep = rank < (least_blocks(size) + spare_blocks(size))[doc]
    return doc[keep], key[keep]


def row_key() -> F.Column:
    """A 64-bit number of a row's id and text."""
    return F.xxhash64("id", "text").alias("key")


def sketched(docs: DataFrame) -> DataFrame:
    """Of (id, text): id, n, node, sketch and key (of id and text) for each row; node and sketch are null for an empty set."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = buffers(b.column(1))
            n_all, nodes_all, sketches = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for lo, hi in steps(at):
                doc, h = shingle_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                n = np.bincount(doc, minlength=hi - lo)
                ends = np.cumsum(n)
                sketches += [parity_bits(h[e - k : e]) if k else None for e, k in zip(ends.tolist(), n.tolist())]
                n_all.append(n)
                nodes_all.append(node_of(n, doc, h))
            n, node = np.concatenate(n_all).astype(np.int64), np.concatenate(nodes_all)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(node, mask=n == 0), pa.array(sketches, pa.binary()), b.column(2)], ["id", "n", "node", "sketch", "key"])

    return docs.select("id", "text", row_key()).mapInArrow(run, f"id {kind}, n long, node long, sketch binary, key long")


def keyed(docs: DataFrame, buckets: int) -> DataFrame:
    """Of (text): packed keys by bucket: different nodes and their sizes, then keys with the nodes that have them. Texts are
    shingled once more for this, as rows and keys in one table would take disk twice, there and in the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def deal():
            key, node, n_node = (np.concatenate([h[i] for h in held]) for i in range(3))
            out_bucket, out = [], []
            for b, (k, n, m) in dealt((key % np.uint64(buckets)).astype(np.int64), buckets, key, node, n_node):
                order = np.argsort(k, kind="stable")
                nodes, first, at = np.unique(n[order], return_index=True, return_inverse=True)
                out_bucket.append(b)
                out.append(packed(nodes, m[order][first].astype(np.uint32), np.diff(k[order], prepend=np.uint64(0)), at.astype(np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out, pa.binary())], ["bucket", "packed"])

        for b in batches:
            raw, at = buffers(b.column(0))
            for lo, hi in steps(at):
                doc, h = shingle_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                n = np.bincount(doc, minlength=hi - lo)
                node = node_of(n, doc, h)
                # equal sets of this step give keys once
                once = np.zeros(hi - lo, bool)
                once[np.unique(node, return_index=True)[1]] = True
                band = np.ones(hi - lo, np.int64)
                while (low := band < n).any():
                    band[low] *= 4
                for bound in (np.where(once & (n > 0), band, 0), np.where(once & (n > 0) & (4 * n > 3 * band), 4 * band, 0)):
                    d, k = block_keys(n, doc, h, bound)
                    held.append((k, node[d], n[d]))
                    size += len(k)
                if size > HELD:
                    yield deal()
                    held, size = [], 0
        if size:
            yield deal()

    return docs.select("text").mapInArrow(run, "bucket int, packed binary")


def matched(packs: DataFrame) -> DataFrame:
    """Of (bucket, packed), by bucket: pairs u, v of keys that few nodes share, of sizes n and m that allow a link, with g, the
    number of such keys (key null); and node u of size n, key and g (nodes that share it) for each node of a hot key."""
    names = ["u", "v", "n", "m", "key", "g"]

    def found(held: list) -> Iterator[pa.RecordBatch]:
        key, node, size = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((node, key))
        key, node, size = key[order], node[order], size[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node, size = key[new], node[new], size[new].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        g = np.diff(np.concatenate([first, [len(key)]]))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for many in range(2, FEW + 1):
            at = first[g == many]
            for i in range(many):
                for j in range(i + 1, many):
                    p, q = size[at + i], size[at + j]
                    fits = at[4 * np.minimum(p, q) >= 3 * np.maximum(p, q)]
                    left.append(fits + i)
                    right.append(fits + j)
        left, right = np.concatenate(left), np.concatenate(right)
        order = np.lexsort((node[right], node[left]))
        left, right = left[order], right[order]
        u, v = node[left], node[right]
        new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])) if len(u) else np.zeros(0, np.int64)
        shared = np.diff(np.append(new, len(u)))
        hot = np.flatnonzero(np.repeat(g > FEW, g))
        both = [
            (u[new], v[new], size[left[new]], size[right[new]], None, shared.astype(np.int64)),
            (node[hot], None, size[hot], None, key[hot].astype(np.int64), np.repeat(g, g)[hot].astype(np.int64)),
        ]
        for columns in both:
            for lo in range(0, len(columns[0]), 100_000):
                n = len(columns[0][lo : lo + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) if c is not None else pa.nulls(n, pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, value in zip(b.column(0).to_pylist(), b.column(1)):
                if bucket != now and held:
                    yield from found(held)
                    held = []
                now = bucket
                nodes, n, step, at = unpacked(value.as_py(), np.int64, np.uint32, np.uint64, np.uint32)
                held.append((np.cumsum(step, dtype=np.uint64), nodes[at], n[at]))
        if held:
            yield from found(held)

    return packs.mapInArrow(run, "u long, v long, n long, m long, key long, g long")


def agreeing(size: F.Column) -> F.Column:
    """Hot keys that a node of this size has to share with another; of fewer, the rest of the keys that agree are not hot."""
    return F.greatest(F.floor((F.floor(F.floor((3 * size + 3) / 4) / 8) + 2) * 3 / 4), F.lit(1))


def counted_pairs(found: DataFrame) -> DataFrame:
    """Pairs u, v that share as many keys, not hot, as a link needs."""
    sums = found.groupBy("u", "v").agg(F.sum("g").alias("g"), F.least(F.min("n"), F.min("m")).alias("n"), F.greatest(F.max("n"), F.max("m")).alias("m"))
    return sums.where(F.col("g") >= F.floor(F.col("n") / 8) + 3 - agreeing(F.col("m"))).select("u", "v")


def near(a: int, b: int) -> bool:
    """Sizes that a Jaccard index of at least 3/4 allows."""
    return 4 * min(a, b) >= 3 * max(a, b)


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes and parity sketches don't rule a link out."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.to_pydict()
            keep = [near(p, q) and 7 * distance(s, t) <= p + q for p, q, s, t in zip(x["n_u"], x["n_v"], x["s_u"], x["s_v"])]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(pairs, "near")
    nodes = nodes.where(in_slots(pairs.select(F.explode(F.array("u", "v")).alias("node")), F.col("node")))
    both = beside(beside(pairs, side("u"), "u", "v"), side("v"), "v", "u")
    return both.select("u", "v", "n_u", "n_v", "s_u", "s_v").mapInArrow(run, "u long, v long")


def slots(keys: DataFrame) -> np.ndarray:
    """A bit for each of SLOTS places: is it some key's (keys: one long column)? So many bits, however many keys there are."""
    place = F.pmod(F.col(keys.columns[0]), F.lit(SLOTS))
    words = keys.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(pmod({keys.columns[0]}, {SLOTS}) & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(SLOTS // 64, np.uint64)
    out[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_slots(keys: DataFrame, key: F.Column) -> F.Column:
    """Is the key's place some key's: false only for keys that are not among them."""
    sent = keys.sparkSession.sparkContext.broadcast(slots(keys))

    @F.pandas_udf("boolean")
    def test(x: pd.Series) -> pd.Series:
        place = x.to_numpy(np.int64) % SLOTS
        return pd.Series((sent.value[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return test(key)


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets have a Jaccard index of at least 3/4. One row's text of each node that takes part is
    read again: rows whose keys can't be such a node's are left out by a bit table, so that few texts are shuffled. A pair is
    compared beside its end with more pairs, in groups of PARTNERS, so each text goes once for each pair or group."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("_node")).groupBy("_node").agg(F.count(F.lit(1)).alias("degree"))
    ends = written(nodes.select("node", "key").join(ends, F.col("node") == F.col("_node")).select("node", "key", "degree"), "ends")
    side = lambda c: ends.select(F.col("node").alias(c), F.col("key").alias(f"key_{c}"), F.col("degree").alias(f"degree_{c}"))
    both = beside(beside(pairs, side("u"), "u", "v"), side("v"), "v", "u")
    left = F.col("degree_u") >= F.col("degree_v")
    pick_ = lambda c, d: F.when(left, F.col(c)).otherwise(F.col(d))
    paired = both.select(pick_("u", "v").alias("main"), pick_("v", "u").alias("node"), pick_("key_u", "key_v").alias("main_key"), pick_("key_v", "key_u").alias("key"), F.ceil(F.greatest("degree_u", "degree_v") / PARTNERS).alias("groups"))
    paired = written(paired.select("main", "node", "main_key", "key", F.pmod(F.xxhash64("node"), "groups").alias("part")), "paired")
    mains = paired.select("main", "part", F.col("main").alias("node"), F.col("main_key").alias("key")).distinct()
    members = mains.unionByName(paired.select("main", "part", "node", "key"))
    texts = docs.select(row_key(), "text").where(in_slots(ends.select("key"), F.col("key"))).groupBy(F.col("key").alias("_key")).agg(F.first("text").alias("text"))
    placed = members.join(texts, F.col("key") == F.col("_key")).select("main", "part", "node", "text")
    placed = placed.repartition(shuffle_partitions(docs.sparkSession), "main", "part").sortWithinPartitions("main", "part", F.col("node") != F.col("main"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, x = None, None, np.zeros(0, np.uint64)
        for b in batches:
            raw, cut = buffers(b.column(3))
            main, part, node = (b.column(i).to_numpy() for i in range(3))
            u, v = [], []
            for lo, hi in steps(cut):
                doc, h = shingle_sets(raw[cut[lo] : cut[hi]], cut[lo : hi + 1] - cut[lo])
                ends_ = np.cumsum(np.bincount(doc, minlength=hi - lo))
                for i in range(lo, hi):
                    y = h[ends_[i - lo - 1] if i > lo else 0 : ends_[i - lo]]
                    if node[i] == main[i]:
                        own, at, x = main[i], part[i], y.copy()
                    elif own == main[i] and at == part[i]:
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * common >= 75 * (len(x) + len(y) - common):
                            u.append(min(main[i], node[i]))
                            v.append(max(main[i], node[i]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return placed.mapInArrow(compare, "u long, v long")


def rarest_keys(hot: DataFrame) -> DataFrame:
    """key, node, n and share (of hot keys) for the nodes that hot keys alone may link, and their rarest hot keys."""
    per = hot.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("hot"))
    by = Window.partitionBy("u").orderBy("g", "key")  # a node's keys: as many as its blocks
    rare = hot.withColumn("rank", F.row_number().over(by)).join(per, F.col("u") == F.col("node"))
    rare = rare.where((F.col("hot") >= agreeing(F.col("n"))) & (F.col("rank") <= F.col("hot") - agreeing(F.col("n")) + 1))
    return rare.select("key", "node", "n", (F.col("hot") / F.col("n")).alias("share"))


def hub_pairs(rare: DataFrame) -> DataFrame:
    """Each key's nodes with the one of the greatest share of hot keys."""
    hubs = rare.groupBy("key").agg(F.max_by("node", F.struct("share", "node")).alias("hub"), F.max_by("n", F.struct("share", "node")).alias("m"))
    fits = 4 * F.least("n", "m") >= 3 * F.greatest("n", "m")
    return rare.select("key", "node", "n").join(hubs, "key").where((F.col("node") != F.col("hub")) & fits).select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()


def hot_pairs(rare: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of nodes that share a hot key, that no link has brought together, and whose sketches don't rule one out."""
    rooted = rare.join(roots.withColumnRenamed("node", "_r"), F.col("node") == F.col("_r"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "hot")
    per_key = rooted.groupBy("key").agg(F.min("root").alias("main"), F.max("root").alias("other"), F.count(F.lit(1)).alias("g")).where("main <> other").select(F.col("key").alias("_key"), "main", "g")
    sides = rooted.select("key", "root").join(per_key, F.col("key") == F.col("_key")).where("root <> main").groupBy("_key", "main", "g").agg(F.count(F.lit(1)).alias("k"))
    keys = written(sides, "keys")
    keys = F.broadcast(keys) if keys.count() <= SENT_KEYS else keys
    open_ = written(rooted.join(keys, F.col("key") == F.col("_key")).drop("_key"), "open")
    dropped(rooted)
    nodes = nodes.where(in_slots(open_.select("node"), F.col("node"))).select(F.col("node").alias("_n"), "sketch")
    open_ = open_.join(nodes, F.col("node") == F.col("_n")).select(
        "key", "node", "n", "sketch", "root", (F.col("root") != F.col("main")).alias("side"), F.ceil(F.col("g") / CHUNK).cast("int").alias("rows"), F.ceil(F.col("k") / CHUNK).cast("int").alias("cols")
    )
    # a node stands on the left of its row of cells, and if it isn't of the main component on the right of its column
    row, col = F.pmod(F.xxhash64("node"), "rows").cast("int"), F.pmod(F.xxhash64("node"), "cols").cast("int")
    cell = lambda i, j, right: F.struct(i.alias("i"), j.alias("j"), F.lit(right).alias("right"))
    left = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda j: cell(row, j, False))
    right = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: cell(i, col, True))
    places = F.when(F.col("side"), F.concat(left, right)).otherwise(left)
    cells = open_.select("key", "node", "n", "sketch", "root", F.explode(places).alias("c")).select("key", "c.i", "c.j", "node", "n", "sketch", "root", "c.right")
    cells = cells.repartition(shuffle_partitions(rare.sparkSession), "key", "i", "j")

    def compare(cell: pa.Table) -> pa.Table:
        n, node, root, right = (cell.column(c).to_numpy() for c in ("n", "node", "root", "right"))
        sketch = cell.column("sketch").to_pylist()
        width, out = np.array([len(x) for x in sketch]), []
        for a in np.unique(width[right]).tolist():
            for b in np.unique(width[~right]).tolist():
                r, l = np.flatnonzero(right & (width == a)), np.flatnonzero(~right & (width == b))
                if 4 * n[r].max() < 3 * n[l].min() or 4 * n[l].max() < 3 * n[r].min():
                    continue
                x, y = (folded([sketch[i] for i in at.tolist()], min(a, b)) for at in (r, l))
                step = max(1, HELD_WORDS // y.size)
                for lo in range(0, len(r), step):
                    part = r[lo : lo + step]
                    apart = np.bitwise_count(x[lo : lo + step, None] ^ y).sum(axis=2, dtype=np.int64)
                    p, q = n[part][:, None], n[l]
                    i, j = np.nonzero((7 * apart <= p + q) & (4 * np.minimum(p, q) >= 3 * np.maximum(p, q)) & (root[part][:, None] != root[l]))
                    out.append((node[part[i]], node[l[j]]))
        u, v = (np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in (0, 1))
        return pa.table({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v))})

    return cells.groupBy("key", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the least id reachable by links, its own included) for each row of docs.

    Words are lower-cased (A-Z) and shingled by five; fewer words make one shingle, none make an empty set, which links to
    nothing. Links: a Jaccard index of at least 3/4. Null text: empty. Null ids: their rows link like others, but are no
    component's id unless all its ids are null. Repeated rows link to each other. An empty table gives an empty one. Other
    columns are ignored. Sets are compared by 64-bit hashes of shingles.
    """
    text = pick(docs, id_col, text_col).toDF("id", "text")
    size = text.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(min(shuffle_partitions(docs.sparkSession), LEAST_BUCKETS), -(-size // BUCKET_BYTES))
    packs = keyed(text, buckets).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    found = written(matched(packs), "matched")
    every = written(sketched(text), "sketches")
    rows = written(every.select("id", "n", "node"), "rows")
    nodes = written(every.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("key").alias("key")), "nodes")
    dropped(every)
    rare = written(rarest_keys(found.where("key is not null").select("u", "n", "key", "g")), "rare")
    likely = written(plausible(counted_pairs(found.where("key is null")).unionAll(hub_pairs(rare)).distinct(), nodes), "pairs")
    dropped(found)
    links = written(verified(likely, text, nodes), "links")
    dropped(likely)
    roots = components(links)
    more = written(hot_pairs(rare, roots, nodes), "pairs")
    if not more.isEmpty():
        roots = components(links.unionAll(verified(more, text, nodes)))
    dropped(rare, more, links)
    # ids: the least of each node, then of each component
    placed = nodes.select("node", "id").join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("id").alias("component")).withColumnRenamed("root", "_root")
    named = placed.join(least, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "component")
    joined = rows.select("id", "n", "node").join(named, F.col("node") == F.col("_node"), "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, without those linked to a row of a lesser id (of equal ids, a lesser text
    hash), and repeated rows of one id and text once. Rows with an empty set all stay."""
    keyed = pick(docs, id_col, text_col).toDF("id", "text")
    found = written(near_duplicates(keyed.select(F.struct("id", F.xxhash64("text").alias("key")).alias("id"), "text"), "id", "text"), "groups")
    kept = without(docs, id_col, text_col, found.where("id <> component_id").select("id.*"))
    again = found.where("n_shingles > 0").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id.*")
    if again.isEmpty():
        return kept
    # repeated rows are rare: only they are brought together
    names = list(docs.columns)
    plain = kept.toDF(*[f"c{i}" for i in range(len(names))])
    i, t = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    twice = plain.join(again.withColumnsRenamed({"id": "_id", "key": "_key"}), F.col(i).eqNullSafe(F.col("_id")) & (F.xxhash64(t) == F.col("_key")), "left_semi")
    return without(kept, id_col, text_col, again).unionAll(restored(twice.dropDuplicates([i, t]), names))


def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
