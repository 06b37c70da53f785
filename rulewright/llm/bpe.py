"""BPE encoding and decoding with a deterministic automaton over tokens.

Compilation begins with the automaton of all byte strings (one state, an arc to itself for each byte) and adds one gadget
for each merge (u, v) -> w, in order of rank. Wherever a u-arc leads to a state with a v-arc, the u-arc is led to a copy
of that state without the v-arc, and beside the u-arc there is a new w-arc to where the v-arc led. What remains accepts
exactly the token strings that the merges make, one for each byte string. All arcs of one label lead to one state, so the
automaton is two tables: the state after each token, and a bit for each state and token (is there such an arc?), in blocks
of BLOCK bytes of which equal ones are kept once.

A pre-split word is encoded by one sweep over its bytes: from each place reached, arcs whose labels are the next bytes
are followed. Each place is reached by one path only, the encoding of the bytes so far. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, pick, table

#: How byte-level BPE splits text into words before merging (fixed by the vocabulary's format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of encoded words that a task remembers, about: of two halves, the one not used for longer is forgotten.
REMEMBERED = 48 << 20
#: Bytes of arc bits in a block.
BLOCK = 64
#: Tokens that are decoded at once.
DECODED = 1 << 16
#: Bytes of results in one Arrow batch.
BATCH_BYTES = 4 << 20


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _blocks(arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different blocks of the rows, and the number of each row's blocks among them."""
    padded = np.zeros((len(arcs), -(-arcs.shape[1] // BLOCK) * BLOCK), np.uint8)
    padded[:, : arcs.shape[1]] = arcs
    all_blocks = padded.reshape(-1, BLOCK)
    key = np.zeros(len(all_blocks), np.uint64)
    for lane in all_blocks.view(np.uint64).T:
        key = mix(key + lane)
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    blocks = all_blocks[first]
    if any((blocks[number[i : i + 100_000]] != all_blocks[i : i + 100_000]).any() for i in range(0, len(number), 100_000)):
        raise RuntimeError("two blocks of arcs have one hash")
    return blocks, number.astype(np.int32).reshape(len(arcs), -1)


class Automaton:
    """label, start: the tokens' bytes, end to end, and where each begins; after: the state that its arcs lead to; blocks, number:
    the arcs' bits by state and token."""

    def __init__(self, label: bytes, start: np.ndarray, after: np.ndarray, blocks: bytes, number: np.ndarray, special: dict[str, int]):
        self.label, self.start, self.size, self.special = np.frombuffer(label, np.uint8), start[:-1], np.diff(start), special
        self.after, self.blocks, self.number, self.width = array("i", after.tobytes()), blocks, array("i", number.tobytes()), number.shape[1]
        cuts, own = start.tolist(), set(special.values())
        self.whole = {label[cuts[i] : cuts[i + 1]]: i for i in range(len(cuts) - 1) if cuts[i] < cuts[i + 1] and i not in own}
        self.next: dict[int, int] = {}
        token = [-1]
        for text, i in self.whole.items():
            node = 0
            for b in text:
                step = node << 8 | b
                if step not in self.next:
                    self.next[step] = len(token)
                    token.append(-1)
                node = self.next[step]
            token[node] = i
        self.token = array("i", token)
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.remembered = 0

    @classmethod
    def compiled(cls, path: str) -> tuple:
        """The parts of the automaton for a vocabulary file, small enough to broadcast: its size depends on the vocabulary alone."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *special.values()]) + 1
        labels: list[bytes | None] = [None] * n
        for word, i in vocab.items():
            labels[i] = word.encode() if word in special else bytes(letters[c] for c in word)
        for word, i in special.items():
            labels[i] = word.encode()
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        made = {w for _, _, w in merges}
        single = [i for i, x in enumerate(labels) if x is not None and len(x) == 1 and i not in made]
        arcs = np.zeros((1024, (n + 7) // 8), np.uint8)
        for b in single:
            arcs[0, b >> 3] |= 1 << (b & 7)
        after, states = np.zeros(n, np.int32), 1
        led = [len(single) + 1]  # labels that lead to each state; the start counts as one
        for u, v, w in merges:
            s, beyond = after[u], after[v]
            if not arcs[s, v >> 3] >> (v & 7) & 1:
                continue  # the two never meet: w is never made
            if led[s] > 1 or u == v:  # for u u the old state stays: it is where the new arc leads
                if states == len(arcs):
                    arcs = np.concatenate([arcs, np.zeros_like(arcs)])
                arcs[states] = arcs[s]
                led[s] -= 1
                led.append(1)
                after[u] = s = states
                states += 1
            arcs[s, v >> 3] &= 255 ^ (1 << (v & 7))
            arcs[:states, w >> 3] |= (arcs[:states, u >> 3] >> (u & 7) & 1) << (w & 7)
            after[w] = beyond
            led[beyond] += 1
        blocks, number = _blocks(arcs[:states])
        start = np.cumsum([0, *(len(x or b"") for x in labels)])
        return b"".join(x or b"" for x in labels), start, after, blocks.tobytes(), number, special

    def has(self, state: int, token: int) -> int:
        return self.blocks[self.number[state * self.width + (token >> 9)] * BLOCK + (token >> 3 & 63)] >> (token & 7) & 1

    def word(self, data: bytes) -> list[int]:
        """Tokens of one pre-split word."""
        blocks, number, width, after, step, token, n = self.blocks, self.number, self.width, self.after, self.next, self.token, len(data)
        whole = self.whole.get(data)
        if whole is not None and self.has(0, whole):
            return [whole]
        state, came = [-1] * (n + 1), [(0, 0)] * (n + 1)
        state[0] = 0
        for i in range(n):
            node, j, row = 0, i, state[i] * width
            while j < n:
                node = step.get(node << 8 | data[j], -1)
                if node < 0:
                    break
                j += 1
                t = token[node]
                if t >= 0 and state[j] < 0 and blocks[number[row + (t >> 9)] * BLOCK + (t >> 3 & 63)] >> (t & 7) & 1:
                    state[j], came[j] = after[t], (t, i)
        out, i = [], n
        while i:
            t, i = came[i]
            out.append(t)
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Tokens as little-endian unsigned 32-bit integers."""
        pieces = self.cut.split(text) if self.cut else [text]
        out, words, older = [], self.words, self.older
        for piece in pieces:
            if piece in self.special:
                out.append(struct.pack("<I", self.special[piece]))
                continue
            for w in self.split.findall(piece):
                ids = words.get(w)
                if ids is None:
                    ids = older.get(w)
                    if ids is None:
                        tokens = self.word(w.encode())
                        ids = struct.pack(f"<{len(tokens)}I", *tokens)
                    if len(w) < 64:
                        self.remembered += 200 + len(w) + len(ids)
                        if self.remembered > REMEMBERED // 2:
                            self.older, self.words, self.remembered = words, {}, 0
                            words, older = self.words, self.older
                        words[w] = ids
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The arcs' labels; numbers that are no token stand for nothing."""
        ids = np.frombuffer(ids, "<u4")
        out = []
        for lo in range(0, len(ids), DECODED):
            part = ids[lo : lo + DECODED]
            part = part[part < len(self.size)]
            size = self.size[part]
            place = np.repeat(self.start[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            out.append(self.label[place].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_COMPILED: dict[str, tuple] = {}


def automaton(spark: SparkSession, path: str):
    """The compiled automaton for a vocabulary file as a broadcast variable."""
    if path not in _COMPILED:
        _COMPILED[path] = Automaton.compiled(path)
    return spark.sparkContext.broadcast(_COMPILED[path])


def _use(sent) -> Automaton:
    """A task's own automaton, which goes with it: a worker may have other work next."""
    return Automaton(*sent.value)


def _mapped(df: DataFrame, sent, method: str, kind: pa.DataType, name: str) -> DataFrame:
    """The first column, and what the automaton's method makes of the second."""
    id_field = df.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, empty = getattr(_use(sent), method), "" if method == "encode" else b""
        for b in batches:
            lo, size, out = 0, 0, []
            for i in range(b.num_rows):
                x = b.column(1)[i].as_py()
                out.append(f(x if x is not None else empty))
                size += len(out[-1])
                if size > BATCH_BYTES or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, i + 1 - lo), pa.array(out, kind)], [id_field.name, name])
                    lo, size, out = i + 1, 0, []

    return df.mapInArrow(run, f"{id_field.name} {id_field.dataType.simpleString()}, {name} {'binary' if kind == pa.binary() else 'string'}")


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (the whole text's tokens as little-endian unsigned 32-bit integers, binary) for each row.

    Strings of the vocabulary's special tokens become these tokens. Null and empty texts have no ids. Null ids of rows,
    repeated rows, an empty table: kept as they are. Other columns are ignored.
    """
    return _mapped(pick(df, id_col, text_col), automaton(df.sparkSession, vocabulary), "encode", pa.binary(), "ids")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text (what the ids stand for; bytes that aren't UTF-8 become U+FFFD) for each row; null ids: empty text."""
    return _mapped(pick(df, id_col, ids_col), automaton(df.sparkSession, vocabulary), "decode", pa.string(), "text")


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode and decode in one pass: id, ids and decoded text for each row, under the same rules."""
    sent, rows = automaton(df.sparkSession, vocabulary), pick(df, id_col, text_col)
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = _use(sent)
        for b in batches:
            lo, size, ids = 0, 0, []
            for i in range(b.num_rows):
                ids.append(use.encode(b.column(1)[i].as_py() or ""))
                size += 3 * len(ids[-1])
                if size > BATCH_BYTES or i == b.num_rows - 1:
                    texts = pa.array([use.decode(x) for x in ids], pa.string())
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, i + 1 - lo), pa.array(ids, pa.binary()), texts], [id_col, "ids", "decoded"])
                    lo, size, ids = i + 1, 0, []

    return rows.mapInArrow(run, f"{id_col} {kind}, ids binary, decoded string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(table(spark, sf_dir, "documents"), vocabulary_path()))
