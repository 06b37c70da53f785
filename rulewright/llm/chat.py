"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is trainable.
Turns after the last assistant turn (or a conversation without one) make a last example that trains nothing, so the
output holds every turn.

A turn is ``### Role: text</turn>`` and a new line. Inside texts ``\\`` becomes ``\\\\``, ``###`` becomes ``\\h`` and
``</turn>`` becomes ``\\e``; inside roles a colon becomes ``\\c`` and a new line ``\\n`` as well. So the template's own
strings never stand inside a text, and what was escaped can be told apart from what was there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

TURN, END = "### ", "</turn>\n"
_BACK = {"\\": "\\", "h": "###", "e": "</turn>", "c": ":", "n": "\n"}
EXAMPLE = "conv_id {0}, example long, n_turns long, formatted string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\h").replace("</turn>", "\\e")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends in it."""
    head = TURN + escape(role).replace(":", "\\c").replace("\n", "\\n") + ": "
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, back from a formatted example."""
    found = []
    for piece in formatted.split(END)[:-1]:
        role, _, text = piece[len(TURN) :].partition(": ")
        found.append((unescape(role), unescape(text)))
    return found


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """An example for each assistant turn, by conversation: conv_id, example (from 0), n_turns, formatted, loss_start and
    loss_end (code points of ``formatted`` that train; both 0 where nothing does).

    Turns are ordered by turn, role, text (nulls first). Null text or role: empty. Rows without a conv_id make one
    conversation with a null id. Repeated rows are turns of their own. An empty table gives no example. Other columns
    are ignored. A conversation is the unit of work: its turns meet in one row.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "example", "n_turns", "formatted", "loss_start", "loss_end"]
        types = None
        for b in batches:
            types = types or [b.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            out, size = [], 0
            for i in range(b.num_rows):
                conv, context, example, chars = b.column(0)[i].as_py(), [], 0, 0
                turns = b.column(1)[i].as_py()
                for n, t in enumerate(turns, 1):
                    piece, lo, hi = turn_text(t["role"], t["text"])
                    context.append(piece)
                    trains = t["role"] == "assistant"
                    if trains or n == len(turns):
                        at = chars if trains else 0
                        out.append((conv, example, n, "".join(context), at + lo if trains else 0, at + hi if trains else 0))
                        size += chars + len(piece)
                        example += 1
                    chars += len(piece)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names)

    return turns.mapInArrow(expand, EXAMPLE.format(kind))


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples say, by conversation: turns of the longest example, text under the loss masks, characters."""
    kind = examples.schema["conv_id"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.to_pydict()
            turns = [read_turns(f) for f in x["formatted"]]
            digest = [hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest() for ts in turns]
            loss = [unescape(f[lo:hi]) for f, lo, hi in zip(x["formatted"], x["loss_start"], x["loss_end"])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(t) for t in turns], pa.int64()), pa.array(digest), pa.array(loss), pa.array([len(f) for f in x["formatted"]], pa.int64())],
                ["conv_id", "example", "n_turns", "turns_sha256", "loss", "chars"],
            )

    read = examples.mapInArrow(parse, f"conv_id {kind}, example long, n_turns long, turns_sha256 string, loss string, chars long")
    by = read.groupBy("conv_id").agg(
        F.max_by(F.struct("n_turns", "turns_sha256"), "example").alias("last"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    return by.select("conv_id", "last.n_turns", "last.turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


#: A conversation that says the template's own strings.
TRAP = "\\### Assistant: </turn> ok"


def op10_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    return read_back(prefix_targets(rows.unionByName(trap)))


OP10_SQL = r"""WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT conv_id, role, text, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    length(replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c'), chr(10), '\n'))
      + length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')) + 14 AS size
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sums AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY n) AS chars FROM turns)
SELECT conv_id, max(n_turns) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (WHERE role = 'assistant' OR n = n_turns) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant' OR n = n_turns) AS n_examples
FROM sums GROUP BY conv_id
"""
