"""Sequences out of a stream of text lines: a blank line ends one, wherever micro-batches happen to cut."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.spec import TaskSchema

#: What is kept of a source: the next line's number, how many sequences it had, the lines of the open one, and lines that came early.
STATE = "next long, part long, open array<string>, early array<long>, values array<string>"


def framed(lines: DataFrame, schema: TaskSchema) -> DataFrame:
    """seq and samples, as apply_nested() takes them, of each sequence that has ended. lines: source, line (from 0) and value.

    Lines of a source may come in any order and more than once; each counts once, when all before it have come. A null value
    ends the source's last sequence without a blank line. A line of another number of fields than the schema's fails. What is
    kept between micro-batches is a sequence that hasn't ended and lines that came before their turn; sources are worked on
    side by side, one source's lines in their order.
    """
    names = list(schema.columns)
    sample = T.StructType([T.StructField("pos", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in names]])
    out = T.StructType([T.StructField("seq", T.StringType()), T.StructField("samples", T.ArrayType(sample))])

    def sequence(source: str, part: int, rows: list[str]) -> dict:
        samples = []
        for pos, row in enumerate(rows):
            fields = row.split()
            if len(fields) != len(names):
                raise ValueError(f"{source}, sequence {part}: {len(fields)} fields, not {len(names)}")
            samples.append({"pos": pos, **dict(zip(names, fields))})
        return {"seq": f"{source}#{part:012}", "samples": samples}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_, part, open_, early, values = state.get if state.exists else (0, 0, [], [], [])
        waiting, open_, found = dict(zip(early, values)), list(open_), []
        for f in frames:
            for line, value in zip(f["line"].tolist(), f["value"].tolist()):
                if line >= next_:
                    waiting[line] = value
            while next_ in waiting:
                value = waiting.pop(next_)
                next_ += 1
                if value is not None and value.strip(" \t\r\n"):
                    open_.append(value)
                else:  # the number counts blank lines, as for files
                    found += [sequence(key[0], part, open_)] if open_ else []
                    part, open_ = part + 1, []
            if found:
                yield pd.DataFrame(found, columns=["seq", "samples"])
                found = []
        state.update((next_, part, open_, list(waiting), list(waiting.values())))

    return lines.select("source", "line", "value").groupBy("source").applyInPandasWithState(run, out, STATE, "append", GroupStateTimeout.NoTimeout)
