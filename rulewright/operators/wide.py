"""Wide rows: a sample with all that stands around it in columns of its own, so that samples are independent of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_seq


def wide(df: DataFrame, columns: list[str], span: int, missing: str = "-") -> DataFrame:
    """df with, for each column c, c0c .. c<2 span>c: its values from ``span`` rows before to ``span`` rows after, itself in the middle.

    ``missing`` stands beyond a sequence's ends, as a value that sets leave out (Limits.nulls); a null stays null. All
    columns are made in one pass over sequences.
    """
    at = lambda c, k: F.col(c) if not k else (F.lag(c, -k, missing) if k < 0 else F.lead(c, k, missing)).over(by_seq())
    return df.withColumns({f"{c}{k + span}c": at(c, k) for c in columns for k in range(-span, span + 1)})
