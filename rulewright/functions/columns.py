"""Atoms and targets as columns over samples in long form: a row for each sample, ``seq`` and ``pos`` beside its columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..plans.spec import FAKE, OWN_KINDS, PAD, Atom, Rule, TaskSchema
from ..shared import written

#: Keys and values of word lists that are sent to every task; with more, both sides are shuffled.
SENT_VALUES = 500_000


def by_seq() -> WindowSpec:
    return Window.partitionBy("seq").orderBy("pos")


#: How a state's current value is called while rules are applied: a column or an expression for it.
Look = Callable[[str, int], Column]


def neighbour(column: str, offset: int) -> Column:
    """The column's value so many rows further in the sequence; PAD beyond its ends, but null where that row has a null."""
    if offset == 0:
        return F.col(column)
    moved = F.lag(column, -offset, PAD) if offset < 0 else F.lead(column, offset, PAD)
    return moved.over(by_seq())


def neighbour_list(column: str, offset: int) -> Column:
    """Like neighbour, for an array column; empty beyond the ends."""
    if offset == 0:
        return F.col(column)
    moved = F.lag(column, -offset) if offset < 0 else F.lead(column, offset)
    return F.coalesce(moved.over(by_seq()), F.array().cast("array<string>"))


def word_list(atom: Atom) -> str:
    """Name of the column that holds, for each row, the values that a word-list atom fires for (see with_word_lists)."""
    return f"w_{atom.kind}_{atom.column}_{atom.size}"


def with_word_lists(df: DataFrame, atoms: list[Atom], vocabulary: DataFrame | None, bigrams: DataFrame | None = None) -> DataFrame:
    """df with a column of values for each atom that needs a list of words (``word``) or of bigrams (``left``, ``right``).

    Affix atoms fire for affixes that make a known word of a known stem. Words and stems are joined, not collected. Lists of up to
    SENT_VALUES values are sent to every task, so that rows of a frequent word don't meet in one.
    """
    for a in sorted({(a.kind, a.column, a.size): a for a in atoms if a.needs_words}.values(), key=word_list):
        name = word_list(a)
        if name in df.columns:
            continue
        n = a.size
        if a.kind in ("follows", "precedes"):
            if bigrams is None:
                raise ValueError(f"{a.text} needs bigrams")
            own, other = ("left", "right") if a.kind == "follows" else ("right", "left")
            lists = bigrams.groupBy(F.col(own).alias("_key")).agg(F.sort_array(F.collect_set(other)).alias(name))
        else:
            if vocabulary is None:
                raise ValueError(f"{a.text} needs a vocabulary")
            word = F.col("word")
            words = vocabulary.select("word").distinct()
            if a.kind in ("add_prefix", "add_suffix"):
                long = words.where(F.length("word") > n)
                affix, stem = (F.left(word, F.lit(n)), F.substr(word, F.lit(n + 1))) if a.kind == "add_prefix" else (F.right(word, F.lit(n)), F.left(word, F.length("word") - n))
                lists = long.select(stem.alias("_key"), affix.alias("affix")).groupBy("_key").agg(F.sort_array(F.collect_set("affix")).alias(name))
            else:
                used = df.select(F.col(a.column).alias("_key")).distinct().where(F.length("_key") >= n)
                key = F.col("_key")
                affix, stem = (F.left(key, F.lit(n)), F.substr(key, F.lit(n + 1))) if a.kind == "drop_prefix" else (F.right(key, F.lit(n)), F.left(key, F.length(key) - n))
                lists = used.withColumn("_stem", stem).join(words, F.col("_stem") == F.col("word"), "left_semi").select("_key", F.array(affix).alias(name))
        lists = written(lists, "lists")
        held = lists.agg(F.coalesce(F.sum(F.size(name) + 1), F.lit(0)).alias("n")).first()["n"]
        lists = F.broadcast(lists) if held <= SENT_VALUES else lists
        df = df.join(lists, F.col(a.column) == F.col("_key"), "left").drop("_key").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return df


def fires(atom: Atom, value: Column, look: Look = neighbour) -> Column:
    """Does the atom hold for this value?"""
    if atom.kind == "identity":
        return look(atom.column, atom.offset) == value
    if atom.kind == "range":
        return reduce(Column.__or__, [look(atom.column, k) == value for k in range(atom.offset, atom.last + 1)])
    if atom.kind == "set":
        return reduce(Column.__or__, [look(c, atom.offset) == value for c in atom.columns])
    if atom.needs_words:
        return F.array_contains(neighbour_list(word_list(atom), atom.offset), value)
    own = look(atom.column, atom.offset)
    if atom.kind in OWN_KINDS:
        return OWN_KINDS[atom.kind].test(own, value)
    return {"prefix": F.startswith, "suffix": F.endswith, "contains": F.contains}[atom.kind](own, value)


def values(atom: Atom, nulls: tuple[str, ...] = (), look: Look = neighbour) -> Column:
    """All values that make the atom fire, for learning: array<string>. Affixes are shorter than the word."""
    none = F.array().cast("array<string>")
    if atom.kind == "identity":
        return F.array(look(atom.column, atom.offset))
    if atom.kind == "range":
        return F.array_distinct(F.array(*[look(atom.column, k) for k in range(atom.offset, atom.last + 1)]))
    if atom.kind == "set":
        found = F.array_distinct(F.array(*[look(c, atom.offset) for c in atom.columns]))
        return F.array_except(found, F.array(*[F.lit(x) for x in nulls])) if nulls else found
    own = look(atom.column, atom.offset)
    if atom.kind in OWN_KINDS:
        return OWN_KINDS[atom.kind].instances(own)
    n, longer = F.lit(atom.size), F.length(own) > atom.size
    if atom.kind in ("drop_prefix", "drop_suffix"):
        return F.when(longer, neighbour_list(word_list(atom), atom.offset)).otherwise(none)
    if atom.needs_words:
        return neighbour_list(word_list(atom), atom.offset)
    if atom.kind == "contains":
        return F.when(longer, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(own) - n + 1, F.lit(1))), lambda i: F.substr(own, i, n)))).otherwise(none)
    return F.when(longer, F.array(F.left(own, n) if atom.kind == "prefix" else F.right(own, n))).otherwise(none)


# -- targets ----------------------------------------------------------------------------------------------------------


def truths(schema: TaskSchema, truth: str) -> Column:
    """The accepted values of a truth column."""
    return F.split(F.col(truth), "[" + schema.truth_separator.replace("\\", "\\\\").replace("]", "\\]") + "]") if schema.truth_separator else F.array(F.col(truth))


def is_right(schema: TaskSchema, value: Column, truth: str) -> Column:
    return F.array_contains(truths(schema, truth), value) if schema.truth_separator else value == F.col(truth)


def affects(rule: Rule, look: Look = neighbour) -> Column:
    """Would any target change? A target FAKE changes nothing but counts as a match."""
    return reduce(Column.__or__, [F.lit(True) if v == FAKE else ~look(t, 0).eqNullSafe(F.lit(v)) for t, v in zip(rule.targets, rule.results)])


def matches(rule: Rule, look: Look = neighbour) -> Column:
    """Does the rule fire on the row: its atoms hold and a target changes?"""
    return reduce(Column.__and__, [fires(a, F.lit(v), look) for a, v in zip(rule.atoms, rule.values)], affects(rule, look))
