"""Applying an ordered rule list: rules one after another, each at once on all rows where it fires on the state before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import fires, matches, with_word_lists, word_list
from ..plans.spec import FAKE, OWN_KINDS, PAD, Rule, TaskSchema

#: Rules up to which a list becomes one Spark plan; longer ones run over whole sequences in tasks (plans grow with rules).
PLANNED = 40


def constrained(df: DataFrame, constraints: list[tuple[tuple[str, ...], str, DataFrame]]) -> tuple[DataFrame, dict[str, list[str]]]:
    """df with the allowed classes of each constraint (key columns, truth, table of keys and ``allowed``) in a column.

    An unknown key allows all (null). Of a key's several lines the last (``line``, if there is one) counts.
    """
    names: dict[str, list[str]] = {}
    for i, (keys, truth, table) in enumerate(constraints):
        name = f"allowed_{i}"
        one = table.groupBy(*keys).agg((F.max_by("allowed", "line") if "line" in table.columns else F.first("allowed")).alias(name))
        one = one.toDF(*[f"_k{j}" for j in range(len(keys))], name)
        on = [F.col(k) == F.col(f"_k{j}") for j, k in enumerate(keys)]
        df = df.join(one, on, "left").drop(*[f"_k{j}" for j in range(len(keys))])
        names.setdefault(truth, []).append(name)
    return df, names


def loadable(table: DataFrame, keys: tuple[str, ...], vocabulary: DataFrame) -> DataFrame:
    """The lines of a constraint (keys, allowed and line) that count beside a vocabulary (word and is_class): those whose keys are all
    known words, with the known classes among theirs; lines without one are left out, and so don't replace earlier ones."""
    words = vocabulary.select("word").distinct()
    for k in keys:
        table = table.join(words.withColumnRenamed("word", "_word"), F.col(k) == F.col("_word"), "left_semi")
    classes = vocabulary.where("is_class").select("word").distinct()
    one = table.select("*", F.posexplode("allowed").alias("_at", "_class"))
    known = one.join(classes, F.col("_class") == F.col("word"), "left_semi")
    return known.groupBy(*keys, "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_class"))), lambda x: x["_class"]).alias("allowed"))


def allowed(rule: Rule, schema: TaskSchema, names: dict[str, list[str]]) -> Column:
    ok = F.lit(True)
    for t, v in zip(rule.targets, rule.results):
        if v != FAKE:
            for name in names.get(schema.truths[schema.states.index(t)], []):
                ok = ok & (F.col(name).isNull() | F.array_contains(name, F.lit(v)))
    return ok


def apply_rule(df: DataFrame, rule: Rule, schema: TaskSchema, names: dict[str, list[str]] | None = None, trace_id: int | None = None, mark: str | None = None) -> DataFrame:
    """One rule over all rows. ``trace_id`` is added to column ``trace`` where it fires; ``mark`` gets whether it did."""
    fire = F.coalesce(matches(rule) & allowed(rule, schema, names or {}), F.lit(False))
    df = df.withColumn("_fire", fire)
    new = {t: F.when(F.col("_fire"), F.lit(v)).otherwise(F.col(t)) for t, v in zip(rule.targets, rule.results) if v != FAKE}
    if trace_id is not None:
        new["trace"] = F.when(F.col("_fire"), F.concat("trace", F.array(F.lit(trace_id)))).otherwise(F.col("trace"))
    if mark:
        new[mark] = F.col("_fire")
    return df.withColumns(new).drop("_fire")


def apply_rules(
    df: DataFrame, rules: list[Rule], schema: TaskSchema, vocabulary: DataFrame | None = None, bigrams: DataFrame | None = None,
    constraints: list[tuple[tuple[str, ...], str, DataFrame]] | None = None, trace: bool = False, planned: int = PLANNED,
) -> DataFrame:
    """df (seq, pos and the schema's columns) after all rules; with ``trace`` the numbers of the rules that fired, by row."""
    atoms = [a for r in rules for a in r.atoms]
    extra = [word_list(a) for a in atoms if a.needs_words]
    out = [*df.columns, *(["trace"] if trace else [])]
    df = with_word_lists(df, atoms, vocabulary, bigrams)
    df, names = constrained(df, constraints or [])
    if trace:
        df = df.withColumn("trace", F.array().cast("array<int>"))
    if len(rules) <= planned:
        for i, rule in enumerate(rules):
            df = apply_rule(df, rule, schema, names, i if trace else None)
        return df.select(*out)
    return _over_sequences(df, rules, schema, names, sorted(set(extra)), trace).select(*out)


def _over_sequences(df: DataFrame, rules: list[Rule], schema: TaskSchema, names: dict[str, list[str]], lists: list[str], trace: bool, curve: bool = False) -> DataFrame:
    """Long lists: rows are dealt and sorted by sequence once, and each batch of whole sequences runs all rules on columns
    of numbers, one comparison of whole columns for each atom. With ``curve`` the result is how many more states each rule
    makes wrong (rule and errors, for each batch; rule -1 stands for those wrong before)."""
    # atoms from outside are columns' functions, so they are tested before the rows are dealt; features don't change
    outside = list(dict.fromkeys((a, v) for r in rules for a, v in zip(r.atoms, r.values) if a.kind in OWN_KINDS))
    if bad := [a.text for a, _ in outside if a.column in schema.states]:
        raise ValueError(f"over states, which rules change: {bad}; such atoms are for features")
    df = df.withColumns({f"own_{i}": F.coalesce(fires(a, F.lit(v)), F.lit(False)) for i, (a, v) in enumerate(outside)}) if outside else df
    width = max([1, *(abs(k) for r in rules for a in r.atoms for _, k in a.reads())])
    dealt = df.repartition("seq").sortWithinPartitions("seq", "pos")
    sent = df.sparkSession.sparkContext.broadcast(rules)
    state_of = {t: schema.truths[schema.states.index(t)] for t in schema.states}

    def begins_of(b: pd.DataFrame) -> np.ndarray:
        """Does a row begin a sequence? Rows without a sequence's id are one."""
        seq, null = b["seq"].to_numpy(object), b["seq"].isna().to_numpy()
        return np.concatenate([[True], (seq[1:] != seq[:-1]) & ~(null[1:] & null[:-1])])

    def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches cut between sequences."""
        rest = None
        for b in (b for b in batches if len(b)):
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            cut = int(np.flatnonzero(begins_of(b))[-1])
            if cut:
                yield b.iloc[:cut].reset_index(drop=True)
            rest = b.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield rest

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sequences(batches):
            begins = begins_of(b)
            # each sequence has PAD rows on either side
            place = np.arange(len(b)) + width * (np.cumsum(begins) * 2 - 1)
            size = int(place[-1]) + width + 1
            cols: dict[str, np.ndarray] = {}
            for c in [*schema.features, *schema.states]:
                cols[c] = np.full(size, PAD, object)
                cols[c][place] = b[c].astype(object).where(b[c].notna(), None).to_numpy(object)
            codes: dict[str, int] = {}
            coded = {c: np.array([codes.setdefault(v, len(codes)) for v in x.tolist()]) for c, x in cols.items()}
            codes.setdefault(PAD, len(codes))
            holders = {c: [frozenset(v) for v in b[c]] for c in lists}
            permitted = {n: [None if v is None else frozenset(v) for v in b[n]] for ns in names.values() for n in ns}
            static: dict[tuple, np.ndarray] = {}
            fired = [[] for _ in range(len(b))] if trace else None
            right = {}  # codes of each row's accepted truths
            for t in schema.states if curve else ():
                separated = b[state_of[t]].tolist() if schema.truth_separator else [[v] for v in b[state_of[t]].tolist()]
                right[t] = [frozenset(codes.setdefault(x, len(codes)) for x in (v.split(schema.truth_separator) if isinstance(v, str) else v or ()) if x is not None) for v in separated]
            wrong = lambda rows: sum(coded[t][place[x]] not in ok[x] for t, ok in right.items() for x in rows.tolist())
            errors = [wrong(np.arange(len(b)))]

            def holds(atom, value):
                at = place
                if atom.kind in ("identity", "range", "set"):
                    code = codes.get(value, -1)
                    ks = range(atom.offset, (atom.last if atom.kind == "range" else atom.offset) + 1)
                    return np.logical_or.reduce([coded[c][at + k] == code for c in atom.columns for k in ks])
                if (atom, value) in outside:
                    return b[f"own_{outside.index((atom, value))}"].to_numpy(bool)
                key = (atom.kind, atom.column, atom.offset, atom.size, value)
                if key not in static:  # features never change
                    if atom.needs_words:
                        own = np.zeros(size, bool)
                        own[at] = [value in s for s in holders[word_list(atom)]]
                    else:
                        test = {"prefix": str.startswith, "suffix": str.endswith, "contains": str.__contains__}[atom.kind]
                        own = np.array([isinstance(v, str) and test(v, value) for v in cols[atom.column].tolist()])
                    static[key] = own[at + atom.offset]
                return static[key]

            for i, r in enumerate(sent.value):
                hit = np.zeros(len(b), bool)
                for t, v in zip(r.targets, r.results):
                    hit |= True if v == FAKE else coded[t][place] != codes.setdefault(v, len(codes))
                for a, v in zip(r.atoms, r.values):
                    if not hit.any():
                        break
                    hit &= holds(a, v)
                rows = np.flatnonzero(hit)
                for t, v in zip(r.targets, r.results):
                    for n in names.get(state_of[t], []) if v != FAKE else ():
                        rows = np.array([x for x in rows.tolist() if permitted[n][x] is None or v in permitted[n][x]], int)
                before = wrong(rows) if curve else 0
                for t, v in zip(r.targets, r.results):
                    if v != FAKE:
                        coded[t][place[rows]] = codes[v]
                if curve:
                    errors.append(wrong(rows) - before)
                if fired is not None:
                    for x in rows.tolist():
                        fired[x].append(i)
            if curve:
                yield pd.DataFrame({"rule": np.arange(-1, len(errors) - 1, dtype=np.int32), "errors": errors})
                continue
            back = np.array(list(codes), object)
            for t in schema.states:
                b[t] = back[coded[t][place]]
            if fired is not None:
                b["trace"] = fired
            yield b

    if curve:
        return dealt.mapInPandas(run, "rule int, errors long")
    kept = T.StructType([f for f in dealt.schema.fields])
    return dealt.mapInPandas(run, kept)


def error_curve(
    df: DataFrame, rules: list[Rule], schema: TaskSchema, vocabulary: DataFrame | None = None, bigrams: DataFrame | None = None,
    constraints: list[tuple[tuple[str, ...], str, DataFrame]] | None = None,
) -> DataFrame:
    """rule (-1: before any) and errors, the number of wrong states after it, for a list of any length.

    Each rule's change is counted where it fires; the sums of these, one for each rule, add up in the order of the list.
    """
    atoms = [a for r in rules for a in r.atoms]
    df = with_word_lists(df, atoms, vocabulary, bigrams)
    df, names = constrained(df, constraints or [])
    changes = _over_sequences(df, rules, schema, names, sorted({word_list(a) for a in atoms if a.needs_words}), False, True)
    none = df.sparkSession.range(-1, len(rules)).select(F.col("id").cast("int").alias("rule"), F.lit(0).cast("long").alias("errors"))
    sums = changes.unionByName(none).groupBy("rule").agg(F.sum("errors").alias("errors"))
    # as many rows as rules
    return sums.select("rule", F.sum("errors").over(Window.orderBy("rule")).alias("errors"))
