"""Learning: candidate rules from wrong rows, their good and bad counts, and the greedy loop.

A row is good for a rule if it makes a wrong state right and bad if it makes a right state wrong. Candidates come from
wrong rows only; bad counts come from rows with a right state that have an instance of the same template. Both are read off one
tally: samples summed up by the instances of templates, their states and truths. While learning, a rule changes the tally by the
instances of the rows it touches, before and after it. All counts are weighted by ``cost`` where the samples have one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import by_seq, fires, is_right, matches, neighbour, truths, values, with_word_lists, word_list
from ..plans.spec import FAKE, Rule, TaskSchema, Template, Templates
from ..shared import dropped, written
from .apply import allowed, apply_rule, constrained

KEY = ["template", "tokens", "results"]


@dataclass(frozen=True)
class Limits:
    """When learning stops and what it leaves out.

    threshold: a score must lie above it. repeats: so many equal best rules in a row are an error. least_good: of the first
    candidates only those with more good rows count. useless, factor: after each turn candidates without a good row and with more
    bad ones than ``useless`` go, and those whose bad rows times ``factor`` reach their good ones (-1: none go); a candidate that
    went comes back when rows that changed give it anew. redundant: which rules without a bad row are added at the end (see redundant_rules):
    "n" those with so many rows, "n%" so many in a hundred of all, "-n" so many as the first rule's score less n, but at
    least ``least_redundant``. nulls: values that don't instantiate sets. write_every: rules between two
    tables of all samples. batch: rules tried at once; results are the same for any.
    """

    threshold: int = 2
    repeats: int = 5
    least_good: int = 0
    max_rules: int = 100_000
    nulls: tuple[str, ...] = ()
    write_every: int = 12
    batch: int = 16
    useless: int = -1
    factor: float = -1
    redundant: str | None = None
    least_redundant: int = 1
    sized_order: bool = True

    @property
    def lists_candidates(self) -> bool:
        """Must candidates be listed, since not all that the samples give count?"""
        return self.least_good > 0 or self.useless >= 0 or self.factor >= 0 or self.redundant is not None


def collapsed(df: DataFrame, schema: TaskSchema) -> DataFrame:
    """Equal independent samples as one, with their number as ``cost``."""
    cost = F.sum("cost") if "cost" in df.columns else F.count(F.lit(1))
    return df.groupBy(*schema.columns).agg(cost.cast("long").alias("cost"))


def _cost(df: DataFrame) -> Column:
    return F.col("cost") if "cost" in df.columns else F.lit(1)


def instances(df: DataFrame, templates: Templates, number: int, template: Template, nulls: tuple[str, ...] = (), only: Column | None = None) -> DataFrame:
    """A row for each sample (for which ``only`` holds) and each distinct choice of values of the template's atoms, in the
    order of the atoms. Neighbours are looked up before rows are left out."""
    lists = {f"v_{i}": values(a, nulls) for i, a in enumerate(template.atoms)}
    out = df.withColumns(lists)
    if only is not None:
        out = out.where(only)
    # one atom after another: the combinations of a row's own values
    for i in range(len(template.atoms)):
        out = out.withColumn(f"v_{i}", F.explode(f"v_{i}"))
    return out.withColumn("template", F.lit(number)).withColumn("tokens", F.array(*[F.col(f"v_{i}") for i in range(len(template.atoms))])).drop(*lists)


def _truth(schema: TaskSchema, state: str) -> str:
    return schema.truths[schema.states.index(state)]


def _all_right(schema: TaskSchema, targets: tuple[str, ...], every: bool) -> Column:
    flags = [F.coalesce(is_right(schema, F.col(t), _truth(schema, t)), F.lit(False)) for t in targets]
    return reduce(Column.__and__ if every else Column.__or__, flags)


def _limits(schema: TaskSchema, targets: tuple[str, ...], names: dict[str, list[str]]) -> Column:
    """For each target the classes that the row's constraints allow; null for all."""
    none = F.lit(None).cast("array<string>")
    out = []
    for t in targets:
        one = none
        for n in names.get(_truth(schema, t), []):
            one = F.when(one.isNull(), F.col(n)).when(F.col(n).isNull(), one).otherwise(F.array_intersect(one, n))
        out.append(one)
    return F.array(*out)


def _permitted(limits: str, results: str) -> Column:
    return ~F.exists(F.arrays_zip(F.col(limits).alias("l"), F.col(results).alias("r")), lambda x: x["l"].isNotNull() & ~F.array_contains(x["l"], x["r"]))


def candidates(df: DataFrame, templates: Templates, nulls: tuple[str, ...] = (), names: dict[str, list[str]] | None = None, forced: bool = False) -> DataFrame:
    """template, tokens, results and good of each rule that makes a wrong row right (with ``forced``: that gives a row its truth)."""
    schema, parts = templates.schema, []
    for number, t in enumerate(templates.items):
        found = instances(df, templates, number, t, nulls, None if forced else ~_all_right(schema, t.targets, True))
        for i, s in enumerate(t.targets):
            found = found.withColumn(f"r_{i}", F.explode(truths(schema, _truth(schema, s))))
        found = found.withColumn("results", F.array(*[F.col(f"r_{i}") for i in range(len(t.targets))]))
        if names:
            found = found.withColumn("_limits", _limits(schema, t.targets, names)).where(_permitted("_limits", "results"))
        gain = sum((F.when(~F.coalesce(is_right(schema, F.col(s), _truth(schema, s)), F.lit(False)), _cost(df)).otherwise(0) for s in t.targets), F.lit(0))
        parts.append(found.select("template", "tokens", "results", (_cost(df) if forced else gain).alias("gain")))
    return reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(F.sum("gain").cast("long").alias("good"))


def tallied(df: DataFrame, templates: Templates, nulls: tuple[str, ...] = (), names: dict[str, list[str]] | None = None, numbers: set[int] | None = None, collapse: bool = False) -> DataFrame:
    """template, tokens, states, accepted, limits and cost: samples summed up by instances of templates (or of those of ``numbers``),
    their targets' states, truths and classes allowed."""
    return summed(listed(df, templates, nulls, names, numbers, collapse=collapse))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*TALLY).agg(F.sum("cost").alias("cost"))


def listed(df: DataFrame, templates: Templates, nulls: tuple[str, ...] = (), names: dict[str, list[str]] | None = None, numbers: set[int] | None = None, keep: tuple[str, ...] = (), collapse: bool = False) -> DataFrame:
    """The rows that tallied() sums up. Each sample is read once for all templates of the same targets. With ``collapse`` samples in
    which the templates see the same are summed up before their instances are listed."""
    schema, parts = templates.schema, []
    for targets, own, atoms in _by_targets(templates, numbers):
        seen = {f"v_{i}": values(a, nulls) for i, a in enumerate(atoms)}
        rows = df.withColumns(seen).select(*keep, *seen, F.array(*targets).alias("states"), *_judged(schema, targets, names), _cost(df).cast("long").alias("cost"))
        if collapse:
            rows = rows.groupBy(*keep, *seen, "states", "accepted", "limits").agg(F.sum("cost").alias("cost"))
        parts.append(_exploded(rows, own, atoms, keep))
    return reduce(DataFrame.unionByName, parts)


def _by_targets(templates: Templates, numbers: set[int] | None) -> list[tuple]:
    """Targets, their numbered templates and all atoms of these."""
    used, found = [(i, t) for i, t in enumerate(templates.items) if numbers is None or i in numbers], []
    for targets in dict.fromkeys(t.targets for _, t in used):
        own = [(i, t) for i, t in used if t.targets == targets]
        found.append((targets, own, list(dict.fromkeys(a for _, t in own for a in t.atoms))))
    return found


def _judged(schema: TaskSchema, targets: tuple[str, ...], names: dict[str, list[str]] | None) -> list[Column]:
    return [F.array(*[truths(schema, _truth(schema, s)) for s in targets]).alias("accepted"), _limits(schema, targets, names or {}).alias("limits")]


def _exploded(rows: DataFrame, own: list, atoms: list, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each instance of the templates from rows with the values of all atoms (v_0, v_1 ..)."""
    found = []
    for i, t in own:
        tokens = None
        for a in t.atoms:
            v = F.col(f"v_{atoms.index(a)}")
            tokens = F.transform(v, lambda x: F.array(x)) if tokens is None else _each_with(tokens, v)
        found.append(_numbered(F.array_distinct(tokens), i))
    exploded = rows.select(*keep, F.explode(F.concat(*found)).alias("x"), "states", "accepted", "limits", "cost")
    return exploded.select(*keep, "x.template", "x.tokens", "states", "accepted", "limits", "cost")


TALLY = ["template", "tokens", "states", "accepted", "limits"]


def _each_with(lists: Column, choices: Column) -> Column:
    return F.flatten(F.transform(lists, lambda c: F.transform(choices, lambda x: F.concat(c, F.array(x)))))


def _numbered(tokens: Column, number: int) -> Column:
    return F.transform(tokens, lambda c: F.struct(F.lit(number).alias("template"), c.alias("tokens")))


def _combined(lists: str) -> Column:
    """All choices of one of each list."""
    start = F.array(F.array().cast("array<string>"))
    return F.aggregate(lists, start, _each_with)


def _right(x: Column, c: str) -> Column:
    return F.coalesce(F.array_contains(x["accepted"], x[c]), F.lit(False))


def _wrong() -> Column:
    """How many of a tally row's states are wrong."""
    return F.size(F.filter(F.arrays_zip("states", "accepted"), lambda x: ~_right(x, "states")))


def _given(tally: DataFrame) -> DataFrame:
    """Each row with all the results that are true of it and allowed."""
    return tally.withColumn("results", F.explode(_combined("accepted"))).where(_permitted("limits", "results"))


def _met(tally: DataFrame, rules: DataFrame, harmed_only: bool = True) -> DataFrame:
    """``rules`` by the rows of a tally in which they fire, with the states that they put wrong (lost) and right (won)."""
    three = F.arrays_zip("states", "accepted", "results")
    lost = F.size(F.filter(three, lambda x: _right(x, "states") & ~_right(x, "results")))
    won = F.size(F.filter(three, lambda x: ~_right(x, "states") & _right(x, "results")))
    # rows with nothing right lose nothing by rules of one target
    rows = tally.where((F.size("states") > 1) | (_wrong() == 0)) if harmed_only else tally
    met = rows.join(rules.select(*KEY), ["template", "tokens"]).where(_permitted("limits", "results"))
    return met.select(*KEY, (lost * F.col("cost")).alias("lost"), (won * F.col("cost")).alias("won"))


def scored_tally(tally: DataFrame, limits: Limits = Limits(), over: int = 0) -> DataFrame:
    """template, tokens, results, good, bad and score of all candidates of a tally with more than ``over`` good rows.

    A rule of several targets may put some of a row's right without giving it all its truths, so all rows meet such rules.
    """
    least, several = max(over, limits.least_good), F.size("results") > 1
    made = _given(tally.withColumn("wrong", _wrong()).where("wrong > 0"))
    good = made.groupBy(*KEY).agg(F.sum(F.col("wrong") * F.col("cost")).cast("long").alias("good")).where(several | (F.col("good") > least))
    sums = _met(tally, good).groupBy(*KEY).agg(F.sum("lost").cast("long").alias("bad"), F.sum("won").cast("long").alias("won"))
    out = good.join(sums, KEY, "left").withColumn("bad", F.coalesce("bad", F.lit(0))).withColumn("good", F.when(several, F.coalesce("won", F.lit(0))).otherwise(F.col("good"))).drop("won")
    return out.where(F.col("good") > least).withColumn("score", F.col("good") - F.col("bad"))


def scored(df: DataFrame, templates: Templates, limits: Limits = Limits(), names: dict[str, list[str]] | None = None, over: int = 0) -> DataFrame:
    """template, tokens, results, good, bad and score of all candidates with more than ``over`` good rows."""
    return scored_tally(tallied(df, templates, limits.nulls, names), limits, over)


def order(sized: bool = True) -> list[Column]:
    """The best rule first: score, more atoms (unless not ``sized``), greater result, earlier template, greater tokens."""
    return [F.desc("score"), *([F.desc(F.size("tokens"))] if sized else []), F.desc("results"), F.asc("template"), F.desc("tokens")]


def to_rule(row, templates: Templates) -> Rule:
    t = templates.items[row["template"]]
    return Rule(t.atoms, tuple(row["tokens"]), t.targets, tuple(row["results"]), row["good"], row["bad"], row["score"])


def changes(after: DataFrame, rule: Rule, templates: Templates, nulls: tuple[str, ...], names: dict[str, list[str]]) -> DataFrame | None:
    """What a rule changes in the tally. after: samples with ``_changed`` and the states before it as ``_old_`` columns.

    Only templates that look at a state it sets take part, and only the rows changed and those from which these templates see one.
    Samples are read once; what they see before and after it, in different rows mostly the same, is summed up without a shuffle of samples.
    """
    wrote, schema, parts = set(rule.targets), templates.schema, []
    numbers = {i for i, t in enumerate(templates.items) if wrote & set(t.targets) or any(c in wrote for a in t.atoms for c, _ in a.reads())}
    if not numbers:
        return None
    reach = max(abs(k) for i in numbers for a in templates.items[i].atoms for _, k in a.reads())
    near = F.max("_changed").over(by_seq().rowsBetween(-reach, reach)) if reach else F.col("_changed")
    old = lambda c, k=0: neighbour(f"_old_{c}" if c in wrote else c, k)
    for targets, own, atoms in _by_targets(templates, numbers):
        seen = {f"v_{i}": values(a, nulls) for i, a in enumerate(atoms)} | {f"o_{i}": values(a, nulls, old) for i, a in enumerate(atoms)}
        rows = after.withColumns(seen | {"_near": near}).where("_near")
        sides = [F.struct(*[F.col(f"{p}_{i}").alias(f"v_{i}") for i in range(len(atoms))], F.array(*states).alias("states"), (_cost(after) * sign).cast("long").alias("cost")) for p, states, sign in (("v", targets, 1), ("o", [old(t) for t in targets], -1))]
        both = rows.select(*_judged(schema, targets, names), F.explode(F.array(*sides)).alias("x")).select("accepted", "limits", "x.*")
        by = [f"v_{i}" for i in range(len(atoms))]
        parts.append(_exploded(both.groupBy(*by, "states", "accepted", "limits").agg(F.sum("cost").alias("cost")).where("cost <> 0"), own, atoms))
    return summed(reduce(DataFrame.unionByName, parts)).where("cost <> 0")


def dealt(df: DataFrame) -> DataFrame:
    """Rows by their instance, so that what is held by instance meets without being shuffled again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "template", "tokens")


def _in_sequences(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq").sortWithinPartitions("seq", "pos")


def _looked_at(df: DataFrame, templates: Templates, names: dict[str, list[str]]) -> DataFrame:
    """df with the columns that learning needs."""
    schema, atoms = templates.schema, [a for t in templates.items for a in t.atoms]
    used = {"seq", "pos", "cost", *schema.states, *schema.truths, *(c for a in atoms for c in a.columns), *(word_list(a) for a in atoms if a.needs_words), *(n for ns in names.values() for n in ns)}
    return df.select(*[c for c in df.columns if c in used])


def celled(tally: DataFrame) -> DataFrame:
    """A tally with a row for each instance: template, tokens and its entries (states, accepted, limits and cost)."""
    return tally.groupBy("template", "tokens").agg(F.collect_list(F.struct("states", "accepted", "limits", "cost")).alias("entries"))


def flat(cells: DataFrame) -> DataFrame:
    """The tally of cells; its rows may repeat, with costs that add up."""
    return cells.select("template", "tokens", F.explode("entries").alias("x")).select("template", "tokens", "x.*")


def scored_cells(cells: DataFrame, least: int, over: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """template, tokens, results, good, bad and score of the rules of cells with more than ``least`` good rows and a score above ``over``.

    An instance has all that its rules' counts need, so nothing is joined or summed up over rows. Entries that cancel each
    other out are harmless, as counts are sums of costs.
    """
    right = lambda e: F.transform(F.arrays_zip(e["states"].alias("s"), e["accepted"].alias("a")), lambda x: F.coalesce(F.array_contains(x["a"], x["s"]), F.lit(False)))
    entries = F.transform("entries", lambda e: e.withField("right", right(e)))
    judged = cells.select(*keep, "template", "tokens", entries.alias("entries"))
    wrong = F.filter("entries", lambda e: F.exists(e["right"], lambda r: ~r))
    results = F.array_distinct(F.flatten(F.transform(wrong, lambda e: F.filter(_combined(e["accepted"]), lambda c: _allows(e["limits"], c)))))
    judged = judged.withColumn("rules", results).where(F.size("rules") > 0)

    def count(entry: Column, c: Column, was: bool) -> Column:
        """States of an entry that a rule turns from right to wrong (was), or from wrong to right."""
        three = F.arrays_zip(entry["right"].alias("was"), entry["accepted"].alias("a"), c.alias("c"))
        now = lambda x: F.coalesce(F.array_contains(x["a"], x["c"]), F.lit(False))
        moved = F.size(F.filter(three, lambda x: (x["was"] & ~now(x)) if was else (~x["was"] & now(x))))
        return F.when(_allows(entry["limits"], c), moved * entry["cost"]).otherwise(0).cast("long")

    total = lambda c, was: F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + count(e, c, was))
    counted = F.transform("rules", lambda c: F.struct(c.alias("results"), total(c, False).alias("good"), total(c, True).alias("bad")))
    out = judged.select(*keep, "template", "tokens", F.explode(F.filter(counted, lambda x: (x["good"] > least) & (x["good"] - x["bad"] > over))).alias("x"))
    return out.select(*keep, "template", "tokens", "x.*", (F.col("x.good") - F.col("x.bad")).alias("score"))


def _allows(limits: Column, results: Column) -> Column:
    return ~F.exists(F.arrays_zip(limits.alias("l"), results.alias("r")), lambda x: x["l"].isNotNull() & ~F.array_contains(x["l"], x["r"]))


def moves(rules: list[Rule], schema: TaskSchema, names: dict[str, list[str]]) -> Column:
    """A row's states after rules that look at no neighbours, one after another, and what each that fired changed: step, old and new states."""
    states = lambda of: F.struct(*[of(s).alias(s) for s in schema.states])
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField("step", T.IntegerType())] + [T.StructField(n, T.StructType([T.StructField(s, T.StringType()) for s in schema.states])) for n in ("old", "new")])))

    def after(number: int, rule: Rule):
        def one(acc: Column) -> Column:
            look = lambda c, _: acc["now"][c] if c in schema.states else F.col(c)
            fire = F.coalesce(matches(rule, look) & allowed(rule, schema, names), F.lit(False))
            sets = {t: F.lit(v) for t, v in zip(rule.targets, rule.results) if v != FAKE}
            new = states(lambda s: F.when(fire, sets.get(s, acc["now"][s])).otherwise(acc["now"][s]))
            move = F.struct(F.lit(number).alias("step"), acc["now"].alias("old"), new.alias("new"))
            return F.struct(new.alias("now"), F.when(fire, F.concat(acc["moves"], F.array(move))).otherwise(acc["moves"]).alias("moves"))

        return one

    held = F.array(F.struct(states(F.col).alias("now"), none.alias("moves")))
    for i, rule in enumerate(rules):
        held = F.transform(held, after(i, rule))
    return F.get(held, F.lit(0))


def _features_hold(rule: Rule, schema: TaskSchema) -> Column:
    """Do those atoms of a rule hold that look at no state?"""
    own = [fires(a, F.lit(v)) for a, v in zip(rule.atoms, rule.values) if not {c for c, _ in a.reads()} & set(schema.states)]
    return F.coalesce(reduce(Column.__and__, own, F.lit(True)), F.lit(False))


def stepped(samples: DataFrame, rules: list[Rule], templates: Templates, nulls: tuple[str, ...], names: dict[str, list[str]]) -> DataFrame:
    """What each of several rules, one after another, changes in the tally: step (from 0) beside a tally's columns, cost with its sign.

    For templates that look at no neighbours, so that only the rows changed take part.
    """
    schema = templates.schema
    # features don't change: rows on which no rule's features hold go before rules run one after another
    samples = samples.where(reduce(Column.__or__, [_features_hold(r, schema) for r in rules]))
    signed = lambda m: F.array(*[F.struct(m["step"].alias("step"), m[which].alias("states"), F.lit(sign).alias("sign")) for which, sign in (("new", 1), ("old", -1))])
    # outer, as a plain explode would have the rules run once more to see whether there is anything to explode
    both = samples.withColumn("_move", F.explode_outer(F.flatten(F.transform(moves(rules, schema, names)["moves"], signed)))).where("_move IS NOT NULL")
    rest = [c for c in samples.columns if c not in schema.states and c != "cost"]
    rows = both.select(*rest, (_cost(samples) * F.col("_move.sign")).alias("cost"), "_move.step", "_move.states.*")
    return listed(rows, templates, nulls, names, keep=("step",)).groupBy("step", *TALLY).agg(F.sum("cost").alias("cost")).where("cost <> 0")


def rank(sized: bool) -> Column:
    """The same order as order(): the greatest comes first."""
    return F.struct("score", *([F.size("tokens").alias("size")] if sized else []), "results", (-F.col("template")).alias("earlier"), "tokens")


def _in_bytes(rank) -> tuple:
    """Spark orders strings by their bytes."""
    return tuple([v.encode() for v in x] if isinstance(x, list) else x for x in rank)


class _State:
    """Samples, cells and listed candidates of the loop.

    Cells are dealt by instance and held in memory; what rules change is kept beside them, in small tables, and joined to them
    each turn, so that a turn shuffles what rules changed but not the cells. Now and then samples and cells are written anew.

    A turn takes the best rules at once, as if each stayed the best until its turn, and then looks whether it did: a rule is
    accepted if those before it left its own instance alone, and if no candidate that they changed has come to be better.
    The first one always is.
    """

    def __init__(self, samples: DataFrame, templates: Templates, limits: Limits, names: dict[str, list[str]]):
        self.templates, self.limits, self.names, self.since = templates, limits, names, 0
        # neighbours are looked up in whole sequences, and lists of candidates are pruned after each rule: then one rule a turn
        self.wide = any(k for t in templates.items for a in t.atoms for _, k in a.reads())
        self.batch = 1 if self.wide or limits.least_good > 0 or limits.useless >= 0 or limits.factor >= 0 else limits.batch
        self.tried = 2  # twice as many as were accepted last time
        self.single, self.pause = 0, 1  # turns of one rule, which need no check, after rules that touched each other
        # sequences stay whole and in order, so that looking at neighbours takes neither a shuffle nor a sort
        self.samples = _in_sequences(samples).persist() if self.wide else written(samples, "samples")
        self.base = dealt(celled(tallied(self.samples, templates, limits.nulls, names, collapse=self.wide))).persist()
        self.deltas: list[DataFrame] = []  # changes of the tally since the base
        self.live: DataFrame | None = None
        self.tables, self.memory = ([], [self.samples, self.base]) if self.wide else ([self.samples], [self.base])
        if limits.lists_candidates:
            self.live = written(scored_cells(self.base, limits.least_good, -(1 << 62)).select(*KEY), "live")
            self.tables.append(self.live)

    def cells(self) -> DataFrame:
        if not self.deltas:
            return self.base
        changed = dealt(celled(reduce(DataFrame.unionByName, self.deltas))).withColumnRenamed("entries", "more").hint("shuffle_hash")
        both = self.base.join(changed, ["template", "tokens"], "full")
        return both.select("template", "tokens", F.concat(F.coalesce("entries", F.array()), F.coalesce("more", F.array())).alias("entries"))

    def best(self, most: int) -> list[Rule]:
        """The best rules, best first; none if no score is above the threshold."""
        found = scored_cells(self.cells(), 0 if self.live is not None else self.limits.least_good, self.limits.threshold)
        if self.live is not None:
            found = found.join(self.live, KEY, "left_semi")
        return [to_rule(r, self.templates) for r in found.orderBy(*order(self.limits.sized_order)).limit(min(most, self.batch, self.tried)).collect()]

    def apply(self, rules: list[Rule]) -> int:
        """Applies as many of these rules, from the first, as stay the best until their turn; their number."""
        t, limits = self.templates, self.limits
        if self.wide:
            rule = rules[0]
            before = self.samples.withColumns({f"_old_{s}": F.col(s) for s in rule.targets})
            after = apply_rule(before, rule, t.schema, self.names, mark="_changed")
            delta = changes(after, rule, t, limits.nulls, self.names)
            delta = None if delta is None else delta.withColumn("step", F.lit(0))
        else:
            delta = stepped(self.samples, rules, t, limits.nulls, self.names)
        if delta is not None:
            delta = written(delta, "delta")
            self.tables.append(delta)
        good = self.verified(rules, delta) if len(rules) > 1 else 1
        self.samples = apply_rule(self.samples, rules[0], t.schema, self.names) if self.wide else self.moved(rules[:good])
        if delta is not None:
            change = delta.where(F.col("step") < good).drop("step")
            self.deltas.append(change)
            if self.live is not None:
                fresh = _given(change.where(F.col("cost") > 0).where(_wrong() > 0)).select(*KEY)
                self.live = written(self.kept(self.live.unionByName(fresh).distinct()), "live")
                self.tables.append(self.live)
        self.since += good
        if len(rules) > 1:
            self.single, self.pause = (self.pause, min(2 * self.pause, 8)) if good == 1 else (0, 1)
        self.tried, self.single = (1 if self.single else 2 * good), max(0, self.single - 1)
        if self.since >= limits.write_every:
            self.write()
        return good

    def moved(self, rules: list[Rule]) -> DataFrame:
        states, columns = self.templates.schema.states, self.samples.columns
        now = self.samples.withColumn("_now", moves(rules, self.templates.schema, self.names)["now"])
        return now.select(*[F.col(f"_now.{c}").alias(c) if c in states else F.col(c) for c in columns])

    def verified(self, rules: list[Rule], delta: DataFrame) -> int:
        """How many of the rules were the best in their turn."""
        steps = range(1, len(rules))
        changed = dealt(delta.groupBy("template", "tokens").agg(F.collect_list(F.struct("step", F.struct("states", "accepted", "limits", "cost").alias("entry"))).alias("changes")))
        held = self.cells().join(changed.hint("shuffle_hash"), ["template", "tokens"], "right")
        # an instance at the start of each step at which it may differ from before
        first = F.array_min(F.transform("changes", lambda c: c["step"])) + 1
        at = held.select("template", "tokens", "entries", "changes", F.explode(F.when(first < len(rules), F.sequence(first, F.lit(len(rules) - 1)))).alias("step"))
        before = F.transform(F.filter("changes", lambda c: c["step"] < F.col("step")), lambda c: c["entry"])
        cells = at.select("template", "tokens", F.concat(F.coalesce("entries", F.array()), before).alias("entries"), "step")
        best = scored_cells(cells, self.limits.least_good, self.limits.threshold, ("step",)).groupBy("step").agg(F.max(rank(self.limits.sized_order)).alias("r"))
        touched = changed.select("template", "tokens", F.array_min(F.transform("changes", lambda c: c["step"])).alias("step"))
        own = touched.join(F.broadcast(self.instances(rules)), ["template", "tokens"]).groupBy("number").agg(F.min("step").alias("step"))  # a row for each rule at most
        of = {r["number"]: r["step"] for r in own.collect()}
        rivals = {r["step"]: r["r"] for r in best.collect()}
        for i in steps:
            if of.get(i, len(rules)) < i or i in rivals and not self.ahead(rules[i], rivals[i]):
                return i
        return len(rules)

    def apart(self) -> bool:
        """Is a sample in one cell only, whatever its states, so that cells don't touch each other?"""
        t, limits = self.templates, self.limits
        own = len(t.items) == 1 and all(a.kind == "identity" and a.offset == 0 and not set(a.columns) & set(t.schema.states) for a in t.items[0].atoms)
        return own and not self.wide and limits.batch > 1 and limits.threshold >= 0 and limits.least_good == 0 and limits.useless < 0 and limits.factor < 0

    def learned_apart(self) -> list[Rule] | None:
        """All rules of cells that are apart, each cell's best in a round; None if these are more than ``max_rules``.

        A loop would take the best of all cells' next rules. So a rule comes as soon as it, and those before it in its cell, are the best.
        """
        t, template = self.templates, self.templates.items[0]
        # a null matches no value
        cells, live, sets, ranked, last = self.base.where(~F.exists("tokens", lambda x: x.isNull())), self.live, [], [], {}
        while True:
            best = scored_cells(cells, 0, self.limits.threshold).withColumn("rank", rank(self.limits.sized_order))
            best = best.groupBy("template", "tokens").agg(F.max_by(F.struct("results", "good", "bad", "score"), "rank").alias("x")).select("template", "tokens", "x.*")
            best = written(best, "best")
            self.tables.append(best)
            rules = [to_rule(r, t) for r in best.toLocalIterator()]
            if not rules:
                break
            for rule in rules:
                last[rule.values] = min(self.place(rule), last.get(rule.values, self.place(rule)))
                ranked.append((last[rule.values], -len(sets), rule))
            if len(ranked) > self.limits.max_rules:
                return None
            sets.append(best.select("tokens", F.struct(F.lit(len(sets)).alias("round"), "results").alias("set")))
            held = cells.join(best.select("template", "tokens", "results"), ["template", "tokens"], "left")
            fires = lambda e: F.coalesce(F.col("results").isNotNull() & _allows(e["limits"], F.col("results")) & ~e["states"].eqNullSafe(F.col("results")), F.lit(False))
            after = lambda e: F.when(fires(e), e.withField("states", F.col("results"))).otherwise(e)
            if live is not None:
                changed = held.select("template", "tokens", F.explode(F.transform(F.filter("entries", fires), after)).alias("x")).select("template", "tokens", "x.*")
                fresh = _given(changed.where(F.col("cost") > 0).where(_wrong() > 0)).select(*KEY)
                live = written(live.unionByName(fresh).distinct(), "live")
                self.tables.append(live)
            cells = written(held.select("template", "tokens", F.transform("entries", after).alias("entries")), "cells")
            self.tables.append(cells)
        self.base, self.live = cells, live
        if sets:
            given = reduce(DataFrame.unionByName, sets).groupBy(F.col("tokens").alias("_tokens")).agg(F.array_sort(F.collect_list("set")).alias("_sets"))
            rows = self.samples.withColumn("_own", F.array(*[F.col(a.column) for a in template.atoms])).join(F.broadcast(given), F.col("_own") == F.col("_tokens"), "left")
            rows = rows.withColumn("_limits", _limits(t.schema, template.targets, self.names))
            step = lambda now, x: F.when(_allows(F.col("_limits"), x["results"]), x["results"]).otherwise(now)
            rows = rows.withColumn("_now", F.when(F.col("_sets").isNotNull(), F.aggregate("_sets", F.array(*template.targets), step)))
            now = {s: F.when(F.col("_now").isNotNull(), F.get("_now", F.lit(i))).otherwise(F.col(s)) for i, s in enumerate(template.targets)}
            self.samples = rows.select(*[now[c].alias(c) if c in now else F.col(c) for c in self.samples.columns])
        return [rule for *_, rule in sorted(ranked, key=lambda x: x[:2], reverse=True)]

    def instances(self, rules: list[Rule]) -> DataFrame:
        rows = [(n, self.number(r), list(r.values)) for n, r in enumerate(rules)]
        return self.base.sparkSession.createDataFrame(rows, "number int, template int, tokens array<string>")

    def number(self, rule: Rule) -> int:
        return next(i for i, t in enumerate(self.templates.items) if t.atoms == rule.atoms and t.targets == rule.targets)

    def place(self, rule: Rule) -> tuple:
        """A rule's rank(), for comparing on the driver."""
        return _in_bytes((rule.score, *((len(rule.values),) if self.limits.sized_order else ()), list(rule.results), -self.number(rule), list(rule.values)))

    def ahead(self, rule: Rule, rival) -> bool:
        return self.place(rule) > _in_bytes(rival)

    def kept(self, live: DataFrame) -> DataFrame:
        """Candidates without those that Limits calls useless."""
        useless, factor = self.limits.useless, self.limits.factor
        if useless < 0 and factor < 0:
            return live
        counts = _met(flat(self.cells()), live, False).groupBy(*KEY).agg(F.sum("won").alias("good"), F.sum("lost").alias("bad"))
        counts = live.join(counts, KEY, "left").fillna(0, ["good", "bad"])
        none = (F.col("bad") > useless) if useless >= 0 else F.lit(False)
        outweighed = (F.col("bad") * factor >= F.col("good")) if factor >= 0 else F.lit(False)
        return counts.where(~F.when(F.col("good") == 0, none).otherwise(outweighed)).select(*KEY)

    def write(self) -> None:
        samples, cells = self.samples.persist() if self.wide else written(self.samples, "samples"), written(celled(summed(flat(self.cells())).where("cost <> 0")), "cells")
        if self.wide:
            samples.count()  # before what it is made of goes
        live = self.live
        self.tables = [x for x in self.tables if x is not live]
        self.close()
        self.samples, self.base, self.deltas, self.since = samples, dealt(cells).persist(), [], 0
        self.tables = [x for x in (None if self.wide else samples, cells, live) if x is not None]
        self.memory = [*([samples] if self.wide else []), self.base]

    def close(self) -> None:
        for x in self.memory:
            x.unpersist()
        dropped(*self.tables)
        self.memory, self.tables = [], []


def learn(
    df: DataFrame, templates: Templates, limits: Limits = Limits(), vocabulary: DataFrame | None = None, bigrams: DataFrame | None = None,
    constraints: list[tuple[tuple[str, ...], str, DataFrame]] | None = None, samples: bool = True,
) -> tuple[list[Rule], DataFrame | None]:
    """Rules in the order in which they were learned, and the samples after them (a table in the shared folder; None without ``samples``).

    Each turn takes the best candidates (``batch`` at most; only these reach the driver) and applies as many of them as a loop of
    one rule a turn would. A turn shuffles what rules change, not the tally, which stays dealt by instance. With one template of
    features alone, cells share no samples: then all cells learn at once, in as many rounds as one of them has rules.
    """
    columns = df.columns
    df = with_word_lists(df, [a for t in templates.items for a in t.atoms], vocabulary, bigrams)
    df, names = constrained(df, constraints or [])
    state, rules = _State(df if samples else _looked_at(df, templates, names), templates, limits, names), []
    try:
        apart = state.learned_apart() if state.apart() else None
        rules += apart or []
        while apart is None and (best := state.best(limits.max_rules - len(rules)) if len(rules) < limits.max_rules else []):
            for rule in best[: state.apply(best)]:
                same = [r for r in rules[-limits.repeats + 1 :] if (r.atoms, r.values, r.results) == (rule.atoms, rule.values, rule.results)]
                if len(same) >= limits.repeats - 1:
                    raise RuntimeError(f"the same rule was best {limits.repeats} times in a row: {rule.text()}")
                rules.append(rule)
        if limits.redundant is not None:
            least = _least_redundant(limits, rules, state.samples)
            # what tells so little of data seen tells something of data unseen: a list as long as the candidates without bad rows
            found = redundant_rules(flat(state.cells()), state.live, least, limits.sized_order)
            rules += [to_rule(r, templates) for r in found.toLocalIterator()]
        return rules, written(state.samples.select(*columns), "learned") if samples else None
    finally:
        state.close()


def _least_redundant(limits: Limits, rules: list[Rule], samples: DataFrame) -> int:
    text = limits.redundant or ""
    if text.endswith("%"):
        return int(text[:-1]) * int(samples.agg(F.coalesce(F.sum(_cost(samples)), F.lit(0)).alias("n")).first()["n"]) // 100
    return max(limits.least_redundant, (rules[0].score if rules else 0) + int(text)) if int(text) < 0 else int(text)


def redundant_rules(tally: DataFrame, live: DataFrame, least: int, sized: bool = True) -> DataFrame:
    """Rules of ``live`` that put nothing wrong that is right now, and that give at least ``least`` rows their truth, whatever their
    state: worst first, good and bad 0 and that number as score.

    They change nothing in the samples, where other rules came first, but are kept beside the learned ones for data that the
    learner hasn't seen. Rows that are wrong now don't count against them.
    """
    forced = _given(tally).groupBy(*KEY).agg(F.sum("cost").cast("long").alias("score")).where(F.col("score") >= least).join(live, KEY, "left_semi")
    harm = _met(tally, forced).groupBy(*KEY).agg(F.sum("lost").alias("bad")).where("bad > 0")
    out = forced.join(harm, KEY, "left_anti").select(*KEY, F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad"), "score")
    return out.orderBy(F.asc("score"), *([F.asc(F.size("tokens"))] if sized else []), F.asc("results"), F.desc("template"), F.asc("tokens"))


def pruned(rules: DataFrame, least_good: int = 0, useless: int | None = None, factor: float | None = None) -> DataFrame:
    """Scored rules without those of few good rows, those of none and many bad ones, and those whose bad rows outweigh."""
    out = rules.where(F.col("good") > least_good)
    if useless is not None:
        out = out.where(~((F.col("good") == 0) & (F.col("bad") > useless)))
    return out.where(F.col("bad") * factor < F.col("good")) if factor is not None else out
