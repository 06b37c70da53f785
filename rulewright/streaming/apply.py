"""Rules over streams of whole sequences: a row holds a sequence's samples, so no state and no shuffle is needed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import FAKE, OWN_KINDS, PAD, Rule, TaskSchema


def nested(df: DataFrame, schema: TaskSchema) -> DataFrame:
    """seq and samples (array of structs in the order of pos) from samples in long form."""
    samples = F.sort_array(F.collect_list(F.struct("pos", *schema.columns)))
    return df.groupBy("seq").agg(samples.alias("samples"))


def _test(rule: Rule, samples: Column, x: Column, i: Column) -> Column:
    def look(column: str, offset: int) -> Column:
        if offset == 0:
            return x[column]
        at = i + offset  # from 0
        return F.when((at >= 0) & (at < F.size(samples)), F.get(samples, at)[column]).otherwise(F.lit(PAD))

    ok = reduce(Column.__or__, [F.lit(True) if v == FAKE else ~x[t].eqNullSafe(F.lit(v)) for t, v in zip(rule.targets, rule.results)])
    for a, v in zip(rule.atoms, rule.values):
        if a.needs_words:
            raise ValueError(f"{a.text} needs a word list; apply it in long form")
        span = range(a.offset, (a.last if a.kind == "range" else a.offset) + 1)
        if a.kind in ("identity", "range", "set"):
            ok = ok & reduce(Column.__or__, [look(c, k) == v for c in a.columns for k in span])
        elif a.kind in OWN_KINDS:
            ok = ok & OWN_KINDS[a.kind].test(look(a.column, a.offset), F.lit(v))
        else:
            ok = ok & {"prefix": F.startswith, "suffix": F.endswith, "contains": F.contains}[a.kind](look(a.column, a.offset), F.lit(v))
    return ok


def _rewriting(rule: Rule, schema: TaskSchema, samples: Column):
    new = {t: v for t, v in zip(rule.targets, rule.results) if v != FAKE}

    def rewritten(x: Column, i: Column) -> Column:
        fire = F.coalesce(_test(rule, samples, x, i), F.lit(False))
        return F.struct(*[F.when(fire, F.lit(new[c])).otherwise(x[c]).alias(c) if c in new else x[c].alias(c) for c in ("pos", *schema.columns)])

    return rewritten


def apply_nested(df: DataFrame, rules: list[Rule], schema: TaskSchema) -> DataFrame:
    """A stream or table of (seq, samples) after all rules, each at once over a whole sequence. For lists of some tens of rules."""
    # each rule's sequence is bound to a variable, so that its many uses don't repeat the rules before
    held = F.array("samples")
    for rule in rules:
        held = F.transform(held, _over(rule, schema))
    return df.withColumn("samples", F.get(held, F.lit(0)))


def _over(rule: Rule, schema: TaskSchema):
    return lambda samples: F.transform(samples, _rewriting(rule, schema, samples))


def flat(df: DataFrame, schema: TaskSchema) -> DataFrame:
    return df.select("seq", F.explode("samples").alias("s")).select("seq", "s.pos", *[f"s.{c}" for c in schema.columns])


def run_stream(source: DataFrame, rules: list[Rule], schema: TaskSchema, path: str, checkpoint: str):
    """Starts a stream of (seq, samples) through the rules into Parquet; what is there now is processed, then it stops."""
    out = apply_nested(source, rules, schema)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
