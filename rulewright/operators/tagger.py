"""Two-stage taggers: rules for unknown words, then rules for context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import Rule, Templates
from ..shared import dropped, written
from ..sources import text
from . import lexicon as lex
from .apply import apply_rules
from .learn import Limits, learn


@dataclass
class Tagger:
    """What training leaves: the lexicon, both rule lists, the words they know and the classes for unknown words."""

    lexicon: DataFrame
    vocabulary: DataFrame
    bigrams: DataFrame
    lexical: list[Rule]
    context: list[Rule]
    common: str
    proper: str


def loaded(spark: SparkSession, lexicon: str, words: list[str], lexical: str, context: str, common: str, proper: str, bigrams: str | None = None, names: dict[str, str] | None = None) -> Tagger:
    """A tagger from the files that training leaves elsewhere: a lexicon, lists of known words (one a line), two rule lists and a
    configuration of bigram files. Columns that rules call otherwise are renamed; without bigrams, atoms of them never hold."""
    known = text.read_lexicon(spark, lexicon).groupBy("length", "key").agg(F.max_by("classes", "line").alias("classes"))
    vocabulary = spark.read.text(words).select(F.trim("value").alias("word")).where("word <> ''").distinct()
    pairs = text.read_bigrams(spark, bigrams) if bigrams else spark.createDataFrame([], "left string, right string")
    first, second = ([r.renamed(names or {}) for r in text.read_rules(spark, path)] for path in (lexical, context))
    return Tagger(known, vocabulary, pairs, first, second, common, proper)


def train(df: DataFrame, word: str, lexical: Templates, context: Templates, first: Column, common: str, proper: str, lexical_limits: Limits = Limits(), context_limits: Limits = Limits()) -> Tagger:
    """df has seq, pos, word, state and truth. ``first`` picks the sequences whose lexicon the others' new words lack."""
    schema = context.schema
    state, truth = schema.states[0], schema.truths[0]
    # the first stage and the lexicons see words, not places: each kind of row once, with its number
    types = written(df.withColumn("_first", first).groupBy("_first", *dict.fromkeys([*lexical.schema.columns, *schema.columns])).agg(F.count(F.lit(1)).alias("cost")), "types")
    one, two = lex.split_parts(types, F.col("_first"))
    known = lex.build(one, [word], truth, cost="cost")
    new = lex.unseen(one, two, word)
    vocab = types.select(F.col(word).alias("word")).distinct()
    pairs = lex.bigrams(df, word).persist()
    placed = lexical.reach > 0
    rows = lex.most_likely(lex.lexical_rows(df.where(~first) if placed else two, new, word), known, [[word]], state, common, proper)
    lexical_rules, guessed = learn(rows, lexical, lexical_limits, vocab, pairs)
    extra = lex.build(guessed, [word], state, cost=None if placed else "cost")
    full = written(lex.merged(extra, known), "lexicon")
    start = lex.most_likely(df, full, [[word]], state, common, proper)
    context_rules, _ = learn(start, context, context_limits, vocab, pairs, samples=False)
    dropped(guessed, full)
    return Tagger(written(lex.build(types, [word], truth, cost="cost"), "lexicon"), vocab, pairs, lexical_rules, context_rules, common, proper)


def tag(
    df: DataFrame, word: str, tagger: Tagger, schema, constrain_above: int | None = None, least_redundant: int | None = None,
    constraints: list[tuple[tuple[str, ...], str, DataFrame]] | None = None,
) -> DataFrame:
    """df with its state filled: unknown words by the lexical rules, all by the lexicon, then by the contextual rules.

    With ``constrain_above``, words that training saw more often may only get classes they had there (``constraints`` are as for
    apply_rules); with ``least_redundant``, rules that learning added without a good row are left out below that score.
    """
    lists = [r if least_redundant is None else confident(r, least_redundant) for r in (tagger.lexical, tagger.context)]
    state = schema.states[0]
    placed = any(k for r in lists[0] for a in r.atoms for _, k in a.reads())
    own = [c for c in dict.fromkeys([word, *schema.columns]) if c in df.columns]
    # rules without neighbours see kinds of rows, each of which is a sequence of its own
    kinds = df if placed else written(df.groupBy(*own).agg(F.count(F.lit(1)).alias("_times")), "types").withColumns({"seq": F.monotonically_increasing_id(), "pos": F.lit(0)})
    new = kinds.select(F.col(word).alias("word")).distinct().join(tagger.lexicon.where("length = 1").select(F.col("key")[0].alias("_k")), F.col("word") == F.col("_k"), "left_anti")
    rows = lex.most_likely(lex.lexical_rows(kinds, new, word), tagger.lexicon, [[word]], state, tagger.common, tagger.proper)
    guessed = lex.build(apply_rules(rows, lists[0], schema, tagger.vocabulary, tagger.bigrams), [word], state, cost=None if placed else "_times")
    full = lex.merged(tagger.lexicon, guessed)
    start = lex.most_likely(df, full, [[word]], state, tagger.common, tagger.proper)
    limits = list(constraints or [])
    if constrain_above is not None:
        often = tagger.lexicon.where((F.col("length") == 1) & (F.col("n") > constrain_above))
        limits.append(((word,), schema.truths[0], often.select(F.col("key")[0].alias(word), F.col("classes").alias("allowed"))))
    return apply_rules(start, lists[1], schema, tagger.vocabulary, tagger.bigrams, limits)


def confident(rules: list[Rule], least: int) -> list[Rule]:
    """Rules without the redundant ones (no good rows) of a lower score."""
    return [r for r in rules if r.good > 0 or r.score >= least]
