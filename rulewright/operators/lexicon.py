"""Lexicons: classes by frequency for keys, most likely classes with back-off, vocabularies and lexical splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import by_seq, neighbour
from ..plans.spec import PAD
from ..shared import written

#: Words that are sent to every task.
SENT_WORDS = 500_000


def build(df: DataFrame, keys: list[str | tuple[str, int]], truth: str, least: int = 1, separator: str | None = None, cost: str | None = None) -> DataFrame:
    """length, key (array), classes (by count, then by the counts of shorter keys, then by name) and n for each prefix of the keys.

    A key is a column or (column, offset). Classes with fewer than ``least`` counts are left out. A row counts ``cost`` times.
    """
    cols = [F.col(k) if isinstance(k, str) else neighbour(*k) for k in keys]
    rows = df.select(*[c.alias(f"k{i}") for i, c in enumerate(cols)], F.explode(F.split(truth, f"[{separator}]") if separator else F.array(truth)).alias("cls"), (F.col(cost) if cost else F.lit(1)).alias("_times"))
    counts = rows.groupBy(*[f"k{i}" for i in range(len(keys))], "cls").agg(F.sum("_times").alias("n"))
    parts = []
    for m in range(1, len(keys) + 1):
        names = [f"k{i}" for i in range(m)]
        parts.append(counts.groupBy(*names, "cls").agg(F.sum("n").alias("n")).select(F.lit(m).alias("length"), F.array(*names).alias("key"), "cls", "n"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.where(F.col("n") >= least)
    shorter = every.select((F.col("length") + 1).alias("length"), F.col("key").alias("_short"), "cls", F.col("n").alias("back"))
    every = every.withColumn("_short", F.slice("key", 1, F.greatest(F.col("length") - 1, F.lit(0)))).join(shorter, ["length", "_short", "cls"], "left")
    entry = F.struct((-F.col("n")).alias("a"), (-F.coalesce("back", F.lit(0))).alias("b"), F.col("cls"))
    return every.groupBy("length", "key").agg(F.sort_array(F.collect_list(entry)).alias("e"), F.sum("n").alias("n")).select("length", "key", F.transform("e", lambda x: x["cls"]).alias("classes"), "n")


def best_classes(lexicon: DataFrame) -> DataFrame:
    return lexicon.select("length", "key", F.col("classes")[0].alias("cls"))


def merged(*lexicons: DataFrame) -> DataFrame:
    """Of a key in several lexicons the last one's entry counts."""
    out = None
    for i, x in enumerate(lexicons):
        x = x.select("length", "key", "classes", F.lit(i).alias("_from"))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("length", "key").agg(F.max_by("classes", "_from").alias("classes"))


def most_likely(df: DataFrame, lexicon: DataFrame, patterns: list[list[str | tuple[str, int]]], state: str, common: str, proper: str) -> DataFrame:
    """df with the most likely class in ``state``: of the patterns' longest keys that the lexicon has, the first; else
    ``proper`` for words that begin with A-Z, and ``common`` for others."""
    own = df.columns
    best, found = best_classes(lexicon), []
    for p, keys in enumerate(patterns):
        # rows that meet by a column stay together by it, for joins that follow
        cols = [k if isinstance(k, str) else f"_q{p}_{i}" for i, k in enumerate(keys)]
        df = df.withColumns({c: neighbour(*k) for c, k in zip(cols, keys) if not isinstance(k, str)})
        for m in range(len(keys), 0, -1):
            side = best.where(F.col("length") == m).select(*[F.col("key")[i].alias(f"_l{i}") for i in range(m)], F.col("cls").alias(f"_c{p}_{m}"))
            df = df.join(side, [F.col(cols[i]) == F.col(f"_l{i}") for i in range(m)], "left").drop(*[f"_l{i}" for i in range(m)])
            found.append(F.col(f"_c{p}_{m}"))
    first = patterns[0][0] if isinstance(patterns[0][0], str) else patterns[0][0][0]
    guess = F.when(F.col(first).rlike("^[A-Z]"), proper).otherwise(common)
    df = df.withColumn("_best", F.coalesce(*found, guess))
    kept = [F.col("_best").alias(c) if c == state else F.col(c) for c in own]
    return df.select(*kept, *([] if state in own else [F.col("_best").alias(state)]))


def vocabulary(df: DataFrame, columns: list[str], classes: list[str] = []) -> DataFrame:
    """word, n and is_class: distinct values of the columns and of the class columns, and how often they stand there."""
    words = df.select(F.explode(F.array(*columns)).alias("word"), F.lit(False).alias("is_class"))
    if classes:
        words = words.unionByName(df.select(F.explode(F.array(*classes)).alias("word"), F.lit(True).alias("is_class")))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_class").alias("is_class"))


def numbered(vocab: DataFrame) -> DataFrame:
    """Vocabulary with ids: classes first, then words, each in binary order. The order comes from ranges of words; a row for each
    range says how many words stand before it."""
    place = F.monotonically_increasing_id()
    kept = written(vocab.repartitionByRange(F.desc("is_class"), F.asc("word")).sortWithinPartitions(F.desc("is_class"), F.asc("word")).withColumn("_place", place), "vocabulary")
    part, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return kept.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*vocab.columns, (F.col("_start") + row).alias("id"))


def split_parts(df: DataFrame, first: Column) -> tuple[DataFrame, DataFrame]:
    """Sequences where ``first`` holds, and the others."""
    return df.where(first), df.where(~first)


def random_half(rate: float, seed: int = 1) -> Column:
    """A condition on whole sequences that holds for about this share of them, always for the same ones."""
    return F.pmod(F.xxhash64("seq", F.lit(seed)), F.lit(1_000_000)) < int(rate * 1_000_000)


def unseen(first: DataFrame, second: DataFrame, word: str, least: int = 1) -> DataFrame:
    """word: those of the second part that stand in the first part fewer than ``least`` times."""
    known = first.groupBy(F.col(word).alias("_known")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return second.select(F.col(word).alias("word")).distinct().join(known, F.col("word") == F.col("_known"), "left_anti")


def bigrams(df: DataFrame, word: str) -> DataFrame:
    """left, right and n of neighbouring words."""
    pairs = df.select(F.col(word).alias("left"), F.lead(word).over(by_seq()).alias("right")).where("right is not null")
    return pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))


def neighbours(df: DataFrame, words: str) -> DataFrame:
    """left and right of each place, of sequences that stand as arrays of words in one row each: nothing is shuffled."""
    w, n = F.col(words), F.size(words) - 1
    both = F.arrays_zip(F.slice(w, F.lit(1), n).alias("left"), F.slice(w, F.lit(2), n).alias("right"))
    return df.where(F.size(words) > 1).select(F.explode(both).alias("p")).select("p.left", "p.right").where("right is not null")


def counted(places: DataFrame) -> DataFrame:
    """left, right and n of the pairs of neighbours()."""
    return places.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))


def sendable(words: DataFrame) -> tuple[DataFrame, bool]:
    """Distinct words as a table, and whether it is sent to every task: with more than SENT_WORDS both sides of a join are shuffled."""
    some = written(words.select("word").distinct(), "words")
    small = some.count() <= SENT_WORDS
    return F.broadcast(some) if small else some, small


def frequent_words(counts: DataFrame, most: int | None = None) -> DataFrame:
    """word: the most frequent of a table of word and n, by powers of two of n, ``most`` (SENT_WORDS) of them or fewer."""
    level = F.floor(F.log2("n"))
    most, least = SENT_WORDS if most is None else most, 64
    for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():  # 64 rows at most
        most -= r["words"]
        if most < 0:
            break
        least = r["level"]
    return counts.where(level >= least).select("word")


def frequent_bigrams(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Bigrams with at least one of the words. Each row of pairs stays or goes."""
    return _held(pairs, sendable(words)[0], "_left IS NOT NULL OR _right IS NOT NULL")


def _held(pairs: DataFrame, words: DataFrame, which: str) -> DataFrame:
    both = pairs
    for side in ("left", "right"):
        both = both.join(words.select(F.col("word").alias(f"_{side}")), F.col(side) == F.col(f"_{side}"), "left")
    return both.where(which).select(*pairs.columns)


def bigrams_with(df: DataFrame, array: str, words: DataFrame, never: DataFrame | None = None) -> DataFrame:
    """left, right and n of neighbouring words of which at least one is among ``words``, from sequences as arrays of words.

    Few words choose the places before these are counted, so that only pairs of the result are shuffled. With many words, pairs
    of two words of ``never``, which are surely not among them, go before counting (SENT_WORDS of these at most).
    """
    places = neighbours(df, array)
    some, small = sendable(words)
    if small:
        return counted(_held(places, some, "_left IS NOT NULL OR _right IS NOT NULL"))
    if never is not None:
        places = _held(places, F.broadcast(never), "_left IS NULL OR _right IS NULL")
    return _held(counted(places), some, "_left IS NOT NULL OR _right IS NOT NULL")


def lexical_rows(second: DataFrame, new_words: DataFrame, word: str) -> DataFrame:
    """Rows of the second part whose word is new: what lexical rules learn from."""
    return second.join(new_words.select(F.col("word").alias("_new")).distinct(), F.col(word) == F.col("_new"), "left_semi")


def frozen(known: DataFrame, value: str = PAD) -> DataFrame:
    """key, classes and line of a lexicon that allows its words one class that no rule gives (or FAKE_CLASS, which changes nothing):
    as a constraint it keeps known words as they are."""
    return known.select("key").distinct().select("key", F.array(F.lit(value)).alias("classes"), F.lit(0).alias("line"))
