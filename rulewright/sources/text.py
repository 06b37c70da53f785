"""Text formats: column text, rules, vocabularies, lexicons, constraints, bigrams and trees."""

from __future__ import annotations

import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.apply import loadable
from ..operators.tree import Node
from ..plans.spec import Rule, TaskSchema, Templates, parse_params, parse_rules
from ..shared import written

log = logging.getLogger("rulewright")
BLANKS = r"[ \t\r\n]+"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0) and value: numbered lines of text files; compression goes by a file's ending. Large files are read in
    blocks by many tasks: a row for each block says how many lines stand before it."""
    here = F.col("_metadata")
    raw = spark.read.text(path).select("value", here["file_path"].alias("file"), here["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    numbered = raw.withColumn("inside", inside).join(starts, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return numbered.select("file", (F.col("start") + F.col("inside")).alias("line"), "value", "block")


def _in_parts(lines: DataFrame, blank: Column) -> DataFrame:
    """Lines that aren't blank with ``part``, the number of blank lines before them in their file: counted by block, then summed."""
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blanks = lines.groupBy("file", "block").agg(F.count_if(blank).alias("n")).select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.coalesce(before, F.lit(0)).alias("blanks"))
    inside = F.sum(blank.cast("int")).over(Window.partitionBy("file", "block").orderBy("line"))
    rows = lines.withColumn("inside", inside).where(~blank).join(blanks, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return rows.withColumn("part", F.col("blanks") + F.col("inside")).drop("_file", "_block", "blanks", "inside")


def read_samples(spark: SparkSession, path: str, schema: TaskSchema, blank_lines_separate: bool = True, fields: list[str] | None = None) -> DataFrame:
    """seq, pos and a column for each blank-separated field. Files are read in blocks, and in their own order.

    With ``blank_lines_separate`` a blank line ends a sequence; else each row is one. A row of another number of fields
    fails. seq is the file's number (by name) and the sequence's in it, so it stays the same whatever the partitions.
    """
    names = list(fields or schema.columns)
    lines = _lines(spark, path).withColumn("words", F.split(F.trim(F.regexp_replace("value", BLANKS, " ")), " "))
    blank = F.col("value").rlike(r"^[ \t\r\n]*$")
    if blank_lines_separate:
        rows = _in_parts(lines, blank)
    else:
        rows = lines.where(~blank).withColumn("part", F.col("line"))
    width = F.size("words")
    checked = F.when(width == len(names), F.col("words")).otherwise(F.raise_error(F.format_string(f"%s:%d has %d fields, not {len(names)}", "file", F.col("line") + 1, width)))
    rows = rows.withColumn("words", checked.cast("array<string>"))
    seq = F.concat_ws("#", "file", F.lpad(F.col("part").cast("string"), 12, "0"))
    pos = F.row_number().over(Window.partitionBy("file", "part").orderBy("line")) - 1
    return rows.select(seq.alias("seq"), pos.alias("pos"), *[F.col("words")[i].alias(n) for i, n in enumerate(names)])


def read_parallel(spark: SparkSession, files: dict[str, list[str]]) -> DataFrame:
    """line and the fields of files whose lines belong together (path: names of its fields; names must differ). Files are joined by
    line number; if one is shorter than another, or a line has another number of fields, reading fails."""
    out = None
    for path, names in files.items():
        words = F.split(F.trim(F.regexp_replace("value", BLANKS, " ")), " ")
        right = F.when(F.size(words) == len(names), words).otherwise(F.raise_error(F.format_string(f"%s:%d has not {len(names)} fields", F.lit(path), F.col("line") + 1)).cast("array<string>"))
        one = _lines(spark, path).select("line", right.alias("_words")).select("line", F.lit(True).alias("_here"), *[F.col("_words")[i].alias(n) for i, n in enumerate(names)])
        if out is None:
            out = one
            continue
        both = out.withColumnRenamed("_here", "_left").join(one, "line", "full")
        whole = F.when(F.col("_left").isNotNull() & F.col("_here").isNotNull(), F.col("line")).otherwise(F.raise_error(F.format_string("%s: line %d is missing, or is one too many", F.lit(path), F.col("line") + 1)).cast("bigint"))
        out = both.withColumn("line", whole).drop("_left")
    return out.drop("_here")


def write_samples(df: DataFrame, schema: TaskSchema, path: str) -> None:
    """Column text: a line for each sample, `` | `` and the trace if there is one, a blank line after each sequence."""
    line = F.concat_ws(" ", *schema.columns)
    if "trace" in df.columns:
        line = F.concat(line, F.when(F.size("trace") > 0, F.concat(F.lit(" | "), F.concat_ws(" ", F.transform("trace", lambda x: x.cast("string"))))).otherwise(""))
    text = df.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("rows"))
    text.sortWithinPartitions("seq").select(F.concat(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("value")).write.text(path)


def read_file(spark: SparkSession, path: str) -> str:
    """A small file whole: declarations, rules, parameters."""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0].value if rows else ""


def read_schema(spark: SparkSession, path: str, truth_separator: str | None = None) -> TaskSchema:
    line = next(x for x in read_file(spark, path).splitlines() if x.strip() and not x.startswith("#"))
    return TaskSchema.parse(line, truth_separator)


def read_templates(spark: SparkSession, path: str, schema: TaskSchema) -> Templates:
    return Templates.parse(read_file(spark, path), schema)


def read_params(spark: SparkSession, path: str) -> dict[str, str]:
    return parse_params(read_file(spark, path))


def read_rules(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> list[Rule]:
    return parse_rules(read_file(spark, path), aliases)


def write_rules(spark: SparkSession, rules: list[Rule], path: str, vocabulary: str = "") -> None:
    lines = [f"#train_voc_file: {vocabulary}", *(r.text() for r in rules)]
    spark.createDataFrame([("\n".join(lines) + "\n",)], "value string").coalesce(1).write.text(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.parquet(path)


def write_vocabulary_text(vocab: DataFrame, path: str) -> None:
    """Vocabulary text in a folder, of word, id and is_class (lexicon.numbered()): the range of ids that are words, the number of
    classes, then the words by id. Files are in the order of their names."""
    sizes = vocab.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_class").alias("classes")).first()
    heads = [(-2, f"#real_word_indices: {sizes['classes']} {sizes['n']}"), (-1, f"#number_of_classes: {sizes['classes']}")]
    lines = vocab.select(F.col("id").cast("long").alias("id"), F.col("word").alias("value")).unionByName(vocab.sparkSession.createDataFrame(heads, "id long, value string"))
    lines.repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)


def read_vocabulary_text(spark: SparkSession, path: str) -> DataFrame:
    """word, id, is_class and is_real from vocabulary text: header lines (# key: value), then a word a line, classes first. Real words
    are those that affixes may make; without a header all but the classes are."""
    lines = written(_lines(spark, path).where("value <> ''"), "vocabulary")
    heads = {r.value.partition(":")[0]: r.value.partition(":")[2] for r in lines.where(F.col("value").rlike("^#(real_word_indices|number_of_classes):")).collect()}
    classes = int(heads.get("#number_of_classes", 0) or 0)
    first, last = (int(x) for x in heads.get("#real_word_indices", f"{classes} {1 << 62}").split())
    words = lines.where(~F.col("value").rlike("^#(real_word_indices|number_of_classes):"))
    at = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    starts = words.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", before.alias("start"))
    numbered = words.join(starts, "file").select(F.trim("value").alias("word"), (F.col("start") + at).cast("int").alias("id"))
    return numbered.withColumns({"is_class": F.col("id") < classes, "is_real": (F.col("id") >= first) & (F.col("id") < last)})


def read_lexicon(spark: SparkSession, path: str, length: int = 1) -> DataFrame:
    """length, key, classes and line from lexicon text: the key's words, then classes by frequency."""
    lines = _lines(spark, path).where("value <> '' and not value rlike '^#(pattern:|[a-z-]+: )' and not value rlike '^n-grams:'")
    words = F.split(F.trim(F.regexp_replace("value", BLANKS, " ")), " ")
    return lines.select(F.lit(length).alias("length"), F.slice(words, 1, length).alias("key"), F.slice(words, length + 1, F.greatest(F.size(words) - length, F.lit(0))).alias("classes"), "line").where(F.size("classes") > 0)


def read_constraints(spark: SparkSession, config: str, vocabulary: DataFrame | None = None) -> list[tuple[tuple[str, ...], str, DataFrame]]:
    """(keys, truth, table of keys, allowed and line) for each line ``key .. truth file`` of a constraint configuration. Beside a
    vocabulary only what it knows counts (see apply.loadable)."""
    out = []
    for line in (x.split() for x in config.splitlines() if x.strip() and not x.startswith("#")):
        *keys, truth, path = line
        table = read_lexicon(spark, path, len(keys)).select(*[F.col("key")[i].alias(k) for i, k in enumerate(keys)], F.col("classes").alias("allowed"), "line")
        out.append((tuple(keys), truth, table if vocabulary is None else loadable(table, tuple(keys), vocabulary)))
    return out


def read_bigrams(spark: SparkSession, config: str) -> DataFrame:
    """left and right from lines ``f_0 f_1 file`` or ``f_-1 f_0 file`` of a configuration and the two-column files they name."""
    out = None
    for line in (x.split() for x in config.splitlines() if x.strip() and not x.startswith("#")):
        words = F.split(F.trim(F.regexp_replace("value", BLANKS, " ")), " ")
        one = _lines(spark, line[2]).where("trim(value) <> ''").select(words[0].alias("left"), words[1].alias("right"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def write_tree(spark: SparkSession, root: Node, path: str) -> None:
    spark.createDataFrame([(root.to_json(),)], "value string").coalesce(1).write.text(path)


def read_tree(spark: SparkSession, path: str) -> Node:
    return Node.from_json(json.dumps(json.loads(read_file(spark, path))))


def read_probabilities(spark: SparkSession, path: str, classes: int = 1) -> DataFrame:
    """seq, pos, word and a map of class to probability from lines ``word class p class p ..``."""
    lines = _lines(spark, path).withColumn("words", F.split(F.trim(F.regexp_replace("value", BLANKS, " ")), " "))
    blank = F.col("value").rlike(r"^[ \t\r\n]*$")
    rows = _in_parts(lines, blank)
    pairs = F.transform(F.sequence(F.lit(classes), F.size("words") - 1, F.lit(2)), lambda i: F.struct(F.element_at("words", i + 1).alias("c"), F.element_at("words", i + 2).cast("double").alias("p")))
    pos = F.row_number().over(Window.partitionBy("file", "part").orderBy("line")) - 1
    return rows.select(F.concat_ws("#", "file", F.lpad(F.col("part").cast("string"), 12, "0")).alias("seq"), pos.alias("pos"), F.col("words")[0].alias("word"), F.map_from_entries(pairs).alias("p").cast(T.MapType(T.StringType(), T.DoubleType())))


def log_run(command: str, **figures) -> None:
    """A line for each run in the library's log."""
    log.info("%s %s", command, " ".join(f"{k}={v}" for k, v in figures.items()))
