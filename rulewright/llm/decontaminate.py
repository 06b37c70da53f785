"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is WINDOW consecutive words of a benchmark item (a shorter item is one window). It is a set of shingles of
SHINGLE words at fixed places; a document holds the window only if it holds all of them. So one shingle is a sufficient
prefix. A first pass over the documents counts the benchmark's shingles, without places; the rarest shingle of each window is
its prefix, and windows with a shingle that stands nowhere go. A second pass joins prefixes only; the match says where the
window would have to begin, positions that leave the document are dropped, and the rest is verified word for word. Shingles
are joined by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SENT_KEYS, pick, table, without, written

WINDOW, SHINGLE = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of the benchmark's windows up to which these are sent to every task; with more, both sides are shuffled.
SENT_CHARS = 64 << 20


def words_of(text: Column) -> Column:
    """Lower-case words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ as an array; null: no words."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def shingle_hashes(hashes: Column, n: Column, k: int) -> Column:
    """A hash of each run of k words, from the words' hashes."""
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """window (its words), item, size, at, k and shingle (hash of k words from the window's word ``at`` on): each shingle of each
    distinct window, of each item that has it."""
    items = pick(benchmark, id_col, text_col).toDF("item", "text").select("item", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("size", F.least(F.size("w"), F.lit(window)))
    runs = items.select("item", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.slice("w", i, F.col("size")))).alias("run"))
    parts = [F.when(F.least(F.col("size"), F.lit(SHINGLE)) == k, F.transform(shingle_hashes(F.col("h"), F.col("size"), k), lambda x, i: F.struct(i.alias("at"), x.alias("shingle")))) for k in range(1, SHINGLE + 1)]
    hashed = runs.select("item", "size", F.array_join("run", " ").alias("window"), F.transform("run", lambda x: F.xxhash64(x)).alias("h"))
    return hashed.select("item", "size", "window", F.least(F.col("size"), F.lit(SHINGLE)).alias("k"), F.explode(F.coalesce(*parts)).alias("p")).select("item", "size", "window", "k", "p.at", "p.shingle").distinct()


def _split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = pick(docs, id_col, text_col).toDF("id", "text")
    return text.select("id", F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("w")).select("id", "key", "w", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))


def occurrences(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str):
    """id, key (text hash), window, size and start (from 0) of each occurrence of a window; and how to send small tables."""
    split = _split(docs, id_col, text_col)
    sizes = windows.agg(F.coalesce(F.sum(F.length("window") + 64), F.lit(0)).alias("chars"), F.collect_set("k").alias("k")).first()
    small = sizes["chars"] <= SENT_CHARS
    send = F.broadcast if small else (lambda df: df)
    every = lambda k, *cols: split.select(*cols, F.posexplode(shingle_hashes(F.col("h"), F.col("n"), k)).alias("place", "shingle"))

    # rarity over all documents, summed up in each task first; the rarest shingle of each window is its prefix
    shingles = windows.select("k", F.col("shingle").alias("known")).distinct()
    counts = [every(k).join(send(shingles.where(F.col("k") == k).drop("k")), F.col("shingle") == F.col("known")).groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).withColumn("k", F.lit(k)) for k in sorted(sizes["k"])]
    none = split.select(F.lit(0).cast("bigint").alias("shingle"), F.lit(0).cast("bigint").alias("df"), F.lit(0).alias("k")).where("false")
    counts = written(reduce(DataFrame.unionByName, counts, none), "counts")
    ranked = windows.select("window", "size", "at", "k", "shingle").distinct().join(counts, ["k", "shingle"])
    by = Window.partitionBy("window").orderBy("df", "at")
    whole = F.count(F.lit(1)).over(Window.partitionBy("window")) == F.col("size") - F.col("k") + 1  # else a shingle stands nowhere
    prefix = ranked.withColumn("rank", F.row_number().over(by)).withColumn("whole", whole).where("rank = 1 and whole").select("window", "size", "at", "k", F.col("shingle").alias("prefix"))
    prefix = written(prefix, "prefixes")

    places = split.select("id", "key", F.lit("").alias("window"), F.lit(0).alias("size"), F.lit(0).alias("start")).where("false")
    for k in sorted(sizes["k"]):
        own = send(prefix.where(F.col("k") == k).drop("k"))
        found = every(k, "id", "key", "n").join(own, F.col("shingle") == F.col("prefix")).withColumn("start", F.col("place") - F.col("at"))
        places = places.unionByName(found.where("start >= 0 and start + size <= n").select("id", "key", "window", "size", "start"))
    places = written(places, "places")
    # verified on the words of texts that have such a place: their keys, which are small, choose them, so that no other text is shuffled
    by_text = places.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("window", "size", "start")).alias("p"))
    by_text = written(by_text, "texts")
    texts = pick(docs, id_col, text_col).toDF("id", "text").withColumn("key", F.xxhash64("text"))
    own_text = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    if by_text.count() <= SENT_KEYS:
        texts = texts.join(F.broadcast(by_text.select("_id", "_key")), own_text, "left_semi")
    worded = texts.join(by_text, own_text).select("id", "key", "p", words_of(F.col("text")).alias("w"))
    same = F.filter("p", lambda x: F.array_join(F.slice("w", x["start"] + 1, x["size"]), " ") == x["window"])
    held = worded.select("id", "key", F.explode(same).alias("x")).select("id", "key", "x.window", "x.size", "x.start")
    return written(held, "occurrences"), send


def marked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_hit, items (sorted ids, as text, of items with a window that occurs) and contaminated, by row.

    Null and empty texts have no words and hit nothing; items without words have no windows; items without an id count
    for hits, not in ``items``. Rows that repeat both id and text get equal results each; null ids are rows like others.
    Empty documents: empty result; empty benchmark: no hit. Other columns are ignored.
    """
    windows = written(item_windows(benchmark, item_col, item_text, window), "windows")
    held, send = occurrences(docs, windows, id_col, text_col)
    split = _split(docs, id_col, text_col)

    hit = held.select("id", "key", "size", "start").distinct().select("id", "key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("word")).distinct()
    n_hit = hit.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n_hit"))
    owners = windows.select("window", F.col("item").cast("string").alias("item")).distinct()
    items = held.select("id", "key", "window").distinct().join(send(owners), "window").groupBy("id", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = n_hit.join(items, n_hit["id"].eqNullSafe(items["id"]) & (n_hit["key"] == items["key"])).select(n_hit["id"].alias("_id"), n_hit["key"].alias("_key"), "n_hit", "items")
    counted = split.select("id", "key", F.col("n").cast("long").alias("n_words"))
    joined = counted.join(found, counted["id"].eqNullSafe(F.col("_id")) & (counted["key"] == F.col("_key")), "left")
    return joined.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def cleaned(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs."""
    windows = written(item_windows(benchmark, item_col, item_text, window), "windows")
    held, _ = occurrences(docs, windows, id_col, text_col)
    return without(docs, id_col, text_col, held)


def op6_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), items AS (SELECT item_id, w, least(len(w), 10) AS size FROM b WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM items)
), places AS (
  SELECT doc_id, i, s.size, array_to_string(w[i : i + s.size - 1], ' ') AS win
  FROM (SELECT d.doc_id, d.w, s.size, unnest(range(1, len(d.w) - s.size + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM items) s) s
), occ AS (SELECT p.doc_id, p.i, p.size, w.item_id FROM places p JOIN wins w ON p.win = w.win AND p.size = w.size),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
