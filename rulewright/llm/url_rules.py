"""URL filters by a sort-merge range join of reversed-host keys.

A host's key is its labels in reverse, each ended by a dot (``www.example.com`` -> ``com.example.www.``): a rule's host
and all its subdomains are then one interval of keys, those that begin with the rule's key. Pages and rules are cut by
the same key ranges, each range is sorted once, and one sweep over it keeps the rules whose interval is open on a
stack. A rule whose interval spans several ranges is dealt to each of them.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, shuffle_partitions, table

#: (host, path, verdict): fits the host and its subdomains where the path begins with the rule's.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the key sample from which range limits come; it sets limits only, every row is dealt by them.
LIMIT_SAMPLE = 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path of a url; both empty for null or where no :// stands."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a table of host, path, verdict and the rule's text (host and path)."""
    df = spark.createDataFrame(rules, "host string, path string, verdict string")
    return df.withColumn("rule", F.concat("host", "path"))


class _Sweep:
    """Rows of sorted ranges; a stack of (key, rules) holds the open intervals, the innermost last."""

    def __init__(self, default: str):
        self.default, self.part, self.stack, self.run, self.last, self.fit = default, None, [], None, None, []

    def row(self, part, key, path, is_rule, rule, verdict):
        if part != self.part:
            self.part, self.stack, self.run = part, [], None
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
            self.run = None
        if is_rule:
            if not self.stack or self.stack[-1][0] != key:
                self.stack.append((key, []))
            self.stack[-1][1].append((path, rule, verdict))
            self.run = None
            return None
        if not key:
            return None, self.default
        if self.run != key:  # paths of all open rules, in order, for this host's run of pages
            self.run, self.last = key, None
            self.open = sorted((p, r, v) for _, rules in self.stack for p, r, v in rules)
            self.at, self.fit = 0, []
        if self.last is not None and path < self.last:
            self.at, self.fit = 0, []
        self.last = path
        while self.at < len(self.open) and self.open[self.at][0] <= path:
            self._close(self.open[self.at][0])
            self.fit.append(self.open[self.at])
            self.at += 1
        self._close(path)
        if not self.fit:
            return None, self.default
        p, rule, verdict = max(self.fit, key=lambda x: (len(x[1]), len(x[1]) - len(x[0]), x[1], x[2]))
        return rule, verdict

    def _close(self, path: str) -> None:
        while self.fit and not path.startswith(self.fit[-1][0]):
            self.fit.pop()


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """A row for each page: id, host, path, rule (null where none fits) and verdict (the rule's, else ``default``).

    The rule with the longest text wins, at equal length the one with the longer host, then the greater text; rules
    with equal text and both verdicts: block. Null urls and such without :// have an empty host and path and fit no
    rule; null ids are kept; repeated rows give repeated results; no rules: all get the default; other columns are
    ignored. Rules with a null or empty host fit nothing; a null path is empty, a null verdict is the default.
    """
    spark = pages.sparkSession
    url = pick(pages, id_col, url_col).toDF("id", "url")
    host, path = host_and_path(F.col("url"))
    keyed = url.select("id", host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    rule = pick(rules, "host", "path", "verdict").where("host <> ''").select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
    rule = rule.withColumn("key", host_key(F.col("host"))).withColumn("rule", F.concat("host", "path"))

    parts = 4 * shuffle_partitions(spark)
    salted = keyed.withColumn("salt", F.xxhash64("id", "path"))
    share = int(min(1.0, LIMIT_SAMPLE / max(1, url.count())) * (1 << 30))
    sample = salted.where(F.pmod(F.xxhash64("salt", "key"), F.lit(1 << 30)) < share).limit(2 * LIMIT_SAMPLE).select("key", "path", "salt")
    limits = sorted((r.key, r.path, r.salt) for r in sample.collect())
    limits = sorted({limits[len(limits) * i // parts] for i in range(1, parts)}) if limits else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, path, salt = (b.column(i).to_pylist() for i in (3, 2, 4))
            part = [bisect.bisect_right(limits, x) for x in zip(key, path, salt)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(part, pa.int32())], ["id", "host", "path", "key", "part"])

    id_type = keyed.schema["id"].dataType.simpleString()
    page_rows = salted.select("id", "host", "path", "key", "salt").mapInArrow(deal, f"id {id_type}, host string, path string, key string, part int")
    firsts = [x[0] for x in limits]

    @F.udf("array<int>")
    def spanned(key: str) -> list[int]:
        """Ranges that hold keys which begin with this one."""
        lo = bisect.bisect_left(firsts, key)
        hi = bisect.bisect_right(firsts, key + "\U0010ffff")
        return list(range(lo, hi + 1))

    rule_rows = rule.select(F.lit(None).cast(id_type).alias("id"), "host", "path", "key", F.explode(spanned("key")).alias("part"), F.lit(0).alias("kind"), "rule", "verdict")
    both = page_rows.select("*", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).unionByName(rule_rows)
    dealt = both.repartition(parts, "part").sortWithinPartitions("part", "key", "kind", "path", "rule", "verdict")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Sweep(default)
        for b in batches:
            x = b.to_pydict()
            found = [state.row(*r) for r in zip(x["part"], x["key"], x["path"], [k == 0 for k in x["kind"]], x["rule"], x["verdict"])]
            keep = [i for i, f in enumerate(found) if f is not None]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(at) for i in range(3)), pa.array([found[i][0] for i in keep], pa.string()), pa.array([found[i][1] for i in keep], pa.string())],
                [id_col, "host", "path", "rule", "verdict"],
            )

    return dealt.select("id", "host", "path", "key", "part", "kind", "rule", "verdict").mapInArrow(sweep, f"{id_col} {id_type}, host string, path string, rule string, verdict string")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


OP2_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT s.page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS v
  FROM split s JOIN rules ON (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)
  GROUP BY s.page_id
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.v, 'allow') AS verdict FROM split s LEFT JOIN fits f USING (page_id)
"""
