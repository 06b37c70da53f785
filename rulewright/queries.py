"""Queries over the driver's tables, one or more for each operator, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.columns import fires, neighbour, values, with_word_lists
from .operators import brackets, convert, evaluate, export, hypernyms, lexicon, tagger, tree
from .operators.apply import apply_rules, error_curve
from .operators.learn import Limits, collapsed, learn, order, pruned, scored
from .operators.wide import wide
from .plans.spec import Rule, TaskSchema, Templates, parse_atom
from .shared import dropped, written
from .streaming import apply as streaming

EVENTS = TaskSchema.parse("kind state => truth")
LINES = TaskSchema.parse("status qty disc state => truth")
TOKENS = TaskSchema.parse("word state => truth")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- samples from the driver's tables ---------------------------------------------------------------------------------


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in order: kind is the event's type, truth the next one's (end for the last), state a guess: click."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("seq"), (F.row_number().over(by) - 1).alias("pos"), F.col("event_type").alias("kind"), F.lit("click").alias("state"),
        F.coalesce(F.lead("event_type").over(by), F.lit("end")).alias("truth"),
    )


EVENT_SQL = """samples AS (
  SELECT user_id AS seq, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, event_type AS kind, 'click' AS state, coalesce(lead(event_type) OVER w, 'end') AS truth
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as independent samples: status, ten buckets of quantity, discount in percent; truth the return flag."""
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("status"), F.floor(F.col("l_quantity").cast("double") / 10).cast("int").cast("string").alias("qty"),
        F.round(F.col("l_discount").cast("double") * 100).cast("int").cast("string").alias("disc"), F.lit("N").alias("state"), F.col("l_returnflag").alias("truth"),
    )


LINE_SQL = """samples AS (
  SELECT l_linestatus AS status, CAST(CAST(floor(CAST(l_quantity AS DOUBLE) / 10) AS INTEGER) AS VARCHAR) AS qty,
         CAST(CAST(round(CAST(l_discount AS DOUBLE) * 100) AS INTEGER) AS VARCHAR) AS disc, 'N' AS state, l_returnflag AS truth
  FROM lineitem
), collapsed AS (SELECT status, qty, disc, state, truth, CAST(count(*) AS BIGINT) AS cost FROM samples GROUP BY ALL)"""


def token_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in order; truth is the document's language."""
    return token_arrays(spark, sf_dir).select("seq", F.posexplode("words").alias("pos", "word"), "truth")


def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a document's words in one row."""
    words = F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "")
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), words.alias("words"), F.col("lang").alias("truth"))


TOKEN_SQL = r"""tokens AS (
  SELECT doc_id AS seq, CAST(i - 1 AS INTEGER) AS pos, w[i] AS word, lang AS truth
  FROM (SELECT doc_id, lang, w, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents))
)"""


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of the texts of benchmark items."""
    words = F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "")
    return _table(spark, sf_dir, "benchmark").select(F.explode(words).alias("word")).distinct()


PART_SQL = r"""words AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '')) AS word FROM benchmark)"""

# -- atoms ------------------------------------------------------------------------------------------------------------


def ctx_identity(spark, sf_dir):
    s = event_samples(spark, sf_dir)
    return s.select("seq", "pos", neighbour("kind", -1).alias("before"), neighbour("kind", 2).alias("after2"))


def ctx_range(spark, sf_dir):
    s = event_samples(spark, sf_dir)
    return s.select("seq", "pos", F.coalesce(fires(parse_atom("kind:[-3,-1]"), F.lit("purchase")), F.lit(False)).alias("fires"), F.array_join(F.array_sort(values(parse_atom("kind:[1,2]"))), ",").alias("vals"))


def set_feature(spark, sf_dir):
    s = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("a"), F.col("p_type").alias("b"), F.col("p_name").alias("c"))
    return s.select("p_partkey", fires(parse_atom("{a,b,c}"), F.lit("Brand#13")).alias("fires"), F.array_join(F.array_sort(values(parse_atom("{a,b,c}"), ("Brand#11",))), "|").alias("vals"))


def affixes(spark, sf_dir):
    w = part_words(spark, sf_dir)
    atoms = {n: parse_atom(t) for n, t in {"pre": "word::2~~", "suf": "word::~~3"}.items()}
    first = {n: F.coalesce(F.get(values(a), F.lit(0)), F.lit("")) for n, a in atoms.items()}
    return w.select("word", *[c.alias(n) for n, c in first.items()], fires(atoms["pre"], F.lit("th")).alias("is_th"), fires(atoms["suf"], F.lit("ing")).alias("is_ing"))


def contains(spark, sf_dir):
    return part_words(spark, sf_dir).select("word", F.array_join(F.array_sort(values(parse_atom("word::2<>"))), ",").alias("grams"), fires(parse_atom("word::2<>"), F.lit("er")).alias("has_er"))


def affix_words(spark, sf_dir):
    w = part_words(spark, sf_dir)
    atoms = [parse_atom(f"word::{x}") for x in ("2++", "++2", "2--", "--2")]
    s = with_word_lists(w, atoms, w)
    return s.select("word", *[F.array_join(F.array_sort(values(a)), ",").alias(a.kind) for a in atoms])


AFFIX_SQL = f"""WITH {PART_SQL}
SELECT a.word,
  coalesce((SELECT string_agg(DISTINCT left(b.word, 2), ',' ORDER BY left(b.word, 2)) FROM words b WHERE length(b.word) > 2 AND substr(b.word, 3) = a.word), '') AS add_prefix,
  coalesce((SELECT string_agg(DISTINCT right(b.word, 2), ',' ORDER BY right(b.word, 2)) FROM words b WHERE length(b.word) > 2 AND left(b.word, length(b.word) - 2) = a.word), '') AS add_suffix,
  CASE WHEN length(a.word) > 2 AND EXISTS (SELECT 1 FROM words b WHERE b.word = substr(a.word, 3)) THEN left(a.word, 2) ELSE '' END AS drop_prefix,
  CASE WHEN length(a.word) > 2 AND EXISTS (SELECT 1 FROM words b WHERE b.word = left(a.word, length(a.word) - 2)) THEN right(a.word, 2) ELSE '' END AS drop_suffix
FROM words a"""


def cooccurrence(spark, sf_dir):
    s = event_samples(spark, sf_dir)
    pairs = written(lexicon.bigrams(s, "kind"), "pairs")
    a, b = parse_atom("kind^^1"), parse_atom("kind^^-1")
    kinds = s.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))  # both lists depend on the kind alone
    kinds = with_word_lists(kinds, [a, b], None, pairs.where("n >= 3"))
    return kinds.select("kind", F.array_join(values(a), ",").alias("after"), F.array_join(values(b), ",").alias("before"), F.when(fires(a, F.lit("purchase")), F.col("n")).otherwise(0).alias("then_purchase"))


COOC_SQL = f"""WITH {EVENT_SQL}, pairs AS (
  SELECT l, r FROM (SELECT kind AS l, lead(kind) OVER (PARTITION BY seq ORDER BY pos) AS r FROM samples) WHERE r IS NOT NULL GROUP BY l, r HAVING count(*) >= 3)
SELECT kind, coalesce((SELECT string_agg(r, ',' ORDER BY r) FROM pairs WHERE l = kind), '') AS after, coalesce((SELECT string_agg(l, ',' ORDER BY l) FROM pairs WHERE r = kind), '') AS before,
  CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM pairs WHERE l = kind AND r = 'purchase')) AS BIGINT) AS then_purchase FROM samples GROUP BY kind"""


def wide_rows(spark, sf_dir):
    """Events with the types of two events before and after in columns of their own, as rows for independent learning."""
    return wide(event_samples(spark, sf_dir), ["kind"], 2).select("seq", "pos", *[f"kind{i}c" for i in range(5)])


WIDE_SQL = f"WITH {EVENT_SQL} SELECT seq, pos, " + ", ".join(f"coalesce({'lag' if i < 2 else 'lead'}(kind, {abs(i - 2)}) OVER (PARTITION BY seq ORDER BY pos), '-') AS kind{i}c" for i in range(5)) + " FROM samples"


def multi_truth(spark, sf_dir):
    """labels as several accepted values: quality or toxic."""
    schema = TaskSchema.parse("source state => truth", "|")
    from .functions.columns import is_right, truths

    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    d = d.select("doc_id", "source", F.when(F.col("n_chars") > 1000, "1").otherwise("0").alias("state"), F.concat_ws("|", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("truth"))
    return d.select("doc_id", is_right(schema, F.col("state"), "truth").alias("is_right"), F.size(F.array_distinct(truths(schema, "truth"))).alias("n_truths"))


# -- rules ------------------------------------------------------------------------------------------------------------

EVENT_RULES = [
    "RULE: kind_0=view => state=view",
    "RULE: state_-1=view kind_0=click => state=purchase",
    "RULE: state_-1=purchase => state=view",
    "RULE: state:[-2,-1]=ZZZ => state=login",
    "RULE: kind:[1,2]=purchase state_0=click => state=purchase",
]


def _event_rules() -> list[Rule]:
    return [Rule.parse(x) for x in EVENT_RULES]


def _lag(col: str, k: int) -> str:
    f = f"lag({col}, {-k})" if k < 0 else f"lead({col}, {k})"
    return f"coalesce({f} OVER (PARTITION BY seq ORDER BY pos), 'ZZZ')" if k else col


def _rule_sql(rules: list[Rule], source: str, allowed: str = "") -> str:
    """A query for each rule on the one before it; ``f_i`` says where rule i fired."""
    steps, before = [], source
    for i, r in enumerate(rules):
        tests = []
        for a, v in zip(r.atoms, r.values):
            span = range(a.offset, (a.last if a.kind == "range" else a.offset) + 1)
            tests.append("(" + " OR ".join(f"{_lag(c, k)} = '{v}'" for c in a.columns for k in span) + ")")
        cond = " AND ".join([*tests, f"state <> '{r.results[0]}'"])
        if allowed:
            cond += f" AND ({allowed} IS NULL OR list_contains({allowed}, '{r.results[0]}'))"
        steps.append(f"s{i} AS (SELECT * REPLACE (CASE WHEN fire THEN '{r.results[0]}' ELSE state END AS state) RENAME (fire AS f_{i}) FROM (SELECT *, {cond} AS fire FROM {before}))")
        before = f"s{i}"
    return ", ".join(steps)


def apply_one_rule(spark, sf_dir):
    return apply_rules(event_samples(spark, sf_dir), _event_rules()[:1], EVENTS).select("seq", "pos", "state")


def apply_rule_list(spark, sf_dir):
    return apply_rules(event_samples(spark, sf_dir), _event_rules(), EVENTS).select("seq", "pos", "state")


def apply_long_list(spark, sf_dir):
    """The same list over whole sequences in tasks, as long lists run."""
    return apply_rules(event_samples(spark, sf_dir), _event_rules(), EVENTS, planned=0).select("seq", "pos", "state")


def apply_nested(spark, sf_dir):
    rows = streaming.nested(event_samples(spark, sf_dir), EVENTS)
    return streaming.flat(streaming.apply_nested(rows, _event_rules(), EVENTS), EVENTS).select("seq", "pos", "state")


def rule_trace(spark, sf_dir):
    got = apply_rules(event_samples(spark, sf_dir), _event_rules(), EVENTS, trace=True)
    return got.select("seq", "pos", F.concat_ws(",", F.transform("trace", lambda x: x.cast("string"))).alias("trace"))


def errors_by_rule(spark, sf_dir):
    return error_curve(event_samples(spark, sf_dir), _event_rules(), EVENTS)


def constraint_filter(spark, sf_dir):
    """Classes that a kind may get: those that follow it in at least a fifth of its events."""
    s = event_samples(spark, sf_dir)
    often = s.groupBy("kind", "truth").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("kind"))).where("5 * n >= all")
    allowed = lexicon.build(s.join(often.select("kind", "truth"), ["kind", "truth"], "left_semi"), ["kind"], "truth").select(F.col("key")[0].alias("kind"), F.col("classes").alias("allowed"))
    return apply_rules(s, _event_rules(), EVENTS, constraints=[(("kind",), "truth", allowed)]).select("seq", "pos", "state")


CONSTRAINT_SQL = f"""WITH {EVENT_SQL}, classes AS (SELECT kind, list(truth) AS allowed FROM (SELECT kind, truth, count(*) AS n, sum(count(*)) OVER (PARTITION BY kind) AS total FROM samples GROUP BY kind, truth) WHERE 5 * n >= total GROUP BY kind),
start AS (SELECT s.*, c.allowed FROM samples s LEFT JOIN classes c USING (kind)), {_rule_sql([Rule.parse(x) for x in EVENT_RULES], "start", "allowed")} SELECT seq, pos, state FROM s4"""

def fake_class_trace(spark, sf_dir):
    """A rule whose class changes nothing is traced where it fires; the rule after it sees the states as they were."""
    rules = [Rule.parse("RULE: kind_0=click => state=FAKE_CLASS"), Rule.parse("RULE: kind_0=view => state=view")]
    got = apply_rules(event_samples(spark, sf_dir), rules, EVENTS, trace=True)
    return got.select("seq", "pos", "state", F.concat_ws(",", F.transform("trace", lambda x: x.cast("string"))).alias("trace"))


FAKE_SQL = f"WITH {EVENT_SQL} SELECT seq, pos, CASE WHEN kind = 'view' THEN 'view' ELSE state END AS state, CASE kind WHEN 'click' THEN '0' WHEN 'view' THEN '1' ELSE '' END AS trace FROM samples"

# -- learning ---------------------------------------------------------------------------------------------------------

EVENT_TEMPLATES = "kind_-1 state_0 => state\nkind_0 => state\nkind_0 kind_-1 => state"
LINE_TEMPLATES = "status state => state\nqty state => state\nstatus disc => state"
LINE_ATOMS = [["status", "state"], ["qty", "state"], ["status", "disc"]]


def _templates(text: str, schema: TaskSchema) -> Templates:
    return Templates.parse(text, schema)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("template", F.concat_ws("|", "tokens").alias("tokens"), F.concat_ws("|", "results").alias("results"), "good", "bad", "score")


def score_rules_seq(spark, sf_dir):
    return _shown(scored(event_samples(spark, sf_dir), _templates(EVENT_TEMPLATES, EVENTS)))


def _score_sql(groups: list[list[str]], source: str, cost: str) -> str:
    good = " UNION ALL ".join(f"SELECT {i} AS template, {' || chr(124) || '.join(g)} AS tokens, truth AS results, sum({cost}) AS good FROM {source} WHERE state <> truth GROUP BY ALL" for i, g in enumerate(groups))
    right = " UNION ALL ".join(f"SELECT {i} AS template, {' || chr(124) || '.join(g)} AS tokens, truth, sum({cost}) AS n FROM {source} WHERE state = truth GROUP BY ALL" for i, g in enumerate(groups))
    return f"""good AS ({good}), rights AS ({right}), scores AS (
  SELECT CAST(template AS INTEGER) AS template, tokens, results, CAST(good AS BIGINT) AS good, CAST(coalesce((SELECT sum(n) FROM rights r WHERE r.template = g.template AND r.tokens = g.tokens AND r.truth <> g.results), 0) AS BIGINT) AS bad FROM good g)"""


SEQ_SCORE_SQL = f"""WITH {EVENT_SQL}, around AS (SELECT *, {_lag("kind", -1)} AS k1 FROM samples), {_score_sql([["k1", "state"], ["kind"], ["kind", "k1"]], "around", "1")}
SELECT *, good - bad AS score FROM scores"""


def collapse_samples(spark, sf_dir):
    return collapsed(line_samples(spark, sf_dir), LINES)


def score_rules_indep(spark, sf_dir):
    return _shown(scored(collapsed(line_samples(spark, sf_dir), LINES), _templates(LINE_TEMPLATES, LINES)))


def best_rule(spark, sf_dir):
    s = collapsed(line_samples(spark, sf_dir), LINES)
    return _shown(scored(s, _templates(LINE_TEMPLATES, LINES)).orderBy(*order()).limit(1))


def prune_rules(spark, sf_dir):
    return _shown(pruned(scored(collapsed(line_samples(spark, sf_dir), LINES), _templates(LINE_TEMPLATES, LINES)), least_good=20, useless=5, factor=1.05))


SIZES = TaskSchema.parse("source size state => truth")


def semi_good_rules(spark, sf_dir):
    """What learning adds beside the learned rules: those that would put nothing right now wrong and give two documents or more
    their language, from source and length; all are taken for English at first."""
    rules, _ = learn(_size_samples(spark, sf_dir), _templates("source size => state", SIZES), Limits(threshold=0, redundant="2"))
    rows = [(0, "|".join(r.values), r.results[0], r.good, r.bad, r.score) for r in rules if not r.good]
    return spark.createDataFrame(rows, "template int, tokens string, results string, good long, bad long, score long")


def _size_samples(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.lit(0).alias("pos"), "source", F.floor(F.col("n_chars") / 200).cast("string").alias("size"), F.lit("en").alias("state"), F.col("lang").alias("truth"))


# A cell's documents share all that rules look at. Its first rule gives it the language with the most documents, if these are more than
# the English ones; no rule after that one gains anything there. Bad rows are those of the cell's state at the end, for any other
# language; candidates are the languages that had a wrong document at the start or, in changed cells, at the end.
SEMI_SQL = """WITH s AS (SELECT source, CAST(CAST(floor(n_chars / 200) AS BIGINT) AS VARCHAR) AS size, lang FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL),
c AS (SELECT source, size, lang, count(*) AS n, coalesce(sum(count(*)) FILTER (WHERE lang = 'en') OVER (PARTITION BY source, size), 0) AS en FROM s GROUP BY source, size, lang),
f AS (SELECT source, size, lang AS state FROM c WHERE lang <> 'en' AND n - en > 0 QUALIFY row_number() OVER (PARTITION BY source, size ORDER BY n DESC, lang DESC) = 1),
e AS (SELECT c.*, coalesce(f.state, 'en') AS state, f.state IS NOT NULL AS changed FROM c LEFT JOIN f USING (source, size)),
b AS (SELECT *, coalesce(sum(n) FILTER (WHERE lang = state) OVER (PARTITION BY source, size), 0) AS settled FROM e)
SELECT CAST(0 AS INTEGER) AS template, source || '|' || size AS tokens, lang AS results, CAST(0 AS BIGINT) AS good, CAST(0 AS BIGINT) AS bad, CAST(n AS BIGINT) AS score
FROM b WHERE n >= 2 AND (lang <> 'en' OR changed) AND (CASE WHEN lang = state THEN 0 ELSE settled END) = 0"""


#: learn_rules stops where no rule puts more than one in so many tokens right.
SPELLING_SHARE = 200


ORDERS = TaskSchema.parse("priority month status level => tstatus tlevel")


def two_targets(spark, sf_dir):
    """Scores of rules that set two states at once: an order's status and whether it is urgent, from its priority."""
    o = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.lit(0).alias("pos"), F.substring("o_orderpriority", 1, 1).alias("priority"), F.month("o_orderdate").cast("string").alias("month"),
        F.lit("O").alias("status"), F.lit("low").alias("level"), F.col("o_orderstatus").alias("tstatus"), F.when(F.substring("o_orderpriority", 1, 1) < "3", "high").otherwise("low").alias("tlevel"),
    )
    return _shown(scored(o, _templates("priority => status level\nmonth => status level", ORDERS)))


TWO_SQL = """WITH s AS (SELECT substr(o_orderpriority, 1, 1) AS priority, CAST(month(o_orderdate) AS VARCHAR) AS month, o_orderstatus AS t1, CASE WHEN substr(o_orderpriority, 1, 1) < '3' THEN 'high' ELSE 'low' END AS t2 FROM orders),
i AS (SELECT 0 AS template, priority AS tokens, t1, t2, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 1, month, t1, t2, count(*) FROM s GROUP BY ALL),
c AS (SELECT DISTINCT template, tokens, t1 AS r1, t2 AS r2 FROM i WHERE t1 <> 'O' OR t2 <> 'low'),
j AS (SELECT c.template, c.tokens, r1 || '|' || r2 AS results,
  sum(n * ((t1 <> 'O' AND r1 = t1)::INT + (t2 <> 'low' AND r2 = t2)::INT)) AS good, sum(n * ((t1 = 'O' AND r1 <> t1)::INT + (t2 = 'low' AND r2 <> t2)::INT)) AS bad FROM c JOIN i USING (template, tokens) GROUP BY ALL)
SELECT CAST(template AS INTEGER) AS template, tokens, results, CAST(good AS BIGINT) AS good, CAST(bad AS BIGINT) AS bad, CAST(good - bad AS BIGINT) AS score FROM j WHERE good > 0"""


def learn_rules(spark, sf_dir):
    """The flagship: words' languages from their spelling, learned on all documents until no rule gains more than a two-hundredth
    of all tokens; counts of each rule."""
    words = written(_spelling(spark, sf_dir), "spelling")
    tokens = words.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("n")).first()["n"]
    rules, _ = learn(words, _templates("word::~~2 => state\nword::3~~ => state\nword::1<> state => state", TOKENS), Limits(threshold=max(2, tokens // SPELLING_SHARE)), samples=False)
    dropped(words)
    rows = [(i, r.text().partition("RULE: ")[2], r.good, r.bad, r.score) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule int, text string, good long, bad long, score long")


def _spelling(spark, sf_dir):
    """Distinct words of each language with their number as cost; all are taken for English at first."""
    words = token_samples(spark, sf_dir).groupBy("word", "truth").agg(F.count(F.lit(1)).alias("cost"))
    return words.select("word", F.lit("en").alias("state"), "truth", "cost")


def learn_lines(spark, sf_dir):
    """All rules learned on order lines, down to the usual threshold, and how many lines are right after them."""
    s = collapsed(line_samples(spark, sf_dir), LINES)
    rules, after = learn(s, _templates(LINE_TEMPLATES, LINES))
    right = after.agg(F.sum(F.when(F.col("state") == F.col("truth"), F.col("cost")).otherwise(0)).alias("n")).first()["n"]
    rows = [(i, "|".join(r.values), r.results[0], r.good, r.bad) for i, r in enumerate(rules)]
    return spark.createDataFrame([(*r, right) for r in rows], "rule int, tokens string, result string, good long, bad long, after_all long")


def _learn_sql(turns: int) -> str:
    """A greedy turn after another; those after the last rule find none. Order lines have fewer rules than turns."""
    parts, source = [LINE_SQL], "collapsed"
    case = "CASE b.template WHEN 0 THEN s.status || '|' || s.state WHEN 1 THEN s.qty || '|' || s.state ELSE s.status || '|' || s.disc END"
    for i in range(turns):
        inner = _score_sql(LINE_ATOMS, source, "cost")
        for n in ("good", "rights", "scores"):
            inner = inner.replace(f"{n} AS (", f"{n}_{i} AS MATERIALIZED (").replace(f"FROM {n} ", f"FROM {n}_{i} ")
        parts.append(inner)
        parts.append(f"best_{i} AS MATERIALIZED (SELECT * FROM scores_{i} WHERE good - bad > 2 ORDER BY good - bad DESC, results DESC, template, string_split(tokens, '|') DESC LIMIT 1)")
        parts.append(f"after_{i} AS MATERIALIZED (SELECT s.* REPLACE (CASE WHEN b.template IS NOT NULL AND {case} = b.tokens THEN b.results ELSE s.state END AS state) FROM {source} s LEFT JOIN best_{i} b ON true)")
        source = f"after_{i}"
    rows = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS rule, tokens, results AS result, good, bad FROM best_{i}" for i in range(turns))
    return f"WITH {', '.join(parts)} SELECT *, (SELECT CAST(sum(cost) FILTER (WHERE state = truth) AS BIGINT) FROM {source}) AS after_all FROM ({rows})"


# -- lexicons ---------------------------------------------------------------------------------------------------------


def lexicon_word_lang(spark, sf_dir):
    return lexicon.build(token_samples(spark, sf_dir), ["word"], "truth").select(F.col("key")[0].alias("word"), F.concat_ws(",", "classes").alias("classes"), "n")


LEX_SQL = f"""WITH {TOKEN_SQL}, c AS (SELECT word, truth, count(*) AS n FROM tokens GROUP BY ALL)
SELECT word, string_agg(truth, ',' ORDER BY n DESC, truth) AS classes, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY word"""


def lexicon_min_count(spark, sf_dir):
    return lexicon.build(token_samples(spark, sf_dir), ["word"], "truth", least=5).select(F.col("key")[0].alias("word"), F.concat_ws(",", "classes").alias("classes"), "n")


def lexicon_backoff(spark, sf_dir):
    got = lexicon.build(event_samples(spark, sf_dir), ["kind", ("kind", -1)], "truth")
    return got.select("length", F.concat_ws("|", "key").alias("key"), F.concat_ws(",", "classes").alias("classes"), "n")


BACKOFF_SQL = f"""WITH {EVENT_SQL}, k AS (SELECT kind, {_lag("kind", -1)} AS k1, truth FROM samples),
one AS (SELECT kind, truth, count(*) AS n FROM k GROUP BY ALL), two AS (SELECT kind, k1, truth, count(*) AS n FROM k GROUP BY ALL)
SELECT CAST(1 AS INTEGER) AS length, kind AS key, string_agg(truth, ',' ORDER BY n DESC, truth) AS classes, CAST(sum(n) AS BIGINT) AS n FROM one GROUP BY kind
UNION ALL SELECT CAST(2 AS INTEGER), two.kind || '|' || k1, string_agg(truth, ',' ORDER BY two.n DESC, one.n DESC, truth), CAST(sum(two.n) AS BIGINT) FROM two JOIN one USING (kind, truth) GROUP BY two.kind, k1"""


def most_likely_tag(spark, sf_dir):
    """Languages of all words by the lexicon of those that a language has at least twice; others: de if capital, else en. By truth."""
    s = token_samples(spark, sf_dir)
    lex = lexicon.build(s, ["word"], "truth", least=2)
    got = lexicon.most_likely(s, lex, [["word"]], "state", "en", "de")
    return got.groupBy("truth", "state").agg(F.count(F.lit(1)).alias("n"))


LIKELY_SQL = f"""WITH {TOKEN_SQL}, c AS (SELECT word, truth, count(*) AS n FROM tokens GROUP BY ALL HAVING count(*) >= 2),
best AS (SELECT word, truth AS cls FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, truth) = 1)
SELECT truth, coalesce(cls, CASE WHEN regexp_matches(t.word, '^[A-Z]') THEN 'de' ELSE 'en' END) AS state, count(*) AS n FROM tokens t LEFT JOIN best USING (word) GROUP BY ALL"""


def seen_unseen_split(spark, sf_dir):
    s = token_samples(spark, sf_dir)
    one, two = lexicon.split_parts(s, F.col("seq") % 10 < 4)
    new = lexicon.unseen(one, two, "word")
    return lexicon.lexical_rows(two, new, "word").groupBy("truth").agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("word").alias("words"))


UNSEEN_SQL = f"""WITH {TOKEN_SQL} SELECT truth, count(*) AS tokens, count(DISTINCT word) AS words FROM tokens WHERE seq % 10 >= 4 AND word NOT IN (SELECT word FROM tokens WHERE seq % 10 < 4) GROUP BY truth"""


def bigrams_frequent(spark, sf_dir):
    """Bigrams of all documents that hold a word of at least 400 occurrences."""
    s = token_samples(spark, sf_dir)
    often = s.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 400").select("word")
    return lexicon.bigrams_with(token_arrays(spark, sf_dir), "words", often)


BIGRAM_SQL = f"""WITH {TOKEN_SQL}, often AS (SELECT word FROM tokens GROUP BY word HAVING count(*) >= 400),
pairs AS (SELECT l AS "left", r AS "right", count(*) AS n FROM (SELECT word AS l, lead(word) OVER (PARTITION BY seq ORDER BY pos) AS r FROM tokens) WHERE r IS NOT NULL GROUP BY ALL)
SELECT * FROM pairs WHERE "left" IN (SELECT word FROM often) OR "right" IN (SELECT word FROM often)"""


def unseen_bigrams(spark, sf_dir):
    """Bigrams of words that the documents of the first part of a split lack, over all documents."""
    s = token_samples(spark, sf_dir)
    one, two = lexicon.split_parts(s, F.col("seq") % 10 < 4)
    seen = written(one.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "seen")
    pairs = lexicon.bigrams_with(token_arrays(spark, sf_dir), "words", lexicon.unseen(seen, two, "word"), lexicon.frequent_words(seen))
    return pairs.groupBy("n").agg(F.count(F.lit(1)).alias("pairs"))


UNSEEN_BIGRAM_SQL = f"""WITH {TOKEN_SQL}, new AS (SELECT DISTINCT word FROM tokens WHERE seq % 10 >= 4 AND word NOT IN (SELECT word FROM tokens WHERE seq % 10 < 4)),
pairs AS (SELECT l, r, count(*) AS n FROM (SELECT word AS l, lead(word) OVER (PARTITION BY seq ORDER BY pos) AS r FROM tokens) WHERE r IS NOT NULL GROUP BY ALL)
SELECT n, count(*) AS pairs FROM pairs WHERE l IN (SELECT word FROM new) OR r IN (SELECT word FROM new) GROUP BY n"""


def merged_lexicons(spark, sf_dir):
    """Classes of words by the lexicon of documents, but for words that benchmark texts have: theirs is bench alone."""
    own = lexicon.build(token_samples(spark, sf_dir), ["word"], "truth")
    other = lexicon.build(part_words(spark, sf_dir).withColumn("truth", F.lit("bench")), ["word"], "truth")
    return lexicon.merged(own, other).select(F.col("key")[0].alias("word"), F.concat_ws(",", "classes").alias("classes"))


MERGED_SQL = f"""WITH {TOKEN_SQL}, {PART_SQL}, c AS (SELECT word, truth, count(*) AS n FROM tokens GROUP BY ALL),
own AS (SELECT word, string_agg(truth, ',' ORDER BY n DESC, truth) AS classes FROM c GROUP BY word)
SELECT word, CASE WHEN b.word IS NULL THEN classes ELSE 'bench' END AS classes FROM own FULL JOIN words b USING (word)"""


def vocabulary_words(spark, sf_dir):
    return lexicon.numbered(lexicon.vocabulary(event_samples(spark, sf_dir), ["kind", "state"], ["truth"])).select("word", "n", "is_class", F.col("id").cast("int").alias("id"))


VOCAB_SQL = f"""WITH {EVENT_SQL}, w AS (SELECT kind AS word, false AS c FROM samples UNION ALL SELECT state, false FROM samples UNION ALL SELECT truth, true FROM samples),
v AS (SELECT word, count(*) AS n, bool_or(c) AS is_class FROM w GROUP BY word) SELECT word, n, is_class, CAST(row_number() OVER (ORDER BY is_class DESC, word) - 1 AS INTEGER) AS id FROM v"""

# -- evaluation -------------------------------------------------------------------------------------------------------


def accuracy(spark, sf_dir):
    got = apply_rules(event_samples(spark, sf_dir), _event_rules(), EVENTS)
    return evaluate.accuracy(got, EVENTS).select("state", "total", "correct")


def _chunks(spark, sf_dir):
    """Events as labels: view B or I by turns of value, purchase outside; the guess leaves out events without a value."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    label = F.when(F.col("event_type").isin("purchase", "refund"), "O").when(F.col("event_id") % 3 == 0, "B-X").otherwise("I-X")
    guess = F.when(F.col("event_id") % 11 == 0, "O").otherwise(label)
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), (F.row_number().over(by) - 1).alias("pos"), label.alias("truth"), guess.alias("guess"))


def phrase_f(spark, sf_dir):
    return evaluate.f_measure(_chunks(spark, sf_dir), "guess", "truth").select("guessed", "expected", "correct", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f", 6).alias("f"))


def _span_sql(col: str) -> str:
    return f"""SELECT seq, min(pos) AS first, max(pos) AS last FROM (SELECT seq, pos, inside, sum(b) OVER (PARTITION BY seq ORDER BY pos) AS span FROM (
      SELECT seq, pos, {col} <> 'O' AS inside, CASE WHEN {col} <> 'O' AND (lag({col}) OVER w IS NULL OR lag({col}) OVER w = 'O' OR starts_with({col}, 'B')) THEN 1 ELSE 0 END AS b FROM chunks WINDOW w AS (PARTITION BY seq ORDER BY pos))) WHERE inside GROUP BY seq, span"""


PHRASE_SQL = f"""WITH labels_ AS (SELECT *, CASE WHEN event_type IN ('purchase', 'refund') THEN 'O' WHEN event_id % 3 = 0 THEN 'B-X' ELSE 'I-X' END AS truth FROM events),
chunks AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, truth, CASE WHEN event_id % 11 = 0 THEN 'O' ELSE truth END AS guess FROM labels_),
g AS ({_span_sql("guess")}), t AS ({_span_sql("truth")}), n AS (SELECT (SELECT count(*) FROM g) AS guessed, (SELECT count(*) FROM t) AS expected, (SELECT count(*) FROM g JOIN t USING (seq, first, last)) AS correct)
SELECT guessed, expected, correct, round(100.0 * correct / guessed, 6) AS precision, round(100.0 * correct / expected, 6) AS recall,
  round(2 * (100.0 * correct / guessed) * (100.0 * correct / expected) / (100.0 * correct / guessed + 100.0 * correct / expected), 6) AS f FROM n"""


def mark_samples(spark, sf_dir):
    got = evaluate.numbered_samples(evaluate.marked(event_samples(spark, sf_dir), EVENTS), 1)
    return got.select("seq", F.col("sample").cast("int").alias("sample"), "mark")


def rule_fires(spark, sf_dir):
    return evaluate.trace_counts(apply_rules(event_samples(spark, sf_dir), _event_rules(), EVENTS, trace=True))


FIRES_SQL = f"WITH {EVENT_SQL}, {_rule_sql([Rule.parse(x) for x in EVENT_RULES], 'samples')} " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS rule, count(*) AS n FROM s4 WHERE f_{i} HAVING count(*) > 0" for i in range(5))

# -- vectors, trees, brackets and the rest ----------------------------------------------------------------------------


def feature_vectors(spark, sf_dir):
    s = event_samples(spark, sf_dir)
    rows = export.feature_rows(s, _templates("kind_-1 => state\nkind_0 kind_1 => state", EVENTS))
    return export.vectors(s, rows, export.feature_ids(rows), "truth").select("seq", "pos", "line")


VECTOR_SQL = f"""WITH {EVENT_SQL}, around AS (SELECT *, {_lag("kind", -1)} AS p, {_lag("kind", 1)} AS q FROM samples),
f AS (SELECT seq, pos, '0 ' || p AS feature FROM around UNION ALL SELECT seq, pos, '1 ' || kind || ' ' || q FROM around),
ids AS (SELECT feature, row_number() OVER (ORDER BY feature) AS id FROM (SELECT DISTINCT feature FROM f)), cls AS (SELECT truth, row_number() OVER (ORDER BY truth) - 1 AS number FROM (SELECT DISTINCT truth FROM samples)),
l AS (SELECT seq, pos, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) AS ids FROM f JOIN ids USING (feature) GROUP BY seq, pos)
SELECT s.seq, s.pos, CAST(number AS VARCHAR) || ', ' || ids || ':' AS line FROM samples s JOIN l USING (seq, pos) JOIN cls USING (truth)"""


def feature_counts(spark, sf_dir):
    s = event_samples(spark, sf_dir)
    rows = export.feature_rows(s, _templates("kind_-1 => state\nkind_0 kind_1 => state", EVENTS))
    return export.feature_ids(rows)


def prob_tree(spark, sf_dir):
    """Leaves of a tree over rule traces and the event's type: how many samples and the most likely next type."""
    got = apply_rules(event_samples(spark, sf_dir), _event_rules(), EVENTS, trace=True)
    root = tree.grow(got, "truth", len(EVENT_RULES), ["kind"], least=10, least_feature=10, gain=0.0005, depth=2)
    out = tree.classified(got, root, 6)
    return out.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.round(F.first(F.array_max(F.map_values("probabilities"))), 6).alias("p"))


def _tree_sql(least: int, gain: float, rounds: int, classes: int) -> str:
    """Leaves as paths of 0 for yes and 1 for no, so that their order is that of their numbers. A rule that can't split a leaf adds nothing."""
    parts, at = [f"WITH {EVENT_SQL}, {_rule_sql(_event_rules(), 'samples')}, p AS (SELECT kind, truth, [{', '.join(f'f_{i}' for i in range(len(EVENT_RULES)))}] AS fired, '' AS leaf FROM s{len(EVENT_RULES) - 1})"], "p"
    for i in range(1, len(EVENT_RULES) + 1):
        parts.append(f"""r{i} AS (SELECT kind, truth, fired, leaf || CASE WHEN y >= {least} AND t - y >= {least} THEN CASE WHEN fired[{i}] THEN '0' ELSE '1' END ELSE '' END AS leaf
  FROM (SELECT *, count(*) OVER (PARTITION BY leaf) AS t, count(*) FILTER (WHERE fired[{i}]) OVER (PARTITION BY leaf) AS y FROM {at}))""")
        at = f"r{i}"
    for i in range(rounds):
        term = "sum(CASE WHEN {0} > 0 THEN {0} * log2({1} / {0}) ELSE 0 END)"
        parts.append(f"""c{i} AS (SELECT leaf, truth, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER (PARTITION BY leaf) AS t FROM {at} GROUP BY leaf, truth),
y{i} AS (SELECT leaf, kind, truth, CAST(count(*) AS DOUBLE) AS y, sum(count(*)) OVER (PARTITION BY leaf, kind) AS ty FROM {at} GROUP BY leaf, kind, truth),
k{i} AS (SELECT DISTINCT leaf, kind, CAST(ty AS DOUBLE) AS ty FROM y{i}),
x{i} AS (SELECT c.leaf, k.kind, c.n, CAST(c.t AS DOUBLE) AS t, coalesce(y.y, 0) AS y, k.ty, c.n - coalesce(y.y, 0) AS z, c.t - k.ty AS tz FROM c{i} c JOIN k{i} k USING (leaf) LEFT JOIN y{i} y ON y.leaf = c.leaf AND y.kind = k.kind AND y.truth = c.truth WHERE k.ty >= {least} AND c.t - k.ty >= {least}),
g{i} AS (SELECT leaf, kind, round(({term.format('n', 't')} - {term.format('y', 'ty')} - {term.format('z', 'tz')}) / any_value(t), 9) AS gain FROM x{i} GROUP BY leaf, kind),
b{i} AS (SELECT leaf, kind AS best FROM g{i} WHERE gain >= {gain} QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY gain DESC, kind DESC) = 1),
d{i} AS (SELECT kind, truth, l.leaf || CASE WHEN best IS NULL THEN '' WHEN kind = best THEN '0' ELSE '1' END AS leaf FROM {at} l LEFT JOIN b{i} b USING (leaf))""")
        at = f"d{i}"
    return ", ".join(parts) + f""" SELECT CAST(row_number() OVER (ORDER BY leaf) - 1 AS INTEGER) AS leaf, CAST(sum(n) AS BIGINT) AS n, round((max(n) + 0.1) / (sum(n) + {classes} * 0.1), 6) AS p
FROM (SELECT leaf, truth, CAST(count(*) AS DOUBLE) AS n FROM {at} GROUP BY leaf, truth) GROUP BY leaf"""


def _bracket_samples(spark, sf_dir):
    from pyspark.sql.window import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = lambda m: (F.pmod(F.col("event_id") * m, F.lit(97)) / 100).alias
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), (F.row_number().over(by) - 1).alias("pos"), p(31)("p_open"), p(57)("p_close"))


def bracket_shortest(spark, sf_dir):
    return brackets.shortest_spans(_bracket_samples(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


BRACKET_SQL = """WITH b AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, (event_id * 31) % 97 >= 50 AS opens, (event_id * 57) % 97 >= 50 AS closes FROM events),
g AS (SELECT *, coalesce(count(*) FILTER (WHERE closes) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM b),
e AS (SELECT *, max(pos) FILTER (WHERE opens) OVER w AS first, max(pos) FILTER (WHERE closes) OVER w AS last FROM g WINDOW w AS (PARTITION BY seq, part))
SELECT CASE WHEN last IS NULL OR first IS NULL OR pos < first THEN 'O' WHEN pos = first THEN 'B' WHEN pos = last THEN 'E' ELSE 'I' END AS label, count(*) AS n FROM e GROUP BY 1"""


LENGTHS = {1: 0.2, 2: 0.4, 3: 0.3, 4: 0.1}


def bracket_decode(spark, sf_dir):
    return brackets.best_spans(_bracket_samples(spark, sf_dir), LENGTHS).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _decode_sql(lengths: dict[int, float]) -> str:
    """A step for each token: the best labels up to it with their numbers, and the best labels with a span open for 1, 2, .. tokens.

    Spans longer than all of ``lengths`` share a prior, so of those the best is enough. Of equal ones the longest span counts, but
    no span before any.
    """
    longest = max(lengths)
    kept = lambda at, v, n: f"{{'v': {v}, 'o': {at}.o, 'b': {at}.b, 'i': {at}.i, 'e': {at}.e, 'n': {n}}}"
    closed = lambda k, prior: f"{{'v': o{k}.v + no + lc + ln({prior}), 'o': o{k}.o, 'b': o{k}.b + 1, 'i': o{k}.i + o{k}.n - 1, 'e': o{k}.e + 1, 'n': 0}}"
    ends = ["{'v': best.v + no + nc, 'o': best.o + 1, 'b': best.b, 'i': best.i, 'e': best.e, 'n': 0}", closed(longest, 1e-12)]
    ends += [closed(k, lengths[k + 1]) for k in range(longest - 1, 0, -1)]
    ends.append(f"{{'v': best.v + lo + lc + ln({lengths[1]}), 'o': best.o, 'b': best.b + 1, 'i': best.i, 'e': best.e, 'n': 0}}")
    choice = f"list_reduce([{', '.join(ends)}], lambda x, y: CASE WHEN y.v > x.v + {brackets.TIE} THEN y ELSE x END)"
    none = "{'v': CAST('-infinity' AS DOUBLE), 'o': 0, 'b': 0, 'i': 0, 'e': 0, 'n': 0}"
    steps = [kept("best", "best.v + lo + nc", "1")] + [kept(f"o{k}", f"o{k}.v + no + nc", f"o{k}.n + 1") for k in range(1, longest)]
    older = kept(f"o{longest}", f"o{longest}.v + no + nc", f"o{longest}.n + 1")
    steps[-1] = f"CASE WHEN o{longest}.v >= o{longest - 1}.v - {brackets.TIE} THEN {older} ELSE {steps[-1]} END"
    logs = ", ".join(f"ln(greatest(least({x}, 1 - 1e-12), 1e-12)) AS {n}" for x, n in (("p", "lo"), ("q", "lc"), ("1 - p", "no"), ("1 - q", "nc")))
    return f"""WITH RECURSIVE t AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j, CAST((event_id * 31) % 97 AS DOUBLE) / 100 AS p, CAST((event_id * 57) % 97 AS DOUBLE) / 100 AS q FROM events),
l AS (SELECT seq, j, {logs} FROM t),
r AS (SELECT seq, CAST(0 AS BIGINT) AS j, {none.replace("CAST('-infinity' AS DOUBLE)", "CAST(0 AS DOUBLE)")} AS best, {", ".join(f"{none} AS o{k}" for k in range(1, longest + 1))} FROM (SELECT DISTINCT seq FROM t)
  UNION ALL SELECT r.seq, l.j, {choice}, {", ".join(steps)} FROM r JOIN l ON l.seq = r.seq AND l.j = r.j + 1),
f AS (SELECT seq, arg_max(best, j) AS best FROM r GROUP BY seq), n AS (SELECT unnest(['O', 'B', 'I', 'E']) AS label, unnest([sum(best.o), sum(best.b), sum(best.i), sum(best.e)]) AS n FROM f)
SELECT label, CAST(n AS BIGINT) AS n FROM n WHERE n > 0"""


def ancestors(spark, sf_dir):
    """Nation, region and the tables' root as two levels of classes."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")).unionByName(r.select(F.col("r_name").alias("child"), F.lit("world").alias("parent")))
    got = hypernyms.with_ancestors(n.select(F.col("n_name").alias("word")), "word", up, 3)
    return got.select("word", F.array_join("ancestors", ">").alias("path"))


ANCESTOR_SQL = "SELECT n_name AS word, r_name || '>world' AS path FROM nation JOIN region ON n_regionkey = r_regionkey"


def converted_rules(spark, sf_dir):
    """Rules of another tagger's syntax over events: converted, parsed and applied."""
    lines = ["click view PREVTAG ZZZ".replace("ZZZ", "STAART"), "click purchase NEXT1OR2WD purchase", "view click CURWD view"]
    schema = TaskSchema.parse("word pos => tpos")
    s = event_samples(spark, sf_dir).select("seq", F.col("pos").alias("at"), F.col("kind").alias("word"), F.col("state").alias("pos"), F.col("truth").alias("tpos"))
    rules = [Rule.parse("RULE: " + convert.tagger_rule(x)) for x in lines]
    from .plans.spec import Atom  # the class column is called pos there, so the place gets that name back last

    renamed = TaskSchema.parse("word tag => truth")
    fixed = [Rule(tuple(Atom(**{**a.__dict__, "columns": tuple("tag" if c == "pos" else c for c in a.columns)}) for a in r.atoms), r.values, ("tag",), r.results) for r in rules]
    got = apply_rules(s.select("seq", F.col("at").alias("pos"), "word", F.col("pos").alias("tag"), F.col("tpos").alias("truth")), fixed, renamed)
    assert schema.states == ("pos",)
    return got.select("seq", "pos", F.col("tag").alias("state"))


CONVERT_SQL = f"WITH {EVENT_SQL}, {_rule_sql([Rule.parse('RULE: state_0=click state_-1=ZZZ => state=view'), Rule.parse('RULE: state_0=click kind:[1,2]=purchase => state=purchase'), Rule.parse('RULE: state_0=view kind_0=view => state=click')], 'samples')} SELECT seq, pos, state FROM s2"


def tagger_pipeline(spark, sf_dir):
    """Two stages on the languages of all documents' words, learned until no rule gains a hundredth of all tokens: lexical rules for
    words that a quarter of the documents lacks, then rules of context; accuracy of the tagged documents by truth."""
    s = token_samples(spark, sf_dir).withColumn("state", F.lit("-"))
    lexical = _templates("word::~~2 => state\nword::3~~ => state", TOKENS)
    context = _templates("state_-1 state_0 => state\nstate:[1,2] state_0 => state", TOKENS)
    tokens = token_arrays(spark, sf_dir).agg(F.coalesce(F.sum(F.coalesce(F.greatest(F.size("words"), F.lit(0)), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    stop = Limits(threshold=max(2, tokens // 100))
    model = tagger.train(s, "word", lexical, context, lexicon.random_half(0.25), "en", "de", stop, stop)
    got = tagger.tag(s, "word", model, TOKENS, constrain_above=5)
    return evaluate.accuracy(got, TOKENS).select("state", "total", "correct")


QUERIES = {f.__name__: f for f in (
    ctx_identity, ctx_range, set_feature, affixes, contains, affix_words, cooccurrence, wide_rows, multi_truth, apply_one_rule, apply_rule_list, apply_long_list, apply_nested, rule_trace, errors_by_rule, fake_class_trace, two_targets, unseen_bigrams, merged_lexicons,
    constraint_filter, score_rules_seq, collapse_samples, score_rules_indep, best_rule, prune_rules, semi_good_rules, learn_rules, learn_lines, lexicon_word_lang, lexicon_min_count, lexicon_backoff,
    most_likely_tag, seen_unseen_split, bigrams_frequent, vocabulary_words, accuracy, phrase_f, mark_samples, rule_fires, feature_vectors, feature_counts, prob_tree, bracket_shortest, bracket_decode,
    ancestors, converted_rules, tagger_pipeline,
)}

_RULES = _event_rules()
ORACLES = {
    "ctx_identity": f"WITH {EVENT_SQL} SELECT seq, pos, {_lag('kind', -1)} AS before, {_lag('kind', 2)} AS after2 FROM samples",
    "ctx_range": f"WITH {EVENT_SQL}, n AS (SELECT seq, pos, {_lag('kind', -1)} AS a, {_lag('kind', -2)} AS b, {_lag('kind', -3)} AS c, {_lag('kind', 1)} AS d, {_lag('kind', 2)} AS e FROM samples) SELECT seq, pos, 'purchase' IN (a, b, c) AS fires, CASE WHEN d = e THEN d ELSE least(d, e) || ',' || greatest(d, e) END AS vals FROM n",
    "set_feature": "SELECT p_partkey, 'Brand#13' IN (p_brand, p_type, p_name) AS fires, array_to_string(list_sort(list_distinct(list_filter([p_brand, p_type, p_name], lambda x: x <> 'Brand#11'))), '|') AS vals FROM part",
    "affixes": f"WITH {PART_SQL} SELECT word, CASE WHEN length(word) > 2 THEN left(word, 2) ELSE '' END AS pre, CASE WHEN length(word) > 3 THEN right(word, 3) ELSE '' END AS suf, starts_with(word, 'th') AS is_th, ends_with(word, 'ing') AS is_ing FROM words",
    "contains": f"WITH {PART_SQL} SELECT word, CASE WHEN length(word) > 2 THEN array_to_string(list_sort(list_distinct(list_transform(range(1, length(word)), lambda i: substr(word, i, 2)))), ',') ELSE '' END AS grams, contains(word, 'er') AS has_er FROM words",
    "affix_words": AFFIX_SQL,
    "cooccurrence": COOC_SQL,
    "wide_rows": WIDE_SQL,
    "multi_truth": "SELECT doc_id, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END IN (quality, toxic) AS is_right, CAST(CASE WHEN quality = toxic THEN 1 ELSE 2 END AS INTEGER) AS n_truths FROM documents JOIN labels USING (doc_id)",
    "apply_one_rule": f"WITH {EVENT_SQL}, {_rule_sql(_RULES[:1], 'samples')} SELECT seq, pos, state FROM s0",
    "apply_rule_list": f"WITH {EVENT_SQL}, {_rule_sql(_RULES, 'samples')} SELECT seq, pos, state FROM s4",
    "apply_long_list": f"WITH {EVENT_SQL}, {_rule_sql(_RULES, 'samples')} SELECT seq, pos, state FROM s4",
    "apply_nested": f"WITH {EVENT_SQL}, {_rule_sql(_RULES, 'samples')} SELECT seq, pos, state FROM s4",
    "rule_trace": f"WITH {EVENT_SQL}, {_rule_sql(_RULES, 'samples')} SELECT seq, pos, array_to_string(list_filter([" + ", ".join(f"CASE WHEN f_{i} THEN '{i}' END" for i in range(5)) + "], lambda x: x IS NOT NULL), ',') AS trace FROM s4",
    "errors_by_rule": f"WITH {EVENT_SQL}, {_rule_sql(_RULES, 'samples')} SELECT CAST(-1 AS INTEGER) AS rule, count(*) AS errors FROM samples WHERE state <> truth " + " ".join(f"UNION ALL SELECT CAST({i} AS INTEGER), count(*) FROM s{i} WHERE state <> truth" for i in range(5)),
    "fake_class_trace": FAKE_SQL,
    "two_targets": TWO_SQL,
    "unseen_bigrams": UNSEEN_BIGRAM_SQL,
    "merged_lexicons": MERGED_SQL,
    "bracket_shortest": BRACKET_SQL,
    "bracket_decode": _decode_sql(LENGTHS),
    "prob_tree": _tree_sql(10, 0.0005, 2, 6),
    "constraint_filter": CONSTRAINT_SQL,
    "score_rules_seq": SEQ_SCORE_SQL,
    "collapse_samples": f"WITH {LINE_SQL} SELECT * FROM collapsed",
    "score_rules_indep": f"WITH {LINE_SQL}, {_score_sql(LINE_ATOMS, 'collapsed', 'cost')} SELECT *, good - bad AS score FROM scores",
    "best_rule": f"WITH {LINE_SQL}, {_score_sql(LINE_ATOMS, 'collapsed', 'cost')} SELECT *, good - bad AS score FROM scores ORDER BY good - bad DESC, results DESC, template, string_split(tokens, '|') DESC LIMIT 1",
    "prune_rules": f"WITH {LINE_SQL}, {_score_sql(LINE_ATOMS, 'collapsed', 'cost')} SELECT *, good - bad AS score FROM scores WHERE good > 20 AND NOT (good = 0 AND bad > 5) AND bad * 1.05 < good",
    "semi_good_rules": SEMI_SQL,
    "learn_lines": _learn_sql(48),
    "lexicon_word_lang": LEX_SQL,
    "lexicon_min_count": LEX_SQL.replace("GROUP BY ALL)\nSELECT", "GROUP BY ALL HAVING count(*) >= 5)\nSELECT"),
    "lexicon_backoff": BACKOFF_SQL,
    "most_likely_tag": LIKELY_SQL,
    "seen_unseen_split": UNSEEN_SQL,
    "bigrams_frequent": BIGRAM_SQL,
    "vocabulary_words": VOCAB_SQL,
    "accuracy": f"WITH {EVENT_SQL}, {_rule_sql(_RULES, 'samples')} SELECT 'state' AS state, count(*) AS total, count(*) FILTER (WHERE state = truth) AS correct FROM s4",
    "phrase_f": PHRASE_SQL,
    "mark_samples": f"WITH {EVENT_SQL} SELECT seq, CAST(pos + 1 AS INTEGER) AS sample, CASE WHEN state = truth THEN '1' ELSE '0' END AS mark FROM samples",
    "rule_fires": FIRES_SQL,
    "feature_vectors": VECTOR_SQL,
    "feature_counts": VECTOR_SQL[: VECTOR_SQL.index("ids AS")] + "c AS (SELECT feature, count(*) AS n FROM f GROUP BY feature) SELECT feature, n, row_number() OVER (ORDER BY feature) AS id FROM c",
    "ancestors": ANCESTOR_SQL,
    "converted_rules": CONVERT_SQL,
}
