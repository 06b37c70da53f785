r"""Personal data by weak supervision, in DataFrame functions only.

Four kinds of spans are certain by their form (email, ip, card, phone). Beside them, spans that only look like personal data
are candidates: digit groups (``number``), codes of letters and digits (``secret``) and pairs of capitalised words (``name``).
Labelers vote on certain spans and candidates alike: by regular expression, checksum, gazetteer, and words before them; for,
against, or not at all. Expectation-maximisation (Dawid and Skene's model: votes independent given the class, a rate of each labeler for each
class, a share of each kind) runs over the counts of vote patterns of all documents, of which there are at most
len(KINDS) * 3 ** len(LABELERS) however many documents there are. Its posteriors, as soft labels, train the span
classifier: naive Bayes over hashed features of a span's own form and of what stands around it, which can judge candidates
that no labeler knows. Candidates that it finds likelier than not are added; certain spans stay whatever it says.

Texts are scanned once: spans, votes and features go to a table in the shared folder, which is all that training and the last
pass read. Nothing is shuffled but counts of patterns and of features (``BUCKETS`` at most), summed up before.

Positions are in code points, ends exclusive. Null and empty texts have no spans; rows with a null id and repeated rows are
treated one by one like others. Other columns, whatever their names, play no part. Patterns can't match the same stretch from
several starts, so the time for a text is in proportion to its length, but for the number of its spans.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, pick, table, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "number", "secret", "name")
TURNS = 25
BUCKETS = 4096
#: Matches of a text whose places are found together.
GROUP = 256

#: The certain kinds. Where several starts could lead to the same end, only the first is tried: the one before which none of its
#: characters stands, or where the last match ended (\G). ++ takes all there is; these patterns need another character after it.
#: Candidates: digit groups and codes, and pairs of capitalised words.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "codes": "|".join([
        r"[(0-9](?<![A-Za-z0-9_.+-].)(?:(?<=\()[0-9])?(?:[ ().\-/]{0,2}[0-9]){6,30}+(?![A-Za-z0-9_])",
        r"[A-Za-z0-9_](?<![A-Za-z0-9_].)(?=[A-Za-z_]{0,40}(?<=[A-Za-z_])[0-9]|[0-9_]{0,40}(?<=[0-9_])[A-Za-z])[A-Za-z0-9_]{11,128}+(?![A-Za-z0-9_])",
    ]),
    "names": r"\p{Lu}(?<!\p{L}.)\p{Ll}{1,20}+ \p{Lu}\p{Ll}{1,20}+(?!\p{L})",
}
#: A character, or a pattern, without which there is no match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": "+", "codes": "[0-9]", "names": r"\p{Lu}"}

# What labelers know (fixed values).
DOMAINS = "com org net edu gov io info biz de fr es it uk nl ch at eu us ca au jp".split()
KEY_PREFIXES = "AKIA ASIA AIza ghp_ gho_ ghs_ glpat sk_ pk_ rk_ xoxb xoxp eyJ".split()
GIVEN_NAMES = (
    "Alice Andrew Anna Anne Antonio Bernd Bob Carlos Carmen Caroline Charles Charlotte Christian Christine Claire Claudia Daniel David Elena Elizabeth "
    "Emily Emma Eva Felix Francisco Frank George Hans Helen Ines Isabel Jack James Jan Jane Javier Jean Jennifer Joan John Jorge Jose Josef Juan Julia "
    "Julie Karl Kate Klaus Laura Linda Louis Lucas Lucia Luis Manuel Maria Marie Mark Martin Mary Max Michael Michel Miguel Nicolas Nina Oliver Otto "
    "Patricia Paul Pedro Peter Philippe Pierre Rachel Richard Robert Rosa Sandra Sarah Sophie Stefan Susan Teresa Thomas Uwe Werner William Wolfgang"
).split()
CUES_FOR = r"(?:pass(?:word|wort|wd|e)?|pwd|token|secret|key|auth|bearer|credential|tel|phone|call|fax|mobile|mail|contact|card|account|konto|iban|ssn|social security|name|mr|mrs|ms|dr|herr|frau|dear|signed)[\s:=.#(\"']*$"
CUES_AGAINST = r"(?:version|licen[cs]e|isbn|issn|doi|page|figure|table|chapter|section|since|year|copyright|rfc|commit|revision|checksum|sha\d*|md5|build|order|invoice)[\s:=.#(\"']*$"
STRICT_NUMBER = r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ -]?[0-9]{3}[ .-][0-9]{4})$"
STRICT_CODE = r"^(?:[0-9a-f]{16,64}|[A-Z0-9]{20}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})$"
DATE = r"^[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}$"


def cut(text: str, patterns: dict[str, str]) -> dict[str, Column]:
    """For each pattern the parts of a split and the matches between them; texts without what NEEDS says aren't searched."""
    out = {}
    for name, pattern in patterns.items():
        whole, none = F.array(F.col(text)), F.array().cast("array<string>")
        may = F.contains(F.col(text), F.lit(NEEDS[name])) if name in ("email", "phone") else F.regexp_like(text, F.lit(NEEDS[name]))
        out[f"{name}_gaps"] = F.when(may, F.split(text, pattern, -1)).otherwise(whole)
        out[f"{name}_found"] = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    return out


def _numbers(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def measured(name: str) -> dict[str, Column]:
    """How far each match of cut() takes the text: the length of the part before it and its own."""
    gaps, found = F.col(f"{name}_gaps"), F.col(f"{name}_found")
    return {f"{name}_sizes": F.transform(_numbers(F.lit(1), F.size(found)), lambda i: F.length(F.element_at(gaps, i)) + F.length(F.element_at(found, i)))}


def group_starts(name: str) -> dict[str, Column]:
    """Where each group of GROUP matches begins."""
    sizes = F.col(f"{name}_sizes")

    def step(acc: Column, g: Column) -> Column:
        size = F.aggregate(F.slice(sizes, g * GROUP + 1, GROUP), F.lit(0), lambda s, x: s + x)
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    groups = _numbers(F.lit(0), F.ceil(F.size(sizes) / GROUP).cast("int") - 1)
    return {f"{name}_starts": F.aggregate(groups, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]}


def matches(name: str) -> Column:
    """start, end, value, and up to 24 characters before and 4 after each match of cut(). Lists grow by copies, so they grow by groups."""
    gaps, found, starts = F.col(f"{name}_gaps"), F.col(f"{name}_found"), F.col(f"{name}_starts")
    none = F.array().cast("array<struct<start: int, end: int, value: string, before: string, after: string>>")

    def step(acc: Column, i: Column) -> Column:
        gap, value = F.element_at(gaps, i), F.element_at(found, i)
        start = acc["at"] + F.length(gap)
        end = start + F.length(value)
        one = F.struct(start.alias("start"), end.alias("end"), value.alias("value"), F.right(gap, F.lit(24)).alias("before"), F.left(F.element_at(gaps, i + 1), F.lit(4)).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def group(g: Column) -> Column:
        own = _numbers(g * GROUP + 1, F.least((g + 1) * GROUP, F.size(found)))
        return F.aggregate(own, F.struct(F.get(starts, g).alias("at"), none.alias("out")), step)["out"]

    return F.flatten(F.transform(_numbers(F.lit(0), F.size(starts) - 1), group))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass Luhn's test?"""
    places = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))
    digit = lambda i: F.coalesce(F.substr(F.reverse(number), i, F.lit(1)).try_cast("int"), F.lit(0))
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(places, F.lit(0), lambda s, i: s + F.when(i % 2 == 1, digit(i)).otherwise(twice(digit(i)))) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """What a match of a certain kind must hold besides its pattern."""
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(digits(value))
    if kind == "card":
        return n.between(14, 19) & luhn(digits(value))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


# -- labelers: 1 for, -1 against, 0 without a vote --------------------------------------------------------------------


def _vote(for_: Column, against: Column) -> Column:
    return F.when(for_, 1).when(against, -1).otherwise(0)


def _is(x: Column, *names: str) -> Column:
    return x["kind"].isin([KINDS.index(n) for n in names])


def by_form(x: Column) -> Column:
    strict = F.when(_is(x, "secret"), F.lit(STRICT_CODE)).otherwise(F.lit(STRICT_NUMBER))
    return _vote(_is(x, *BASE) | F.regexp_like(x["value"], strict), F.regexp_like(x["value"], F.lit(DATE)))


def by_checksum(x: Column) -> Column:
    number = digits(x["value"])
    return F.when(_is(x, "card", "number") & F.length(number).between(12, 19), F.when(luhn(number), 1).otherwise(-1)).otherwise(0)


def by_gazetteer(x: Column) -> Column:
    name = F.element_at(F.split(x["value"], " "), 1).isin(GIVEN_NAMES)
    prefix = reduce(Column.__or__, [F.startswith(x["value"], F.lit(p)) for p in KEY_PREFIXES])
    domain = F.lower(F.element_at(F.split(x["value"], r"\."), -1)).isin(DOMAINS)
    return F.when(_is(x, "name"), _vote(name, ~name)).when(_is(x, "secret"), _vote(prefix, F.lit(False))).when(_is(x, "email"), _vote(domain, ~domain)).otherwise(0)


def by_words_before(x: Column) -> Column:
    return _vote(F.regexp_like(F.lower(x["before"]), F.lit(CUES_FOR)), F.regexp_like(F.lower(x["before"]), F.lit(CUES_AGAINST)))


def by_mixture(x: Column) -> Column:
    """Codes that change often between letters and digits look random; digits that are all the same aren't a number of anyone."""
    turns = F.size(F.regexp_extract_all(x["value"], F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"), F.lit(0)))
    same = F.regexp_like(digits(x["value"]), F.lit(r"^([0-9])\1+$"))
    return F.when(_is(x, "secret"), _vote(turns >= 3, turns <= 1)).when(_is(x, "number", "card", "phone"), _vote(F.lit(False), same)).otherwise(0)


LABELERS = (by_form, by_checksum, by_gazetteer, by_words_before, by_mixture)


def features(x: Column) -> Column:
    """Buckets of a span's length, shape, share of digits, last word before it and characters around it."""
    shape = x["value"]
    for those, mark in (("[0-9]", "9"), (r"\p{Ll}", "a"), (r"\p{Lu}", "A")):
        shape = F.regexp_replace(shape, those, mark)
    shape = F.left(F.regexp_replace(shape, r"(.)\1+", "$1"), F.lit(12))
    share = F.floor(10 * F.length(digits(x["value"])) / F.length(x["value"]))
    word = F.regexp_extract(F.lower(x["before"]), r"(\p{L}{1,20})[^\p{L}]{0,6}$", 1)
    around = F.concat(F.right(x["before"], F.lit(1)), F.lit(" "), F.left(x["after"], F.lit(1)))
    rows = [("length", x["kind"], F.least(x["end"] - x["start"], F.lit(48)).cast("string")), ("shape", x["kind"], shape), ("digits", x["kind"], share.cast("string")), ("word", x["kind"], word), ("around", x["kind"], around)]
    return F.array(*[F.pmod(F.xxhash64(F.lit(name), kind, value), F.lit(BUCKETS)).cast("int") for name, kind, value in rows])


def certain(kind: str) -> Column:
    found = F.filter(matches(kind), lambda x: holds(kind, x["value"]))
    return F.transform(found, lambda x: x.withField("kind", F.lit(KINDS.index(kind))))


def spans(df: DataFrame) -> DataFrame:
    """doc_id, certain spans by start and kind, and all that labelers judge: kind, start, end, votes and features."""
    rows = pick(df, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("doc_id", *[c.alias(n) for n, c in cut("text", PATTERNS).items()])
    for more in (measured, group_starts):
        rows = rows.withColumns({n: c for name in PATTERNS for n, c in more(name).items()})
    rows = rows.select("doc_id", F.concat(*[certain(k) for k in BASE]).alias("base"), F.concat(matches("codes"), matches("names")).alias("loose"))
    overlaps = lambda x: F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    kind = lambda v: F.when(F.contains(v, F.lit(" ")) & F.regexp_like(v, F.lit(r"^\p{Lu}\p{Ll}")), KINDS.index("name")).when(F.regexp_like(v, F.lit("[A-Za-z]")), KINDS.index("secret")).otherwise(KINDS.index("number"))
    loose = F.transform(F.filter("loose", lambda x: ~overlaps(x)), lambda x: x.withField("kind", kind(x["value"])))
    judged = F.transform(F.concat("base", loose), lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.array(*[label(x).cast("int") for label in LABELERS]).alias("votes"), features(x).alias("features")))
    base = F.array_sort(F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return rows.select("doc_id", base.alias("base"), judged.alias("judged"))


# -- learning ---------------------------------------------------------------------------------------------------------


def _total(items: Column, value, where=None) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + (F.when(where(x), value(x)).otherwise(0.0) if where is not None else value(x)))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def posteriors(patterns: DataFrame) -> DataFrame:
    """kind, votes and p, the probability that spans with these votes are personal data. patterns: kind, votes and their number n.

    One row holds all patterns, and one expression runs the turns: shares and rates from the posteriors, then posteriors from these.
    """
    one = patterns.groupBy().agg(F.sort_array(F.collect_list(F.struct("kind", "votes", F.col("n").cast("double").alias("n")))).alias("items"))
    items, numbers = F.col("items"), F.sequence(F.lit(0), F.lit(len(LABELERS) - 1))
    start = F.transform(items, lambda x: _sigmoid(F.aggregate(x["votes"], F.lit(0.0), lambda s, v: s + v)))
    state = lambda p, share, rates: F.struct(p.alias("p"), share.alias("share"), rates.alias("rates"))

    def learned(acc: Column) -> Column:
        each = F.zip_with(items, acc["p"], lambda x, p: F.struct(x["kind"].alias("kind"), x["votes"].alias("votes"), (x["n"] * p).alias("yes"), (x["n"] * (1 - p)).alias("no")))
        yes, no = lambda x: x["yes"], lambda x: x["no"]
        share = F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda k: F.log((1 + _total(each, yes, lambda x: x["kind"] == k)) / (1 + _total(each, no, lambda x: x["kind"] == k))))
        rate = lambda j, v, of: (1 + _total(each, of, lambda x: F.get(x["votes"], j) == v)) / (2 + _total(each, of, lambda x: F.get(x["votes"], j) != 0))
        rates = F.transform(numbers, lambda j: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda v: F.when(v == 0, 0.0).otherwise(F.log(rate(j, v, yes) / rate(j, v, no)))))
        return state(acc["p"], share, rates)

    def expected(acc: Column) -> Column:
        odds = lambda x: F.get(acc["share"], x["kind"]) + F.aggregate(numbers, F.lit(0.0), lambda s, j: s + F.get(F.get(acc["rates"], j), F.get(x["votes"], j) + 1))
        return state(F.transform(items, lambda x: _sigmoid(odds(x))), acc["share"], acc["rates"])

    none = F.array().cast("array<double>")
    end = F.aggregate(F.sequence(F.lit(1), F.lit(2 * TURNS)), state(start, none, F.array().cast("array<array<double>>")), lambda acc, i: F.when(i % 2 == 1, learned(acc)).otherwise(expected(acc)))
    return one.select(F.explode(F.arrays_zip(items.alias("item"), end["p"].alias("p"))).alias("x")).select("x.item.kind", "x.item.votes", "x.p")


def classifier(judged: DataFrame, labels: DataFrame) -> tuple[float, list[float]]:
    """Log odds of the whole and of each bucket, by naive Bayes. judged: kind, votes and features; labels: posteriors()."""
    # labels has a row for each pattern of votes at most
    soft = judged.join(F.broadcast(labels), ["kind", "votes"]).select("p", F.explode("features").alias("bucket"))
    sums = {r["bucket"]: (r["yes"], r["no"]) for r in soft.groupBy("bucket").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()}  # BUCKETS at most
    n = len(judged.first()["features"]) if sums else 1
    yes, no = (sum(s[i] for s in sums.values()) for i in (0, 1))
    weight = lambda b: math.log((sums[b][0] + 1) / (yes + BUCKETS)) - math.log((sums[b][1] + 1) / (no + BUCKETS)) if b in sums else 0.0
    return math.log((yes / n + 1) / (no / n + 1)), [weight(b) for b in range(BUCKETS)]


def scanned(df: DataFrame) -> DataFrame:
    """doc_id, base (certain spans) and spans (these and the ones added) of each row of df (doc_id, text)."""
    found = written(spans(df), "spans")
    judged = found.select(F.explode("judged").alias("x")).select("x.kind", "x.votes", "x.features")
    patterns = judged.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"))
    labels = written(posteriors(patterns), "posteriors")
    bias, weights = classifier(judged, labels)
    dropped(labels)
    known = F.expr("array(" + ", ".join(f"{w!r}D" for w in weights) + ")")
    score = lambda x: F.aggregate(x["features"], F.lit(bias), lambda s, f: s + F.get(known, f))
    more = F.filter("judged", lambda x: (x["kind"] >= len(BASE)) & (score(x) >= 0))
    more = F.transform(more, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def shown(of: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(of, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op11_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))
