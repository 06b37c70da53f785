"""Personal data: certain spans by Python's own regular expressions, learning by plain loops over the same votes and features."""

import hashlib
import math
import random
import re
from collections import defaultdict

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from rulewright.llm import private

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def brute_base(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def garbled(seed):
    """Characters of the patterns in any order, so that matches begin, end and follow each other anywhere."""
    r = random.Random(seed)
    return "".join(r.choice(["a", "b_", "@", "@x", ".", ".com", "-", " ", "+", "1", "22", "4", "(", ")", "é", "🙂", "255", "256", ".0", "\n", "%"]) for _ in range(120))


def rows():
    hexes = lambda seed, n: f"{random.Random(seed).getrandbits(4 * n):0{n}x}"
    short = [(i, t if t is None or len(t) < 150_000 else t[:3000], g) for i, t, g in fx.odd_rows()]  # the plain patterns take quadratic time on one long word
    out = [*short, *((1000 + i, garbled(i), "en") for i in range(150))]
    out += [(2000 + i, f"{fx.prose(i, 20)} mail me.{i}@host{i}.example.com or 10.0.{i}.7 {fx.prose(i + 1, 5)} card 4111 1111 1111 1111, call +1 (212) 555-01{i:02} {fx.prose(i + 2, 9)}", "en") for i in range(40)]
    out += [(3000 + i, f'{fx.prose(i, 20)} token = "{hexes(i, 40)}" {fx.prose(i + 1, 20)}', "en") for i in range(30)]
    out += [(3100 + i, f"{fx.prose(i, 20)} password={hexes(90 + i, 18)} {fx.prose(i + 1, 20)} version 2.{i} of 2024-01-{10 + i}", "en") for i in range(15)]
    out += [(4000, "a@b.c_x@d.e and 1.2.3.4.5.6.7.8 00000000255.1.1.1 999.1.1.1", "en"), (4001, "9" * 5000 + " " + "1 " * 3000, "en"), (4002, "a@" + "b." * 20_000 + "c", "en"), (4003, "+1" + "(" * 9000, "en"), (4004, "x@y.z " * 2000, "en")]
    return out


@pytest.fixture
def found(spark, docs):
    return private.scanned(fx.documents(spark, rows())).select("doc_id", "base", "spans").collect()


def test_certain_spans(spark, docs, tmp_path):
    df = fx.documents(spark, rows())
    got = sorted((str(r.doc_id), [tuple(s) for s in r.base]) for r in private.scanned(df).select("doc_id", "base").collect())
    assert got == sorted((str(i), brute_base(t)) for i, t, _ in rows())


def test_query(spark, tmp_path):
    data = [(i, t) for i, t, _ in rows()]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in private.op11_weak_supervision(spark, str(tmp_path)).collect():
        own = [brute_base(t) for i, t in data if i == r.doc_id]
        shown = [",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in base) for base in own]
        at = [hashlib.sha256(s.encode()).hexdigest() for s in shown].index(r.base_sha256)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in own[at]) for n in range(4))
        assert set(shown[at].split(",")) - {""} <= set(r.spans.split(","))


def brute_learning(judged):
    """Posteriors by pattern, and the classifier's verdict of each judged span. judged: (kind, votes, features)."""
    n = defaultdict(int)
    for kind, votes, _ in judged:
        n[kind, votes] += 1
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    p = {k: sigmoid(sum(k[1])) for k in n}
    for _ in range(private.TURNS):
        part = lambda of, where: sum(n[k] * of(p[k]) for k in n if where(*k))
        yes, no = lambda q: q, lambda q: 1 - q
        share = [math.log((1 + part(yes, lambda k, v, c=c: k == c)) / (1 + part(no, lambda k, v, c=c: k == c))) for c in range(len(private.KINDS))]
        rate = lambda j, x, of: (1 + part(of, lambda k, v: v[j] == x)) / (2 + part(of, lambda k, v: v[j] != 0))
        rates = {(j, x): math.log(rate(j, x, yes) / rate(j, x, no)) for j in range(len(private.LABELERS)) for x in (-1, 1)}
        p = {(k, v): sigmoid(share[k] + sum(rates[j, x] for j, x in enumerate(v) if x)) for k, v in n}
    yes, no = defaultdict(float), defaultdict(float)
    for kind, votes, features in judged:
        for f in features:
            yes[f] += p[kind, votes]
            no[f] += 1 - p[kind, votes]
    total = [sum(yes.values()), sum(no.values())]
    weight = {f: math.log((yes[f] + 1) / (total[0] + private.BUCKETS)) - math.log((no[f] + 1) / (total[1] + private.BUCKETS)) for f in yes}
    size = len(judged[0][2])
    return p, lambda features: math.log((total[0] / size + 1) / (total[1] / size + 1)) + sum(weight[f] for f in features)


def test_learning(spark, docs):
    df = fx.documents(spark, rows())
    table = [(str(r.doc_id), r.base, r.judged) for r in private.spans(df).collect()]
    judged = [(x.kind, tuple(x.votes), tuple(x.features)) for _, _, xs in table for x in xs]
    p, score = brute_learning(judged)
    patterns = spark.createDataFrame([(k, list(v), sum(x[:2] == (k, v) for x in judged)) for k, v in p], "kind int, votes array<int>, n long")
    got = {(r.kind, tuple(r.votes)): r.p for r in private.posteriors(patterns).collect()}
    assert got.keys() == p.keys() and all(math.isclose(got[k], p[k], rel_tol=1e-6, abs_tol=1e-9) for k in p)
    want = sorted((i, sorted([*map(tuple, base), *((x.start, x.kind, x.end) for x in xs if x.kind >= 4 and score(x.features) >= 0)])) for i, base, xs in table)
    assert sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in private.scanned(df).collect()) == want


def test_secrets_are_found_and_clean_texts_left(found):
    text = {i: t for i, t, _ in rows()}
    more = {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.spans if s.kind >= 4] for r in found if r.doc_id is not None}
    assert all(any(len(v) == 40 for v in more[3000 + i]) for i in range(30)) and all(any(len(v) == 18 for v in more[3100 + i]) for i in range(15))
    assert not any(more[i] for i in range(8)) and not any(more[2000 + i] for i in range(40)) and not any("2024-01" in v for vs in more.values() for v in vs)


def test_native_and_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = private.scanned(df)
    assert out.collect() == []
    for part in (out, private.spans(df), private.posteriors(df.select(F.lit(0).alias("kind"), F.array(*[F.lit(1)] * 5).alias("votes"), F.lit(1).alias("n")))):
        assert not re.search("Python|Pandas|Arrow|MapIn|ExistingRDD\\[.*Python", part._jdf.queryExecution().executedPlan().toString().replace("ExistingRDD", ""))


def test_one_long_word(spark):
    """Where no match can begin, none is tried: a word of a megabyte, and one before an @."""
    df = spark.createDataFrame([(1, "z" * (1 << 20)), (2, "z1" * (1 << 19) + "@"), (3, "7" * (1 << 20)), (4, "x@y.z " * 20_000)], "doc_id long, text string")
    assert {r.doc_id: len(r.base) for r in private.scanned(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 20_000}


def test_luhn(spark):
    numbers = ["4111111111111111", "4111111111111112", "79927398713", "0", "18"]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    assert [r.ok for r in df.select(private.luhn(F.col("n")).alias("ok")).collect()] == [luhn(n) for n in numbers]
