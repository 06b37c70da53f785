"""Each operator against a brute-force version, on tables with every odd case."""

import collections
import hashlib
import math
import random
import struct
import tracemalloc
import zlib

import fixtures as fx
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rulewright.llm import bpe, chat, common, decontaminate, katz, licenses, near_duplicates, quality, sharding, toxicity, url_rules


def key(r):
    return (r[0] is not None, r[0] or 0, *map(str, r[1:]))


def by_rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)


# -- shared -----------------------------------------------------------------------------------------------------------


def test_words_of_buffers():
    texts = [t for _, t, _ in fx.odd_rows()][:-3]
    raw, at = common.buffers(pa.array(texts))
    for most in (1 << 21, 300, 1):
        got = []
        for lo, hi in common.steps(at, most):
            w = common.Words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            got += [[w.text(j).decode() for j in range(w.first[i], w.first[i + 1])] for i in range(hi - lo)]
        assert got == [fx.SPACED.findall(fx.low(t)) for t in texts]


def test_columns_that_differ_in_case_only(spark):
    """Under Spark's default, names that differ in case only don't get in the way either."""
    assert spark.conf.get("spark.sql.caseSensitive") == "false"
    df, rows = fx.documents(spark, fx.odd_rows()), fx.odd_rows()
    assert by_rows(common.pick(df, "doc_id", "text"), "doc_id", "text") == sorted(((i, t) for i, t, _ in rows), key=key)
    kept = quality.cleaned(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert kept.columns == df.columns and 0 < kept.count() < len(rows)
    assert licenses.scanned(df).count() == len(rows)


def test_very_long_text(spark):
    """One text of 50 MB among short ones."""
    long = "word wordy wd " * (50 << 20 >> 4) + "end of it"
    raw, at = common.buffers(pa.array(["a b", long, "c"]))
    n = sum(len(common.Words(raw[a:b], at[lo : hi + 1].clip(a, b) - a).start) for lo, hi, a, b in common.pieces(raw, at, common.SPACED))
    assert n == len(long.split()) + 3
    assert len(toxicity.grams(long)) < 200 and set(toxicity.grams("word wordy wd word")) <= set(toxicity.grams(long))


def test_packed_rows_round_trip():
    a, b = np.arange(100, dtype=np.uint64) * 77, np.random.default_rng(1).integers(0, 9, 100).astype(np.int32)
    assert all((x == y).all() for x, y in zip(common.unpacked(common.packed(a, b), np.uint64, np.int32), (a, b)))
    assert all(len(x) == 0 for x in common.unpacked(common.packed(a[:0], b[:0]), np.uint64, np.int32))


# -- 1 ----------------------------------------------------------------------------------------------------------------


def brute_counts(t):
    t = t or ""
    w, seen, dups, lines = fx.SPACED.findall(t), set(), 0, 0
    for line in t.split("\n"):
        if fx.SPACED.search(line):
            lines += 1
            dups += line in seen
            seen.add(line)
    three, repeated = collections.Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if three[tuple(w[k : k + 3])] > 1:
            repeated.update((k, k + 1, k + 2))
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dups, len(repeated), lines


def test_quality_counts(spark, docs):
    extra = [(80, "a b\n\na b\n a b\nc # $\nc # $", "en"), (81, "\n\n", "en"), (82, "a\r\nb\r\na\r\n", "en")]
    from pyspark.sql import functions as F

    df = docs.unionByName(fx.documents(spark, extra))
    got = by_rows(quality.measured(df), "doc_id", *quality.COUNTS)
    assert got == sorted(((i, *brute_counts(t)) for i, t, _ in fx.odd_rows() + extra), key=key)
    out = quality.judged(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert out.count() == df.count() and out.where(~F.col("base_failed") & ~F.col("kept")).count() == 0  # no labels: base rules only
    assert quality.judged(df.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_binomial_tail_is_exact():
    for n, p in ((30, 0.1), (200, 0.05)):
        for k in range(int(n * p)):
            assert math.isclose(math.exp(quality.log_tail(k, n, p)), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)
    assert quality.log_tail(10, 100, 0.1) == 0 and quality.log_tail(0, 0, 0.1) == 0


def test_thresholds_keep_good_documents(spark):
    good = [(i, fx.prose(i, 60), "en") for i in range(900)]
    bad = [(1000 + i, fx.prose(i, 60).replace(" ", "*** "), "en") for i in range(100)]
    few = [(2000 + i, fx.prose(i, 60).replace(" ", "*** "), "fr") for i in range(20)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _, _ in good + bad + few] + [(None, 1), (5, None), (5, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judged(fx.documents(spark, good + bad + few), labels).collect()}
    assert all(got[i].kept for i, _, _ in good)
    assert not any(got[i].kept for i, _, _ in bad)
    assert all(got[i].kept for i, _, _ in few)  # too few labels for a bound in that stratum
    kept = quality.cleaned(fx.documents(spark, good + bad + few), labels)
    assert kept.columns == list(fx.documents(spark, []).columns) and kept.count() == 920


def brute_levels(rows, labels):
    """Cutoff level of each stratum, by tails of the binomial distribution summed term by term."""
    known = {}
    for i, q in labels:
        if i is not None and q is not None:
            known[i] = max(known.get(i, 0), q)
    names, tally = list(quality.CUTOFFS), collections.defaultdict(lambda: ([], []))
    for i, t, g in rows:
        n, chars, symbols, dups, repeats, lines = brute_counts(t)
        if i in known and n >= 50 and 2 * repeats <= n:
            tally[g][known[i] > 0].append((symbols / chars, dups / lines, repeats / n, chars / n))
    hit = lambda m, i: any(x > quality.CUTOFFS[k][i] for k, x in zip(names, m))
    tail = lambda k, n: sum(math.comb(n, j) * 0.05**j * 0.95 ** (n - j) for j in range(k + 1)) if n and k < 0.05 * n else 1
    p = {g: [tail(sum(hit(m, i) for m in good), len(good)) for i in range(8)] for g, (bad, good) in tally.items()}
    open_, through = set(p), set()
    while fresh := {g for g in open_ if max(p[g]) <= 0.05 / len(open_)}:
        through |= fresh
        open_ -= fresh
    levels = {}
    for g, (bad, good) in tally.items():
        best = 0
        for i in range(8):
            if p[g][i] > 0.05 / max(1, len(open_)):
                break
            gain = sum(hit(m, i) for m in bad) - quality.WEIGHT * sum(hit(m, i) for m in good)
            if gain > best:
                best, levels[g] = gain, i
    return {g: {k: quality.CUTOFFS[k][i] for k in names} for g, i in levels.items()}, hit


def test_thresholds_are_those_by_brute_force(spark, docs):
    r = random.Random(11)
    rows = list(fx.odd_rows())
    for g, n, bad in (("en", 400, 90), ("de", 150, 60), (None, 90, 20), ("fr", 40, 30)):
        for j in range(n + bad):
            text = fx.prose(len(rows), 60)
            if j >= n or r.random() < 0.02:
                text = "".join(c + ("#" * r.randrange(4) if c == " " else "") for c in text)
            rows.append((1000 + len(rows), text, g))
    labels = [(i, int(k % 7 != 0 if i is not None and i < 100 else "#" not in (t or "") or r.random() < 0.03)) for k, (i, t, _) in enumerate(rows)]
    cuts, _ = brute_levels(rows, labels)
    assert len(cuts) >= 2
    got = {(r_.doc_id, r_.n_words, r_.word_chars, r_.stratum): r_.kept for r_ in quality.judged(fx.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    for i, t, g in rows:
        n, chars, symbols, dups, repeats, lines = brute_counts(t)
        fine = n >= 50 and 2 * repeats <= n and not (g in cuts and any(x > cuts[g][k] for k, x in zip(quality.CUTOFFS, (symbols / chars, dups / lines, repeats / n, chars / n))))
        assert got[(i, n, chars, g)] == fine


def test_false_rejections_stay_under_the_risk():
    """In simulated strata whose good documents are rejected at twice the risk, hardly any level passes."""
    r = np.random.default_rng(4)
    passed = 0
    for _ in range(2000):
        n = int(r.integers(90, 500))
        rate = np.minimum(0.051 * np.array([0.2, 0.5, 1, 1.5, 2, 3, 4, 5]), 1)  # above the risk from the third level on
        hits = np.cumsum(np.bincount(np.searchsorted(rate, r.random(n)), minlength=9))[:8]
        p = np.maximum.accumulate([quality.log_tail(int(h), n, 0.05) for h in hits])
        passed += p[2] <= math.log(0.05)
    assert passed <= 2000 * 0.06


# -- 2 ----------------------------------------------------------------------------------------------------------------


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = fx.low(rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_url_rules(spark):
    r = random.Random(4)
    hosts = ["com", "example.com", "www.example.com", "xexample.com", "net", "a.net", "b.a.net", "", "ünï.com", "Example.COM", ".com", "a..com", "example.com:80"]
    urls = [f"{s}{r.choice(hosts)}{p}" for s in ("http://", "https://", "") for p in ("", "/", "/en", "/en/", "/en/x", "/es/1?q=/fr/", "/fr#x", "?x", "#/en/", "/En/", "/en/\nx") for _ in range(8)]
    pages = [(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://a.net/fr/", "x"), (5, None, "x"), (6, "http://a.net/es/", "x"), (6, "http://a.net/es/", "x")]
    for rules in (url_rules.RULES, [*url_rules.RULES, ("a.net", "/", "allow"), ("a.net", "/es/", "allow"), ("b.a.net", "", "block"), ("com", "/en/x", "block"), ("net", "/es/1", "allow")], []):
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        got = by_rows(url_rules.judge(spark.createDataFrame(pages, "page_id long, url string, host string"), table), "page_id", "host", "path", "rule", "verdict")
        assert got == sorted(((i, *brute_url(u, rules)) for i, u, _ in pages), key=key)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(empty, url_rules.rule_table(spark, url_rules.RULES)).count() == 0


# -- 3 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("dims", "bits"), [(1, 3), (2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_is_a_walk(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()  # neighbours on the curve are neighbours in space


def test_shards(spark, docs):
    got = sharding.hilbert_shards(docs, "doc_id", "text", ["doc_id", "lang", "n_chars"], shards=7).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sorted((i is not None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t, _ in fx.odd_rows())
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    order = [r.hilbert for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    few = sharding.hilbert_shards(docs.limit(3), "doc_id", "text", ["lang"])
    assert few.select("shard").distinct().count() == 3
    assert sharding.hilbert_shards(docs.limit(0), "doc_id", "text", ["lang"]).count() == 0


def test_text_dimensions_count_whole(spark):
    """Texts that begin alike are told apart; the placement by brute force: rows by curve index, crc32 and id, cut evenly."""
    df = fx.documents(spark, [(i, fx.prose(i, 3), f"https://example.com/section/{i * 7 % 100:03d}") for i in range(100)] + [(200, None, None)])
    limits = sharding.text_limits(df.select("doc_id", "lang"), "lang", 15)
    assert len(limits) == 15 and limits == sorted(limits)
    got = sharding.hilbert_shards(df, "doc_id", "text", ["lang"], shards=6).collect()
    assert len({r.hilbert for r in got}) >= 12
    ranked = sorted(got, key=lambda r: (r.hilbert, r.text_crc32, r.doc_id))
    n, seen = len(ranked), collections.Counter()
    for k, r in enumerate(ranked):
        assert (r.shard, r.slot) == (k * 6 // n, seen[k * 6 // n])
        seen[r.shard] += 1
    part = {r.doc_id: r.hilbert for r in got}
    level = lambda i: sum(f"https://example.com/section/{i * 7 % 100:03d}" >= x for x in limits)
    assert all(part[i] <= part[j] for i in range(100) for j in range(100) if level(i) < level(j))


def test_text_limits_are_those_of_all_values(spark):
    """More rows than any sample, values that differ far behind, ties and nulls: limits stand at their places among all of them."""
    rows = spark.range(30_011).select("id", F.when(F.col("id") % 50 > 0, F.concat(F.lit("x" * 300), (F.col("id") * F.col("id") % 997).cast("string"))).alias("v"))
    values = sorted("x" * 300 + str(i * i % 997) for i in range(30_011) if i % 50)
    for n in (1, 15):
        assert sharding.text_limits(rows, "v", n) == sorted({values[len(values) * i // (n + 1)] for i in range(1, n + 1)})
    assert sharding.text_limits(rows.where("v is null"), "v", 15) == []


def test_shards_prune_files(spark, docs, tmp_path):
    df = fx.documents(spark, [(i, fx.prose(i, 3), "en") for i in range(2000)])
    layout = sharding.hilbert_shards(df, "doc_id", "text", ["doc_id", "n_chars"])
    spans = sharding.shard_ranges(df, layout, "doc_id", ["doc_id"]).collect()
    assert sum(r.max_doc_id - r.min_doc_id for r in spans) < 0.5 * 40 * 2000
    sharding.write_shards(df, layout, "doc_id", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2000


# -- 4 ----------------------------------------------------------------------------------------------------------------


def test_bpe_is_the_librarys(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path()
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    r = random.Random(7)
    wild = ["".join(r.choice(" \n\t'!aàÀ漢0９½ⅷ_-🙂‍́stre" + chr(r.randrange(32, 0x3000))) for _ in range(60)) for _ in range(150)]
    special = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext", "!!!!!!! ******* aaaaaaa       x", "he'll I'VE  don't\r\n\r\n "]
    df = docs.unionByName(fx.documents(spark, [(900 + i, t, "x") for i, t in enumerate(wild + special)]))
    got = sorted((key((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in bpe.digests(bpe.round_trip(df, path)).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append(key((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))))
    assert got == sorted(want)
    coded = bpe.encode(docs, path)
    strange = spark.createDataFrame([(1, bytearray(struct.pack("<3I", 5, 2**31, 60_000))), (2, None)], "doc_id long, ids binary")
    assert by_rows(bpe.decode(strange, path), "doc_id", "text") == [(1, library.decode([5])), (2, "")]
    assert by_rows(bpe.decode(coded, path), "doc_id", "text") == sorted(((i, t or "") for i, t, _ in fx.odd_rows()), key=key)
    assert bpe.encode(docs.limit(0), path).count() == 0


# -- 5 ----------------------------------------------------------------------------------------------------------------


def shingles(t):
    w = fx.SPACED.findall(fx.low(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common_ = len(sets[i] & sets[j])
            if sets[i] and 100 * common_ >= 75 * len(sets[i] | sets[j]) and sets[j]:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))), key=key)


@pytest.mark.parametrize("few", [2, 8])
def test_near_duplicates(spark, docs, few, monkeypatch):
    monkeypatch.setattr(near_duplicates, "FEW", few)
    monkeypatch.setattr(near_duplicates, "CHUNK", 8)
    common_part = fx.prose(99, 60)
    rows = [(i, t) for i, t, _ in fx.odd_rows()]
    # chains whose ends don't link, copies of copies, and documents that only share a passage
    text = fx.prose(5, 150)
    for i in range(30):
        text = fx.edited(text, i, 0.02)
        rows.append((100 + i, text))
    rows += [(200 + i, fx.edited(fx.prose(6, 100), 50 + i, 0.01 * (i % 9))) for i in range(40)]
    rows += [(300 + i, common_part + " " + fx.prose(1000 + i, 20)) for i in range(30)] + [(400 + i, " ".join(fx.prose(8, 40).split()[i:])) for i in range(20)]
    df = fx.documents(spark, [(i, t, "en") for i, t in rows])
    assert by_rows(near_duplicates.near_duplicates(df), "doc_id", "n_shingles", "component_id") == brute_components(rows)
    kept = near_duplicates.one_of_each(df)
    want = brute_components(rows)
    sizes = [r for r in want if r[1]]
    assert kept.columns == df.columns
    assert kept.where("trim(text) <> ''").count() >= len({c for _, _, c in sizes}) - 2
    left = [x for x in brute_components([(n, r.text) for n, r in enumerate(kept.select("text").collect())]) if x[1]]
    assert len({c for _, _, c in left}) == len(left)  # no two texts that stay are linked, also not two of one id


def test_sketch_distance_bounds_difference():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 1 << 62, r.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([b, a[: len(a) // 2]]))
        assert near_duplicates.distance(near_duplicates.parity_bits(a), near_duplicates.parity_bits(b)) <= len(np.setxor1d(a, b))


def test_near_duplicates_of_nothing(spark, docs):
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0
    assert near_duplicates.one_of_each(docs.limit(0)).count() == 0


# -- 6 ----------------------------------------------------------------------------------------------------------------


def brute_hits(t, items):
    w, hit, found = fx.ALNUM.findall(fx.low(t)), set(), set()
    for item, text in items:
        b = fx.ALNUM.findall(fx.low(text))
        n = min(len(b), 10)
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found - {"None"}), bool(hit)


def test_decontamination(spark, docs):
    passage = fx.prose(77, 25)
    items = [(1, passage), (10, "two words"), (2, None), (3, "!!! ..."), (4, passage), (None, fx.prose(78, 12)), (5, "rare"), (6, "x a b c d e x a b c d e x"), (7, "same " * 10)]
    extra = [(500, "start " + passage.upper().replace(" ", ", ") + " end"), (501, " ".join(passage.split()[5:16])), (502, " ".join(passage.split()[:9])), (503, "two words two words"), (504, fx.prose(78, 12)), (505, "RARE!rare"), (506, "x a b c d e x a b c d e x a b c d e x")]
    df = docs.unionByName(fx.documents(spark, [(i, t, "en") for i, t in extra]))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")
    rows = [(i, t) for i, t, _ in fx.odd_rows()] + extra
    got = by_rows(decontaminate.marked(df, bench), "doc_id", "n_words", "n_hit", "items", "contaminated")
    assert got == sorted(((i, *brute_hits(t, items)) for i, t in rows), key=key)
    clean = decontaminate.cleaned(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not brute_hits(t, items)[3] for _, t in rows)
    assert decontaminate.marked(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.marked(df.limit(0), bench).count() == 0
    plan = decontaminate.marked(df, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_decontamination_of_many_places_leaves_other_texts(spark, monkeypatch):
    """With more places than a broadcast used to hold, only texts that have one are shuffled to be verified."""
    passage, plans = fx.prose(77, 12), {}
    keep = decontaminate.written

    def spied(df, name, *by):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name, *by)

    monkeypatch.setattr(decontaminate, "written", spied)
    df = spark.createDataFrame([(i, passage + " same " * (60_000 if i < 2 else 1), "en") for i in range(8)] + [(i, fx.prose(i, 30), "en") for i in range(10, 40)], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, passage), (2, "same " * 10)], "item_id long, text string")
    got = by_rows(decontaminate.marked(df, bench), "doc_id", "n_words", "n_hit", "contaminated")
    # the repeated word's windows stand at all its places but the last nine
    assert got == [(i, 60_012 if i < 2 else 13, 60_012 if i < 2 else 12, True) for i in range(8)] + [(i, 30, 0, False) for i in range(10, 40)]
    assert "LeftSemi" in plans["occurrences"]


# -- 7 ----------------------------------------------------------------------------------------------------------------


def katz_discounts(counts, most=5):
    """Katz's discounts by his formula, for the greatest cutoff that gives them between 0 and 1."""
    n = collections.Counter(counts)
    for k in range(most, 1, -1):
        if all(n[r] for r in range(1, k + 1)):
            a = (k + 1) * n[k + 1] / n[1]
            d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)} if a < 1 else {}
            if d and all(0 < x < 1 for x in d.values()):
                return d
    return {1: 0.5}


class BruteKatz:
    def __init__(self, texts):
        self.words = collections.Counter(w for t in texts for w in t)
        self.after = collections.defaultdict(collections.Counter)
        for t in texts:
            for h, w in zip(["<s>", *t], t):
                self.after[h][w] += 1
        self.total = sum(self.words.values())
        d = katz_discounts(self.words.values())
        kept = sum(d.get(c, 1) * c for c in self.words.values())
        mass = self.total if kept < self.total else self.total + 1
        self.p1 = {w: d.get(c, 1) * c / mass for w, c in self.words.items()}
        self.unseen = 1 - kept / mass
        self.d = katz_discounts([c for x in self.after.values() for c in x.values()])
        self.alpha, self.div = {}, {}
        for h, x in self.after.items():
            n = sum(x.values())
            kept = sum(self.d.get(c, 1) * c for c in x.values())
            self.div[h] = n if kept < n - 1e-9 else n + 1
            self.alpha[h] = (1 - kept / self.div[h]) / (1 - sum(self.p1[w] for w in x))

    def p(self, h, w):
        c = self.after[h][w] if h in self.after else 0
        return self.d.get(c, 1) * c / self.div[h] if c else self.alpha.get(h, 1) * self.p1.get(w, self.unseen)


def katz_wanted(rows):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    texts = [(i, [*fx.SPACED.findall(fx.low(t)), "</s>"]) for i, t in rows]
    m = BruteKatz([t for i, t in texts if i is not None and not out(i)])
    want = []
    for i, t in texts:
        score = sum(math.log10(m.p(h, w)) for h, w in zip(["<s>", *t], t))
        base = sum(math.log10((m.words[w] + 0.1) / (m.total + 0.1 * (len(m.words) + 1))) for w in t)
        want.append((i, out(i), len(t), sum(m.words[w] > 0 for w in t), m.total, base, score))
    return m, want


def same_scores(got, want):
    by = lambda rows: sorted(rows, key=lambda r: (key(r[:5]), round(r[5], 3)))
    for x, y in zip(by(got), by(want), strict=True):
        assert x[:5] == y[:5]
        assert math.isclose(x[5], y[5], rel_tol=1e-8, abs_tol=1e-6) and math.isclose(x[6], y[6], rel_tol=1e-8, abs_tol=1e-6)


@pytest.mark.parametrize("sizes", [None, (700, 300, 1e-3, 256)])
def test_katz(spark, docs, sizes, monkeypatch):
    """Also with chunks and buckets of a few hundred tokens, words spread over buckets, and texts in pieces."""
    if sizes:
        for name, x in zip(("HELD", "BUCKET", "SPREAD_SHARE"), sizes):
            monkeypatch.setattr(katz, name, x)
        monkeypatch.setattr(common, "STEP_BYTES", sizes[3])
    rows = [(i, t) for i, t, _ in fx.odd_rows()]
    m, want = katz_wanted(rows)
    for h in ("<s>", *sorted(m.words)[:20]):
        if h in m.after:
            assert math.isclose(sum(m.p(h, w) for w in m.words) + m.p(h, "never seen"), 1, abs_tol=1e-9)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.scored(docs).collect()]
    same_scores(got, want)


def test_katz_histories_without_rare_words(spark, monkeypatch):
    """A frequent history with one word after it only, and bigrams of rare words beside it; the same with any number of tasks."""
    ids = iter(i for i in range(1, 10_000) if zlib.crc32(str(i).encode()) % 10)
    held = iter(i for i in range(1, 10_000) if not zlib.crc32(str(i).encode()) % 10)
    r = random.Random(5)
    rows = [(next(ids), "hot pair " * 40 + " ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(60))) for _ in range(40)]
    rows += [(next(ids), "zig zag zig zag zig zag zig zag zig zag zig zag zig zag"), (next(held), "hot pair hot new zig zag"), (next(held), "zig w1 hot hot pair"), (next(held), "never seen w2 w3")]
    _, want = katz_wanted(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(katz, "BUCKET", 500)
    scores = []
    for parts in (1, 5):
        monkeypatch.setattr(katz, "HELD", 1000 * parts)
        got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.scored(df.repartition(parts)).collect()]
        same_scores(got, want)
        scores.append(sorted(got))
    assert scores[0] == scores[1]


def test_katz_without_training(spark, docs):
    assert katz.scored(docs.limit(0)).count() == 0
    only = docs.where("doc_id is null")
    assert [(r.train_tokens, r.score) for r in katz.scored(only).collect()] == [(0, 0.0)] * 2


# -- 8 ----------------------------------------------------------------------------------------------------------------


def test_licenses(spark, docs):
    mit = licenses.TEMPLATES[0][1]
    words = mit.split()
    changed = " ".join([*words[:9], "indeed", *words[9:]])  # one word more: a neighbouring diagonal
    texts = {
        700: "Under the MIT license. under the mit\nLICENSE", 701: "Apache License, Version 2.0 and CC BY-NC 4.0", 702: "under the mit", 703: f"x {mit} y", 704: f"x {changed} y",
        705: " ".join(words[:12]), 706: "This work is licensed under the GNU General Public License, version 3.", 707: "under the mit license" * 2,
    }
    df = docs.unionByName(fx.documents(spark, [(i, t, "en") for i, t in texts.items()]))
    got = {r.doc_id: r for r in licenses.digest(licenses.scanned(df)).where("doc_id is not null").collect()}
    for i, t in [(i, t) for i, t, _ in fx.odd_rows() if i is not None and i != 60] + list(texts.items()):
        w, hits = fx.ALNUM.findall(fx.low(t)), []
        for label, phrase in licenses.PHRASES:
            p = phrase.split()
            hits += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(hits), min([h[0] for h in hits], default=None), max([h[0] for h in hits], default=None), ",".join(sorted({h[1] for h in hits})))
    assert [got[i].labels for i in (702, 703, 704, 705, 706)] == ["", "mit", "mit", "", "gpl-3"]
    assert got[704].score > 0.9 and got[705].score == 0 and got[0].score == 0
    whole = [(800 + i, f"Copyright (c) 2020 A. Person\n\n{t}\n\nint main() {{ return 0; }}", "en") for i, t in enumerate((licenses.MIT, licenses.BSD_3, licenses.ISC, licenses.ZLIB, licenses.UNLICENSE, licenses.BOOST, licenses.APACHE_2_NOTICE, licenses.GPL_NOTICE.format(2)))]
    # words changed, added and left out here and there
    whole += [(900 + i, " ".join(w for k, w in enumerate(t.split()) if k % 23) , "en") for i, (_, t, _) in enumerate(whole[:5])]
    found = {r.doc_id: r.labels for r in licenses.digest(licenses.scanned(fx.documents(spark, whole))).collect()}
    assert [found[800 + i] for i in range(8)] == ["mit", "bsd-3", "isc", "zlib", "unlicense", "bsl-1", "apache-2", "gpl-2"]
    assert all(found[900 + i] == found[800 + i] for i in range(5))
    assert licenses.scanned(docs.limit(0)).count() == 0 and licenses.scanned(docs).count() == docs.count()


def brute_licenses(text):
    """(n_words, labels, score) by voting over all places of all templates, spans compared with each other."""
    w, spans = fx.ALNUM.findall(fx.low(text or "")), []
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    for label, text, base in [(*p, True) for p in licenses.PHRASES] + [(*t, False) for t in licenses.TEMPLATES]:
        t = fx.ALNUM.findall(fx.low(text))
        votes = collections.defaultdict(list)
        for q in range(len(t) - 2):
            for p in at.get(tuple(t[q : q + 3]), []):
                votes[p - q].append((p, q))
        groups = []
        for d in sorted(votes):
            if base or not groups or d - groups[-1][-1] > licenses.DRIFT:
                groups.append([])
            groups[-1].append(d)
        for g in groups:
            places = [v for d in g for v in votes[d]]
            windows, first, last = {q for _, q in places}, min(p for p, _ in places), max(p for p, _ in places) + 2
            cover = len({q + j for q in windows for j in range(3)}) / len(t)
            if len(windows) == len(t) - 2 if base else cover >= licenses.COVER and last - first < len(t) + licenses.DRIFT * len(g):
                spans.append((label, base, first, last, cover))
    kept = [s for s in spans if s[1] or not any(not o[1] and o[2] <= s[3] and s[2] <= o[3] and o[4] > s[4] for o in spans)]
    return len(w), ",".join(sorted({s[0] for s in kept})), max([s[4] for s in kept], default=0.0)


def test_licenses_by_brute_force(spark, docs):
    r = random.Random(8)
    rows = [(i, t, "en") for i, t, _ in fx.odd_rows()]
    for i in range(150):
        parts = []
        for _ in range(r.randrange(1, 9)):
            words = r.choice([*licenses.TEMPLATES, *licenses.PHRASES])[1].split()
            words = [w for w in words if r.random() > r.choice([0, 0, 0.04])]
            for _ in range(r.choice([0, 0, 1, 2])):
                words.insert(r.randrange(len(words) + 1), r.choice(["the", "license", "extra", "software"]))
            parts += [" ".join(words[: r.choice([len(words)] * 3 + [len(words) // 2])]), fx.prose(i, r.choice([0, 0, 3]))]
        rows.append((r.choice([None, 1000 + i, 1000 + i, 1000]), " ".join(parts), "en"))
    rows += [rows[-1], rows[-1], (2000, "This work is licensed under the GNU General Public License, version 3. " * 400, "en")]
    got = licenses.digest(licenses.scanned(fx.documents(spark, rows)))
    want = sorted(((i, *brute_licenses(t)) for i, t, _ in rows), key=key)
    have = by_rows(got, "doc_id", "n_words", "labels", "score")
    assert [x[:3] for x in have] == [x[:3] for x in want] and all(abs(x[3] - y[3]) < 1e-12 for x, y in zip(have, want))


# -- 9 ----------------------------------------------------------------------------------------------------------------


def test_toxicity(spark, docs):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        text, toxic = fx.prose(i, 80), i % 5 == 0
        if toxic:
            text = text.replace(" ", f" {r.choice(['blorgous', 'Blorgish', 'vextly'])} ", r.randrange(1, 4))
        rows.append((i, text, "en"))
        labels.append((i, int(toxic)))
    df, table = fx.documents(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.judged(df, table).collect()
    assert all(0 <= x.score <= 1 and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    wrong = [x for x in got if x.predicted != int(x.doc_id % 5 == 0)]
    assert len(wrong) <= 10 and len([x for x in wrong if x.held_out]) <= 4
    kept = toxicity.cleaned(df, table)
    assert kept.columns == df.columns and abs(kept.count() - 1200) <= 10
    none = table.limit(0)
    assert toxicity.judged(docs, none).where("predicted = 0").count() == docs.count()  # nothing is known to be toxic
    assert toxicity.judged(docs.limit(0), none).count() == 0


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The driver, whose memory the pipeline's stages share, gets neither the ratios nor the texts' features, only the model."""
    rows = [(i, fx.prose(i, 20) + (" blorgous vextly" if i % 4 == 0 else ""), "en") for i in range(200)]
    table = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "_fitted", None)  # tasks import their own
    monkeypatch.setattr(type(spark.range(1)), "toPandas", None)
    weights, _ = toxicity.trained(fx.documents(spark, rows), table)
    assert np.count_nonzero(weights) > 50


def test_fit_takes_little_more_memory_than_its_features():
    """Four million places of few features: numbering them takes no sort, and the fit at most 16 bytes a place."""
    r = np.random.default_rng(3)
    size = np.full(1000, 4000)
    col, ratio = r.integers(0, 1 << 14, size.sum()).astype(np.int32), r.normal(size=1 << 14)
    y = (np.arange(1000) % 4 == 0).astype(float)
    tracemalloc.start()
    weights, _ = toxicity._fitted(y, np.full(1000, 1e-3), size, col, ratio)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(col), peak
    assert np.all(weights[np.setdiff1d(np.arange(1 << 14), col)] == 0) and np.count_nonzero(weights) > 1 << 13


def test_toxicity_features_and_scores_by_brute_force(spark):
    """Ratios are those of counted texts, and scores those of a regression fitted anew by plain gradient steps."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["blorg", "vext"] if i % 3 == 0 and r.random() < 0.3 else ["abc", "bcd", "cde"]) for _ in range(6)), "en") for i in range(1, 120)] + [(500, None, "en"), (501, "", "en"), (None, "abc", "en")]
    labels = [(i, int(i % 3 == 0)) for i, _, _ in rows if i is not None]
    df, table = fx.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    sets = {}
    for i, t, _ in rows:
        s = " " + " ".join((t or "").lower().split()) + " "
        sets[i] = {s[k : k + n] for n in (3, 4, 5) for k in range(len(s) - n + 1)}
    train = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    n1 = sum(y for _, y in train)
    n0 = len(train) - n1
    names = sorted(set().union(*(sets[i] for i, _ in train)))
    c1, c0 = (np.array([sum(g in sets[i] for i, y in train if y == c) for g in names], float) for c in (1, 0))
    a = toxicity.SMOOTH
    ratio = np.log((c1 + a) / ((c1 + c0) * n1 / (n1 + n0) + a)) - np.log((c0 + a) / ((c1 + c0) * n0 / (n1 + n0) + a))
    x = np.array([[ratio[k] if g in sets[i] else 0 for k, g in enumerate(names)] for i, _ in train])
    y = np.array([y for _, y in train], float)
    weight, w, bias = np.where(y > 0, 0.5 / n1, 0.5 / n0), np.zeros(len(names)), 0.0
    for _ in range(60_000):
        e = weight * (1 / (1 + np.exp(-(x @ w + bias))) - y)
        w, bias = w - 2.0 * (x.T @ e + toxicity.PENALTY * w), bias - 2.0 * e.sum()
    want = {i: 1 / (1 + math.exp(-(sum(w[k] * ratio[k] for k, g in enumerate(names) if g in sets[i]) + bias))) for i, _, _ in rows}
    got = {q.doc_id: q.score for q in toxicity.judged(df, table).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 0.03 for i in want)


# -- 10 ---------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    tricky = ["", None, chat.TRAP, "\\", "\\h", "####", "#####</turn>\n### User: x</turn>\n", "a\\\\###", "</turn", ": :", "é🙂\n"]
    rows = [(1, n, "assistant" if n % 2 else "user", t) for n, t in enumerate(tricky)] + [(2, 0, "user", "only")] + [(3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (3, None, None, "first"), (3, 1, "to:ol\n", "x")]
    rows += [(None, 5, "user", "u"), (None, 6, "assistant", "v")]
    df = spark.createDataFrame([(c, n, r, t, 1) for c, n, r, t in rows], "conv_id long, turn long, role string, text string, example long")
    examples = chat.prefix_targets(df)
    for r in examples.collect():
        turns = chat.read_turns(r.formatted)
        assert len(turns) == r.n_turns
        if r.loss_end:
            assert turns[-1][0] == "assistant" and chat.unescape(r.formatted[r.loss_start : r.loss_end]) == turns[-1][1]
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for c in (1, 2, 3, None):
        turns = sorted(((n is not None, n or 0, r or "", t or "") for x, n, r, t in rows if x == c))
        text = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.prefix_targets(df.limit(0))).count() == 0
