"""Small corpora worked out by hand, and properties of learning."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rulewright.functions.columns import fires, values, with_word_lists
from rulewright.operators import brackets, evaluate, lexicon, tree
from rulewright.operators.apply import apply_rule, apply_rules, error_curve, loadable
from rulewright.operators.convert import chunk_template, tagger_rule
from rulewright.operators.learn import TALLY, Limits, candidates, changes, learn, order, scored, tallied
from rulewright.plans.spec import Rule, TaskSchema, Templates, parse_atom, parse_params, parse_rules, register_atom
from rulewright.queries import QUERIES, learn_rules
from rulewright.streaming import apply as streaming

SCHEMA = TaskSchema.parse("w st => tr")


def samples(spark, text, schema=SCHEMA):
    """Sequences are lines; samples are blank-separated, their columns split by a slash."""
    rows = [(s, p, *x.split("/")) for s, line in enumerate(text.splitlines()) for p, x in enumerate(line.split())]
    return spark.createDataFrame(rows, ["seq", "pos", *schema.columns])


def states(df, column="st"):
    return [r[column] for r in df.orderBy("seq", "pos").collect()]


@pytest.mark.parametrize("planned", [0, 40])
def test_rules_apply_at_once(spark, planned):
    df = samples(spark, "a/A/A a/A/A a/A/A a/A/A")
    assert states(apply_rules(df, parse_rules("RULE: st_-1=A st_0=A => st=B"), SCHEMA, planned=planned)) == ["A", "B", "B", "B"]


@pytest.mark.parametrize("planned", [0, 40])
def test_padding_matches_beyond_the_ends(spark, planned):
    df = samples(spark, "a/A/A b/A/A\nc/A/A")
    assert states(apply_rules(df, parse_rules("RULE: w_-1=ZZZ => st=X\nRULE: w_1=ZZZ st_0=A => st=Y"), SCHEMA, planned=planned)) == ["X", "Y", "X"]


@pytest.mark.parametrize("planned", [0, 40])
def test_constraints(spark, planned):
    df = samples(spark, "known/A/A unknown/A/A twice/A/A")
    table = spark.createDataFrame([("known", ["A"], 0), ("twice", ["A"], 1), ("twice", ["B"], 2)], "w string, allowed array<string>, line int")
    got = apply_rules(df, parse_rules("RULE: st_0=A => st=B"), SCHEMA, constraints=[(("w",), "tr", table)], planned=planned)
    assert states(got) == ["A", "B", "B"]


def test_constraints_beside_a_vocabulary(spark):
    """Unknown keys and unknown classes go, lines without a known class don't replace earlier ones."""
    table = spark.createDataFrame([("a", ["A", "Z"], 0), ("a", ["Y"], 1), ("b", ["B"], 2), ("b", ["A", "B"], 3), ("new", ["A"], 4)], "w string, allowed array<string>, line int")
    words = spark.createDataFrame([("a", False), ("b", False), ("A", True), ("B", True)], "word string, is_class boolean")
    got = loadable(table, ("w",), words)
    assert sorted((r.w, list(r.allowed), r.line) for r in got.collect()) == [("a", ["A"], 0), ("b", ["A", "B"], 3), ("b", ["B"], 2)]
    df = samples(spark, "a/A/A b/B/B new/A/A")
    out = apply_rules(df, parse_rules("RULE: st_0=A => st=B\nRULE: st_0=B => st=A"), SCHEMA, constraints=[(("w",), "tr", got)])
    assert states(out) == ["A", "A", "A"]


NULLS = [(0, 0, "x", "A"), (0, 1, None, "A"), (0, 2, "y", None), (0, 3, "x", "A"), (None, 0, None, None), (None, 1, "y", "A")]


@pytest.mark.parametrize("path", ["planned", "long", "nested"])
@pytest.mark.parametrize(("rule", "wanted"), [
    ("w_-1=ZZZ => st=B", ["B", "A", None, "A", "B", "A"]),  # a null neighbour isn't the padding
    ("w_-1=y => st=B", ["A", "A", None, "B", None, "A"]),
    ("w=y => st=B", ["A", "A", "B", "A", None, "B"]),  # a null state changes
    ("w:[-1,1]=x => st=B", ["B", "B", "B", "B", None, "A"]),
    ("st_1=A => st=C", ["C", "A", "C", "A", "C", "A"]),
    ("{w,st}=A => st=B", ["B", "B", None, "B", None, "B"]),
    ("w::1~~=x~~ => st=B", ["B", "A", None, "B", None, "A"]),
])
def test_nulls_in_all_paths(spark, path, rule, wanted):
    """Null features and states match nothing, and rows without a sequence's id are a sequence."""
    df = spark.createDataFrame([(*r, "T") for r in NULLS], "seq long, pos int, w string, st string, tr string")
    rules = parse_rules(f"RULE: {rule}")
    if path == "nested":
        got = streaming.flat(streaming.apply_nested(streaming.nested(df, SCHEMA), rules, SCHEMA), SCHEMA)
    else:
        got = apply_rules(df, rules, SCHEMA, planned=0 if path == "long" else 40)
    assert [r.st for r in sorted(got.collect(), key=lambda r: (r.seq is None, r.pos))] == wanted


def _shape(own):
    return F.regexp_replace(F.regexp_replace(own, "[A-Z]+", "X"), "[a-z]+", "x")


@pytest.mark.parametrize("path", ["planned", "long", "nested"])
def test_atoms_from_outside(spark, path):
    """An atom of one's own is parsed, learned and applied like the others."""
    register_atom("shape", lambda own, value: _shape(own) == value, lambda own: F.array(_shape(own)))
    df = samples(spark, "Abc/A/B de/A/A Xy/A/B\nfg/A/A H/A/A Kl/A/B")
    t = Templates.parse("w::shape => st\nw_-1::shape w::shape => st", SCHEMA)
    rules, _ = learn(df, t, Limits(threshold=1))
    assert [r.text().partition("RULE: ")[2] for r in rules] == ["w::shape=Xx => st=B"] and parse_rules(rules[0].text())[0].atoms == rules[0].atoms
    rules += parse_rules("RULE: w_1::shape=X => st=C\nRULE: w_-1::shape=ZZZ => st=D\nRULE: w_-1::shape=X => st=E")
    if path == "nested":
        got = streaming.flat(streaming.apply_nested(streaming.nested(df, SCHEMA), rules, SCHEMA), SCHEMA)
    else:
        got = apply_rules(df, rules, SCHEMA, planned=0 if path == "long" else 40)
    assert states(got) == ["E", "A", "C", "E", "A", "E"]  # the padding has a shape too
    with pytest.raises(ValueError):
        parse_atom("w::unknown")


def test_error_curve_of_a_long_list(spark):
    """Counted rule by rule, under a constraint, with several truths; as many rules as no single plan would hold."""
    schema = TaskSchema.parse("w st => tr", "|")
    df = samples(spark, "a/A/B|C b/A/A c/C/C\na/B/A b/B/C|B a/C/A d/A/D", schema)
    rules = parse_rules("\n".join(f"RULE: w_{k}={w} st_0={x} => st={y}" for k in (0, -1) for w in "abc" for x in "ABC" for y in "ABCD" if x != y))
    table = spark.createDataFrame([("a", ["A", "B"], 0)], "w string, allowed array<string>, line int")
    limits = [(("w",), "tr", table)]
    got = [r.errors for r in error_curve(df, rules, schema, constraints=limits).orderBy("rule").collect()]
    assert len(got) == len(rules) + 1 == 55 and len(set(got)) > 2
    for n in (0, 1, 7, 20, 54):
        after = apply_rules(df, rules[:n], schema, constraints=limits)
        assert got[n] == sum(r.st not in r.tr.split("|") for r in after.collect())


def test_tally_changes_like_a_new_tally(spark):
    """Counts kept up by changed rows are those of counting anew, also for templates that look at neighbours' states."""
    df = samples(spark, "a/A/B b/A/C a/C/B\nc/A/B a/A/B b/A/A c/B/B")
    t = Templates.parse("w => st\nst_-1 w => st\nst:[1,2] => st\nw_1 => st", SCHEMA)
    rule = Rule.parse("RULE: w_0=a => st=B")
    after = apply_rule(df.withColumn("_old_st", F.col("st")), rule, SCHEMA, mark="_changed")
    both = tallied(df, t).unionByName(changes(after, rule, t, (), {})).groupBy(*TALLY).agg(F.sum("cost").alias("cost")).where("cost <> 0")
    rows = lambda x: sorted(map(str, x.select(*TALLY, "cost").collect()))
    assert rows(both) == rows(tallied(after.select(*df.columns), t))


@pytest.mark.parametrize("planned", [0, 40])
def test_fake_class_is_traced_only(spark, planned):
    df = samples(spark, "a/A/A b/A/A")
    got = apply_rules(df, parse_rules("RULE: w_0=a => st=FAKE_CLASS\nRULE: st_0=A => st=B"), SCHEMA, trace=True, planned=planned)
    assert [(r.st, list(r.trace)) for r in got.orderBy("pos").collect()] == [("B", [0, 1]), ("B", [1])]


def test_long_and_planned_lists_agree(spark):
    df = samples(spark, "the/D/D dogs/N/N run/N/V fast/A/A\nrun/V/V dogs/N/N un/N/A")
    words = spark.createDataFrame([("dogs",), ("dog",), ("unrun",), ("run",)], "word string")
    pairs = spark.createDataFrame([("dogs", "run"), ("run", "fast")], "left string, right string")
    rules = parse_rules("RULE: w_0::~~1=~~s => st=S\nRULE: w::2++=un++ st_0=N => st=U\nRULE: w::--1=--s => st=P\nRULE: w^^1=run => st=Q\nRULE: w_-1^^1=run => st=R\nRULE: w:[-2,-1]=the st_0=A => st=T\nRULE: {w,st}=V => st=W\nRULE: w::1<>=u<> => st=Z")
    a, b = (states(apply_rules(df, rules, SCHEMA, words, pairs, planned=n)) for n in (0, 40))
    assert a == b and len(set(a)) > 3


def test_atoms_instantiate(spark):
    df = samples(spark, "abc/A/A ab/B/B", SCHEMA)
    got = lambda text, nulls=(): [sorted(r[0]) for r in df.select(values(parse_atom(text), nulls), "pos").orderBy("pos").collect()]
    assert got("w_-1") == [["ZZZ"], ["abc"]]
    assert got("w:[0,1]") == [["ab", "abc"], ["ZZZ", "ab"]]
    assert got("w::2~~") == [["ab"], []]  # a word of just the affix's length gives none, but the test holds
    assert got("w::1<>") == [["a", "b", "c"], ["a", "b"]]
    assert got("{w,st}", ("A",)) == [["abc"], ["B", "ab"]]
    assert [r[0] for r in df.select(fires(parse_atom("w::2~~"), F.lit("ab"))).collect()] == [True, True]
    words = spark.createDataFrame([("xabc",), ("b",), ("abs",)], "word string")
    for text, wanted in {"w::1++": [["x"], []], "w::++1": [[], ["s"]], "w::1--": [[], ["a"]], "w::--1": [[], []]}.items():
        a = parse_atom(text)
        listed = with_word_lists(df, [a], words)
        assert [sorted(r[0]) for r in listed.select(values(a), "pos").orderBy("pos").collect()] == wanted


def test_rows_of_a_frequent_word_stay_apart(spark):
    """Word lists go to the rows; these aren't shuffled by their word."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).selectExpr("id AS seq", "0 AS pos", "CASE WHEN id % 100 = 0 THEN 'b' ELSE 'a' END AS word")
        pairs = spark.createDataFrame([("a", "x"), ("a", "b"), ("c", "d")], "left string, right string")
        got = with_word_lists(rows, [parse_atom("word^^1")], None, pairs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
        assert {(r.word, tuple(r[got.columns[-1]])) for r in got.collect()} == {("a", ("b", "x")), ("b", ())} and got.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scores_are_error_changes(spark):
    df = samples(spark, "a/A/B b/A/A a/A/B\nc/B/B a/A/B b/A/B")
    t = Templates.parse("w => st\nw_-1 st => st", SCHEMA)
    for row in scored(df, t).collect():
        rule = Rule(t.items[row.template].atoms, tuple(row.tokens), ("st",), tuple(row.results))
        errors = [r.errors for r in error_curve(df, [rule], SCHEMA).orderBy("rule").collect()]
        assert errors[0] - errors[1] == row.score


def test_tie_break(spark):
    df = samples(spark, "a/A/B b/A/C")
    t = Templates.parse("w => st\nw st => st", SCHEMA)
    best = scored(df, t).orderBy(*order()).first()
    assert (best.template, list(best.tokens), list(best.results)) == (1, ["b", "A"], ["C"])  # more atoms, then the greater result


def test_learning_lowers_errors(spark):
    df = samples(spark, "a/A/B b/A/A a/A/B a/A/B\nb/A/A a/A/B c/A/C c/A/C c/A/C")
    rules, after = learn(df, Templates.parse("w => st", SCHEMA), Limits(threshold=0))
    assert [(r.values, r.results, r.score) for r in rules] == [(("a",), ("B",), 4), (("c",), ("C",), 3)]
    assert after.where("st <> tr").count() == 0


def test_two_targets(spark):
    schema = TaskSchema.parse("w s1 s2 => t1 t2")
    df = samples(spark, "a/A/A/B/C a/A/A/B/A b/A/A/A/A", schema)
    t = Templates.parse("w => s1 s2", schema)
    got = {tuple(r.results): (r.good, r.bad) for r in scored(df, t).collect()}
    assert got == {("B", "C"): (3, 1), ("B", "A"): (2, 0)}
    out = apply_rules(df, parse_rules("RULE: w=a => s1=B s2=C"), schema).orderBy("pos").select("s1", "s2").collect()
    assert [tuple(r) for r in out] == [("B", "C"), ("B", "C"), ("A", "A")]


def test_several_truths(spark):
    schema = TaskSchema.parse("w st => tr", "|")
    df = samples(spark, "a/A/B|C a/C/B|C b/A/A", schema)
    got = {tuple(r.results): r.good for r in candidates(df, Templates.parse("w => st", schema)).collect()}
    assert got == {("B",): 1, ("C",): 1}
    assert evaluate.accuracy(df, schema).first().correct == 2


def test_constraints_while_learning(spark):
    df = samples(spark, "a/A/B a/A/B a/A/B")
    no = spark.createDataFrame([("a", ["A"])], "w string, allowed array<string>")
    assert learn(df, Templates.parse("w => st", SCHEMA), Limits(threshold=0), constraints=[(("w",), "tr", no)])[0] == []


def test_texts_round_trip():
    text = "GOOD:3 BAD:1 SCORE:2 RULE: w_0::~~2=~~ed st:[-2,-1]=A=B $near=x => st=C"
    aliases = {"near": "{w,st}_1"}
    assert parse_rules("#head\n" + text, aliases)[0].text() == text
    assert parse_params("A = 1; # x\nB = ${A}/b;\n") == {"A": "1", "B": "1/b"}
    for bad in ("w::x~~", "w:[2,1]", "a=b=>"):
        with pytest.raises(ValueError):
            parse_atom(bad)
    with pytest.raises(ValueError):
        Templates.parse("nothing => st", SCHEMA)
    assert tagger_rule("NN s fhassuf 1 NNS 3") == "pos_0=NN word_0::~~1=~~s => pos=NNS"
    assert tagger_rule("NN VB PREVBIGRAM a b") == "pos_0=NN pos_-1=b pos_-2=a => pos=VB"
    assert chunk_template("P_1P0W13", {"P": "pos", "W": "word"}) == "pos_-1 pos_0 word:[1,3] => chunk"


def test_spans(spark):
    rows = [(0, i, g, t) for i, (g, t) in enumerate(zip("B I O I B I".split(), "B I O B I I".split()))]
    df = spark.createDataFrame(rows, "seq int, pos int, guess string, truth string")
    r = evaluate.f_measure(df, "guess", "truth").first()
    assert (r.guessed, r.expected, r.correct) == (3, 2, 1)


def test_brackets(spark):
    df = spark.createDataFrame([(0, i, o, c) for i, (o, c) in enumerate([(0.9, 0.1), (0.1, 0.1), (0.1, 0.9), (0.1, 0.1), (0.8, 0.8)])], "seq int, pos int, p_open double, p_close double")
    for solve in (brackets.shortest_spans, brackets.best_spans):
        assert states(solve(df), "label") == ["B", "I", "E", "O", "B"]


def test_long_spans(spark):
    """An opening and a closing 70 tokens apart, without and with a prior that allows all lengths."""
    df = spark.createDataFrame([(0, i, 0.9 if i == 2 else 0.01, 0.9 if i == 71 else 0.01) for i in range(75)], "seq int, pos int, p_open double, p_close double")
    for lengths in (None, {n: 1 / 75 for n in range(1, 76)}):
        assert states(brackets.best_spans(df, lengths), "label") == ["O"] * 2 + ["B"] + ["I"] * 68 + ["E"] + ["O"] * 3


def test_lexicon_and_guess(spark):
    df = samples(spark, "a/-/X a/-/Y a/-/Y b/-/Z")
    lex = lexicon.build(df, ["w"], "tr")
    assert {r.key[0]: list(r.classes) for r in lex.collect()} == {"a": ["Y", "X"], "b": ["Z"]}
    got = lexicon.most_likely(samples(spark, "a/-/X New/-/X new/-/X"), lex, [["w"]], "st", "nn", "NP")
    assert states(got) == ["Y", "NP", "nn"]


@pytest.mark.parametrize("sent", [1000, 3, 0])
def test_bigrams_of_arrays(spark, monkeypatch, sent):
    """Few and many words, with and without words that are surely not among them, give what windows over tokens give; no window is needed."""
    monkeypatch.setattr(lexicon, "SENT_WORDS", sent)
    texts = ["a b a b c", "d", "", "c a b x y z x", "b b b", None, "y c"]
    docs = spark.createDataFrame([(i, t.split() if t is not None else None) for i, t in enumerate(texts)], "seq long, words array<string>")
    tokens = docs.select("seq", F.posexplode("words").alias("pos", "word"))
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    for wanted in (["x", "b"], ["a", "x", "y", "z"], ["none"]):
        words = spark.createDataFrame([(w,) for w in wanted], "word string")
        never = lexicon.frequent_words(counts.join(words, "word", "left_anti"))
        assert never.count() <= sent
        plain = [t.split() for t in texts if t]
        want = Counter((p, q) for w in plain for p, q in zip(w, w[1:]) if p in wanted or q in wanted)
        for df in (lexicon.bigrams_with(docs, "words", words), lexicon.bigrams_with(docs, "words", words, never), lexicon.frequent_bigrams(lexicon.bigrams(tokens, "word"), words)):
            assert {(r.left, r.right): r.n for r in df.collect()} == dict(want) and df.count() == len(want)
        assert "Window" not in lexicon.bigrams_with(docs, "words", words, never)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bigrams_frequent", "unseen_bigrams"])
def test_bigram_queries_sort_no_tokens(spark, sf_dir, name):
    assert "Window" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_tree(spark):
    rows = [(i, 0, [0] if i < 12 else [], "a" if i % 2 else "b", "X" if i < 12 else "Y") for i in range(30)]
    df = spark.createDataFrame(rows, "seq int, pos int, trace array<int>, f string, tr string")
    root = tree.grow(df, "tr", 1, ["f"])
    assert (root.rule, root.yes.counts, root.no.counts) == (0, {"X": 12}, {"Y": 18})
    assert tree.Node.from_json(root.to_json()).yes.counts == {"X": 12}
    assert tree.classified(df, root, 2).where("leaf = 0").count() == 12


def test_tree_by_brute_force(spark):
    """Leaves and their counts are those of splitting all rows rule by rule, nulls among them."""
    r = random.Random(4)
    rows = [(i, 0, None if i % 50 == 0 else [k for k in range(8) if r.random() < (0.02, 0.9, 0.5, 0.3, 0.1, 0.97, 0.4, 0.2)[k]], r.choice("abc"), r.choice("XYZ")) for i in range(400)]
    df = spark.createDataFrame(rows, "seq int, pos int, trace array<int>, f string, tr string")

    def split(part, rules):
        for n, k in enumerate(rules):
            yes = [x for x in part if k in (x[2] or [])]
            if len(yes) >= 20 and len(part) - len(yes) >= 20:
                return split(yes, rules[n + 1 :]) + split([x for x in part if k not in (x[2] or [])], rules[n + 1 :])
        return [sorted(x[0] for x in part)]

    root = tree.grow(df, "tr", 8, least=20)
    got = {}
    for x in tree.classified(df, root, 3).select("leaf", "seq").collect():
        got.setdefault(x.leaf, []).append(x.seq)
    assert [sorted(got[k]) for k in sorted(got)] == split(rows, range(8)) and len(got) > 5
    empty = tree.grow(df.limit(0), "tr", 8, ["f"])
    assert (empty.leaf, empty.counts) == (0, {})


def test_deep_tree(spark):
    """Long lists split one leaf after another; such a tree is written, read and used as it is."""
    root = node = tree.Node(leaf=0)
    for k in range(1500):
        node.leaf, node.rule, node.yes, node.no = None, k, tree.Node(leaf=k), tree.Node(leaf=1500)
        node = node.no
    again = tree.Node.from_json(root.to_json())
    assert [n.leaf for n in tree._leaves(again)] == list(range(1501))
    df = spark.createDataFrame([([7, 9],), ([1499],), ([],), (None,)], "trace array<int>")
    assert [r.leaf for r in df.select(tree.leaf_of(again).alias("leaf")).collect()] == [7, 1499, 1500, 1500]


def test_stream(spark, tmp_path):
    df = samples(spark, "a/A/A a/A/A\na/A/A")
    streaming.nested(df, SCHEMA).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    streaming.run_stream(source, parse_rules("RULE: st_-1=A => st=B"), SCHEMA, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert states(streaming.flat(spark.read.parquet(str(tmp_path / "out")), SCHEMA)) == ["A", "B", "A"]


def test_learn_rules_runs_to_its_threshold(spark, tmp_path):
    """Each of six languages needs a rule of its own."""
    rows = [(i, f"{a}o{a}o{a}", f"l{i}", "s", 5) for i, a in enumerate("bdfgkm") for _ in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = learn_rules(spark, str(tmp_path)).collect()
    assert [(r.rule, r.good, r.bad, r.score) for r in got] == [(i, 5, 0, 5) for i in range(6)]
    assert {r.text.split("state=")[-1] for r in got} == {f"l{i}" for i in range(6)}
