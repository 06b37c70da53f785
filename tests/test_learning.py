"""The learner against one in plain Python: rules, order, pruned candidates, and rules without a bad row."""

import random
from collections import Counter

import pytest

from rulewright.operators import learn as learning
from rulewright.operators.learn import Limits, learn, scored_cells, scored_tally, celled, tallied
from rulewright.plans.spec import PAD, TaskSchema, Templates

SCHEMA = TaskSchema.parse("w x st => tr")
OWN = "w => st\nw st => st\nx st => st\nw x => st"
NEAR = "w => st\nst_-1 w => st\nx_1 st => st"


def corpus(seed, n=60, classes="ABC"):
    r = random.Random(seed)
    return [(s, p, r.choice("abcde"), r.choice("xyz"), r.choice(classes), r.choice(classes + "A")) for s in range(n // 4) for p in range(4)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, pos int, w string, x string, st string, tr string")


class Plain:
    """One rule a turn, all counts anew each time."""

    def __init__(self, rows, templates):
        self.rows, self.templates = [dict(zip(("seq", "pos", "w", "x", "st", "tr"), r)) for r in rows], templates.items

    def tokens(self):
        """For each row its (template, tokens)."""
        at = {(r["seq"], r["pos"]): r for r in self.rows}
        for r in self.rows:
            look = lambda c, k, r=r: at.get((r["seq"], r["pos"] + k), {}).get(c, PAD)
            yield r, [(n, tuple(look(a.column, a.offset) for a in t.atoms)) for n, t in enumerate(self.templates)]

    def counts(self, instances):
        good, bad, right = Counter(), Counter(), {}
        for r, own in instances:
            for n, v in own:
                if r["st"] != r["tr"]:
                    good[n, v, r["tr"]] += 1
                else:
                    right.setdefault((n, v), Counter())[r["tr"]] += 1
        for key in {*good, *(self.live or ())}:
            bad[key] = sum(c for truth, c in right.get(key[:2], {}).items() if truth != key[2])
        return good, bad

    def learn(self, limits):
        rules, self.live = [], None
        before = list(self.tokens())
        good, bad = self.counts(before)
        if limits.lists_candidates:
            self.live = {k for k, n in good.items() if n > limits.least_good}
        while True:
            ranked = [(n - bad[k], len(k[1]) if limits.sized_order else 0, k[2], -k[0], k[1], k) for k, n in good.items() if n > (0 if self.live is not None else limits.least_good) and (self.live is None or k in self.live)]
            best = max(ranked, default=None)
            if best is None or best[0] <= limits.threshold:
                break
            (n, v, result) = best[-1]
            rules.append((n, v, result, best[0]))
            # what each row counts for, before and after
            tally = lambda rows: Counter((n, v, r["st"], r["tr"]) for r, own in rows for n, v in own)
            was = tally(before)
            hits = [r for r, own in before if (n, v) in own and r["st"] != result]
            for r in hits:
                r["st"] = result
            before = list(self.tokens())
            if self.live is not None:
                self.live |= {(n, v, truth) for (n, v, st, truth), c in (tally(before) - was).items() if st != truth}
            good, bad = self.counts(before)
            if self.live is not None and (limits.useless >= 0 or limits.factor >= 0):
                gone = lambda k: (limits.useless >= 0 and bad[k] > limits.useless) if not good[k] else (limits.factor >= 0 and bad[k] * limits.factor >= good[k])
                self.live = {k for k in self.live if not gone(k)}
        if limits.redundant is not None:
            least = self.least(limits, rules)
            forced = Counter((n, v, r["tr"]) for r, own in before for n, v in own)
            more = [(c, len(k[1]) if limits.sized_order else 0, k[2], -k[0], k[1], k) for k, c in forced.items() if c >= least and k in self.live and bad[k] == 0]
            rules += [(*k, c) for c, *_, k in sorted(more)]
        return rules

    def least(self, limits, rules):
        text = limits.redundant
        if text.endswith("%"):
            return int(text[:-1]) * len(self.rows) // 100
        return max(limits.least_redundant, rules[0][3] + int(text)) if int(text) < 0 else int(text)


CASES = {
    "plain": Limits(threshold=1),
    "one rule a turn": Limits(threshold=0, batch=1, write_every=2),
    "many at once": Limits(threshold=0, batch=32, write_every=7),
    "few candidates": Limits(threshold=1, least_good=4),
    "useless": Limits(threshold=0, useless=1),
    "outweighed": Limits(threshold=0, useless=0, factor=0.8),
    "without bad rows": Limits(threshold=2, redundant="2"),
    "in a hundred": Limits(threshold=2, redundant="4%", sized_order=False),
    "below the first": Limits(threshold=2, redundant="-5", least_redundant=2),
}


@pytest.mark.parametrize("case", CASES)
def test_learner(spark, case):
    limits = CASES[case]
    templates, rows = Templates.parse(OWN, SCHEMA), corpus(len(case), 80)
    rules, after = learn(frame(spark, rows), templates, limits)
    plain = Plain(rows, templates)
    want = plain.learn(limits)
    number = lambda r: next(i for i, t in enumerate(templates.items) if t.atoms == r.atoms)
    assert [(number(r), r.values, r.results[0], r.score) for r in rules] == want and len(want) > 3
    assert Counter((r.seq, r.pos, r.st) for r in after.collect()) == Counter((r["seq"], r["pos"], r["st"]) for r in plain.rows)


@pytest.mark.parametrize("limits", [Limits(threshold=1), Limits(threshold=1, useless=2, factor=0.9, redundant="3")])
def test_learner_with_neighbours(spark, limits):
    templates, rows = Templates.parse(NEAR, SCHEMA), corpus(5, 60)
    rules, _ = learn(frame(spark, rows), templates, limits)
    number = lambda r: next(i for i, t in enumerate(templates.items) if t.atoms == r.atoms)
    assert [(number(r), r.values, r.results[0], r.score) for r in rules] == Plain(rows, templates).learn(limits)


def test_rules_that_touch_each_other_are_tried_alone(spark, monkeypatch):
    """Where only the first of two stays the best, most turns take one rule and check nothing; rules are the same."""
    calls, templates = [], Templates.parse(OWN, SCHEMA)
    monkeypatch.setattr(learning._State, "verified", lambda self, rules, delta: calls.append(1) or 1)
    rules, _ = learn(frame(spark, corpus(3, 80)), templates, Limits(threshold=0, max_rules=8), samples=False)
    want = Plain(corpus(3, 80), templates).learn(Limits(threshold=0))[:8]
    assert [(r.values, r.results[0], r.score) for r in rules] == [x[1:] for x in want] and len(rules) == 8
    assert len(calls) <= 4


def test_rows_without_a_sequence_change_the_tally(spark):
    """They are one sequence, whose rows see each other: rules are those of the same rows under an id."""
    templates, rows = Templates.parse(NEAR, SCHEMA), [(0, i, *r[2:]) for i, r in enumerate(corpus(5, 40))]
    want, _ = learn(frame(spark, rows), templates, Limits(threshold=1))
    got, none = learn(frame(spark, [(None, *r[1:]) for r in rows]), templates, Limits(threshold=1), samples=False)
    assert got == want and len(want) > 2 and none is None


def test_cells_count_as_tallies_do(spark):
    """Also with several truths and several targets."""
    schema = TaskSchema.parse("w s1 s2 => t1 t2", "|")
    r = random.Random(2)
    rows = [(i, 0, r.choice("ab"), r.choice("AB"), r.choice("AB"), r.choice(["A", "B|C", "C"]), r.choice("AB")) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, pos int, w string, s1 string, s2 string, t1 string, t2 string")
    tally = tallied(df, Templates.parse("w => s1 s2\nw s1 => s1", schema))
    shown = lambda x: sorted(map(str, x.select("template", "tokens", "results", "good", "bad", "score").collect()))
    assert shown(scored_cells(celled(tally), 0, -1000)) == shown(scored_tally(tally))


@pytest.mark.parametrize("limits", [dict(threshold=0), dict(threshold=1, sized_order=False, redundant="2"), dict(threshold=0, redundant="1")])
@pytest.mark.parametrize("constrained", [False, True])
def test_cells_apart_learn_at_once(spark, limits, constrained, monkeypatch):
    """One template of features: the rules, their order and the samples are those of the loop, which isn't entered."""
    templates = Templates.parse("w x => st", SCHEMA)
    df = frame(spark, [*corpus(5, 240), (900, 0, None, "x", "A", "B"), (900, 1, None, "x", "A", "B"), (900, 2, None, "x", "B", "B")][: 240 if limits["threshold"] == 0 else None])
    bounds = [(("w",), "tr", spark.createDataFrame([("a", ["A", "B"]), ("b", ["C"])], "w string, allowed array<string>"))] if constrained else None
    some = df.where("w is not null")
    want, after = learn(some, templates, Limits(batch=1, **limits), constraints=bounds)
    monkeypatch.setattr(learning._State, "best", None)
    got, now = learn(df, templates, Limits(**limits), constraints=bounds)
    assert len(want) > 5
    assert [(r.values, r.results, r.good, r.bad, r.score) for r in got] == [(r.values, r.results, r.good, r.bad, r.score) for r in want]
    assert sorted(map(tuple, now.where("w is not null").collect())) == sorted(map(tuple, after.collect()))
    assert now.columns == df.columns and now.count() == df.count()
