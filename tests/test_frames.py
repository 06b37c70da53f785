"""Streams of lines, cut anywhere, give what the whole file gives."""

import os
import random

import pytest

from rulewright.operators.apply import apply_rules
from rulewright.plans.spec import TaskSchema, parse_rules
from rulewright.sources import text
from rulewright.streaming import apply as streaming
from rulewright.streaming.frames import framed

SCHEMA = TaskSchema.parse("w st => tr")
RULES = "RULE: st_-1=A w_0=b => st=B\nRULE: w_-1=ZZZ => st=C\nRULE: st:[1,2]=B => st=D"


def corpus(seed):
    r = random.Random(seed)
    rows = ["" if r.random() < 0.25 else f"{r.choice('abc')} {r.choice('AB')}\t {r.choice('AB')}" for _ in range(60)]
    return [*rows, " \t", "a A A"]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_is_as_the_whole_file(spark, tmp_path, seed):
    """Two sources in pieces of random sizes, lines of a piece in any order, some twice, some before their turn."""
    wanted, lines, r = [], [], random.Random(seed)
    for name in ("one.txt", "two.txt"):
        rows = corpus(seed + len(lines))
        (tmp_path / name).write_text("\n".join(rows) + "\n")
        whole = apply_rules(text.read_samples(spark, str(tmp_path / name), SCHEMA), parse_rules(RULES), SCHEMA)
        wanted += sorted((name, int(x.seq.split("#")[1]), x.pos, x.w, x.st, x.tr) for x in whole.collect())
        lines += [(name, i, v) for i, v in enumerate(rows)] + [(name, len(rows), None)]
    order = sorted(lines, key=lambda x: x[1] + r.uniform(0, 8))
    order += r.sample(order, 10)
    schema, at = "source string, line long, value string", 0
    for piece in range(6):
        end = len(order) if piece == 5 else min(len(order), at + r.randrange(1, 30))
        path = tmp_path / "in" / f"{piece}"
        spark.createDataFrame(order[at:end], schema).coalesce(1).write.json(str(path))
        for f in path.glob("*.json"):
            os.utime(f, (1_700_000_000 + piece, 1_700_000_000 + piece))
        at = end
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    streaming.run_stream(framed(source, SCHEMA), parse_rules(RULES), SCHEMA, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = streaming.flat(spark.read.parquet(str(tmp_path / "out")), SCHEMA)
    shown = sorted((x.seq.split("#")[0], int(x.seq.split("#")[1]), x.pos, x.w, x.st, x.tr) for x in got.collect())
    assert shown == sorted(wanted) and len(shown) > 50


def test_wrong_number_of_fields_fails(spark, tmp_path):
    schema = "source string, line long, value string"
    spark.createDataFrame([("s", 0, "a A"), ("s", 1, "")], schema).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    with pytest.raises(Exception, match="2 fields, not 3"):
        streaming.run_stream(framed(source, SCHEMA), parse_rules(RULES), SCHEMA, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
