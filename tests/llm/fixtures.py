"""Small documents with every odd case, and brute-force versions of what operators count."""

import random
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, words string, row long, key string, id string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"{r.choice('abcdefgh')}w{r.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"x{r.randrange(10**6)}" for w in text.split(" "))


def odd_rows():
    """(doc_id, text, lang): nulls, empties, repeats, ties, a very long text, near and exact copies."""
    base = prose(1, 120)
    rows = [(i, prose(10 + i, 60 + i), "en") for i in range(8)]
    rows += [(20 + i, edited(base, i, 0.02), "de") for i in range(12)] + [(40, base, "de"), (41, base.upper(), "de"), (42, base, None)]
    rows += [(50, None, "en"), (51, "", "en"), (52, " \t\n\x0b", None), (53, "one", "fr"), (54, "One", "fr"), (55, "a b c d", "fr"), (None, base, "en"), (None, None, None), (56, "é\x00ü 漢字 🙂", "fr")]
    rows += [(60, prose(3, 60), "en"), (60, prose(3, 60), "en"), (60, prose(4, 60), "en")]
    rows += [(70, prose(5, 30_000, 50_000), "en"), (71, "z" * 200_000, "en"), (72, "same " * 3000, "en")]
    return rows


def documents(spark, rows):
    return spark.createDataFrame([(i, t, g, "src", len(t) if t else None, "clash", None, 1, "k", "x") for i, t, g in rows], SCHEMA)
