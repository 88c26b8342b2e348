import itertools
import random
import re

from pyspark.sql import functions as F

from pointloom.llm import licenses


def brute(text, templates=licenses.TEMPLATES, percent=licenses.PERCENT):
    text = text or ""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x)
    w, base = cut(low), []
    for label, phrase in licenses.BASE.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    found = []
    for end, least in ((r"[.!?][ \t\n]|\n", 1), (r"[.!?][ \t\n]|\n[ \t]*\n", licenses.WRAPPED)):
        for block, (label, t) in itertools.product(re.split(end, low), templates):
            have, t = set(cut(block)), set(licenses.tokens(t))
            if len(t) >= least and 100 * len(t & have) >= percent * len(t):
                found.append((label, len(t & have) / len(t)))
    places = [i for i, _ in base]
    joined = lambda x: ",".join(sorted(set(x)))
    return (len(w), len(base), min(places, default=None), max(places, default=None), joined(x for _, x in base), joined([x for _, x in base] + [x for x, _ in found]), max((s for _, s in found), default=0.0))


def texts():
    rng = random.Random(6)
    bits = [t for _, t in licenses.TEMPLATES] + list(licenses.BASE.values()) + ["CC BY-NC", "UNDER  the\tMIT-license", "Apache License, Version 2.0.", "der Text über", "x_mit_y", "é", "license", ". ", "\n", "! ", "2", "the", "version"]
    out = []
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            b = rng.choice(bits)
            w = b.split(" ")
            if rng.random() < 0.4 and len(w) > 3:
                del w[rng.randrange(len(w))]
            if rng.random() < 0.2:
                rng.shuffle(w)
            parts.append(rng.choice([str.upper, str, str])(" ".join(w)))
        out.append(rng.choice([" ", ". ", "\n", "-", "é"]).join(parts))
    mit = dict((len(t), t) for label, t in licenses.TEMPLATES if label == "mit")
    wrapped = max(mit.values(), key=len).replace(" this software", "\n  this software").replace(" free of", "\nfree of")
    return [None, "", " ", *out, wrapped, wrapped.replace("\n", "\n\n"), "mit " * 20000, "under the mit license " * 3000, "a" * 50000]


def test_matches_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, words string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in licenses.scan(docs).collect()}
    for i, t in rows:
        assert got[i] == brute(t), (t or "")[:200]


def test_other_threshold_repeated_rows_and_empty(spark):
    rows = [(1, t) for t in texts()[:60]] + [(None, "MIT License, released under")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[1:] for r in licenses.scan(docs, percent=50).collect()), key=str)
    assert got == sorted((brute(t, percent=50) for _, t in rows), key=str)
    assert licenses.scan(docs.limit(0)).collect() == []


def test_plan_has_no_python(spark):
    plan = licenses.scan(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    assert not re.search("Python|Arrow|Cartesian|NestedLoop", plan._jdf.queryExecution().executedPlan().toString())


def test_templates_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    rows = list(enumerate(texts()[:40]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in licenses.scan(docs).collect()} == {i: brute(t) for i, t in rows}
