import random

import pytest

from pointloom.llm import windows


def brute(rows, window):
    first = {}
    cut = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in cut:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in cut:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "cc", "é", "The", "the", "x,", "日本"])
    passages = [" ".join(word() for _ in range(rng.randrange(60, 130))) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 80))) for _ in range(3)]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            parts.insert(rng.randrange(4), p)
        rows.append((i * 7 % 61, rng.choice([" ", "\n", " \t\x0b", " "]).join(parts)))
    rows += [(100, rows[5][1]), (100, rows[6][1]), (101, rows[5][1]), (101, rows[5][1]), (102, None), (103, ""), (104, " \n"), (None, rows[5][1]), (None, None)]
    rows += [(105, "z " * 400), (106, "z " * 120 + "y"), (107, "q " * 49), (108, "q " * 50), (109, "q " * 50), (110, "w" * 5000 + " " + passages[0] * 3)]
    return rows


@pytest.mark.parametrize("hot", [windows.HOT, 3])
def test_matches_brute_force(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, th string").repartition(5)
    got = sorted((tuple(r) for r in windows.remove_repeats(docs, hot=hot).collect()), key=str)
    assert got == brute(rows, windows.WINDOW)


def test_other_lengths_and_empty(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in windows.remove_repeats(docs, window=12, mer=3).collect()), key=str)
    assert got == brute(rows, 12)
    assert windows.remove_repeats(docs.limit(0)).collect() == []


def alternating(k, first):
    """a and b by the parity of their places' bits; the two of a length collide under any polynomial hash modulo 2**64."""
    return ["ab"[(i.bit_count() + first) % 2] for i in range(k)]


def test_words_that_collide_in_polynomials(spark):
    tail = " ".join(f"t{i}" for i in range(49))
    rows = [(k, "".join(alternating(2**j, k % 2)) + f" {tail} {k // 2}") for j in (10, 11) for k in range(4 * j, 4 * j + 4)]
    rows += [(100 + k, " ".join(alternating(64, k))) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in windows.remove_repeats(docs).collect()), key=str) == brute(rows, windows.WINDOW)
