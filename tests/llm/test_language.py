import random
import zlib

import pytest

from pointloom.llm import language

SYLLABLES = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ich", "er"], "cc": ["ção", "oes", "qui", "lhe"]}


def rows(n=400):
    rng = random.Random(1)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang if rng.random() < 0.9 else rng.choice(list(SYLLABLES))]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 120))]
        out.append((i, " ".join(words).title(), None if rng.random() < 0.2 else lang, lang))
    return out


def test_held_out_accuracy_and_contract(spark):
    data = rows()
    odd = [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "123 !?\n", "bb", None), (1003, "ich " * 60000, None, "bb"), (None, "mira kato", "aa", "aa"), (1004, "\U0001d400", None, None), (5, "mira", "aa", "aa")]
    docs = spark.createDataFrame([(*r[:3], "x") for r in data + odd], "doc_id long, text string, lang string, fold string").repartition(4)
    got = language.identify(docs).collect()
    assert len(got) == len(data) + len(odd)
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    for i, text, _, _ in data + odd:
        if i not in (None, 5):
            assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
            assert (by[i].lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
            assert 0 <= by[i].score <= 1
    held = [(by[i].lang_pred, lang) for i, _, _, lang in data if i != 5 and by[i].held_out]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.97
    assert by[1003].lang_pred == "bb"


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify(docs).collect()] == ["und"]
    assert language.identify(docs.limit(0)).collect() == []


def test_penalty_makes_weights_sparse():
    import numpy as np

    rng = np.random.default_rng(0)
    data = [(np.append(rng.choice(400, 30, replace=False), language.BINS), np.append(rng.random(30), 1.0), int(i % 2)) for i in range(60)]
    w = language.fit(data, 2)
    assert 0 < (w[:400] != 0).mean() < 1 and not w[400:-1].any()
    assert language.temperature(np.array([[8.0, 0], [0, 8.0], [8.0, 0]]), np.array([0, 1, 1])) == pytest.approx(8 / np.log(2), rel=0.1)


def test_every_language_is_learned(spark):
    """More languages than any limit would let through, each with one word that marks it; one of them only in the calibrating fold."""
    rows = [(100 * k + i, f"q{chr(97 + k % 26)}{chr(97 + k // 26)}z " * 12, f"l{k}") for k in range(70) for i in range(8)]
    alone = next(i for i in range(90_000, 90_100) if zlib.crc32(str(i).encode()) % 4 == 3)
    rows.append((alone, "ωψω " * 12, "alone"))
    out = language.identify(spark.createDataFrame([*rows, (99_999, "ωψω " * 9, None)], "doc_id long, text string, lang string")).collect()
    truth = {i: lang for i, _, lang in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in out if r.doc_id in truth) >= 0.97 * len(rows)
    assert {r.lang_pred for r in out if r.doc_id == 99_999} == {"alone"}
