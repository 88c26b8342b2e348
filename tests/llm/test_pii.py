import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pointloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(2)
    bits = ["a.b@c.d", "x@y", "@", "é", "\U0001f600", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "0000255.1.2.3", "4111 1111-1111 1111", "4111111111111111", "411111111111111", "+1 (743) 555-3824", "+1", "+44 20.", "1", "23", ".", " ", "-", "+", "\n", "a@b.c_d@e.f", "(", "word", "__%", "a.b.c@d-e.f.g.", "99999999999999999999.1.1.1"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    return [None, "", *made, "a" * 60000, "1" * 60000, "a." * 20000 + "@" + "b." * 20000, "1 " * 20000, "a@b.c " * 30000, "+1 " + "(" * 20000, "1.2.3.4 " * 500]


@pytest.fixture(scope="module")
def models(spark):
    return pii.train(spark)


def test_base_spans_match_plain_patterns(spark, models):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.digest(docs, models=models).collect()}
    for i, t in rows:
        want = brute(t)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (t[:200], got[i])
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(x[2] == k for x in want) for k in PLAIN]
        assert set(joined.split(",")) <= set(got[i].spans.split(","))


def test_models_tell_snippets_apart(spark, models):
    made = pii.snippets()
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(made)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(docs, models=models).collect()}
    for kind in pii.GENERATORS:
        own = [(bool(re.search(rf"\b{kind}:", got[i])), y) for i, (k, _, y) in enumerate(made) if k == kind]
        assert sum(a == bool(y) for a, y in own) / len(own) > 0.93, kind


#: Spans in sentences of other makes than those of the training snippets: (kind, text, personal or not).
UNSEEN = [
    ("secret", "export AUTH_TOKEN=9f8e7d6c5b4a39281706f5e4d3c2", 1), ("secret", "his password is: hunter2x9q8z7w", 1), ("secret", "set secret = 7c6b5a4f3e2d1c0b9a8f", 1), ("secret", "API_KEY='00ff11ee22dd33cc44bb'", 1),
    ("secret", "the password: something", 0), ("secret", "token = identifier", 0), ("secret", "a key: understanding", 0), ("secret", "secret: gardening", 0),
    ("hex", "commit key 3f786850e387550fdab836ed7e6dc881de23001b leaked", 1), ("hex", "<a94a8fe5ccb19ba61c4c0873d391e987982fbbd3>", 1), ("hex", "see e99a18c428cb38d5f260853678922e03.", 1),
    ("hex", "a000000000000000", 0), ("hex", "fffffffffffffffffff", 0), ("hex", "cafecafecafecafe", 0),
    ("number", "please ring 415-555-2671 tonight", 1), ("number", "mobile: (212) 555-0199", 1), ("number", "his ssn was 219-09-9999", 1), ("number", "fax 303 555 0142 now", 1),
    ("number", "on 2019-11-23 we met", 0), ("number", "build 20.14.3021", 0), ("number", "serial 88123456", 0), ("number", "it was 3.141592653 exactly", 0),
    ("mail", "reach me: jane at example dot org", 1), ("mail", "bob [at] mail [dot] net please", 1), ("mail", "kim(at)site(dot)com", 1),
    ("mail", "we met at noon. Later", 0), ("mail", "stay at home. Always", 0), ("mail", "arrive at dawn. It", 0),
    ("iban", "pay to DE89 3704 0044 0532 0130 00 today", 1), ("iban", "account GB29 1234 6016 1331 9268 19", 1), ("iban", "FR14 2004 1010 0505 0001 30", 1),
    ("iban", "code XQ12 ABCD EFGH XYZA BCDE here", 0), ("iban", "AB99 HGFE DCBA ZYXH GFED", 0),
]


def test_models_on_unseen_sentences(spark, models):
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(UNSEEN)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(docs, models=models).collect()}
    hits = {kind: [(bool(re.search(rf"\b{kind}:", got[i])), y) for i, (k, _, y) in enumerate(UNSEEN) if k == kind] for kind in pii.GENERATORS}
    for kind, own in hits.items():
        print(kind, "found", sum(a for a, y in own if y), "of", sum(y for _, y in own), "wrongly", sum(a for a, y in own if not y), "of", sum(not y for _, y in own))
    every = [x for own in hits.values() for x in own]
    assert sum(a for a, y in every if y) >= 0.8 * sum(y for _, y in every)
    assert sum(a for a, y in every if not y) <= 0.2 * sum(not y for _, y in every)


def test_redaction_clashing_names_and_empty(spark, models):
    docs = spark.createDataFrame([(1, "é mail a@b.c, token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\" end", "x", "y"), (1, None, None, None)], "doc_id long, text string, spans string, row string")
    found = pii.find(docs.select("doc_id", "text"), models)
    assert sorted((r.x or "") for r in found.select(pii.redacted("text", "spans").alias("x")).collect()) == ["", 'é mail [EMAIL], [SECRET]" end']
    assert pii.digest(docs, models=models).count() == 2
    assert pii.digest(docs.limit(0), models=models).collect() == []
    plan = pii.digest(docs, models=models)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
    assert found.where(F.size("spans") < F.size("base_spans")).count() == 0
