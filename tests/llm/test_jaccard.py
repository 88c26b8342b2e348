import random
import re

import pyarrow as pa
import pytest

from pointloom.llm import jaccard


def brute(rows, n=5, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], []
    passage = rng.choices(vocabulary, k=60)
    for _ in range(25):
        base.append(rng.choices(vocabulary, k=rng.randrange(20, 150)))
        if rng.random() < 0.5:
            base[-1] = base[-1][:30] + passage
    for _ in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append(" ".join(w).upper() if rng.random() < 0.1 else rng.choice([" ", "\n", "\t "]).join(w))
    rows += ["", None, " \n", "one", "One", "one two three four", "one two three four five", "É é", "é é", "a b" * 3000, "a b" * 3000 + " c", " x "]
    ids = rng.sample(range(1000), len(rows))
    return [*zip(ids, rows, strict=True), (5000, rows[0]), (5000, rows[7]), (None, rows[3]), (None, "nowhere else at all in here"), (None, rows[3] + " tail"), (None, "z1 z2 z3 z4 z5 z6 " * 5), (None, "z1 z2 z3 z4 z5 z6 " * 4), (-3, rows[9])]


@pytest.mark.parametrize("hot", [jaccard.HOT, -1])
def test_matches_brute_force(spark, hot, monkeypatch):
    if hot < 0:  # every n-gram is dealt over several tasks, in blocks of three classes a task
        monkeypatch.setattr(jaccard, "HOT", 0.5)
        monkeypatch.setattr(jaccard, "ROUNDS", 1)
        monkeypatch.setattr(jaccard, "LANE", 3)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int").repartition(6)
    assert sorted((tuple(r) for r in jaccard.link(docs).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("lane", [jaccard.LANE, 2])
def test_every_link(spark, lane, monkeypatch):
    monkeypatch.setattr(jaccard, "LANE", lane)
    rows = corpus()
    links, members = jaccard.class_links(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int").repartition(5))
    got, of = sorted(((r.doc_id, r.n_links) for r in members.collect()), key=str), {}
    words = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset({tuple(w)} if w else ()) for w in words]
    similar = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    assert got == sorted(((d, sum(similar(s, x) for x in sets) - bool(s)) for (d, _), s in zip(rows, sets, strict=True)), key=str)
    for r in members.collect():
        of.setdefault(r.class_id, set()).update(s for (d, _), s in zip(rows, sets, strict=True) if d == r.doc_id and d is not None)
    assert all(r.u < r.v and r.u in of and r.v in of for r in links.collect())
    distinct = {s for s in sets if s}
    assert links.count() == links.distinct().count() == sum(similar(a, b) for a in distinct for b in distinct if a != b) // 2


def test_empty_table(spark):
    links, members = jaccard.class_links(spark.createDataFrame([], "doc_id long, text string"))
    assert links.collect() == members.collect() == []
    assert jaccard.link(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bound_is_never_too_small():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 90, rng.integers(1, 80))).astype(np.uint64) for _ in range(2))
        assert jaccard.suffix_bound(x, y) >= len(np.intersect1d(x, y))


@pytest.mark.parametrize("step", [1, 7, 60, 10_000])
def test_pruning_does_not_depend_on_batches(step):
    """One class between two that link, given by many tasks; then a group that is large only by repeats, and a large one."""
    rows = [(1, 0, 1, 100), *[(1, 0, 2, 200)] * 120, (1, 0, 3, 100)]
    rows += [(2, 0, k // 30, 100 + 50 * (k // 30)) for k in range(90)] + [(3, 0, k // 2, 2**k % 997) for k in range(400)]
    fields = pa.schema([("gram", pa.int64()), ("salt", pa.int32()), ("cls", pa.int64()), ("place", pa.int64())])
    whole = pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], schema=fields)
    got = [tuple(r.values()) for b in jaccard._shared(80)([whole.slice(i, step) for i in range(0, len(rows), step)]) for r in b.to_pylist()]
    assert [r[:2] for r in got] == [(1, 1), (1, 3), *((3, k) for k in range(200))]


def test_copies_over_many_partitions(spark):
    """A longer text's copies, one a task, stand between two similar texts in each n-gram they share."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(104)]
    more = " ".join(f"m{i}" for i in range(30))

    def cls(text):
        batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
        return int(jaccard.class_ids(*jaccard.set_hashes(*jaccard.utf8(batch.column("text")), 5))[0])

    while True:
        rng.shuffle(words)
        a, b, c = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(words) + " " + more
        if min(cls(a), cls(b)) < cls(c) < max(cls(a), cls(b)):
            break
    parts = [[(1000 + k, c), *((2000 + 10 * k + i, more) for i in range(4))] for k in range(64)]
    parts[3].append((1, a))
    parts[9].append((2, b))
    docs = spark.createDataFrame(spark.sparkContext.parallelize(parts, 64).flatMap(lambda p: p), "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = sorted((tuple(r) for r in jaccard.link(docs).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute([r for p in parts for r in p])


def alternating(k, first):
    """Words of a and b by the parity of their places' bits; the two of a length collide under any polynomial hash modulo 2**64."""
    return "".join("ab"[(i.bit_count() + first) % 2] for i in range(k))


def test_long_words_that_collide_in_polynomials(spark):
    rows = [(k, f"one two {alternating(2**j, k % 2)} four five") for j in (10, 11) for k in range(10 * j, 10 * j + 4)]
    assert sorted((tuple(r) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute(rows)


def test_overlaps():
    import numpy as np

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64) for _ in range(20)]
    got = jaccard.overlaps(sets, columns=17)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(20) for j in range(20) if i != j)


@pytest.mark.parametrize("chunk", [6])
def test_large_group_of_near_copies(spark, chunk, monkeypatch):
    """Near copies of a text, some too far from most of them, come out whole, with columns of clashing names beside them."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "CARRIED", min(3, jaccard.CARRIED) if chunk == 6 else jaccard.CARRIED)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(160):
        w = list(words)
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame([(d, t, 1, 2, 3, 4) for d, t in rows], "doc_id long, text string, cls int, label int, th int, node int").repartition(8)
    assert sorted((tuple(r) for r in jaccard.link(docs).collect()), key=str) == brute(rows)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


def test_components(spark):
    from pointloom.llm.components import components

    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 90)] + [(300 - k, 299 - k) for k in range(0, 70, 3)] + [(500, 500 + rng.randrange(1, 60)) for _ in range(80)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    assert got == {k: v for k, v in label.items() if k != v}
