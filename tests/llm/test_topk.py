import math
import random

import numpy as np
import pytest

from pointloom.llm import topk


def brute(rows, every, k):
    take = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in take:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in take if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def rows():
    rng = random.Random(4)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    out = []
    for i in range(700):
        size = 10 ** rng.uniform(-3, 1)
        out.append((i, [size * (c + rng.gauss(0, 0.2)) for c in rng.choice(centre)]))
    out += [(700, [0.0] * 8), (710, [1.0, 2.0]), (711, [3.0, 1.0]), (712, None), (720, [float("nan")] * 8), (721, [None] + [1.0] * 7), (730, [float("inf")] * 8), (None, [1.0] * 8), (740, []), (741, [])]
    out += [(20, out[20][1]), (20, out[21][1]), (5, out[5][1]), (9, [1e9] * 8)]
    return out


@pytest.mark.parametrize("shard,bucket,block", [(10000, 1024, 4096), (64, 16, 7)])
def test_matches_brute_force(spark, monkeypatch, shard, bucket, block):
    for name, value in (("SHARD_ROWS", shard), ("BUCKET", bucket), ("QUERY_ROWS", block)):
        monkeypatch.setattr(topk, name, value)
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows()], "vec_id long, embedding array<double>, shard int")
    assert sorted(tuple(r) for r in topk.top_k(docs, every=10).collect()) == brute(rows(), 10, 5)


def test_pruning_skips_work_and_stays_exact():
    rng = np.random.default_rng(1)
    p = np.floor(256 * rng.standard_normal((6000, 16)) * rng.lognormal(0, 1, (6000, 1))).astype(np.int64)
    q = p[:40]
    counts = {}
    got = topk.search(np.arange(40), q, np.arange(6000), p, 5, counts)
    assert counts["verified"] < 0.5 * 40 * 6000 and counts["skipped"] > 0
    for i in range(40):
        want = sorted((-int(s), j) for j, s in enumerate(p @ q[i]) if j != i)[:5]
        assert [(-int(s), int(j)) for s, j in zip(got.scores[i], got.ids[i], strict=True)] == want


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
