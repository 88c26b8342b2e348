import random
import re

import corpus_pipeline
from tests.llm.test_jaccard import brute as brute_links
from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_quality_packing import check_bins, documents
from tests.llm.test_windows import brute as brute_windows


def tables(spark, path):
    rng = random.Random(2)
    rows, labels = documents(160)
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s, _ in rows]
    passage = " ".join(rng.choice("abcdefg") + str(i) for i in range(70))
    good = [r for r in rows if r[0] in {i for i, y, _ in labels if y}]
    rows += [(1000 + i, r[1] + " tail", "en", "a", 0) for i, r in enumerate(good[:20])]
    rows += [(2000 + i, f"{good[20 + i][1]}. {passage}. Write to a.b{i}@mail.example.com or call +1 (743) 555-38{i + 10} now.", "en", "b", 0) for i in range(10)]
    rows += [(3000, None, "en", "a", 0), (3001, "", None, None, None), (None, good[40][1], "en", "a", 1), (good[41][0], good[41][1], "en", "a", 1)]
    rows = [(*r, "x", 1, None, 2.0, r[0], "y") for r in rows]  # columns whose names the operators use inside
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, redacted string, th int, row string, label double, node long, spans string").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_against_plain_versions(spark, tmp_path):
    d = str(tmp_path)
    tables(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, at = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
        docs.write.parquet(f"{d}/{len(at)}")
        docs = spark.read.parquet(f"{d}/{len(at)}")
        at.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=str))
    assert {1000, 2000} < {i for i, _ in at[0]} and 3000 not in {i for i, _ in at[0]}
    linked = {i for i, _, c in brute_links(at[0]) if i == c}
    assert {i for i, _ in at[1]} == linked and len(at[1]) == len(linked)
    cleaned = {d: (k if n else dict(at[1])[d]) for d, _, n, k in brute_windows(at[1], 50)}
    assert dict(at[2]) == cleaned and any(n for _, _, n, _ in brute_windows(at[1], 50))
    for i, text in at[2]:
        spans = brute_spans(text)
        if spans:
            assert "[EMAIL]" in dict(at[3])[i] and "@" not in dict(at[3])[i]
    assert sum("[PHONE]" in t for _, t in at[3]) == 10
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    check_bins(packed, {i: len(re.findall(r"[^ \t-\r]+", t)) for i, t in at[3]}, corpus_pipeline.packing.CAPACITIES)
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, d).collect()) == sorted((r.doc_id, r.n_tokens) for r in packed)
