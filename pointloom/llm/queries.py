"""One query for each operator, over the whole of its table; each is thin and takes its rows from the operator."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op8_bpe_speculate_verify(spark, sf_dir):
    import public_tokenizers

    from pointloom.llm import bpe

    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)


@query
def op3_flac_media(spark, sf_dir):
    from pointloom.llm import flac

    return flac.describe(_table(spark, sf_dir, "documents"))


@query
def op10_super_kmer_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from pointloom.llm import windows

    out = windows.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_SPLIT = r"[^\x20\x09-\x0D]+"

ORACLES["op10_super_kmer_dedup"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPLIT}') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win FROM p),
f AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT k.doc_id, unnest(range(k.i, k.i + 50)) AS j FROM k JOIN f ON k.win = f.win AND f.first < k.doc_id),
x AS (SELECT doc_id, list(j) AS js FROM g GROUP BY doc_id),
e AS (SELECT w.doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w JOIN x USING (doc_id)),
c AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.j) AS kept FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.j = g.j WHERE g.j IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN js IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query
def op9_ngram_jaccard_join(spark, sf_dir):
    from pointloom.llm import jaccard

    return jaccard.link(_table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op9_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPLIT}') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM x JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT y.d, r.c FROM r JOIN (SELECT u AS d, v AS o FROM e UNION SELECT v, u FROM e) y ON y.o = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""


@query
def op5_pii_boosted_spans(spark, sf_dir):
    from pointloom.llm import pii

    return pii.digest(_table(spark, sf_dir, "documents"))


@query
def op1_license_containment(spark, sf_dir):
    from pointloom.llm import licenses

    return licenses.scan(_table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    from pointloom.llm import licenses

    as_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"('{label}', {as_list(licenses.tokens(t))})" for label, t in licenses.TEMPLATES)
    phrases = ", ".join(f"('{label}', {as_list(p.split())})" for label, p in licenses.BASE.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH t(label, ws) AS (VALUES {templates}), p(label, ws) AS (VALUES {phrases}),
d AS (SELECT doc_id, {_LOWER} AS low FROM documents),
w AS (SELECT doc_id, low, regexp_extract_all(low, '{word}') AS ws FROM d),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
b AS (SELECT i.doc_id, i.i - 1 AS place, p.label FROM i JOIN p ON i.ws[i.i:i.i + len(p.ws) - 1] = p.ws),
k AS (SELECT doc_id, 1 AS least, list_distinct(regexp_extract_all(unnest(string_split_regex(low, '[.!?][ \\t\\n]|\\n')), '{word}')) AS ks FROM d
  UNION ALL SELECT doc_id, {licenses.WRAPPED}, list_distinct(regexp_extract_all(unnest(string_split_regex(low, '[.!?][ \\t\\n]|\\n[ \\t]*\\n')), '{word}')) FROM d),
f AS (SELECT k.doc_id, t.label, len(list_intersect(t.ws, k.ks)) / len(t.ws) AS score FROM k, t WHERE len(t.ws) >= k.least AND 100 * len(list_intersect(t.ws, k.ks)) >= {licenses.PERCENT} * len(t.ws)),
bb AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM b GROUP BY doc_id),
ff AS (SELECT doc_id, max(score) AS score FROM f GROUP BY doc_id),
ll AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM f) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(bb.n, 0) AS BIGINT) AS n_base, CAST(bb.lo AS BIGINT) AS first_word,
       CAST(bb.hi AS BIGINT) AS last_word, coalesce(bb.ls, '') AS base_labels, coalesce(ll.ls, '') AS labels, CAST(coalesce(ff.score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN bb USING (doc_id) LEFT JOIN ff USING (doc_id) LEFT JOIN ll USING (doc_id)
"""


ORACLES["op1_license_containment"] = _license_sql()


@query
def op2_topk_norm_buckets(spark, sf_dir):
    from pointloom.llm import topk

    return topk.top_k(_table(spark, sf_dir, "embeddings"))


ORACLES["op2_topk_norm_buckets"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, CAST(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op7_language_ftrl(spark, sf_dir):
    from pointloom.llm import language

    return language.identify(_table(spark, sf_dir, "documents"))


@query
def op6_quality_empirical_bayes(spark, sf_dir):
    from pointloom.llm import quality

    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), columns=["doc_id", "source", "lang"])


@query
def op4_best_fit_packing(spark, sf_dir):
    from pointloom.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"))
