"""Document quality: a classifier's evidence combined with host and path posteriors by hierarchical empirical Bayes.

A logistic regression on shape features, fitted to a bounded sample of labelled documents, gives each document's chance of being good.
Grouped sums of those chances give hosts and, within them, paths a posterior mean each, shrunk toward the level above by Beta priors
whose strengths come from the spread between groups. A document's log odds move by how far its path (its host and path without the document
itself) is from the global mean. Documents below the threshold are rejected. Where the host's column holds a URL, its host and the first
segment of its path are the levels; else the two columns' values are.

Null text counts as empty. A null host or path is a group of its own. Ties at the threshold are kept. An empty table gives no rows. Empty texts are rejected. Repeated rows are judged each by itself.
Without labels every document with words is kept.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.arrowtext import slices, spaced_words, utf8, word_hashes
from pointloom.llm.shared import stored

#: Labelled documents that the classifier is fitted to, at most about so many.
SAMPLE = 4000
#: Log odds a document must reach; and how much of the path's shift it takes.
THRESHOLD, WEIGHT = 0.0, 1.0
#: Group tables of up to so many rows are broadcast; larger ones are joined by shuffle, salted over SALTS.
BROADCAST_ROWS, SALTS = 100_000, 16
NAMES = ["words", "word_length", "symbols", "pipes", "digits", "upper", "repeats", "distinct", "lines", "bad_ends"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*@^~<>{}[]\\=_")] = True


def shape(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Features of each row, all bounded."""
    starts, ends, first = spaced_words(data, at)
    n, size = np.diff(first), np.maximum(np.diff(at), 1)
    per = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[at]) / size
    h = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[1:] != row[:-1])
    m = np.maximum(n, 1)
    marked = _SYMBOL[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    by = lambda hit: np.bincount(row, hit, len(n)) / m
    return np.stack([
        np.minimum(np.log1p(n), 8), np.minimum(np.bincount(row, ends - starts, len(n)) / m, 40), np.minimum(per(_SYMBOL[data]), 0.5), per(data == ord("|")), per((data >= 48) & (data <= 57)),
        per((data >= 65) & (data <= 90)), by(same), np.bincount(row, new, len(n)) / np.maximum(n, 1) ** 0.85, np.minimum(per(data == 10), 0.2), by(marked),
    ], 1)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights (bias last) of a ridge logistic regression by Newton steps."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def _logits(batches, model):
    """The row and its log odds; null for texts without words."""
    for batch in batches:
        for part in slices(batch, "text"):
            x = shape(*utf8(part.column("text")))
            if model is None:
                s = np.full(len(x), 1.0)
            else:
                mean, spread, w = model
                s = np.clip(np.hstack([(x - mean) / spread, np.ones((len(x), 1))]) @ w, -12, 12)
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("h"), part.column("p"), pa.array(s, mask=x[:, 0] == 0)], ["row", "h", "p", "evidence"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality"):
    """The classifier, or None if there aren't both kinds of labels."""
    known = labels.where(labels[label_column].isNotNull() & labels[id_column].isNotNull()).groupBy(labels[id_column].cast("bigint").alias("id")).agg(F.max(label_column).cast("int").alias("y"))
    n = known.count()
    picked = known.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n))))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = shape(*utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    texts = docs.select(docs[id_column].cast("bigint").alias("id"), docs[text_column].cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), "id").select("y", "text").mapInArrow(run, "y int, x array<double>").collect()
    y = np.array([r.y > 0 for r in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    x = np.array([r.x for r in rows])
    order = np.lexsort((*x.T, y))  # whatever order they came in
    return fit(x[order], y[order])


def _strength(level: DataFrame) -> float:
    """Of the Beta prior over groups (n, mean, above: the mean a level up), by moments: mean (1 - mean) / between-group variance - 1."""
    m = level.agg(F.sum(F.expr("n * (mean - above) * (mean - above)")).alias("spread"), F.sum(F.expr("above * (1 - above)")).alias("noise"), F.sum(F.expr("n * above * (1 - above)")).alias("room"), F.sum("n").alias("n")).first()
    if not m.n or not m.room:
        return 1e6
    between = max(m.spread - m.noise, 1e-9) / m.n
    return float(min(max(m.room / m.n / between - 1, 1.0), 1e6))


def posteriors(evidence: DataFrame) -> DataFrame:
    """(h, p, path_n, path_sum, host, host_n, host_sum, host_k, prior, k): sums by path and host, the host's posterior mean, the global mean
    and the strengths of the hosts' and the paths' priors."""
    paths = stored(evidence.groupBy("h", "p").agg(F.count("chance").alias("n"), F.coalesce(F.sum("chance"), F.lit(0.0)).alias("s")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = total.s / total.n if total.n else 0.5
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("mean", F.expr("s / greatest(n, 1)")).withColumn("above", F.lit(prior))
    k = _strength(hosts.where("n > 0"))
    hosts = hosts.select("h", ((F.col("s") + k * prior) / (F.col("n") + k)).alias("host"), F.col("n").alias("host_n"), F.col("s").alias("host_sum"), F.lit(k).alias("host_k"))
    both = paths.join(hosts, "h")
    own = _strength(both.where("n > 0").select("n", F.expr("s / n").alias("mean"), F.col("host").alias("above")))
    return stored(both.select("h", "p", F.col("n").alias("path_n"), F.col("s").alias("path_sum"), "host", "host_n", "host_sum", "host_k", F.lit(prior).alias("prior"), F.lit(own).alias("k")), "posteriors")


def _judged(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_column: str = "doc_id", text_column: str = "text", columns: list[str] | None = None, threshold: float = THRESHOLD, weight: float = WEIGHT) -> DataFrame:
    """Columns c0, c1, ... of docs in a struct row, and what is judged."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_column=id_column, text_column=text_column))
    site = docs[host].cast("string")
    of_url = lambda part: F.when(site.contains("://"), F.try_parse_url(site, F.lit(part)))
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731  null is a name of its own
    hosts, paths = named(F.coalesce(of_url("HOST"), site)), named(F.coalesce(F.regexp_extract(of_url("PATH"), "^/[^/]*", 0), docs[path].cast("string")))

    def scored(names):
        row = F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(names))) if names else F.struct(F.lit(1).alias("c"))
        df = docs.select(row.alias("row"), hosts.alias("h"), paths.alias("p"), docs[text_column].cast("string").alias("text"))
        kind = df.schema["row"].dataType.simpleString()
        return df.mapInArrow(lambda b: _logits(b, model.value), f"row {kind}, h string, p string, evidence double")

    names = columns or docs.columns
    groups = posteriors(scored([]).select("h", "p", F.expr("1 / (1 + exp(-evidence))").alias("chance")))
    df = scored(names)
    if groups.count() <= BROADCAST_ROWS:
        df = df.join(F.broadcast(groups), ["h", "p"], "left")
    else:
        df = df.withColumn("salt", F.pmod(F.xxhash64("row.c0", "evidence"), F.lit(SALTS)))
        df = df.join(groups.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))), ["h", "p", "salt"], "left")
    of_host = "(host_sum - coalesce(1 / (1 + exp(-evidence)), 0) + host_k * prior) / (host_n - int(evidence is not null) + host_k)"
    df = df.withColumn("host", F.expr(of_host))
    alone = "(path_sum - coalesce(1 / (1 + exp(-evidence)), 0) + k * host) / (path_n - int(evidence is not null) + k)"
    df = df.withColumn("path_posterior", F.expr(alone))
    odds = lambda x: f"ln(greatest({x}, 1e-9) / greatest(1 - {x}, 1e-9))"
    df = df.withColumn("log_odds", F.expr(f"evidence + {weight!r}D * ({odds('path_posterior')} - {odds('prior')})"))
    added = [F.col("evidence"), F.col("host").alias("host_posterior"), "path_posterior", "log_odds", F.expr(f"coalesce(log_odds >= {threshold!r}D, false)").alias("keep")]
    return df.select("row", *added)


def judge(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, **how) -> DataFrame:
    """The given columns of docs (default: all) with evidence, host_posterior, path_posterior, log_odds and keep; columns of docs named so are left out."""
    names = columns or docs.columns
    df = _judged(docs, labels, columns=names, **how)
    added = df.columns[1:]
    return df.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names) if c not in added), *added)


def kept(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs without those rejected, with the same columns."""
    df = _judged(docs, labels, columns=docs.columns, **how)
    return df.where("keep").select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
