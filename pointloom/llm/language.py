"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Weights are trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled texts (PER_LANGUAGE of
each language, chosen by a hash), whole texts each; document frequencies count every training document. One temperature, fitted on
sampled texts kept out of training, calibrates the probabilities. Only the text is an input of a prediction.

Null text or no letter: "und" with score 0. Without any labelled text every document is "und". Rows are judged one by one.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.arrowtext import U64, mix, slices, utf8
from pointloom.llm.shared import summed_vectors

ORDERS = (1, 2, 3)
BINS = 1 << 15
SCALE = 30.0
PER_LANGUAGE = 250
#: Follow-the-regularised-leader: rate, smoothing, absolute and squared penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 4
SLICE = 1 << 20
UNKNOWN = "und"

_fold = np.arange(1 << 16, dtype=np.uint32)
_letter = np.zeros(1 << 16, bool)
for _c in range(1 << 16):
    _x = chr(_c)
    _letter[_c] = _x.isalpha()
    _fold[_c] = ord(_l) if len(_l := _x.lower()) == 1 else _c
    if _x.isspace():
        _fold[_c] = 32
    elif _x.isdigit():
        _fold[_c] = 48


def letters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters, offsets in characters, and whether each row has a letter."""
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    small = np.minimum(chars, 0xFFFF)
    is_letter = _letter[small]
    for i in np.flatnonzero(chars > 0xFFFF).tolist():
        is_letter[i] = chr(chars[i]).isalpha()
    own = begins[at]
    count = np.concatenate([[0], np.cumsum(is_letter)])
    return np.where(chars > 0xFFFF, chars, _fold[small]), own, count[own[1:]] > count[own[:-1]]


def gram_bins(chars: np.ndarray) -> np.ndarray:
    """Bins of all n-grams of one text."""
    c, out = chars.astype(U64), []
    for n in ORDERS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, U64(n))
            for k in range(n):
                h = h * U64(0x100000001B3) + c[k : len(c) - n + 1 + k]
            out.append((mix(h) & U64(BINS - 1)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def term_counts(data, at):
    """(row has a letter, its counts by bin) of each row."""
    chars, own, has = letters(data, at)
    for i in range(len(own) - 1):
        yield has[i], np.bincount(gram_bins(chars[own[i] : own[i + 1]]), minlength=BINS)


def _frequencies(batches):
    total, seen = np.zeros(BINS, np.uint64), False
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            for _, counts in term_counts(*utf8(part.column("text"))):
                total += counts > 0
                seen = True
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([zlib.compress(total.astype("<u8").tobytes(), 1)], pa.binary())], ["segment", "cells"])


def _sparse(batches):
    """Bins and counts of sampled texts."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            bins, counts = [], []
            for _, c in term_counts(*utf8(part.column("text"))):
                own = np.flatnonzero(c)
                bins.append(own.astype("<i4").tobytes()), counts.append(c[own].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("fold"), pa.array(bins, pa.binary()), pa.array(counts, pa.binary())], ["lang", "fold", "bins", "counts"])


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (bins and a bias, classes) by FTRL-proximal steps, one text at a time in a fixed shuffled order."""
    z, n = np.zeros((BINS + 1, classes)), np.zeros((BINS + 1, classes))
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)).tolist():
            bins, x, y = rows[i]
            w = weights_of(z[bins], n[bins])
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[bins] + g * g) - np.sqrt(n[bins])) / ALPHA
            z[bins] += g - step * w
            n[bins] += g * g
    return weights_of(z, n)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of scores with the least log loss."""
    grid = np.exp(np.linspace(-3, 3, 121))
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, heat: float):
        self.languages, self.weights, self.heat = languages, weights, heat

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Scores by language; the weights already hold the inverse document frequencies."""
        return SCALE * (counts @ self.weights[:-1]) / max(1, counts.sum()) + self.weights[-1]


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """labelled: doc_id, text, lang, fold (int; fold 3 calibrates). Every language is learned: weights take 8 BINS bytes for each."""
    labelled = labelled.where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not sizes:
        return Model([], np.zeros((BINS + 1, 0)), 1.0)
    share = F.create_map(*(x for r in sizes for x in (F.lit(r.lang), F.lit(min(1.0, per_language / r["count"])))))
    picked = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < 1_000_000 * F.coalesce(share[F.col("lang")], F.lit(0.0)))
    picked = picked.select("lang", "fold", "text").mapInArrow(_sparse, "lang string, fold int, bins binary, counts binary").collect()
    df = summed_vectors(labelled.select("text").mapInArrow(_frequencies, "segment int, cells binary"))[0]
    idf = np.log((1 + sum(r["count"] for r in sizes)) / (1 + df)) + 1
    languages = sorted(r.lang for r in sizes)
    rows, held = [], []
    for r in sorted(picked, key=lambda r: (r.lang, r.fold, r.bins, r.counts)):
        bins, counts = np.frombuffer(r.bins, "<i4"), np.frombuffer(r.counts, "<i4")
        x = np.append(SCALE * counts * idf[bins] / max(1, counts.sum()), 1.0)
        (held if r.fold == 3 else rows).append((np.append(bins, BINS), x, languages.index(r.lang)))
    rows += [r for r in held if r[2] not in {y for *_, y in rows}]  # a language whose sample is all in the calibrating fold
    w = fit(rows, len(languages))
    s = np.array([x @ w[bins] for bins, x, _ in held]).reshape(-1, len(languages))
    heat = temperature(s, np.array([y for *_, y in held])) if held else 1.0
    w[:-1] *= idf[:, None]
    return Model(languages, w, heat)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, held_out, text) -> doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.heat))

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                said, sure = [], []
                for has, counts in term_counts(*utf8(part.column("text"))):
                    if not has or not m.languages:
                        said.append(UNKNOWN), sure.append(0.0)
                        continue
                    p = softmax(m.scores(counts) / m.heat)
                    said.append(m.languages[int(p.argmax())]), sure.append(float(p.max()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(said, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", folds: int = 4, held: int = 2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score: learned from documents whose crc32(doc_id) mod folds isn't held. A null doc_id is held out."""
    df = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("string").alias("text"), docs[lang_column].cast("string").alias("lang"))
    df = df.withColumn("fold", (F.crc32(F.col("doc_id").cast("string")) % folds).cast("int")).withColumn("held_out", F.coalesce(F.col("fold") == held, F.lit(True)))
    return predict(df, train(df.where("not held_out"), per_language)).withColumnRenamed("doc_id", id_column)
