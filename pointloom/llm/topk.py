"""Exact top-k by inner product for a stated query set: vectors bucketed by length, buckets pruned by length or by one coordinate.

Candidates are dealt over shards of bounded size by hash, once; the queries go to every shard and are answered in blocks as they stream by,
so what is shuffled is the points plus the queries times the shards. Each shard orders its own by length and cuts them into buckets. For a query with k answers
so far, the k-th score divided by both lengths is the bucket's local cosine threshold: above 1 the bucket is skipped; at COORDINATE or
more, only candidates whose coordinate lies in the range that the threshold allows on the query's largest coordinate are verified;
below, those long enough. Shards' answers are merged by rank. Products are exact integers.

Rows with a null vec_id, a null vector, or null or non-finite components take no part. Vectors of different dimension don't meet.
A vec_id repeated among queries is answered once, for its least vector; repeated candidates are ranked each. A query's own vec_id is no candidate. Ties go to the smaller vec_id. Other columns aren't looked at; an empty
table gives no rows. Scores are exact while they fit 64 bits, that is for components of up to about 1.4e6 in 64 dimensions.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
BUCKET = 1024
SHARD_ROWS = 16384
QUERY_ROWS = 2048
COORDINATE = 0.6
SLACK = 1e-9


def quantized(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each component, of rows that take part."""
    v = vectors.select(vectors[id_column].cast("bigint").alias("id"), vectors[vector_column].cast("array<double>").alias("e"))
    v = v.where("id is not null and e is not null and forall(e, x -> x is not null and abs(x) < double('Infinity'))")
    return v.select("id", F.transform("e", lambda x: F.floor(x * scale)).cast("array<bigint>").alias("v"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


class Answers:
    """The k best (score, id) of each query so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int, kind):
        self.k, self.least = k, np.iinfo(np.int64).min if kind == np.int64 else -np.inf
        self.scores, self.ids = np.full((n, k), self.least, kind), np.zeros((n, k), np.int64)

    def floor(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray):
        touched, place = np.unique(query, return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        s, i = np.concatenate([self.scores[touched].ravel(), scores]), np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(touched)))[q]
        top = rank < self.k
        self.scores[touched], self.ids[touched] = s[top].reshape(-1, self.k), i[top].reshape(-1, self.k)


def search(query_ids, queries, ids, vectors, k: int = K, counts: dict | None = None) -> Answers:
    """The k best of vectors for each query; both integer matrices."""
    big = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    kind = np.float64 if big < 2**53 else np.int64
    q, p = queries.astype(kind), vectors.astype(kind)
    q_len, p_len = (np.sqrt((x.astype(float) ** 2).sum(1)) for x in (q, p))
    order = np.argsort(-p_len, kind="stable")
    p, p_len, ids = p[order], p_len[order], ids[order]
    unit = np.divide(q, q_len[:, None], out=np.zeros(q.shape), where=q_len[:, None] > 0)
    focus = np.abs(unit).argmax(1) if q.shape[1] else np.zeros(len(q), int)
    out = Answers(len(q), k, kind)
    counts = counts if counts is not None else {}
    for start in range(0, len(p), BUCKET):
        own, lengths, names = p[start : start + BUCKET], p_len[start : start + BUCKET], ids[start : start + BUCKET]
        floor = out.floor().astype(float)
        reach = q_len * lengths[0]
        live = ~(floor > reach * (1 + SLACK) + SLACK)
        counts["skipped"] = counts.get("skipped", 0) + int((~live).sum())
        cosine = np.divide(floor, reach, out=np.full(len(q), -np.inf), where=(reach > 0) & np.isfinite(floor))
        by_coordinate = live & (cosine >= COORDINATE)
        if by_coordinate.any():
            t = np.minimum(1, cosine - SLACK)
            f = unit[np.arange(len(q)), focus]
            spread = np.sqrt(np.maximum(0, 1 - t * t, where=np.isfinite(t), out=np.zeros(len(q))) * np.maximum(0, 1 - f * f))
            low = np.where(f <= -t, -1.0, f * t - spread) - 1e-7
            high = np.where(f >= t, 1.0, f * t + spread) + 1e-7
            small = np.divide(own, lengths[:, None], out=np.zeros(own.shape), where=lengths[:, None] > 0)
            for c in np.unique(focus[by_coordinate]).tolist():
                rank = np.argsort(small[:, c], kind="stable")
                line = small[rank, c]
                mine = np.flatnonzero(by_coordinate & (focus == c))
                a, b = np.searchsorted(line, low[mine], "left"), np.searchsorted(line, high[mine], "right")
                for i, x, y in zip(mine.tolist(), a.tolist(), b.tolist(), strict=True):
                    if y - x > len(own) // 2:
                        by_coordinate[i] = False  # the range keeps too much: as by length
                        continue
                    some = rank[x:y]
                    s = own[some] @ q[i]
                    good = (s >= floor[i]) & (names[some] != query_ids[i])
                    counts["verified"] = counts.get("verified", 0) + len(some)
                    if good.any():
                        out.add(np.full(int(good.sum()), i), s[good], names[some[good]])
        rest = np.flatnonzero(live & ~by_coordinate)
        if len(rest):
            enough = np.where(np.isfinite(floor[rest]), np.divide(floor[rest] * (1 - SLACK), q_len[rest], out=np.full(len(rest), -np.inf), where=q_len[rest] > 0), -np.inf)
            n = int((lengths >= enough.min() - SLACK).sum())  # lengths descend
            s = q[rest] @ own[:n].T
            counts["verified"] = counts.get("verified", 0) + s.size
            s[query_ids[rest][:, None] == names[None, :n]] = out.least
            limit = out.floor()[rest]
            if n > k:
                limit = np.maximum(limit, np.partition(s, n - k, axis=1)[:, n - k])
            i, j = np.nonzero((s >= limit[:, None]) & (s > out.least))
            if len(i):
                out.add(rest[i], s[i, j], names[j])
    return out


def _answers(k: int, query_rows: int):
    """Of rows sorted by dim, shard and asks: a shard's points are kept, and its queries, which come after them, are answered as they come."""

    def run(batches):
        key, held, points = None, [], None
        for batch in batches:
            dims, shards, asks = (batch.column(c).to_numpy() for c in ("dim", "shard", "asks"))
            if not len(dims):
                continue
            cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(dims)], strict=True):
                if key != (dims[a], shards[a]):
                    key, held, points = (dims[a], shards[a]), [], None
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                elif held:
                    if points is None:
                        table = pa.Table.from_batches(held)
                        points = table.column("id").to_numpy(), _matrix(table.column("v"), int(key[0]))
                    for first in range(a, b, query_rows):
                        some = pa.Table.from_batches([batch.slice(first, min(query_rows, b - first))])
                        names = some.column("id").to_numpy()
                        got = search(names, _matrix(some.column("v"), int(key[0])), *points, k)
                        i, j = np.nonzero(got.scores > got.least)
                        yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(got.ids[i, j]), pa.array(got.scores[i, j].astype(np.int64))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each row whose id is divisible by every."""
    points = quantized(vectors, id_column, vector_column, scale)
    # Equal rows beyond k can't be among the answers' k places, so repeats of one row never fill a shard.
    points = points.groupBy("id", "v").agg(F.count("*").alias("n")).withColumn("n", F.explode(F.expr(f"sequence(1L, least(n, {k + 1}L))")))
    points = points.select("id", "v", F.size("v").alias("dim"))
    asked = points.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    shards = max(1, -(-quantized(vectors, id_column, vector_column, scale).count() // SHARD_ROWS))
    here = points.select("dim", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "id", "v")
    there = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "id", "v")
    dealt = here.unionByName(there).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks")
    found = dealt.mapInArrow(_answers(k, QUERY_ROWS), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
