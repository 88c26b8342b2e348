"""Packing documents into sequences of several permitted lengths by best fit, each bin as long as its contents need in the end.

Documents longer than the longest length are cut into pieces of it and a rest. Pieces are dealt over shards of bounded size by a hash, and
each shard packs its own, longest first: into the open bin with the least room that suffices, else into a new bin. Its length is the
permitted one of least cost for each token it is going to hold: every length is filled on trial with the pieces that are left, the longest
that fits first, and counts what it would shrink to. When all are placed, each bin shrinks to the shortest permitted length that holds
its contents. A sequence's cost is its length plus a fixed part plus attention's share, which grows with the square of the length.

Null or empty texts have no tokens and no piece. Rows of equal doc_id are told apart by their text's hash; ties of length go by doc_id,
that hash and the piece's number. Equal rows are packed each for itself. Columns of docs but the id and the text aren't looked at. An empty
table gives no rows. The number of shards follows the number of pieces, so that a shard is bounded; more documents may move pieces.
"""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
#: A sequence's fixed cost in tokens, and the length at which attention costs as much as all the rest.
FIXED, ATTENTION = 16, 1 << 16
#: Pieces of a shard, about.
SHARD = 100_000


def cost(capacity: int, fixed: int = FIXED, attention: int = ATTENTION) -> float:
    return capacity + fixed + capacity * capacity / attention


def best_fit(lengths: list[int], capacities=CAPACITIES, fixed: int = FIXED, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (given in descending order), and each bin's final capacity."""
    capacities = sorted(capacities)
    count = Counter(lengths)  # of pieces left, by length, and the lengths as bits
    bits = sum(1 << n for n in count)
    rooms: dict[int, list[int]] = {}
    mask, used, place, offset = 0, [], [], []

    def filled(capacity: int, n: int) -> int:
        """Tokens of a bin that begins with n and takes the longest piece left that fits, again and again."""
        room, took, here = capacity - n, Counter(), bits
        while room and (fits := here & ((2 << room) - 1)):
            m = fits.bit_length() - 1
            k = min(count[m] - took[m], room // m)
            took[m] += k
            room -= k * m
            if took[m] == count[m]:
                here &= ~(1 << m)
        return capacity - room

    def opened(n: int) -> int:
        best = None
        for c in capacities:
            if c >= n:
                tokens = filled(c, n)
                final = min(x for x in capacities if x >= tokens)
                price = cost(final, fixed, attention) / tokens
                if best is None or price < best[0]:
                    best = price, final
        return best[1]

    for n in lengths:
        count[n] -= 1
        if not count[n]:
            bits &= ~(1 << n)
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(used), opened(n)
            used.append(0)
        place.append(b), offset.append(used[b])
        used[b] += n
        if room > n:
            rooms.setdefault(room - n, []).append(b)
            mask |= 1 << (room - n)
    return place, offset, [min(c for c in capacities if c >= u) for u in used]


def tokens_of(text: str = "text") -> str:
    """The default length: words between white space."""
    return f"size(filter(split({text}, '[ \\\\t-\\\\r]+'), w -> w <> ''))"


def pack(docs: DataFrame, capacities=CAPACITIES, fixed: int = FIXED, attention: int = ATTENTION, shard: int = SHARD, id_column: str = "doc_id", text_column: str = "text", length: str | None = None) -> DataFrame:
    """A row per piece: bin_id, capacity, bin_tokens, position, doc_id, piece, start (in the document), n_tokens, at (in the bin)."""
    top = max(capacities)
    sizes = docs.select(docs[id_column].cast("bigint").alias("doc_id"), F.xxhash64(docs[text_column]).alias("th"), F.expr(length or f"coalesce({tokens_of('`' + text_column + '`')}, 0)").cast("bigint").alias("n")).where("n > 0")
    pieces = sizes.withColumn("piece", F.explode(F.expr(f"sequence(0L, (n - 1) div {top})")))
    pieces = pieces.select("doc_id", "th", F.col("piece").cast("int").alias("piece"), F.expr(f"piece * {top}").alias("start"), F.expr(f"least({top}, n - piece * {top})").cast("int").alias("n_tokens"))
    total = sizes.agg(F.sum(F.expr(f"(n + {top} - 1) div {top}"))).first()[0] or 0
    shards = max(1, -(-total // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "th", "piece"), F.lit(shards)).cast("int"))
    allowed = tuple(capacities)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "th", "piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        place, offset, final = best_fit(rows["n_tokens"].tolist(), allowed, fixed, attention)
        rows["bin"], rows["at"] = place, offset
        rows["capacity"] = np.array(final)[rows["bin"]]
        rows["bin_tokens"] = rows.groupby("bin")["n_tokens"].transform("sum")
        rows["position"] = rows.groupby("bin").cumcount()
        rows["bin_id"] = [f"{rows['shard'].iloc[0]}-{b}" for b in place]
        return rows[["bin_id", "capacity", "bin_tokens", "position", "doc_id", "piece", "start", "n_tokens", "at"]]

    kind = "bin_id string, capacity int, bin_tokens bigint, position int, doc_id bigint, piece int, start bigint, n_tokens int, at bigint"
    return dealt.groupBy("shard").applyInPandas(run, kind).withColumnRenamed("doc_id", id_column)
