"""Removal of passages that an earlier document has, by exact counting of word windows in super-k-mers.

A window is WINDOW consecutive words. Its minimiser is the least hash among the runs of MER words in it; neighbouring windows with
the same minimiser form a super-k-mer. Equal windows have equal minimisers, so
  1. super-k-mers are listed by minimiser, and those whose minimiser only one document has are left;
  2. the others travel as one packed string each to the minimiser's bucket, which sorts all windows by 128 bits of their words and
     finds the smallest document of each; a minimiser with more than HOT super-k-mers is dealt over several buckets,
     whose first occurrences are then compared among each other;
  3. each document drops the words of its windows that a smaller doc_id has.

Null text: no words. Null doc_id: it neither removes nor loses words. Rows of equal doc_id don't affect each other.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.arrowtext import U64, mix, slices, spaced_words, utf8, word_hashes
from pointloom.llm.shared import stored

WINDOW = 50
MER = 8
HOT = 2000
#: Bytes of packed strings that a bucket's task sorts at once, besides one minimiser's.
CHUNK = 4 << 20
_LEFT, _RIGHT = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of neighbours; the shifts keep it from being a polynomial."""
    return (a ^ (a >> U64(29))) * _LEFT + (b ^ (b >> U64(32))) * _RIGHT


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of that many words, by its first word: runs of twice the length until two that overlap give the whole."""
    if len(words) < length:
        return np.zeros(0, U64)
    h, have = words, 1
    while 2 * have <= length:
        h, have = _joined(h[:-have], h[have:]), 2 * have
    rest = length - have
    return mix(_joined(h[:-rest], h[rest:]) if rest else h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:]) if len(x) > have else x[:0]
        have *= 2
    rest = width - have
    return x if not rest else np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]


def super_kmers(data: np.ndarray, at: np.ndarray, window: int, mer: int):
    """(row, first window counted from the row's start, number of windows, minimiser) of each super-k-mer."""
    starts, ends, first = spaced_words(data, at)
    counts = np.diff(first)
    least = sliding_min(run_hashes(word_hashes(data, starts, ends), mer), window - mer + 1)
    row = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    place = np.arange(len(least)) - first[row]
    inside = place + window <= counts[row]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (row[1:] != row[:-1]) | (least[1:] != least[:-1])
    head = np.flatnonzero(begins)
    size = np.add.reduceat(inside.astype(np.int64), head) if len(head) else head
    return row[head], place[head], size, least[head].view(np.int64)


def _listed(window: int, mer: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                row, place, size, least = super_kmers(*utf8(part.column("text")), window, mer)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("th").take(take), pa.array(least), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32))], ["doc_id", "th", "least", "place", "size"])

    return run


def _packed(window: int, hot: int):
    """Strings of the super-k-mers that a document was asked for."""

    def run(batches):
        for batch in batches:
            wanted = batch.filter(batch.column("need").is_valid())
            for part in slices(wanted, "text"):
                data, at = utf8(part.column("text"))
                starts, ends, first = spaced_words(data, at)
                need = part.column("need")
                own = np.repeat(np.arange(part.num_rows), np.diff(need.offsets.to_numpy()))
                flat = need.flatten()
                least, place, size, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                a = starts[first[own] + place]
                b = ends[first[own] + place + size + window - 2]
                raw = data.tobytes()
                strings = [raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                doc = part.column("doc_id").take(pa.array(own))
                salt = mix(np.asarray(doc).astype(np.int64).view(U64)) % np.maximum(1, (n + hot - 1) // hot).astype(U64)
                yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(salt.astype(np.int32)), pa.array(n > hot), doc, part.column("th").take(pa.array(own)), pa.array(place), pa.array(strings, pa.binary())], ["least", "salt", "hot", "doc_id", "th", "place", "packed"])

    return run


def _ranges(doc, th, place, owner, position, chosen):
    """(super-k-mer, from, to) of runs of chosen windows; position counts windows within the super-k-mer."""
    begin = chosen.copy()
    begin[1:] &= ~chosen[:-1] | (owner[1:] != owner[:-1])
    head = np.flatnonzero(begin)
    size = np.add.reduceat(chosen.astype(np.int64), head) if len(head) else head
    own = owner[head]
    start = place[own] + position[head]
    return doc[own], th[own], start, start + size


def _settled(window: int):
    """Within whole minimisers: ranges of windows that a smaller document has; first occurrences of hot ones stay open."""

    def judge(table: pa.Table):
        doc, th = table.column("doc_id").to_numpy(), table.column("th").to_numpy()
        place, hot = table.column("place").to_numpy(), table.column("hot").to_numpy()
        data, at = utf8(table.column("packed"))
        starts, ends, first = spaced_words(data, at)
        counts = np.diff(first)
        h1, h2 = (run_hashes(word_hashes(data, starts, ends, s), window) for s in (2, 3))
        row = np.repeat(np.arange(len(counts)), counts)[: len(h1)]
        position = np.arange(len(h1)) - first[row]
        inside = position + window <= counts[row]
        h1, h2, row, position = h1[inside], h2[inside], row[inside], position[inside]
        order = np.lexsort((doc[row], h2, h1))
        a, b, d = h1[order], h2[order], doc[row][order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        smallest = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else d
        later = np.zeros(len(order), bool)
        later[order] = d > smallest
        gone = _ranges(doc, th, place, row, position, later)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(gone[0]), pa.int64()), pa.array(gone[2] * 0 + np.arange(len(gone[0]))), *map(pa.array, gone[:2]), *(pa.array(x.astype(np.int32)) for x in gone[2:])], ["h1", "h2", "doc_id", "th", "start", "stop"])
        keep = np.flatnonzero(hot[row] & ~later)
        if len(keep):
            start = (place[row[keep]] + position[keep]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h1[keep].view(np.int64)), pa.array(h2[keep].view(np.int64)), pa.array(doc[row[keep]]), pa.array(th[row[keep]]), pa.array(start), pa.array(start + 1)], ["h1", "h2", "doc_id", "th", "start", "stop"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "packed"):
                held.append(part)
                size += part.column("packed").nbytes
                if size < CHUNK:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                least, salt = table.column("least").to_numpy(), table.column("salt").to_numpy()
                cut = int(np.flatnonzero((least == least[-1]) & (salt == salt[-1]))[0])  # sorted: the last key may go on
                if cut:
                    yield from judge(table.slice(0, cut).combine_chunks())
                    held = table.slice(cut).combine_chunks().to_batches()
                    size = sum(x.column("packed").nbytes for x in held)
        if held:
            yield from judge(pa.Table.from_batches(held).combine_chunks())

    return run


def _cleaned(window: int, with_row: bool = False):
    """Words that stay: those not in windows start..stop."""

    def run(batches):
        for batch in batches:
            texts, gone = batch.column("text").to_pylist(), batch.column("gone")
            kept, total, removed = [], [], []
            flat = gone.flatten()
            start, stop = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            valid = gone.is_valid().to_pylist()
            at = gone.offsets.to_numpy()
            base = at[0] if len(at) else 0
            for i, text in enumerate(texts):
                words = (text or "").encode().split()
                n = len(words)
                if valid[i] and at[i + 1] > at[i]:
                    edge = np.zeros(n + 1, np.int64)
                    s, e = start[at[i] - base : at[i + 1] - base], stop[at[i] - base : at[i + 1] - base]
                    np.add.at(edge, s, 1)
                    np.add.at(edge, e + window - 1, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, stays.tolist(), strict=True) if k]
                kept.append(b" ".join(words).decode())
                total.append(n), removed.append(n - len(words))
            if with_row:
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_removed", "kept"])
                continue
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "th", "n_words", "n_removed", "kept"])

    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW, mer: int = MER, hot: int = HOT) -> DataFrame:
    """(doc_id, th, gone): for each text with windows that a smaller doc_id has, their ranges (start, stop), counted in words.

    docs: doc_id bigint, text string, th bigint (a hash of the text, which tells rows of equal doc_id apart).
    """
    kinds = "doc_id bigint, th bigint, least bigint, place int, size int"
    listed = stored(docs.where("doc_id is not null").mapInArrow(_listed(window, mer), kinds), "super-kmers")
    several = listed.groupBy("least").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b").select("least", "n")
    need = listed.join(several, "least").groupBy("doc_id", "th").agg(F.collect_list(F.struct("least", "place", "size", "n")).alias("need"))
    packed = docs.join(need, ["doc_id", "th"], "left").mapInArrow(_packed(window, hot), "least bigint, salt int, hot boolean, doc_id bigint, th bigint, place int, packed binary")
    dealt = packed.repartition("least", "salt").sortWithinPartitions("least", "salt")
    found = dealt.mapInArrow(_settled(window), "h1 bigint, h2 bigint, doc_id bigint, th bigint, start int, stop int")
    # Settled ranges have no h1; each of them is a key of its own here.
    key = [F.coalesce("h1", F.xxhash64("doc_id", "th", "start", "h2")), F.col("h2")]
    smallest = F.min("doc_id").over(Window.partitionBy(*key))
    gone = found.withColumn("smallest", smallest).where("h1 is null or doc_id > smallest")
    return gone.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))


def clean_documents(docs: DataFrame, window: int = WINDOW, mer: int = MER, hot: int = HOT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with the same columns; texts that lose words become those that stay, joined by one space, others are as they were."""
    row = F.struct(*docs.columns).alias("row")
    chosen = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("string").alias("text"), row).withColumn("th", F.xxhash64("text"))
    gone = repeated_ranges(chosen.select("doc_id", "text", "th"), window, mer, hot)
    joined = chosen.join(gone, ["doc_id", "th"], "left")
    kind = f"row {joined.schema['row'].dataType.simpleString()}, n_removed bigint, kept string"
    cleaned = joined.select("row", "doc_id", "th", "text", "gone").mapInArrow(_cleaned(window, True), kind)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row")[text_column])
    return cleaned.select(*(text.alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns))


def remove_repeats(docs: DataFrame, window: int = WINDOW, mer: int = MER, hot: int = HOT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_removed and kept, the words that stay joined by one space."""
    chosen = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    gone = repeated_ranges(chosen, window, mer, hot)
    out = chosen.join(gone, ["doc_id", "th"], "left").mapInArrow(_cleaned(window), "doc_id bigint, th bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.col("doc_id").alias(id_column), "n_words", "n_removed", "kept")
