"""Near-duplicate documents: the components of all pairs whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Sets are ordered rarest n-gram first, so two similar sets share one among their first n - ceil(t n) + 1 n-grams. Steps:
  1. Each text gives its set; equal sets form a class, named by 128 bits, and only classes go on. A count sketch of fixed size, summed
     over all documents, gives the order (by its count, then by hash: any total order keeps the result exact, a rarer one makes fewer
     candidates).
  2. Prefix n-grams that several classes have are kept with position and set size; of each class that has one, a text is kept.
  3. Each class joins the blocks of its rarest and of its most common shared n-gram. Blocks are cut into chunks of bounded size, sets of
     a chunk are compared exactly, and typical classes of the components found are carried from chunk to chunk. N-grams whose classes
     are all in one component are done, as pairs inside a component change nothing. So a large group of near copies costs its size,
     not its square.
  4. Pairs left across components pass the length and positional filters; each is verified once, by suffix bounds and then by its exact
     overlap.
Components are whole; links inside a component that other links already connect aren't all verified, so their number isn't given with
them. class_links verifies and counts every link.
Texts travel instead of sets, as they are smaller compressed.

Null text, or text without words: an empty set, linked with nothing. Fewer words than n: the whole sequence is the only element.
Rows of equal doc_id are separate documents. A null doc_id takes part; components are named by the least doc_id that isn't null.
Ties: equal sets are one class whatever their texts. Other columns of docs are not looked at, whatever their names.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.arrowtext import U64, lowered, mix, slices, spaced_words, utf8, word_hashes
from pointloom.llm.components import components
from pointloom.llm.shared import discard, stored
from pointloom.llm.windows import run_hashes

N = 5
PERCENT = 80
#: Cells of the count sketch; levels of one byte make 2 MiB, whatever the corpus.
CELLS = 1 << 21
#: Bits of the filter of classes whose sets are wanted: 8 MiB. False positives only cost time.
FILTER_BITS = 1 << 26
SEGMENTS = 16
#: Documents that an n-gram may have, beyond twice a cell's mean count, before its rows are dealt over several tasks.
HOT = 4096
#: Classes of an n-gram that are compared with each other where they are sorted.
SMALL = 48
#: A round of blocks, and up to so many in all while more pairs than prefix rows are left; in those after the first, only
#: REPRESENTATIVES of each component and n-gram take part. Then all pairs left across components follow.
ROUNDS, REPRESENTATIVES = 4, 4
#: Classes and n-grams of a chunk, and classes carried to the next chunk of the block.
CHUNK, CHUNK_GRAMS, CARRIED = 256, 1 << 20, 48
#: Classes of a block that one task takes.
LANE = 4096
#: Classes a task remembers to list each of them only once.
REMEMBERED = 500_000


def set_hashes(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all rows, each sorted, and their offsets."""
    starts, ends, first = spaced_words(data, at)
    words, counts = word_hashes(data, starts, ends), np.diff(first)
    runs = run_hashes(words, n)
    row = np.repeat(np.arange(len(counts)), counts)
    whole = row[: len(runs)]
    inside = np.arange(len(runs)) - first[whole] + n <= counts[whole]
    hashes, owner = [runs[inside]], [whole[inside]]
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            hashes.append(mix(run_hashes(words, k)[first[short]] + U64(k)))
            owner.append(short)
    h, r = hashes[0], owner[0]
    if len(hashes) > 1:
        h, r = np.concatenate(hashes), np.concatenate(owner)
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    at = np.searchsorted(r, np.arange(len(counts) + 1))
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i > 1:
            h[i:j].sort()
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(len(counts) + 1))


def class_ids(h: np.ndarray, at: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of the name of each set that isn't empty; two seeds give the 128 bits of its name."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ U64((0x5851F42D4C957F2D, 0x14057B7EF767814F)[seed])))])
    return mix((total[at[1:]] - total[at[:-1]]) ^ mix(np.diff(at).astype(U64))).view(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of one byte."""
    return np.minimum(255, 4 * np.log2(1.0 + counts)).astype(np.uint8)


def _signed(n: int):
    def run(batches):
        cells, any_row, held, waiting = np.zeros(CELLS, np.int64), False, [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = utf8(part.column("text"))
                h, own = set_hashes(lowered(data), at, n)
                sizes = np.diff(own)
                held.append((h & U64(CELLS - 1)).astype(np.int64))
                waiting, any_row = waiting + len(h), True
                if waiting > CELLS:
                    cells += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, waiting = [], 0
                k = part.num_rows
                named = (pa.array(class_ids(h, own, seed), mask=sizes == 0) for seed in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), *named, pa.array(sizes), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if any_row:
            cells += np.bincount(np.concatenate(held), minlength=CELLS) if held else 0
            yield _sketch_rows(dict(enumerate(cells.reshape(SEGMENTS, -1))))

    def _sketch_rows(parts):
        k = len(parts)
        packed = [zlib.compress(x.astype("<u8" if x.max() >> 32 else "<u4").tobytes(), 1) for x in parts.values()]
        return pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 5, pa.array(list(parts), pa.int32()), pa.array(packed, pa.binary())], names)

    names = ["doc_id", "th", "cls", "alt", "n", "segment", "cells"]
    return run


def _summed(batches):
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, x in zip(batch.column("segment").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            raw = zlib.decompress(x)
            own = np.frombuffer(raw, "<u8" if len(raw) == CELLS // SEGMENTS * 8 else "<u4").astype(np.uint64)
            parts[s] = parts[s] + own if s in parts else own
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(x.astype("<u8").tobytes(), 1) for x in parts.values()], pa.binary())], ["segment", "cells"])


def count_levels(rows: DataFrame, lanes: int = 4) -> tuple[np.ndarray, float]:
    """The sketch of all documents and a cell's mean count: partial sums by segment and lane, of at most 8 lanes CELLS bytes for the driver."""
    dealt = rows.withColumn("lane", F.pmod(F.xxhash64("cells"), F.lit(lanes))).repartition("segment", "lane").select("segment", "cells")
    counts = np.zeros((SEGMENTS, CELLS // SEGMENTS), np.uint64)
    for r in dealt.coalesce(SEGMENTS * lanes).mapInArrow(_summed, "segment int, cells binary").collect():
        counts[r.segment] += np.frombuffer(zlib.decompress(r.cells), "<u8")
    return levels(counts.ravel()), int(counts.sum()) / CELLS


def prefix_rows(h: np.ndarray, at: np.ndarray, level: np.ndarray, percent: int):
    """(row, n-gram, position, level) of each set's first n-grams in rare-first order.

    An n-gram's name here is its level and 56 bits of its hash, so sorting names sorts by level; names that collide only add candidates.
    """
    sizes = np.diff(at)
    names = (level[(h & U64(CELLS - 1)).astype(np.int64)].astype(U64) << U64(56)) | (h & U64((1 << 56) - 1))
    lengths = sizes - -(-percent * sizes // 100) + (sizes > 0)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i > 1:
            names[i:j].sort()
    row = np.repeat(np.arange(len(sizes)), lengths)
    position = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    gram = names[at[row] + position]
    return row, gram, position, (gram >> U64(56)).astype(np.int64)


def _prefixes(n: int, percent: int, level, mean: float, hot: float):
    def run(batches):
        scale, met = level.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = utf8(part.column("text"))
                h, own = set_hashes(lowered(data), at, n)
                sizes, names = np.diff(own), class_ids(h, own)
                fresh = np.zeros(len(sizes), bool)
                for i in np.flatnonzero(sizes).tolist():
                    if names[i] not in met:
                        fresh[i] = True
                        met.add(names[i])
                if len(met) > REMEMBERED:
                    met.clear()
                row, gram, position, rank = prefix_rows(h, own, scale, percent)
                keep = fresh[row]
                row, gram, position, rank = row[keep], gram[keep], position[keep], rank[keep]
                count = 2.0 ** (rank / 4)  # of the n-gram's cell, which holds others too
                lanes = np.where(count > hot + 2 * mean, np.ceil(count / hot), 1).astype(np.int64)
                salt = np.where(lanes > 1, (names[row] & 0x7FFFFFFF) % lanes + 1, 0)
                place = (position << 32) | sizes[row]
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(names[row]), pa.array(place)], ["gram", "salt", "cls", "place"])

    return run


def _shared(percent: int):
    """Of rows sorted by n-gram, salt and class: one of each class, and only those that may link with another of their n-gram.

    Groups of up to SMALL classes are compared here; larger and salted ones are kept whole.
    """

    def distinct(table: pa.RecordBatch) -> pa.RecordBatch:
        gram, cls = table.column("gram").to_numpy(), table.column("cls").to_numpy()
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1])
        return table if new.all() else table.filter(pa.array(new))

    def rows(gram, cls, place):
        return pa.RecordBatch.from_arrays([*map(pa.array, (gram, cls, (place >> 32).astype(np.int32), (place & 0xFFFFFFFF).astype(np.int32)))], names)

    def judge(table: pa.RecordBatch) -> pa.RecordBatch:
        gram, cls, place, salt = (table.column(k).to_numpy() for k in ("gram", "cls", "place", "salt"))
        head = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        size = np.diff(np.append(head, len(gram)))
        several = np.flatnonzero(np.repeat(size > 1, size) | (salt > 0))
        gram, cls, place, salt = gram[several], cls[several], place[several], salt[several]
        size = np.repeat(size, size)[several]
        pos, n = place >> 32, place & 0xFFFFFFFF
        keep = (salt > 0) | (size > SMALL)
        for d in range(1, SMALL):
            i = np.flatnonzero((size > d) & (size <= SMALL))
            if not len(i):
                break
            i = i[i + d < len(gram)]
            i = i[gram[i] == gram[i + d]]
            j = i + d
            ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((100 + percent) * (1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1)) >= percent * (n[i] + n[j]))
            keep[i[ok]] = keep[j[ok]] = True
        return rows(gram[keep], cls[keep], place[keep])

    def whole(table: pa.RecordBatch) -> pa.RecordBatch:
        return rows(*(table.column(k).to_numpy() for k in ("gram", "cls", "place")))

    def run(batches):
        held, large = None, False  # the open group's classes; of a large one, whose classes are all kept, the last
        for batch in batches:
            if not batch.num_rows:
                continue
            table = distinct(batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0])
            gram = table.column("gram").to_numpy()
            if large:
                end = int((gram == gram[0]).sum())
                yield whole(table.slice(1, end - 1))
                if end == len(gram):
                    held = table.slice(end - 1)
                    continue
                table, gram = table.slice(end), gram[end:]
            cut = int(np.flatnonzero(gram == gram[-1])[0])  # the last group may go on
            large = len(gram) - cut > SMALL
            if large:
                yield judge(table)
                held = table.slice(len(gram) - 1)
            else:
                if cut:
                    yield judge(table.slice(0, cut))
                held = table.slice(cut)
        if held is not None and not large:
            yield judge(held)

    names = ["gram", "cls", "pos", "n"]
    return run


def shared_prefixes(docs: DataFrame, level, mean: float, n: int, percent: int) -> DataFrame:
    listed = docs.mapInArrow(_prefixes(n, percent, level, mean, HOT), "gram bigint, salt int, cls bigint, place bigint")
    dealt = listed.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "cls")
    return dealt.mapInArrow(_shared(percent), "gram bigint, cls bigint, pos int, n int")


def _may_link(percent: int):
    """Length and positional filters of two prefix entries a and b of one n-gram; holds at the first n-gram that a linked pair shares."""
    return F.expr(f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) AND {100 + percent} * (1 + least(a.n - a.pos - 1, b.n - b.pos - 1)) >= {percent} * (a.n + b.n)")


def suffix_bound(x: np.ndarray, y: np.ndarray, pieces: int = 16) -> int:
    """At most so many common elements of two sorted sets: the smaller count between each two pivots."""
    pivots = x[:: max(1, len(x) // pieces)]
    a, b = np.searchsorted(x, pivots), np.searchsorted(y, pivots)
    return int(np.minimum(np.diff(a, append=len(x)), np.diff(b, append=len(y))).sum() + min(a[0], b[0]))


def _verified(n: int, percent: int):
    """Pairs (u, v) of those whose texts x and y have similar sets."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "x"):
                for few in slices(part, "y"):
                    (xs, xa), (ys, ya) = ((lambda data, at: set_hashes(lowered(data), at, n))(*utf8(few.column(k))) for k in ("x", "y"))
                    linked = []
                    for i in range(few.num_rows):
                        x, y = xs[xa[i] : xa[i + 1]], ys[ya[i] : ya[i + 1]]
                        need = -(-percent * (len(x) + len(y)) // (100 + percent))
                        if suffix_bound(x, y) >= need:
                            at = np.searchsorted(y, x)
                            linked.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()) >= need)
                        else:
                            linked.append(False)
                    keep = pa.array(linked, pa.bool_())
                    yield pa.RecordBatch.from_arrays([few.column("u").filter(keep), few.column("v").filter(keep)], ["u", "v"])

    return run


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    h, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(h)))
    shared = np.repeat(size > 1, size)
    own, column = own[shared], np.repeat(np.arange(int((size > 1).sum())), size[size > 1])
    out = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int((size > 1).sum()), columns):
        i, j = np.searchsorted(column, [first, first + columns])
        has = np.zeros((len(sets), min(columns, column[j - 1] - first + 1)), np.float32)
        has[own[i:j], column[i:j] - first] = 1
        out += has @ has.T
    return out


def linked_components(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set the first one of its component, and how many sets it is linked with (itself included)."""
    sizes = np.array([len(x) for x in sets])
    linked = (100 + percent) * overlaps(sets) >= percent * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, True)
    first = np.full(len(sets), -1)
    for i in range(len(sets)):
        if first[i] < 0:
            mine = linked[i]
            while True:
                more = linked[mine].any(axis=0)
                if (more == mine).all():
                    break
                mine = more
            first[mine] = i
    return first, linked.sum(axis=1)


def _blocks(n: int, percent: int, chunk: int, most_carried: int):
    """Of rows (gram, salt, node, text) sorted by gram and salt: links (u, v) that make the components of each chunk."""

    def settle(nodes, sets):
        """Links of a chunk, and the places of those to carry on: one of each component, large ones first, then more of the largest."""
        first, degree = linked_components(sets, percent)
        links = [(nodes[f], nodes[i]) for i, f in enumerate(first.tolist()) if i != f]
        sizes = np.bincount(first, minlength=len(first))[first]
        order = np.lexsort((-degree, first, -sizes))
        new = np.ones(len(order), bool)
        new[1:] = first[order][1:] != first[order][:-1]
        keep = np.concatenate([order[new], order[~new][: most_carried // 3]])[:most_carried]
        return links, keep.tolist()

    def run(batches):
        nodes: list[int] = []
        sets: list[np.ndarray] = []
        key, carried, grams, out = None, 0, 0, []

        def flush(go_on):
            nonlocal nodes, sets, carried, grams
            keep = []
            if len(sets) > max(1, carried):
                links, keep = settle(nodes, sets)
                out.extend(links)
            keep = keep if go_on else []
            nodes, sets = [nodes[i] for i in keep], [sets[i] for i in keep]
            carried, grams = len(keep), sum(map(len, sets))

        for batch in batches:
            for part in slices(batch, "text"):
                data, at = utf8(part.column("text"))
                h, own = set_hashes(lowered(data), at, n)
                keys = zip(*(part.column(k).to_pylist() for k in ("gram", "salt", "node")), strict=True)
                for i, (gram, salt, node) in enumerate(keys):
                    if key != (gram, salt):
                        flush(False)
                        key = gram, salt
                    elif len(sets) >= chunk or grams > CHUNK_GRAMS and len(sets) > carried + 1:
                        flush(True)
                    nodes.append(node)
                    sets.append(h[own[i] : own[i + 1]].copy())
                    grams += len(sets[-1])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["u", "v"])
            out.clear()
        flush(False)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["u", "v"])

    return run


def wanted_filter(rows: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size of the hash th, two bits each: words of 64 bits united before and after the shuffle."""
    places = rows.select(F.explode(F.array(*(F.expr(f"shiftrightunsigned(th, {k}) & {FILTER_BITS - 1}") for k in (0, 32)))).alias("place"))
    words = places.groupBy(F.expr("place div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(place % 64)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, "<i8")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def passes(bits: np.ndarray, th: np.ndarray) -> np.ndarray:
    h = th.astype(np.int64).view(U64)
    out = np.ones(len(h), bool)
    for k in (0, 32):
        at = (h >> U64(k)) & U64(FILTER_BITS - 1)
        out &= (bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
    return out


def _wanted(wanted):
    """Rows that pass the filter, equal ones once in a task."""

    def run(batches):
        bits, met = wanted.value, set()
        for batch in batches:
            passed = passes(bits, batch.column("th").to_numpy())
            th, doc = batch.column("th").to_pylist(), batch.column("doc_id").to_pylist()
            for i in np.flatnonzero(passed).tolist():
                passed[i] = (th[i], doc[i]) not in met
                met.add((th[i], doc[i]))
            if len(met) > REMEMBERED:
                met.clear()
            yield batch.filter(pa.array(passed))

    return run


def _indexed(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, text, th) -> signs (doc_id, th, cls, alt, n), nodes (cls, alt, node, ..) of classes that share a prefix n-gram, their
    entries (gram, node, pos, n) and a text (node, text) of each.
    """
    spark = docs.sparkSession
    signed = stored(docs.mapInArrow(_signed(n), "doc_id bigint, th bigint, cls bigint, alt bigint, n bigint, segment int, cells binary"), "signatures")
    signs = signed.where("segment is null").select("doc_id", "th", "cls", "alt", "n")
    sketch, mean = count_levels(signed.where("segment is not null").select("segment", "cells"))
    level = spark.sparkContext.broadcast(sketch)
    listed = stored(shared_prefixes(docs, level, mean, n, percent), "prefixes")
    level.unpersist()

    one = signs.where("cls is not null").groupBy("cls", "alt").agg(F.min(F.struct("th", "doc_id")).alias("one")).select("cls", "alt", "one.*")
    nodes = stored(one.join(listed.select("cls").distinct(), "cls").withColumn("node", F.monotonically_increasing_id()), "nodes")
    entries = stored(listed.join(nodes.select("cls", "node"), "cls").select("gram", "node", "pos", "n"), "entries")
    discard(listed)
    wanted = spark.sparkContext.broadcast(wanted_filter(nodes))
    of = nodes.select("th", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("d"), "node")
    texts = docs.select("doc_id", "text", "th").mapInArrow(_wanted(wanted), "doc_id bigint, text string, th bigint")
    texts = texts.select("th", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("d"), "text").dropDuplicates(["th", "none", "d"])
    texts = stored(texts.join(of, ["th", "none", "d"]).select("node", "text"), "texts")
    wanted.unpersist()
    return signs, nodes, entries, texts


def _named(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """docs (doc_id, text, th) -> doc_id, th, n, (cls, alt) (null: empty set) and label, the component's name.

    A class that shares a prefix n-gram gets a number of its own, its node; the label of a component is (0, its least node, 0), that of
    other classes (1, cls, alt).
    """
    signs, nodes, entries, texts = _indexed(docs, n, percent)
    labels = left = None
    steps: list[DataFrame] = []
    for r in range(ROUNDS + 1):
        marked = (left if left is not None else entries).select("gram", "node", "pos", "n")
        if labels is None:
            marked = marked.withColumn("label", F.col("node"))
        else:  # the component's own name is its least node, which has no row
            marked = marked.join(labels, "node", "left").select("gram", "node", "pos", "n", F.coalesce("label", "node").alias("label"))
        mixed = marked.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k")).where("lo < hi").select("gram", "k")
        before, left = left, stored(marked.join(mixed, "gram"), "left")
        discard(before)
        pairs = None
        if r:
            here = F.expr("a.gram = b.gram AND a.node < b.node AND a.label <> b.label")
            pairs = left.alias("b").join(left.alias("a"), here).where(_may_link(percent)).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
            pairs = stored(pairs.distinct(), "pairs")
            steps.append(pairs)
        last = r == ROUNDS or r > 0 and pairs.count() <= left.count()
        if last:
            both = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("y")), "v").join(texts.select(F.col("node").alias("u"), F.col("text").alias("x")), "u")
            links = both.select("u", "v", "x", "y").mapInArrow(_verified(n, percent), "u bigint, v bigint")
        else:
            part = left
            if r:  # typically few pairs are left after the first round
                few = Window.partitionBy("gram", "label").orderBy(F.xxhash64("node", F.lit(r)), "node")
                part = left.withColumn("i", F.row_number().over(few)).where(F.col("i") <= REPRESENTATIVES)
            choice = F.struct("k", "gram")
            block = part.groupBy("node").agg(F.array(F.min(choice), F.max(choice)).alias("both"), F.min("n").alias("n"))
            block = block.select("node", "n", F.explode(F.array_distinct("both")).alias("one"))
            block = block.select("node", "one.gram", "n", F.expr(f"int(pmod(xxhash64(node, {r}), (one.k + {LANE - 1}) div {LANE}))").alias("salt"))
            dealt = texts.join(block, "node").repartition("gram", "salt").sortWithinPartitions("gram", "salt", "n", "node")
            links = dealt.select("gram", "salt", "node", "text").mapInArrow(_blocks(n, percent, CHUNK, CARRIED), "u bigint, v bigint")
        links = stored(links, "links")
        steps.append(links)
        if not links.isEmpty():  # the components so far are stars, to which the new links are added
            before = labels
            labels = components(links if labels is None else links.unionByName(labels.select(F.col("label").alias("u"), F.col("node").alias("v"))))
            discard(before)
        if last:
            break
    discard(texts, entries, left, *steps)

    own = F.struct(F.lit(1).alias("kind"), "cls", "alt")
    if labels is None:
        return signs.withColumn("label", own)
    known = nodes.join(labels, "node", "left").select("cls", "alt", F.coalesce("label", "node").alias("label"))
    shared = F.struct(F.lit(0).alias("kind"), F.col("label").alias("cls"), F.lit(0).cast("bigint").alias("alt"))
    return signs.join(known, ["cls", "alt"], "left").withColumn("label", F.when(F.col("label").isNull(), own).otherwise(shared))


def _keyed(docs: DataFrame, id_column: str, text_column: str, *more) -> DataFrame:
    return docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("string").alias("text"), *more).withColumn("th", F.xxhash64("text"))


def link(docs: DataFrame, n: int = N, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles and component_id, the least doc_id that links lead to (itself included)."""
    named = _named(_keyed(docs, id_column, text_column), n, percent)
    least = named.where("cls is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "label", "left")
    return out.select(F.col("doc_id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def class_links(docs: DataFrame, n: int = N, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: pairs (u, v) of classes of equal sets, u < v, that are similar, and members (doc_id, class_id, n_links) of all documents.

    class_id, a class's 128 bits in hexadecimal, is null for an empty set; n_links counts a document's links with others, equal sets included. Every pair of classes that
    share a prefix n-gram and pass the filters is verified, so work follows the links and not the documents; an n-gram's classes are
    dealt over lanes of LANE, and each pair of lanes meets in a task of its own. link finds components without listing pairs.
    """
    signs, nodes, entries, texts = _indexed(_keyed(docs, id_column, text_column), n, percent)
    lanes = entries.groupBy("gram").agg(F.ceil(F.count("*") / LANE).cast("int").alias("lanes"))
    dealt = stored(entries.join(lanes, "gram").withColumn("lane", F.pmod(F.xxhash64("node"), "lanes").cast("int")), "dealt")
    a = dealt.select("gram", "node", "pos", "n", F.col("lane").alias("la"), F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lb"))
    b = dealt.select("gram", "node", "pos", "n", F.col("lane").alias("lb"), F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("la"))
    met = a.alias("a").join(b.alias("b"), F.expr("a.gram = b.gram AND a.la = b.la AND a.lb = b.lb AND a.node < b.node")).where(_may_link(percent))
    pairs = stored(met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct(), "pairs")
    both = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("y")), "v").join(texts.select(F.col("node").alias("u"), F.col("text").alias("x")), "u")
    links = stored(both.select("u", "v", "x", "y").mapInArrow(_verified(n, percent), "u bigint, v bigint"), "links")
    discard(dealt, pairs, texts, entries)

    name = F.concat(F.hex("cls"), F.lit("-"), F.hex("alt"))
    named = nodes.select("node", name.alias("name"))
    links = links.join(named.select(F.col("node").alias("u"), F.col("name").alias("p")), "u").join(named.select(F.col("node").alias("v"), F.col("name").alias("q")), "v")
    links = links.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))
    members = signs.select("doc_id", name.alias("class_id"))
    sizes = members.where("class_id is not null").groupBy("class_id").agg(F.count("*").alias("size"))
    ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    more = ends.join(sizes.withColumnRenamed("class_id", "v"), "v").groupBy(F.col("u").alias("class_id")).agg(F.sum("size").alias("more"))
    counts = sizes.join(more, "class_id", "left").select("class_id", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    out = members.join(counts, "class_id", "left")
    return links, out.select(F.col("doc_id").alias(id_column), "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def representatives(docs: DataFrame, n: int = N, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one document of each component, that of the least doc_id (null last); those of an empty set all stay."""
    full = _keyed(docs, id_column, text_column, F.struct(*docs.columns).alias("row"))
    named = _named(_keyed(docs, id_column, text_column), n, percent).where("cls is not null")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    least = named.groupBy("label").agg(F.min(key).alias("one"))
    # Of a component's rows only one stays, so what goes is small beside the texts; equal rows count as one.
    stays = least.select("one.doc_id", "one.th").withColumn("stays", F.lit(True))
    sized = named.groupBy("doc_id", "th").agg(F.lit(True).alias("has_set"))
    marks = sized.join(stays, [sized["doc_id"].eqNullSafe(stays["doc_id"]), sized["th"] == stays["th"]], "left").select(sized["doc_id"].alias("d"), sized["th"].alias("t"), "has_set", "stays")
    joined = full.join(marks, [F.coalesce(full["doc_id"], F.lit(0)) == F.coalesce(marks["d"], F.lit(0)), full["doc_id"].isNull() == marks["d"].isNull(), full["th"] == marks["t"]], "left")
    empty = joined.where("has_set is null")
    one = joined.where("stays").dropDuplicates(["d", "t"])
    return empty.unionByName(one).select("row.*")
