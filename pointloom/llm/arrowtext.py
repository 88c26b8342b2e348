"""Text columns as numpy arrays: Arrow buffers are read in place, one slice of bounded size at a time."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20
U64 = np.uint64
#: Bytes of a word that are hashed by blocks.
LONG = 64
#: Masks of the first k of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if big else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """The batch in pieces of about limit bytes of the column; a longer value is a piece of its own."""
    _, at = utf8(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def spaced_words(data: np.ndarray, at: np.ndarray):
    """Starts and ends of runs without ASCII white space, and each row's first word (one more than rows)."""
    gap = _SPACE[data]
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~gap
    step = np.diff(word)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = at[1:-1]
    cut = np.unique(inner[(inner > 0) & (inner < len(data))])
    if len(cut):
        cut = cut[~gap[cut] & ~gap[cut - 1]]  # a row's text may begin right after the last one's end
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the words' bytes: blocks of eight, each mixed in by a bijection; words beyond LONG bytes by xxhash of the whole.

    Hashes of different seeds are independent: words that collide under one don't under another but by chance.
    """
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place
    h = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(0x9E3779B97F4A7C15 * (2 * seed + 1) % 2**64))
    h = mix(h ^ (blocks[starts] & _FIRST[np.minimum(size, 8)]))
    more = np.flatnonzero((size > 8) & (size <= LONG))
    for k in range(8, LONG, 8):
        if not len(more):
            break
        h[more] = mix(h[more] ^ (blocks[starts[more] + k] & _FIRST[np.minimum(size[more] - k, 8)]))
        more = more[size[more] > k + 8]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] ^= U64(xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed))
    return mix(h) if (size > LONG).any() else h


def lowered(data: np.ndarray) -> np.ndarray:
    """With A-Z in lower case."""
    return _LOWER[data]


def binary_array(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column from bytes and offsets."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
