"""FLAC streams in binary columns: frames of many streams are coded and decoded side by side as numpy matrices.

encode: text -> one mono 8-bit stream a row, with a seek point for every frame (of very long texts, every few). read: streams -> PCM of every frame with its
sample offset, from seek points or by looking for frame headers; the checksum of every header and frame is verified.
Supported when reading: constant, verbatim, fixed and linear-predictor subframes, Rice codes of both kinds with any partition
order and escapes, wasted bits, mono, 8 to 16 bits a sample. Null and empty texts are stored as 64 zero bytes.
"""

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointloom.llm.arrowtext import slices, utf8

BLOCK = 512
UNIT = 64
#: Seek points that a table's size field allows; longer streams have one for every few frames.
MOST_POINTS = ((1 << 24) - 1) // 18
#: Linear predictors that encode() tries: past samples, bits of a coefficient, and its binary places.
TAPS, PRECISION, PLACES = 4, 12, 10
RATE = 8000
# Fixed values of the format: polynomials of the checksums of headers and frames.
POLY8, POLY16 = 0x07, 0x8005


def _crc_table(poly: int, width: int) -> np.ndarray:
    """The checksum of each value of width bits."""
    crc = np.arange(1 << width, dtype=np.uint32)
    for _ in range(width):
        crc = np.where(crc >> (width - 1) & 1, crc << 1 ^ poly, crc << 1) & ((1 << width) - 1)
    return crc


_CRC8, _CRC16 = _crc_table(POLY8, 8).tolist(), _crc_table(POLY16, 16).astype(np.uint16)
#: Zeros before the first one in 16 bits.
_ZEROS = np.full(1 << 16, 16, np.int64)
for _b in range(16):
    _ZEROS[1 << _b : 2 << _b] = 15 - _b


def _crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start..start+size of all, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Checksums of many pieces at once, two bytes a step; zeros set before a piece leave its checksum as it is."""
    out = np.zeros(len(starts), np.uint16)
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    for some in np.array_split(order, max(1, len(order) // 2048)):
        if not len(some):
            continue
        n = int(sizes[some[0]] + 1) // 2 * 2
        table = np.zeros((n, len(some)), np.uint8)
        for k, i in enumerate(some.tolist()):
            table[n - sizes[i] :, k] = data[starts[i] : ends[i]]
        pairs = table[0::2].astype(np.uint16) << 8 | table[1::2]
        crc = np.zeros(len(some), np.uint16)
        for row in pairs:
            crc = _CRC16[crc ^ row]
        out[some] = crc
    return out


def _coded_number(n: int) -> bytes:
    """As UTF-8 would, with up to seven bytes."""
    if n < 0x80:
        return bytes([n])
    k = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    head = (0xFF << (8 - k)) & 0xFF
    return bytes([head | n >> 6 * (k - 1), *(0x80 | n >> 6 * j & 0x3F for j in range(k - 2, -1, -1))])


@lru_cache(100_000)
def _header(number: int, size: int) -> bytes:
    """A frame header: fixed block size, rate and width from the stream's header, mono."""
    code = {256 << k: 8 + k for k in range(8)}.get(size, 7)
    head = bytes([0xFF, 0xF8, code << 4, 0x02]) + _coded_number(number) + ((size - 1).to_bytes(2, "big") if code == 7 else b"")
    return head + bytes([_crc8(head)])


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of each block's best linear predictor, by its autocorrelation, and what they leave; sums are of integers, hence exact."""
    wide, n = x.astype(np.int64), x.shape[1]
    r = np.stack([(wide[:, k:] * wide[:, : n - k]).sum(1) for k in range(TAPS + 1)]).astype(float)
    a, error = np.zeros((TAPS, len(x))), np.maximum(r[0], 1.0)
    for i in range(TAPS):
        reflection = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(0)) / error
        a[:i] -= reflection * a[:i][::-1].copy()
        a[i] = reflection
        error = np.maximum(error * (1 - reflection**2), 1e-6)
    top = 1 << (PRECISION - 1)
    c = np.clip(np.rint(a.T * (1 << PLACES)), -top, top - 1).astype(np.int64)
    guess = sum(c[:, j : j + 1] * wide[:, TAPS - 1 - j : n - 1 - j] for j in range(TAPS)) >> PLACES
    return c, (wide[:, TAPS:] - guess).astype(np.int32)


def _bodies(x: np.ndarray) -> list[bytes]:
    """Subframes of equally long blocks of 8-bit samples, with the cheapest of constant, verbatim, fixed and linear predictors."""
    f, n = x.shape
    residuals = [x.astype(np.int32)]
    for _ in range(4):
        residuals.append(np.diff(residuals[-1], axis=1))
    sums = np.stack([np.abs(r[:, 4 - k :]).sum(1) for k, r in enumerate(residuals)])
    coefficients, rest = _linear(x)
    # A linear predictor costs its coefficients, and is worth it where residuals get that many bits shorter in all.
    extra = 9 + TAPS * PRECISION
    gain = (n - TAPS) * np.log2((sums.min(0) + 1) / (np.abs(rest).sum(1) + 1)) - 8 * (TAPS - sums.argmin(0))
    order = np.where(gain > extra, 5, sums.argmin(0))
    residuals.append(rest)
    constant = (x == x[:, :1]).all(1)
    out: list[bytes] = [b""] * f
    for choice in range(6):
        mine = np.flatnonzero((order == choice) & ~constant)
        if not len(mine):
            continue
        o, more = (choice, 0) if choice < 5 else (TAPS, extra)
        r = residuals[choice][mine]
        u = np.where(r < 0, -2 * r - 1, 2 * r)
        mean = u.sum(1) // u.shape[1]
        guess = np.maximum(np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64), 0)
        cost = np.stack([(u >> np.clip(guess + d, 0, 14)[:, None]).sum(1) + u.shape[1] * (np.clip(guess + d, 0, 14) + 1) for d in (-1, 0, 1)])
        k_of, least = np.clip(guess + cost.argmin(0) - 1, 0, 14), cost.min(0)
        verbatim = 18 + 8 * o + more + least >= 8 + 8 * n
        for i in mine[verbatim].tolist():
            out[i] = b"\x02" + x[i].astype(np.int8).tobytes()
        for k in np.unique(k_of[~verbatim]).tolist():
            own = np.flatnonzero(~verbatim & (k_of == k))
            u_k, frames = u[own], mine[own]
            q = u_k >> k
            ends = np.cumsum(q + (1 + k), axis=1)
            size = (18 + 8 * o + more + ends[:, -1] + 7) // 8
            at = np.concatenate([[0], np.cumsum(size)])
            base = at[:-1] * 8
            bits = np.zeros(at[-1] * 8, np.uint8)
            first = 8 + o if choice < 5 else 31 + o  # subframe type: fixed or linear predictor of this order
            head = [0, *(first >> j & 1 for j in range(5, -1, -1)), 0]
            for j, b in enumerate(head):
                bits[base + j] = b
            for w in range(o):
                for j in range(8):
                    bits[base + 8 + 8 * w + j] = x[frames, w] >> (7 - j) & 1
            if more:  # precision, places, coefficients
                place = base + 8 + 8 * o
                fields = [(PRECISION - 1, 4), (PLACES, 5), *((coefficients[frames, j], PRECISION) for j in range(TAPS))]
                for value, width in fields:
                    for j in range(width):
                        bits[place + j] = value >> (width - 1 - j) & 1
                    place = place + width
            start = base + 8 + 8 * o + more  # then Rice codes of the first kind in one partition
            for j in range(4):
                bits[start + 6 + j] = k >> (3 - j) & 1
            stop = (start + 10)[:, None] + ends - (1 + k)
            bits[stop] = 1
            for j in range(k):
                bits[stop + 1 + j] = u_k >> (k - 1 - j) & 1
            packed = np.packbits(bits).tobytes()
            for j, i in enumerate(frames.tolist()):
                out[i] = packed[at[j] : at[j + 1]]
    for i in np.flatnonzero(constant).tolist():
        out[i] = b"\x00" + x[i, :1].astype(np.int8).tobytes()
    return out


def encode_many(payloads: list[np.ndarray]) -> list[bytes]:
    """A FLAC stream for each payload of bytes; byte b is the sample b - 128. Equal payloads give equal streams."""
    cuts = [(d, s, min(BLOCK, len(p) - s)) for d, p in enumerate(payloads) for s in range(0, len(p), BLOCK)]
    frames: list[bytes] = [b""] * len(cuts)
    sizes = np.array([c[2] for c in cuts])
    for n in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == n)
        x = np.stack([payloads[cuts[i][0]][cuts[i][1] : cuts[i][1] + n] for i in mine.tolist()]).astype(np.int16) - 128
        for i, body in zip(mine.tolist(), _bodies(x), strict=True):
            frames[i] = _header(cuts[i][1] // BLOCK, n) + body
    lengths = np.array([len(x) for x in frames])
    ends = np.cumsum(lengths)
    sums = crc16(np.frombuffer(b"".join(frames), np.uint8), ends - lengths, ends).astype(">u2").tobytes()
    out: list[list[bytes]] = [[] for _ in payloads]
    for i, (d, _, _) in enumerate(cuts):
        out[d].append(frames[i] + sums[2 * i : 2 * i + 2])
    streams = []
    for p, own in zip(payloads, out, strict=True):
        seek, at = bytearray(), 0
        step = -(-len(own) // MOST_POINTS)
        for j, x in enumerate(own):
            seek += b"" if j % step else (j * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, len(p) - j * BLOCK).to_bytes(2, "big")
            at += len(x)
        least, most = min(map(len, own)), max(map(len, own))
        info = BLOCK.to_bytes(2, "big") * 2 + least.to_bytes(3, "big") + most.to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5((p ^ 0x80).tobytes()).digest()
        streams.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + bytes(seek) + b"".join(own))
    return streams


class Corrupt(ValueError):
    """A stream that breaks the format or fails a checksum."""


def _metadata(stream: bytes) -> dict:
    if stream[:4] != b"fLaC":
        raise Corrupt("no stream marker")
    at, info, seek, last = 4, None, [], False
    while not last:
        if at + 4 > len(stream):
            raise Corrupt("metadata cut off")
        last, kind, n = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body, at = stream[at + 4 : at + 4 + n], at + 4 + n
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[2:4], "big"), "width": (packed >> 36 & 0x1F) + 1, "channels": (packed >> 41 & 7) + 1, "samples": packed & 0xFFFFFFFFF, "md5": body[18:34]}
        elif kind == 3:
            seek = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, n, 18) if body[i : i + 8] != b"\xff" * 8]
    if info is None or info["channels"] != 1:
        raise Corrupt("no mono stream header")
    return info | {"audio": at, "seek": seek}


def _parse_header(stream: bytes, at: int, info: dict) -> tuple[int, int, int, int] | None:
    """Size of the block, first sample, bits a sample and where the subframe begins; None if no frame header is here."""
    h = stream[at : at + 17]
    if len(h) < 6 or h[0] != 0xFF or h[1] & 0xFE != 0xF8 or h[3] >> 4 or h[3] & 1:
        return None
    code, rate, width = h[2] >> 4, h[2] & 15, h[3] >> 1 & 7
    lead = next((k for k in range(8) if not h[4] >> (7 - k) & 1), 8)
    number, n = (h[4], 1) if lead == 0 else (h[4] & (0x7F >> lead), lead)
    if lead in (1, 8) or not code or rate == 15 or len(h) < 4 + n:
        return None
    for b in h[5 : 4 + n]:
        number = number << 6 | b & 0x3F
    p = 4 + n
    if code == 6:
        size, p = h[p] + 1, p + 1
    elif code == 7:
        size, p = int.from_bytes(h[p : p + 2], "big") + 1, p + 2
    else:
        size = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= len(h) or _crc8(h[:p]) != h[p]:
        return None
    bits = {0: info["width"], 1: 8, 2: 12, 4: 16}.get(width)
    return bits and (size, number if h[1] & 1 else number * info["block"], bits, at + p + 1)


def _frames(stream: bytes, info: dict) -> list[tuple[int, int, int, int, int, int]]:
    """(start, end, size, first sample, bits, subframe) of every frame, from seek points if they tell all frames, else by search."""
    starts = [info["audio"] + b for _, b in info["seek"]]
    heads = [_parse_header(stream, s, info) for s in starts]
    if not heads or None in heads or starts[0] != info["audio"] or sum(h[0] for h in heads) != info["samples"]:
        found, at, want = [], info["audio"], 0
        while 0 <= (at := stream.find(b"\xff", at)) < len(stream):
            h = _parse_header(stream, at, info)
            if h and h[1] == want:
                found.append((at, h))
                want += h[0]
                at = h[3]
            else:
                at += 1
        if want != info["samples"] or not found:
            raise Corrupt("frames are missing")
        starts, heads = [x[0] for x in found], [x[1] for x in found]
    return [(s, e, *h) for s, e, h in zip(starts, [*starts[1:], len(stream)], heads, strict=True)]


class _Bits:
    """Reads bits of many frames in step."""

    def __init__(self, data: np.ndarray):
        pad = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        self.words = pad[:-4] << np.uint64(24) | pad[1:-3] << np.uint64(16) | pad[2:-2] << np.uint64(8) | pad[3:-1]
        self.words = (self.words << np.uint64(8) | pad[4:]).view(np.int64)  # 40 bits from each byte on
        self.last = len(self.words) - 1

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 33 bits from there on, as the upper bits of 40."""
        return (self.words[np.minimum(at >> 3, self.last)] << (at & 7)) & 0xFFFFFFFFFF

    def take(self, at: np.ndarray, n) -> np.ndarray:
        """n bits (up to 32)."""
        return self.peek(at) >> (40 - n)

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned codes with k low bits, and where the next ones begin."""
        w = self.peek(at)
        q = _ZEROS[w >> 24]
        if q.max(initial=0) >= 16:
            more = np.flatnonzero(q == 16)
            while len(more):
                if (at[more] + q[more] >> 3).max() > self.last:
                    raise Corrupt("codes run past the end")
                z = _ZEROS[self.peek(at[more] + q[more]) >> 24]
                q[more] += z
                more = more[z == 16]
        at = at + q + 1
        u = q << k | np.where(k > 0, self.peek(at) >> (40 - k), 0)
        return u, at + k


def _signed(v: np.ndarray, bits) -> np.ndarray:
    return v - ((v >> (bits - 1)) << bits)


def _rice_many(bits: _Bits, at: np.ndarray, k: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """counts[i] signed numbers with k[i] low bits from at[i] on, for all i in step; those that end drop out."""
    order = np.argsort(-counts, kind="stable")
    at, k, counts = at[order].copy(), k[order], counts[order]
    top = 40 - k
    codes = np.zeros((int(counts.max(initial=0)), len(at)), np.int64)
    active = np.searchsorted(-counts, -np.arange(len(codes)), "left")
    words, last = bits.words, bits.last
    for i, m in enumerate(active.tolist()):
        a, low = at[:m], k[:m]
        w = words[np.minimum(a >> 3, last)] << (a & 7) & 0xFFFFFFFFFF
        q = _ZEROS[w >> 24]
        if int(q.max()) < 16:
            q1 = q + 1
            codes[i, :m] = q << low | (w << q1 & 0xFFFFFFFFFF) >> top[:m] if int((q1 + low).max()) <= 33 else q << low | bits.take(a + q1, low)
            a += q1 + low
        else:
            codes[i, :m], at[:m] = bits.rice(a, low)
    if len(at) and (int(at.max()) >> 3) > last:
        raise Corrupt("codes run past the end")
    signed = (codes >> 1 ^ -(codes & 1)).T
    out: list = [None] * len(at)
    for j, i in enumerate(order.tolist()):
        out[i] = signed[j, : counts[j]]
    return out


def _start_group(bits: _Bits, at: np.ndarray, n: int, width: int, kind: int):
    """What comes before the residual in subframes of one type and length: finished samples, or (samples with warm-up, coefficients, shift, residual's place)."""
    f = len(at)
    if kind == 0:
        return np.repeat(_signed(bits.take(at, width), width)[:, None], n, 1), None, None, None
    if kind == 1:
        return _signed(bits.take((at[:, None] + width * np.arange(n)).ravel(), width), width).reshape(f, n), None, None, None
    order = kind - 8 if kind < 32 else kind - 31
    if kind < 8 or kind < 32 and order > 4 or order > n:
        raise Corrupt("no such predictor")
    x = np.zeros((f, n), np.int64)
    for i in range(order):
        x[:, i] = _signed(bits.take(at, width), width)
        at = at + width
    if kind < 32:
        return x, None, None, at
    precision, shift = bits.take(at, 4) + 1, _signed(bits.take(at + 4, 5), 5)
    at = at + 9
    coefficients = np.zeros((f, order), np.int64)
    for j in range(order):
        coefficients[:, j] = _signed(bits.take(at, precision), precision)
        at = at + precision
    if (shift < 0).any() or (precision > 15).any():
        raise Corrupt("no such predictor")
    return x, coefficients, shift, at


def _residuals(bits: _Bits, at: np.ndarray, n: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """Rice residuals of all frames: whole frames in step where there is one partition, else partition by partition."""
    wide, split = bits.take(at, 2), bits.take(at + 2, 4)
    if (wide > 1).any() or (n % (1 << split)).any() or (n >> split < order).any():
        raise Corrupt("no such residual")
    at, k_bits = at + 6, 4 + wide
    out: list = [None] * len(at)
    k = bits.take(at, k_bits)
    plain = (split == 0) & (k < (1 << k_bits) - 1)
    own = np.flatnonzero(plain)
    for i, r in zip(own.tolist(), _rice_many(bits, at[own] + k_bits[own], k[own], (n - order)[own]), strict=True):
        out[i] = r
    for i in np.flatnonzero(~plain).tolist():
        here, step, parts = at[i : i + 1], int(n[i] >> split[i]), []
        for part in range(1 << int(split[i])):
            count = step - (int(order[i]) if part == 0 else 0)
            k = bits.take(here, k_bits[i])
            here = here + k_bits[i]
            if k[0] == (1 << k_bits[i]) - 1:
                raw = int(bits.take(here, 5)[0])
                at_each = here + 5 + raw * np.arange(count)
                parts.append(_signed(bits.take(at_each, raw), raw) if raw else np.zeros(count, np.int64))
                here = here + 5 + raw * count
            else:
                values = np.zeros(count, np.int64)
                for j in range(count):
                    values[j : j + 1], here = bits.rice(here, k)
                parts.append(values >> 1 ^ -(values & 1))
        out[i] = np.concatenate(parts)
    return out


def _predicted(x: np.ndarray, residual: np.ndarray, coefficients, shift, order: int) -> np.ndarray:
    """Samples from warm-up and residual."""
    if coefficients is not None:
        for i in range(order, x.shape[1]):
            x[:, i] = residual[:, i - order] + ((coefficients * x[:, i - order : i][:, ::-1]).sum(1) >> shift)
        return x
    for o in range(order - 1, -1, -1):  # running sums undo the differences
        warm = np.diff(x[:, :order], n=o, axis=1)
        residual = warm[:, -1:] + np.cumsum(residual, axis=1)
    x[:, order:] = residual
    return x


def decode_many(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """(first sample, samples) of every frame of each stream. Raises Corrupt if a checksum fails."""
    frames, base, infos = [], 0, []
    for d, s in enumerate(streams):
        info = _metadata(s)
        infos.append(info)
        frames += [(d, base + a, base + b, size, first, width, base + sub) for a, b, size, first, width, sub in _frames(s, info)]
        base += len(s)
    data = np.frombuffer(b"".join(streams), np.uint8)
    _, start, end, size, first, width, sub = (np.array(c, np.int64) for c in zip(*frames, strict=True))
    if (crc16(data, start, end) != 0).any():  # over the checksum itself: 0 if it is right
        raise Corrupt("a frame's checksum is wrong")
    bits = _Bits(data)
    kind, wasted, at = data[sub] >> 1 & 0x3F, (data[sub] & 1).astype(np.int64), 8 * sub + 8
    for i in np.flatnonzero(wasted).tolist():
        one = at[i : i + 1]
        k = 0
        while not bits.take(one + k, 1)[0]:
            k += 1
        wasted[i], at[i] = k + 1, at[i] + k + 1
    out: list[list] = [[] for _ in streams]
    done: list = [None] * len(frames)
    keys = np.stack([size, width - wasted, kind.astype(np.int64)], 1)
    groups, member = np.unique(keys, axis=0, return_inverse=True)
    started, places, lengths, orders, owners = [], [], [], [], []
    for g, (n, w, t) in enumerate(groups.tolist()):
        mine = np.flatnonzero(member.ravel() == g)
        started.append((mine, *_start_group(bits, at[mine], n, w, t)))
        if started[-1][4] is not None:
            order = t - 8 if t < 32 else t - 31
            places.append(started[-1][4]), lengths.append(np.full(len(mine), n)), orders.append(np.full(len(mine), order)), owners.append(g)
    residual = iter(_residuals(bits, *map(np.concatenate, (places, lengths, orders))) if owners else [])
    for g, (mine, x, coefficients, shift, place) in enumerate(started):
        if place is not None:
            order = int(groups[g][2]) - (8 if groups[g][2] < 32 else 31)
            x = _predicted(x, np.stack([next(residual) for _ in mine]), coefficients, shift, order)
        for i, row in zip(mine.tolist(), x << wasted[mine][:, None], strict=True):
            done[i] = row
    for (d, *_), f, x in zip(frames, first.tolist(), done, strict=True):
        out[d].append((f, x))
    for info, own in zip(infos, out, strict=True):
        own.sort(key=lambda b: b[0])
        if info["md5"] != bytes(16) and info["width"] == 8 and hashlib.md5(np.concatenate([x for _, x in own]).astype(np.int8).tobytes()).digest() != info["md5"]:
            raise Corrupt("the samples' digest is wrong")
    return out


def payloads(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sizes of the texts in UTF-8, and their bytes with zeros up to a positive multiple of 64."""
    data, at = utf8(column)
    sizes = np.diff(at)
    out = []
    for a, n in zip(at[:-1].tolist(), sizes.tolist(), strict=True):
        p = np.zeros(max(UNIT, -(-n // UNIT) * UNIT), np.uint8)
        p[:n] = data[a : a + n]
        out.append(p)
    return sizes, out


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: n_bytes (of the text in UTF-8) and media, a FLAC stream of them. Null is empty. No shuffle."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, data = payloads(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), pa.array(encode_many(data), pa.binary())], [id_column, "n_bytes", "media"])

    chosen = docs.select(docs[id_column].cast("bigint").alias("id"), docs[text_column].cast("string").alias("text"))
    return chosen.mapInArrow(run, f"`{id_column}` bigint, n_bytes bigint, media binary")


def read(media: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """PCM blocks of stored streams: a row per frame with its number, its first sample's offset, samples and signed 16-bit PCM.

    A null stream has no blocks. Raises Corrupt where a checksum fails.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "media"):
                ids = part.column("id").to_pylist()
                streams = part.column("media").to_pylist()
                own = [i for i, s in enumerate(streams) if s is not None]
                blocks = decode_many([streams[i] for i in own]) if own else []
                rows = [(ids[i], k, f, len(x), x.astype("<i2").tobytes()) for i, b in zip(own, blocks, strict=True) for k, (f, x) in enumerate(b)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [id_column, "block", "sample_offset", "n_samples", "pcm"])

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    chosen = media.select(media[id_column].cast("bigint").alias("id"), media[media_column].alias("media"))
    return chosen.mapInArrow(run, f"`{id_column}` bigint, block int, sample_offset bigint, n_samples int, pcm binary")


def features(x: np.ndarray) -> str:
    """peak:energy:crossings:rise of signed samples, all integers."""
    x = x.astype(np.int64)
    return f"{np.abs(x).max()}:{(x * x).sum()}:{((x[1:] < 0) != (x[:-1] < 0)).sum()}:{np.abs(np.diff(x)).sum()}"


def describe(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Store each text as a FLAC stream, read the stored bytes back, and describe both; no shuffle.

    doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the bytes read back), media_bytes, media_sha256, feature, n_blocks.
    Null is empty; equal texts give equal values.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, data = payloads(part.column("text"))
                streams = encode_many(data)
                rows = []
                for s, blocks in zip(streams, decode_many(streams), strict=True):
                    x = np.concatenate([b for _, b in blocks])
                    back = (x + 128).astype(np.uint8).tobytes()
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(s), hashlib.sha256(s).hexdigest(), features(x), len(blocks)))
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), *arrays], names)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks"]
    chosen = docs.select(docs[id_column].cast("bigint").alias("id"), docs[text_column].cast("string").alias("text"))
    return chosen.mapInArrow(run, f"`{id_column}` bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_blocks bigint")
