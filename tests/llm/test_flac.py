import hashlib
import random
import zlib

import numpy as np
import pytest

from pointloom.llm import flac


def padded(text):
    raw = (text or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


class Reader:
    """A plain decoder, one bit at a time."""

    def __init__(self, data):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n, signed=False):
        v = int(self.bits[self.at : self.at + n] or "0", 2)
        self.at += n
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    def unary(self):
        n = self.bits.index("1", self.at) - self.at
        self.at += n + 1
        return n


def plain_decode(stream, block=flac.BLOCK):
    at = 4
    while True:
        last, n = stream[at] >> 7, int.from_bytes(stream[at + 1 : at + 4], "big")
        if stream[at] & 127 == 0:
            total = int.from_bytes(stream[at + 14 : at + 22], "big") & 0xFFFFFFFFF
        at += 4 + n
        if last:
            break
    r, out = Reader(stream[at:]), []
    while len(out) < total:
        assert r.take(15) == 0x7FFC
        r.take(1)
        code, _, _ = r.take(4), r.take(4), r.take(8)
        lead = 0
        while r.take(1):
            lead += 1
        r.take(7 - lead + 8 * max(0, lead - 1))
        size = r.take(16) + 1 if code == 7 else 256 << (code - 8)
        r.take(8), r.take(1)
        kind = r.take(6)
        r.take(1)
        if kind == 0:
            x = [r.take(8, True)] * size
        elif kind == 1:
            x = [r.take(8, True) for _ in range(size)]
        else:
            order, shift = kind - 8 if kind < 32 else kind - 31, 0
            x = [r.take(8, True) for _ in range(order)]
            if kind < 32:
                taps = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}[order]
            else:
                precision, shift = r.take(4) + 1, r.take(5, True)
                taps = [r.take(precision, True) for _ in range(order)]
            assert r.take(6) == 0
            k = r.take(4)
            for _ in range(size - order):
                u = r.unary() << k | r.take(k)
                x.append((u >> 1 ^ -(u & 1)) + (sum(c * x[-1 - j] for j, c in enumerate(taps)) >> shift))
        out += x
        r.at = -(-r.at // 8) * 8 + 16
    return bytes(v + 128 for v in out)


TEXTS = [None, "", "a", "x" * 64, "é" * 1000, "the cat sat on the mat. " * 300, "\x00￿" * 50, "".join(chr(100 + (i // 7) % 20) for i in range(3000)), "".join(chr(random.Random(4).randrange(32, 9000)) for _ in range(2000))]


def test_streams_decode_plainly_and_side_by_side():
    rng = np.random.default_rng(1)
    walks = [np.clip(np.cumsum(rng.integers(-s, s + 1, n)) + 128, 0, 255).astype(np.uint8) for s in (0, 1, 3, 40) for n in (64, 512, 576, 1664)]
    data = [np.frombuffer(padded(t), np.uint8) for t in TEXTS] + walks + [rng.integers(0, 256, 576).astype(np.uint8)]
    streams = flac.encode_many(data)
    assert {b"\x00", b"\x02"} < {s[f[5] : f[5] + 1] for s in streams for f in flac._frames(s, flac._metadata(s))}
    for p, s, blocks in zip(data, streams, flac.decode_many(streams), strict=True):
        assert plain_decode(s) == p.tobytes()
        assert (np.concatenate([x for _, x in blocks]) + 128).astype(np.uint8).tobytes() == p.tobytes()
        assert [f for f, _ in blocks] == list(range(0, len(p), flac.BLOCK))


def bits_to_bytes(bits):
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_linear_prediction_partitions_escapes_and_wasted_bits():
    rng = np.random.default_rng(2)
    n, order, shift, taps, wasted = 256, 3, 5, [40, -20, 9], 1
    x = [int(v) for v in rng.integers(-50, 50, order)]
    residual = []
    for i in range(order, n):
        residual.append(int(rng.integers(-6, 7)))
        x.append(residual[-1] + (sum(c * x[i - 1 - j] for j, c in enumerate(taps)) >> shift))
    width, word = 16 - wasted, lambda v, b: f"{v & (1 << b) - 1:0{b}b}"
    bits = "0" + word(31 + order, 6) + "1" + "1" + "".join(word(v, width) for v in x[:order]) + word(10 - 1, 4) + word(shift, 5) + "".join(word(c, 10) for c in taps)
    bits += "01" + word(2, 4)  # Rice codes of the second kind in four partitions, of which the third is raw
    for part in range(4):
        own = residual[max(0, part * 64 - order) : part * 64 + 64 - order]
        if part == 2:
            bits += word(31, 5) + word(5, 5) + "".join(word(v, 5) for v in own)
        else:
            bits += word(part, 5) + "".join("0" * (u >> part) + "1" + (word(u, part) if part else "") for u in ((2 * v if v >= 0 else -2 * v - 1) for v in own))
    head = bytes([0xFF, 0xF8, 0x80, 0x08, 0])
    frame = np.frombuffer(head + bytes([flac._crc8(head)]) + bits_to_bytes(bits), np.uint8)
    crc = 0
    for b in frame.tolist():
        crc ^= b << 8
        for _ in range(8):
            crc = crc << 1 ^ 0x8005 if crc >> 15 else crc << 1
            crc &= 0xFFFF
    info = (256).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 15 << 36 | n).to_bytes(8, "big") + bytes(16)
    stream = b"fLaC\x80\x00\x00\x22" + info + frame.tobytes() + crc.to_bytes(2, "big")
    ((first, got),) = flac.decode_many([stream])[0]
    assert first == 0 and got.tolist() == [v << wasted for v in x]
    broken = bytearray(stream)
    broken[60] ^= 4
    with pytest.raises(flac.Corrupt):
        flac.decode_many([bytes(broken)])


def test_encoder_uses_linear_predictors_and_thins_seek_points(monkeypatch):
    """A slow oscillation is what two past samples predict; the plain decoder reads it too."""
    wave = (128 + 100 * np.sin(0.9 * np.arange(2048))).round().astype(np.uint8)
    text = padded("In the beginning there was a sentence of some length, and then another one came. " * 20)
    text = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    monkeypatch.setattr(flac, "MOST_POINTS", 2)
    streams = flac.encode_many([wave, text])
    for payload, stream, blocks in zip([wave, text], streams, flac.decode_many(streams), strict=True):
        assert (np.concatenate([b for _, b in blocks]) + 128 == payload).all()
        assert plain_decode(stream) == payload.tobytes()
    info = flac._metadata(streams[0])
    assert len(info["seek"]) == 2 and {(streams[0][f[-1]] >> 1) & 0x3F for f in flac._frames(streams[0], info)} == {31 + flac.TAPS}


def test_frames_are_found_without_seek_points():
    p = np.frombuffer(padded(TEXTS[5]), np.uint8)
    s = flac.encode_many([p])[0]
    info = flac._metadata(s)
    bare = s[:4] + b"\x80" + s[5:42] + s[info["audio"] :]
    assert [x.tolist() for _, x in flac.decode_many([bare])[0]] == [x.tolist() for _, x in flac.decode_many([s])[0]]


def test_tables(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (3, "x" * 64)], "doc_id long, text string").withColumn("n_bytes", __import__("pyspark").sql.functions.lit("clash"))
    rows = flac.describe(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        p, n = padded(TEXTS[r.doc_id]), len((TEXTS[r.doc_id] or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    media = flac.encode(docs)
    assert {(r.doc_id, hashlib.sha256(r.media).hexdigest(), len(r.media)) for r in media.collect()} == {(r.doc_id, r.media_sha256, r.media_bytes) for r in rows}
    blocks = sorted((r for r in flac.read(media).collect() if r.doc_id == 5), key=lambda r: r.block)
    assert [r.sample_offset for r in blocks] == [flac.BLOCK * i for i in range(len(blocks))]
    assert (np.concatenate([np.frombuffer(r.pcm, "<i2") for r in blocks]) + 128).astype(np.uint8).tobytes() == padded(TEXTS[5])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert flac.describe(empty).collect() == [] and flac.read(flac.encode(empty)).collect() == []
