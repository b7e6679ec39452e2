"""FLAC: an encoder and decoder for 8-bit mono streams, and payloads stored as their samples.

A stream has STREAMINFO (with the MD5 of the samples), a SEEKTABLE and frames of ``BLOCK`` samples. The encoder takes
for each frame the cheapest of fixed predictors of order 0 to 2, linear predictors of the orders ``ORDERS`` fitted to the
frame's autocorrelation and quantised to ``PRECISION`` bits, one that is given, or the plain samples, with one Rice
partition, since more of them cost more than they save on 192 samples. The decoder reads constant, verbatim, fixed (0 to 4) and linear predictor (1 to 32)
subframes of both Rice codings, checks the CRC-8 of each header, the CRC-16 of each frame and the MD5 of the samples, and
writes PCM blocks with their sample offsets.

``media_digests`` writes the streams as a table in the shared scratch folder, reads them back, and takes all it returns
from the PCM blocks that it decodes. Many frames are decoded in lock step: their starts are found by the sync code with the frame number that is due and a
right CRC-8, and proven by the CRC-16 over what lies between two starts. Then one NumPy step reads sample i of every
frame. Where the starts can't be proven so, frames are decoded one after the other. A Spark task holds one block of
documents of about ``BLOCK_BYTES``.

Edge cases: a null or empty text is a payload of 192 spaces; repeated rows give equal values; an empty table gives an
empty result; only the key and the text are read, so clashing names of other columns do no harm.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import byte_blocks, named, stored

BLOCK = 192
SEEK_FRAMES = 256
ORDERS, PRECISION = (1, 3), 4
PCM_BLOCK = 64 * BLOCK
BLOCK_BYTES = 2 << 20
RATE_CODE, RATE = 4, 8000


@lru_cache(1)
def _crc8_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint16)
    for _ in range(8):
        t = np.where(t & 0x80, (t << 1) ^ 0x07, t << 1) & 0xFF
    return t.astype(np.uint8)


@lru_cache(1)
def _crc16_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t.astype(np.uint16)


_far = [np.zeros((0, 256), np.uint16)]


def _crc16_far(n: int) -> np.ndarray:
    """Row d: what a byte contributes to the CRC-16 of a message with d bytes behind it."""
    t = _far[0]
    if len(t) < n:
        one, rows = _crc16_table(), list(t) or [_crc16_table()]
        while len(rows) < max(n, 512):
            last = rows[-1]
            rows.append(((last << 8) & 0xFFFF).astype(np.uint16) ^ one[last >> 8])
        t = _far[0] = np.array(rows)
    return t


def crc16s(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many ranges of ``data`` that lie one behind the other without overlap: it is linear over bytes."""
    if not len(starts):
        return np.zeros(0, np.uint16)
    if int(lengths.max()) > 1 << 15:
        return np.array([_crc16_long(data[a : a + n]) for a, n in zip(starts, lengths)], np.uint16)
    ends = np.cumsum(lengths)
    owner_end = np.repeat(ends, lengths)
    at = np.arange(int(ends[-1]))
    source = at + np.repeat(starts - (ends - lengths), lengths)
    table = _crc16_far(int(lengths.max()))
    return np.bitwise_xor.reduceat(table[owner_end - 1 - at, data[source]], ends - lengths)


def _crc16_long(data: np.ndarray) -> int:
    c, t = 0, _crc16_table().tolist()
    for b in data.tolist():
        c = ((c << 8) & 0xFFFF) ^ t[(c >> 8) ^ b]
    return c


def _crc8s(rows: np.ndarray) -> np.ndarray:
    c, t = np.zeros(len(rows), np.uint8), _crc8_table()
    for j in range(rows.shape[1]):
        c = t[c ^ rows[:, j]]
    return c


def _coded(n: int) -> bytes:
    """A frame number in UTF-8's manner."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        lead >>= 1
    return bytes([((~(2 * lead + 1)) & 0xFF) | n, *reversed(tail)])


@lru_cache(1 << 16)
def _header(number: int) -> bytes:
    """Frame header: fixed blocking, 192 samples (code 1), 8 kHz, mono, 8 bits."""
    h = bytes([0xFF, 0xF8, 0x10 | RATE_CODE, 0x02]) + _coded(number)
    return h + bytes([int(_crc8s(np.frombuffer(h, np.uint8)[None])[0])])


def _residuals(x: np.ndarray, order: int) -> np.ndarray:
    for _ in range(order):
        x = x[:, 1:] - x[:, :-1]
    return x


def fit_predictors(x: np.ndarray, order: int, precision: int = PRECISION) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (a row per frame) and shifts of quantised linear predictors, by Levinson's recursion."""
    y = x.astype(np.float64)
    n = x.shape[1]
    r = np.stack([np.einsum("ij,ij->i", y[:, : n - lag], y[:, lag:]) for lag in range(order + 1)], axis=1)
    a, error = np.zeros((len(x), order)), r[:, 0] * (1 + 1e-9) + 1e-9
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = 1 << (precision - 1)
    shift = np.clip(precision - 1 - np.ceil(np.log2(np.maximum(np.abs(a).max(1), 1e-4) + 1e-9)), 0, 15).astype(np.int64)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -top, top - 1).astype(np.int64), shift


def _rice_parameters(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best Rice parameter of each row, of five around what its mean suggests, and the bits it takes."""
    guess = np.floor(np.log2(np.maximum(u.mean(1) * 0.7, 1))).astype(np.int32)
    best, bits = guess, np.full(len(u), np.iinfo(np.int64).max)
    for step in (-1, 0, 1, 2):
        k = np.clip(guess + step, 0, 14)
        now = (u >> k[:, None]).sum(1) + u.shape[1] * (1 + k.astype(np.int64))
        best, bits = np.where(now < bits, k, best), np.minimum(now, bits)
    return best, bits


def encode_frames(samples: np.ndarray, numbers: np.ndarray, lpc: tuple[tuple[int, ...], int] | None = None, orders: tuple[int, ...] = ORDERS) -> list[bytes]:
    """Frames of rows of ``BLOCK`` signed 8-bit samples.

    ``orders``: of linear predictors to fit to each frame; ``lpc``: coefficients and shift of one more to try.
    """
    x = samples.astype(np.int32)
    f = len(x)
    best_bits, best = np.full(f, 8 * BLOCK, np.int64), np.full(f, -1)  # -1: verbatim
    fitted = [(*fit_predictors(x, o), PRECISION) for o in orders if f]
    if lpc:
        fitted.append((np.tile(np.array(lpc[0], np.int64), (f, 1)), np.full(f, lpc[1]), 15))
    tried = {}
    for code, kind in enumerate([0, 1, 2, *fitted]):
        if isinstance(kind, tuple):
            coefficients, shift, precision = kind
            order = coefficients.shape[1]
            guess = sum(coefficients[:, [i]] * x[:, order - 1 - i : BLOCK - 1 - i] for i in range(order)) >> shift[:, None]
            r, extra = (x[:, order:] - guess).astype(np.int32), 4 + 5 + precision * order
        else:
            r, order, extra = _residuals(x, kind), kind, 0
        u = np.where(r >= 0, 2 * r, -2 * r - 1)
        k, bits = _rice_parameters(u)
        bits = bits + 10 + 8 * order + extra
        tried[code] = u, k, order, kind
        best = np.where(bits < best_bits, code, best)
        best_bits = np.minimum(bits, best_bits)
    headers = [_header(int(n)) for n in numbers]
    head = np.array([len(h) for h in headers])
    size = head + 1 + (best_bits + 7) // 8 + 2
    ends = np.cumsum(size)
    start = ends - size
    bits = np.zeros(int(ends[-1]) * 8, np.uint8)

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[at + j] = (value >> (width - 1 - j)) & 1

    body = (start + head) * 8
    for code in set(best.tolist()):
        rows = np.flatnonzero(best == code)
        at = body[rows]
        if code == -1:
            put(at, np.full(len(rows), 1 << 1), 8)
            put((at[:, None] + 8 + 8 * np.arange(BLOCK)).ravel(), (x[rows] & 0xFF).ravel(), 8)
            continue
        u, k, order, kind = tried[code]
        u, k, linear = u[rows], k[rows], isinstance(kind, tuple)
        put(at, np.full(len(rows), ((32 + order - 1) if linear else 8 + order) << 1), 8)
        at = at + 8
        for j in range(order):
            put(at, x[rows, j] & 0xFF, 8)
            at = at + 8
        if linear:
            coefficients, shift, precision = kind
            put(at, np.full(len(rows), precision - 1), 4)
            put(at + 4, shift[rows], 5)
            at = at + 9
            for j in range(order):
                put(at, coefficients[rows, j] & ((1 << precision) - 1), precision)
                at = at + precision
        put(at, k, 10)  # coding 0, partition order 0, then 4 bits of the parameter
        at = at + 10
        q = u >> k[:, None]
        stop = at[:, None] + np.cumsum(q + 1 + k[:, None], axis=1)
        for parameter in set(k.tolist()):
            own = k == parameter
            value = (1 << parameter) | (u[own] & ((1 << parameter) - 1))
            put((stop[own] - 1 - parameter).ravel(), value.ravel(), parameter + 1)
    data = np.packbits(bits)
    joined = np.frombuffer(b"".join(headers), np.uint8)
    where = np.arange(len(joined)) + np.repeat(start - (np.cumsum(head) - head), head)
    data[where] = joined
    crc = crc16s(data, start, size - 2)
    data[ends - 2], data[ends - 1] = crc >> 8, crc & 0xFF
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(start.tolist(), ends.tolist())]


def encode_many(payloads: list[bytes], lpc=None) -> list[bytes]:
    """One FLAC stream for each payload; a payload's length is a positive multiple of ``BLOCK``."""
    counts = [len(p) // BLOCK for p in payloads]
    if any(not n or len(p) % BLOCK for n, p in zip(counts, payloads)):
        raise ValueError(f"payloads must be positive multiples of {BLOCK} bytes")
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(n) for n in counts])
    frames = encode_frames(samples, numbers, lpc)
    out, at = [], 0
    for n in counts:
        own = frames[at : at + n]
        sizes = [len(x) for x in own]
        md5 = hashlib.md5(samples[at : at + n].tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | (n * BLOCK)).to_bytes(8, "big") + md5
        points, offset = [], 0
        for i, s in enumerate(sizes):
            if i % SEEK_FRAMES == 0:
                points.append(struct.pack(">QQH", i * BLOCK, offset, BLOCK))
            offset += s
        seek = b"".join(points)
        out.append(b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(own))
        at += n
    return out


class FlacError(ValueError):
    pass


def read_metadata(data: bytes) -> dict:
    """STREAMINFO's fields, the seek points, and where the frames begin."""
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, out = 4, False, {"seek": []}
    while not last:
        last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"block": struct.unpack(">H", body[2:4])[0], "rate": packed >> 44, "channels": ((packed >> 41) & 7) + 1, "bits": ((packed >> 36) & 31) + 1, "total": packed & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            out["seek"] = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, n, 18)]
        at += 4 + n
    if out.get("bits") != 8 or out.get("channels") != 1:
        raise FlacError("only 8-bit mono is read")
    return out | {"frames_at": at}


class _Bits:
    """Big-endian bit windows of a byte buffer, for many places at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        w = np.zeros(len(data) + 8, np.uint64)
        for j in range(8):
            w = (w << np.uint64(8)) | padded[j : j + len(w)]
        self.w = w

    def window(self, p: np.ndarray) -> np.ndarray:
        """At least 57 valid bits from bit ``p`` on, at the top."""
        return self.w[p >> 3] << (p & 7).astype(np.uint64)

    def read(self, p: np.ndarray, width: int) -> np.ndarray:
        return (self.window(p) >> np.uint64(64 - width)).astype(np.int64) if width else np.zeros(len(p), np.int64)

    def signed(self, p: np.ndarray, width: int) -> np.ndarray:
        v = self.read(p, width)
        return v - ((v >> (width - 1)) << width)


def _zeros(w: np.ndarray) -> np.ndarray:
    """Leading zeros of 64-bit values from the exponent of their top 52 bits as a float; 64 if these are all zero."""
    top = w >> np.uint64(12)
    return np.where(top > 0, 1074 - (top.astype(np.float64).view(np.int64) >> 52), 64)


def decode_subframes(bits: _Bits, p: np.ndarray, block: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Decode the subframe at bit ``p[i]`` of ``block[i]`` samples into ``out[i]``, all in lock step; the ends in bits."""
    head = bits.read(p, 8)
    kind = (head >> 1) & 63
    if (head & 0x81).any():
        raise FlacError("padding or wasted bits in a subframe")
    p = p + 8
    end = p.copy()
    for k in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == k)
        at, n = p[rows], block[rows]
        width = int(n.max())
        if k == 0:
            out[rows, :width] = bits.signed(at, 8)[:, None]
            end[rows] = at + 8
        elif k == 1:
            for j in range(width):
                live = rows[n > j]
                out[live, j] = bits.signed(p[live] + 8 * j, 8)
            end[rows] = at + 8 * n
        elif 8 <= k <= 12 or k >= 32:
            order = k - 8 if k < 32 else k - 31
            x = np.zeros((width, len(rows)), np.int64)
            for j in range(order):
                x[j] = bits.signed(at, 8)
                at = at + 8
            weights = shift = None
            if k >= 32:
                precision = bits.read(at, 4) + 1
                shift = bits.signed(at + 4, 5)
                at = at + 9
                weights = np.zeros((order, len(rows)), np.int64)
                for j in range(order):
                    for q in np.unique(precision).tolist():
                        own = precision == q
                        weights[j, own] = bits.signed(at[own], q)
                    at = at + precision
            end[rows] = _rice(bits, at, n, order, x)
            _restore(x, order, weights, shift)
            out[rows, :width] = x.T
        else:
            raise FlacError(f"reserved subframe type {k}")
    return end


def _rice(bits: _Bits, at: np.ndarray, n: np.ndarray, order: int, x: np.ndarray) -> np.ndarray:
    """Residuals into ``x[order:]``, a row per sample; the place after them."""
    coding = bits.read(at, 2)
    if (coding > 1).any():
        raise FlacError("reserved residual coding")
    wide = coding + 4
    part = n >> bits.read(at + 2, 4)
    at = at + 6
    left = part - order
    k = np.zeros(len(at), np.int64)
    raw = np.zeros(len(at), np.int64)
    fresh = np.ones(len(at), bool)
    uneven = len(np.unique(n)) > 1
    plain = False
    for j in range(order, len(x)):
        if fresh.any():  # a partition begins: read its parameter
            value = np.where(wide == 4, bits.read(at, 4), bits.read(at, 5))
            escape = fresh & (value == np.where(wide == 4, 15, 31))
            k = np.where(fresh, value, k)
            at = np.where(fresh, at + wide, at)
            raw = np.where(escape, bits.read(at, 5), raw)
            at = np.where(escape, at + 5, at)
            raw = np.where(fresh & ~escape, -1, raw)
            plain = (raw >= 0).any()
        live = n > j if uneven else None
        w = bits.window(at)
        q = _zeros(w)
        long = q + 1 + k > 56
        if long.any():
            for i in np.flatnonzero(long):
                q[i] = _long_zeros(bits, int(at[i]))
            low = bits.window(at + q + 1)
        else:
            low = w << (q + 1).astype(np.uint64)
        ku = k.astype(np.uint64)
        u = (q << k) | (low >> np.uint64(1) >> (np.uint64(63) - ku)).astype(np.int64)
        r = (u >> 1) ^ -(u & 1)
        step = q + 1 + k
        if plain:
            for i in np.flatnonzero(raw >= 0):
                r[i] = int(bits.signed(at[i : i + 1], int(raw[i]))[0]) if raw[i] else 0
                step[i] = raw[i]
        if live is None:
            x[j] = r
            at = at + step
        else:
            x[j] = np.where(live, r, 0)
            at = np.where(live, at + step, at)
        left = left - 1
        fresh = (left == 0) & (n > j + 1)
        left = np.where(fresh, part, left)
    return at


def _long_zeros(bits: _Bits, at: int) -> int:
    start = at
    while True:
        z = int(_zeros(bits.window(np.array([at])))[0])
        if z < 52:
            return at + z - start
        at += 52
        if at >> 3 >= len(bits.w) - 8:
            raise FlacError("a residual runs off the end")


def _restore(x: np.ndarray, order: int, weights: np.ndarray | None, shift: np.ndarray | None) -> None:
    """Add the prediction to residuals, in place; rows are samples."""
    if weights is None:
        for level in range(order, 0, -1):
            # Undo one difference: the first value of this level comes from the warm-up samples.
            warm = x[:order].copy()
            for _ in range(level - 1):
                warm = warm[1:] - warm[:-1]
            seed = warm[len(warm) - 1 : len(warm)]
            x[order:] = np.cumsum(x[order:], axis=0) + seed
        return
    for j in range(order, len(x)):
        x[j] += (weights * x[j - 1 : j - order - 1 : -1] if j > order else weights * x[order - 1 :: -1][:order]).sum(0) >> shift


def _frame_starts(data: np.ndarray, spans: list[tuple[int, int, int]]) -> list[np.ndarray | None]:
    """For each (first byte, end, frames due): the starts of its frames, or None where they aren't proven."""
    sync = np.flatnonzero((data[:-4] == 0xFF) & (data[1:-3] == 0xF8) & (data[2:-2] == (0x10 | RATE_CODE)) & (data[3:-1] == 0x02)) if len(data) > 4 else np.zeros(0, np.int64)
    raw = data.tobytes()
    out: list[np.ndarray | None] = []
    edges = np.searchsorted(sync, [(a, b) for a, b, _ in spans])
    for (a, b, due), (lo, hi) in zip(spans, edges):
        own = sync[lo:hi]
        if len(own) != due:  # chance matches: keep those with the number that is due, in turn
            picked = []
            for s in own.tolist():
                h = _header(len(picked))
                if raw[s : s + len(h)] == h:
                    picked.append(s)
            own = np.array(picked, np.int64)
        out.append(own if len(own) == due and due and own[0] == a else None)
    return out


def decode_many(streams: list[bytes]) -> list[bytes]:
    """The samples of each stream as unsigned bytes; every checksum is verified."""
    metas = [read_metadata(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    offsets = np.cumsum([0, *map(len, streams)])
    spans = [(int(o) + m["frames_at"], int(e), m["total"] // BLOCK if m["block"] == BLOCK and m["total"] % BLOCK == 0 else -1) for o, e, m in zip(offsets, offsets[1:], metas)]
    found = _frame_starts(data, spans)
    bits = _Bits(data)
    lanes = [i for i, f in enumerate(found) if f is not None]
    out: list[bytes | None] = [None] * len(streams)
    if lanes:
        starts = np.concatenate([found[i] for i in lanes])
        ends = np.concatenate([np.append(found[i][1:], spans[i][1]) for i in lanes])
        numbers = np.concatenate([np.arange(spans[i][2]) for i in lanes])
        heads = [_header(int(n)) for n in numbers]
        size = np.array([len(h) for h in heads])
        total = int(size.sum())
        where = np.arange(total) + np.repeat(starts - (np.cumsum(size) - size), size)
        right_head = np.logical_and.reduceat(data[np.minimum(where, len(data) - 1)] == np.frombuffer(b"".join(heads), np.uint8), np.cumsum(size) - size)
        crc = crc16s(data, starts, ends - starts - 2)
        sound = right_head & (crc == (data[ends - 2].astype(np.uint16) << 8 | data[ends - 1]))
        frames = np.zeros((len(starts), BLOCK), np.int64)
        stop = np.zeros(len(starts), np.int64)
        if sound.all():
            stop = decode_subframes(bits, (starts + size) * 8, np.full(len(starts), BLOCK), frames)
        proven = sound & ((stop + 7) // 8 + 2 == ends)
        at = 0
        pcm = frames.astype(np.int8).tobytes()
        for i in lanes:
            n = spans[i][2]
            if proven[at : at + n].all():
                out[i] = pcm[at * BLOCK : (at + n) * BLOCK]
            at += n
    for i, m in enumerate(metas):
        if out[i] is None:
            out[i] = b"".join(x.astype(np.int8).tobytes() for _, _, x in decode_frames(streams[i], m))
        if m["md5"] != bytes(16) and hashlib.md5(out[i]).digest() != m["md5"]:
            raise FlacError("the samples do not match their MD5")
    return [(np.frombuffer(x, np.uint8) ^ 0x80).tobytes() for x in out]


def decode_frames(stream: bytes, meta: dict | None = None, sample: int = 0):
    """(sample offset, byte offset, samples) of each frame in turn; starts at the seek point before ``sample``."""
    m = meta or read_metadata(stream)
    data = np.frombuffer(stream, np.uint8)
    bits = _Bits(data)
    point = max((p for p in m["seek"] if p[0] <= sample), default=(0, 0, 0))
    at, done = m["frames_at"] + point[1], point[0]
    while done < m["total"]:
        if stream[at] != 0xFF or stream[at + 1] != 0xF8:
            raise FlacError("no frame where one is due")
        code, lead = stream[at + 2] >> 4, stream[at + 4]
        n = at + 5
        if lead >= 0xC0:
            n += 8 - (lead ^ 0xFF).bit_length() - 1
        sizes = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
        if code in (6, 7):
            block = int.from_bytes(stream[n : n + code - 5], "big") + 1
            n += code - 5
        else:
            block = sizes.get(code, 0)
        n += {12: 1, 13: 2, 14: 2}.get(stream[at + 2] & 15, 0)
        if not block or int(_crc8s(data[None, at:n])[0]) != stream[n]:
            raise FlacError("bad frame header")
        x = np.zeros((1, block), np.int64)
        stop = (int(decode_subframes(bits, np.array([(n + 1) * 8]), np.array([block]), x)[0]) + 7) // 8
        if _crc16_long(data[at:stop]) != int.from_bytes(stream[stop : stop + 2], "big"):
            raise FlacError("bad frame checksum")
        yield done, at, x[0]
        done, at = done + block, stop + 2


def pcm_pieces(samples: bytes, block: int = PCM_BLOCK):
    """(sample offset, samples) of the blocks of decoded samples."""
    for at in range(0, len(samples), block):
        yield at, samples[at : at + block]


class Digest:
    """What is kept of a payload's PCM blocks as they come by: its hash, its end, and measures of the signed samples."""

    def __init__(self):
        self.sha, self.tail, self.bytes, self.peak, self.energy, self.crossings, self.below = hashlib.sha256(), b"", 0, 0, 0, 0, None

    def add(self, pcm: bytes) -> None:
        self.sha.update(pcm)
        self.tail = (self.tail + pcm[-16:])[-16:]
        self.bytes += len(pcm)
        x = (np.frombuffer(pcm, np.uint8) ^ 0x80).view(np.int8).astype(np.int32)
        below = x < 0
        self.peak = max(self.peak, int(np.abs(x).max()))
        self.energy += int((x * x).sum())
        self.crossings += int((below[1:] != below[:-1]).sum()) + (self.below is not None and bool(below[0]) != self.below)
        self.below = bool(below[-1])

    def feature(self) -> str:
        """Peak, mean square and zero crossings."""
        return f"peak={self.peak};energy={self.energy // max(self.bytes, 1)};crossings={self.crossings}"


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % BLOCK or (0 if text else BLOCK))


def encode_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): the FLAC stream of each padded text."""
    import pyarrow as pa

    def run(batches):
        for b in byte_blocks(batches, BLOCK_BYTES):
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            media = encode_many([pad(t) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])

    rows = df.select(named(key).alias("key"), named(text).alias("text"))
    return rows.mapInArrow(run, f"key {dict(df.dtypes)[key]}, n_bytes bigint, media binary").withColumnRenamed("key", key)


def pcm_blocks(df: DataFrame, key: str = "doc_id", media: str = "media", block: int = PCM_BLOCK) -> DataFrame:
    """(key, sample_offset, pcm): decoded samples as unsigned bytes, in blocks that can be sought by sample offset."""
    import pyarrow as pa

    def run(batches):
        for b in byte_blocks(batches, BLOCK_BYTES, "media"):
            keys, streams = b.column(0), b.column(1).to_pylist()
            rows = [(i, at, pcm) for i, samples in enumerate(decode_many(streams)) for at, pcm in pcm_pieces(samples, block)]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["key", "sample_offset", "pcm"])

    rows = df.filter(named(media).isNotNull()).select(named(key).alias("key"), named(media).alias("media"))
    return rows.mapInArrow(run, f"key {dict(df.dtypes)[key]}, sample_offset bigint, pcm binary").withColumnRenamed("key", key)


def media_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each padded text as FLAC, read the stored bytes back, and digest the blocks that are decoded from them."""
    import pyarrow as pa

    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in byte_blocks(batches, BLOCK_BYTES, "media"):
            media, found = b.column(2).to_pylist(), []
            for samples in decode_many(media):
                d = Digest()
                for _, pcm in pcm_pieces(samples):
                    d.add(pcm)
                found.append((d.bytes, d.sha.hexdigest(), zlib.crc32(d.tail), d.feature()))
            size, sha, tail, feature = (list(c) for c in zip(*found))
            columns = (pa.array(size, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(feature))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=names)

    media = stored(encode_media(df.select(named(key).alias("key"), named(text).alias("text")), "key", "text"), "media", level=9)
    out = media.mapInArrow(run, f"key {dict(df.dtypes)[key]}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return out.withColumnRenamed("key", key)


def op3_flac(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return media_digests(table(spark, sf_dir, "documents"))
