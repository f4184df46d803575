"""FLAC media columns: 8-bit mono streams, coded and decoded for many frames at once by array operations.

A payload of bytes is kept as signed 8-bit samples (byte - 128) in frames of 1024 samples. A frame is a
constant, a verbatim or a linear-prediction subframe: a fixed predictor of order 0 to 3 or one of order LPC_ORDER
fitted to the frame, whichever codes shortest, with Rice-coded residuals in eight partitions. The stream has the
STREAMINFO block with the MD5 of the samples and a SEEKTABLE with every frame, so that any block of samples can
be read alone; a stream of more frames than a table can hold has points at equal distances, and the frames between two
points are found by their headers and checksums.

The decoder reads any such stream of 8-bit mono: all subframe types, predictors up to order 32, both Rice methods,
escaped partitions, any block size. It checks the CRC-8 of every frame header, the CRC-16 of every
frame and the MD5 of the stream, and raises ValueError if one is wrong. Frames are decoded side by side: step i takes the
ith residual of every frame from a 64-bit window at its bit position.

Memory: a task codes batches of about BATCH bytes and decodes TOGETHER frames at once; of a longer text only its own
bytes, coded and decoded, are held beside them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean_up, materialize, written

FRAME = 1024
ALIGN = 64
LPC_ORDER = 4
PARTITION_ORDER = 3
BATCH = 1 << 20
TOGETHER = 1024
#: PCM of up to so many bytes of media is written at once, more in so many waves.
WAVE, WAVES = 1 << 25, 12
#: Points of a seek table: a metadata block's length has 24 bits.
POINTS = 900_000
RATE = 16000
#: Coefficients of the fixed predictors by order (fixed values of the format).
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_PRECISION = 12


def _table(polynomial: int, width: int) -> np.ndarray:
    """CRC of each value of `width` bits, highest bit first, from zero."""
    crc = np.arange(1 << width, dtype=np.int64)
    for _ in range(width):
        crc = np.where(crc >> (width - 1) & 1, crc << 1 ^ polynomial, crc << 1) & ((1 << width) - 1)
    return crc


_CRC8 = _table(0x07, 8).tolist()
_CRC16 = _table(0x8005, 16).astype(np.uint16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16(frames: list[bytes]) -> np.ndarray:
    """The CRC-16 of each, side by side: zero bytes before a frame leave the register at zero."""
    if not frames:
        return np.zeros(0, np.uint16)
    longest = max(map(len, frames)) + 1 & ~1
    flat = np.frombuffer(b"".join(f.rjust(longest, b"\0") for f in frames), ">u2").reshape(len(frames), -1)
    words = np.ascontiguousarray(flat.T.astype(np.uint16))
    crc = np.zeros(len(frames), np.uint16)
    for word in words:
        crc = _CRC16[crc ^ word]
    return crc


def _number(n: int) -> bytes:
    """A frame number, coded as UTF-8 codes code points."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while n >= limit:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit = 0x40 >> len(tail)
    return bytes([0xFF << (7 - len(tail)) & 0xFF | n, *reversed(tail)])


@lru_cache(maxsize=8192)
def frame_header(number: int, length: int) -> bytes:
    exact = length == FRAME
    head = bytes([0xFF, 0xF8, 0xA0 if exact else 0x70, 0x02]) + _number(number) + (b"" if exact else struct.pack(">H", length - 1))
    return head + bytes([crc8(head)])


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shifts of predictors fitted to rows of x by Levinson and Durbin's recursion."""
    f = x.astype(np.float32)
    n = x.shape[1]
    r = np.stack([np.einsum("ij,ij->i", f[:, lag:], f[:, : n - lag]) for lag in range(LPC_ORDER + 1)], axis=1).astype(float)
    a = np.zeros((len(x), LPC_ORDER))
    error = r[:, 0] * 1.0001 + 1e-3
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error *= np.maximum(1 - k * k, 1e-6)
    largest = np.maximum(np.abs(a).max(axis=1), 1e-6)
    shift = np.clip(_PRECISION - 2 - np.floor(np.log2(largest)).astype(int), 0, 15)
    most = (1 << (_PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -most - 1, most).astype(np.int32), shift


def _bodies(x: np.ndarray) -> list[bytes]:
    """The subframes of rows of x, int32 samples; the length is a multiple of eight times the partitions."""
    rows, n = x.shape
    parts = 1 << PARTITION_ORDER
    each = n // parts
    coefficients, shift = _lpc(x)
    residuals = [x]
    for _ in range(3):
        r = residuals[-1].copy()
        r[:, 1:] -= residuals[-1][:, :-1]
        residuals.append(r)
    orders = [0, 1, 2, 3, LPC_ORDER]
    guess = np.zeros_like(x)
    for j in range(LPC_ORDER):
        guess[:, LPC_ORDER:] += coefficients[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : n - 1 - j]
    residuals.append(x - (guess >> shift[:, None]))
    best_bits = best = None
    for choice, (r, order) in enumerate(zip(residuals, orders, strict=True)):
        u = (r << 1) ^ (r >> 31)
        u[:, :order] = 0
        sums = u.reshape(rows, parts, each).sum(axis=2, dtype=np.int64)
        sizes = np.full(parts, each)
        sizes[0] -= order
        k = np.clip(np.floor(np.log2(np.maximum(sums / np.maximum(sizes, 1) * 0.6931, 1e-3))).astype(int) + 1, 0, 14)
        bits = (sizes * (k + 1) + (sums >> k)).sum(axis=1) + 8 * order + (choice == 4) * (9 + _PRECISION * order)
        if best is None:
            best_bits, best, best_u, best_k = bits, np.zeros(rows, int), u, k
        else:
            less = bits < best_bits
            best_bits = np.where(less, bits, best_bits)
            best[less] = choice
            best_u = np.where(less[:, None], u, best_u)
            best_k = np.where(less[:, None], k, best_k)
    constant = (x == x[:, :1]).all(axis=1)
    order = np.array(orders)[best]
    lpc = best == 4
    # A frame's fields in the order of the format; a field of no bits is absent.
    head_values = np.zeros((rows, 1 + LPC_ORDER + 2 + LPC_ORDER + 1), np.int64)
    head_bits = np.zeros_like(head_values)
    head_values[:, 0] = np.where(lpc, (32 + LPC_ORDER - 1) << 1, (8 + order) << 1)
    head_bits[:, 0] = 8
    for i in range(LPC_ORDER):
        here = order > i
        head_values[here, 1 + i] = x[here, i] & 0xFF
        head_bits[here, 1 + i] = 8
    at = 1 + LPC_ORDER
    head_values[lpc, at], head_bits[lpc, at] = _PRECISION - 1, 4
    head_values[lpc, at + 1], head_bits[lpc, at + 1] = shift[lpc], 5
    head_values[lpc, at + 2 : at + 2 + LPC_ORDER] = coefficients[lpc] & ((1 << _PRECISION) - 1)
    head_bits[lpc, at + 2 : at + 2 + LPC_ORDER] = _PRECISION
    head_values[:, -1], head_bits[:, -1] = PARTITION_ORDER, 6
    k = np.repeat(best_k, each, axis=1)
    q = best_u >> k
    values = np.empty((rows, parts, each + 1), np.int32)
    bits = np.empty((rows, parts, each + 1), np.int32)
    values[:, :, 0], bits[:, :, 0] = best_k, 4
    values[:, :, 1:] = ((1 << k) | (best_u & ((1 << k) - 1))).reshape(rows, parts, each)
    bits[:, :, 1:] = (q + 1 + k).reshape(rows, parts, each)
    for i in range(LPC_ORDER):  # the warm-up samples have no residuals
        here = order > i
        values[here, 0, 1 + i] = bits[here, 0, 1 + i] = 0
    values = np.concatenate([head_values.astype(np.int32), values.reshape(rows, -1)], axis=1)
    bits = np.concatenate([head_bits.astype(np.int32), bits.reshape(rows, -1)], axis=1)
    ends = np.cumsum(bits, axis=1, dtype=np.int64)
    sizes = (ends[:, -1] + 7) // 8
    starts = np.cumsum(sizes) - sizes
    ends += (starts * 8 + 24)[:, None]  # three bytes in front, which nothing writes to
    ends, values = ends.reshape(-1), values.reshape(-1)
    last = (ends - 1) >> 3
    shifted = values << (-ends & 7)
    total = int(sizes.sum()) + 4
    packed = np.bincount(last, shifted & 255, total)
    packed += np.bincount(last - 1, shifted >> 8 & 255, total)
    packed += np.bincount(last - 2, shifted >> 16, total)
    packed = packed.astype(np.uint8).tobytes()
    raw = (x & 0xFF).astype(np.uint8)
    out = []
    for i, (a, size) in enumerate(zip((starts + 3).tolist(), sizes.tolist(), strict=True)):
        if constant[i]:
            out.append(bytes([0, raw[i, 0]]))
        elif size > n + 1:
            out.append(b"\x02" + raw[i].tobytes())
        else:
            out.append(packed[a : a + size])
    return out


def _frames(payloads: list[bytes], first: int = 0) -> list[list[bytes]]:
    """The frames of each payload; first: the number of the first frame, for a part of a long payload."""
    by_length: dict[int, tuple[list[tuple[int, int]], list[bytes]]] = {}
    out: list[list[bytes]] = []
    for i, payload in enumerate(payloads):
        out.append([b""] * -(-len(payload) // FRAME))
        for j in range(len(out[-1])):
            part = payload[j * FRAME : (j + 1) * FRAME]
            places, parts = by_length.setdefault(len(part), ([], []))
            places.append((i, j))
            parts.append(part)
    wholes: list[bytes] = []
    where: list[tuple[int, int]] = []
    for length, (places, parts) in by_length.items():
        x = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, length).astype(np.int32) - 128
        wholes += [frame_header(first + j, length) + body for (_, j), body in zip(places, _bodies(x), strict=True)]
        where += places
    for (i, j), frame, crc in zip(where, wholes, crc16(wholes).tolist(), strict=True):
        out[i][j] = frame + crc.to_bytes(2, "big")
    return out


def _samples_md5(payload: bytes) -> bytes:
    return hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest()


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    block = min(FRAME, len(payload))
    sizes = list(map(len, frames))
    bits = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + bits.to_bytes(8, "big") + _samples_md5(payload)
    step = -(-len(frames) // POINTS)
    offsets = np.cumsum([0, *sizes[:-1]])[::step]
    points = np.zeros(len(offsets), [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    points["sample"], points["offset"], points["n"] = np.arange(len(offsets)) * FRAME * step, offsets, FRAME
    if (len(frames) - 1) % step == 0:
        points["n"][-1] = len(payload) - (len(frames) - 1) * FRAME
    table = points.tobytes()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, whose lengths must be positive multiples of 64."""
    if any(not p or len(p) % ALIGN for p in payloads):
        raise ValueError("payloads must be positive multiples of 64 bytes")
    short = [i for i, p in enumerate(payloads) if len(p) <= 4 * BATCH]
    out: list[bytes] = [b""] * len(payloads)
    for i, frames in zip(short, _frames([payloads[i] for i in short]), strict=True):
        out[i] = _stream(payloads[i], frames)
    step = BATCH // FRAME * FRAME
    for i, payload in enumerate(payloads):
        if not out[i]:
            frames = [f for a in range(0, len(payload), step) for f in _frames([payload[a : a + step]], a // FRAME)[0]]
            out[i] = _stream(payload, frames)
    return out


class Layout:
    """What the metadata of a stream says: samples, md5, frame offsets (from `start`) and first samples."""

    def __init__(self, media: bytes):
        if media[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, table = 4, False, b""
        while not last:
            last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
            block = media[at + 4 : at + 4 + size]
            at += 4 + size
            if kind == 0:
                self.block = int.from_bytes(block[2:4], "big")
                packed = int.from_bytes(block[10:18], "big")
                self.samples, self.md5 = packed & (1 << 36) - 1, block[18:34]
                if packed >> 36 & 31 != 7 or packed >> 41 & 7:
                    raise ValueError("only 8-bit mono is read here")
            elif kind == 3:
                table = block
        self.start = at
        points = np.frombuffer(table, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        points = points[points["sample"] != 2**64 - 1]
        self.first = points["sample"].astype(np.int64)
        self.offsets = points["offset"].astype(np.int64)
        self.lengths = points["n"].astype(np.int64)


@lru_cache(maxsize=8192)
def _parse_header(head: bytes) -> tuple[int, int]:
    """Block size and length of a frame header that head begins with; its CRC-8 is checked."""
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8 or head[3] & 0xF0 or head[3] >> 1 & 7 not in (0, 1):
        raise ValueError("no frame header of 8-bit mono")
    code, at = head[2] >> 4, 4
    lead = head[at]
    at += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if code == 6:
        size, at = head[at] + 1, at + 1
    elif code == 7:
        size, at = int.from_bytes(head[at : at + 2], "big") + 1, at + 2
    elif code:
        size = 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
    else:
        raise ValueError("reserved block size")
    at += {12: 1, 13: 2, 14: 2}.get(head[2] & 15, 0)
    if at >= len(head) or crc8(head[:at]) != head[at]:
        raise ValueError("wrong CRC-8 of a frame header")
    return size, at + 1


def _slow_zeros(data: bytes, at: int) -> int:
    """Zero bits from bit `at` on, however many."""
    n = 0
    while not data[at + n >> 3] >> (7 - (at + n & 7)) & 1:
        n += 1
    return n


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The signed samples of whole frames, decoded side by side, checksums verified."""
    if not frames:
        return []
    if any(len(f) < 9 for f in frames):
        raise ValueError("a frame is cut short")
    sums = crc16([f[:-2] for f in frames])
    if (sums != np.frombuffer(b"".join(f[-2:] for f in frames), ">u2")).any():
        raise ValueError("wrong CRC-16 of a frame")
    heads = [_parse_header(f[:16]) for f in frames]
    sizes = np.array([s for s, _ in heads])
    out: list[np.ndarray] = [np.zeros(0)] * len(frames)
    chosen = []
    for i, (frame, (size, at)) in enumerate(zip(frames, heads, strict=True)):
        kind = frame[at]
        if kind & 0x81:
            raise ValueError("a subframe with padding or wasted bits")
        kind >>= 1
        if kind == 0:
            out[i] = np.full(size, np.int8(frame[at + 1] - 256 if frame[at + 1] > 127 else frame[at + 1]), np.int32)
        elif kind == 1:
            out[i] = np.frombuffer(frame, np.int8, size, at + 1).astype(np.int32)
        elif 8 <= kind <= 12 or kind >= 32:
            chosen.append(i)
        else:
            raise ValueError("reserved subframe type")
    if not chosen:
        return out
    chosen.sort(key=lambda i: -sizes[i])
    starts, pieces, total = [], [], 0
    for i in chosen:
        starts.append((total + heads[i][1]) * 8)
        pieces.append(frames[i])
        total += len(frames[i])
    data = b"".join(pieces) + bytes(16)
    octets = np.frombuffer(data, np.uint8)
    n = len(data) - 8
    window = np.zeros(n, np.uint64)
    for i in range(8):
        window |= octets[i : i + n].astype(np.uint64) << np.uint64(56 - 8 * i)
    pos = np.array(starts)
    size = sizes[chosen]

    def take(which: np.ndarray, width) -> np.ndarray:
        """The next `width` bits (32 at most) of the frames in which."""
        at = pos[which]
        w = window[at >> 3] << (at & 7).astype(np.uint64)
        pos[which] = at + width
        width = np.asarray(width, np.uint64)
        return np.where(width > 0, w >> (np.uint64(64) - np.maximum(width, np.uint64(1))), np.uint64(0)).astype(np.int64)

    def signed(v: np.ndarray, width) -> np.ndarray:
        return v - ((v >> (width - 1) & 1) << width)

    every = np.arange(len(chosen))
    kind = take(every, 8) >> 1
    lpc = kind >= 32
    order = np.where(lpc, kind - 31, kind - 8)
    deepest = int(order.max())
    longest = int(size.max())
    samples = np.zeros((deepest + longest, len(chosen)), np.int32)  # `deepest` rows of nothing first
    for i in range(deepest):
        which = np.flatnonzero(order > i)
        samples[deepest + i, which] = signed(take(which, 8), 8)
    coefficients = np.zeros((max(deepest, 1), len(chosen)), np.int64)
    shift = np.zeros(len(chosen), np.int64)
    for o in range(1, min(4, deepest) + 1):
        coefficients[:o, (kind == 8 + o)] = np.array(FIXED[o])[:, None]
    which = np.flatnonzero(lpc)
    if len(which):
        precision = take(which, 4) + 1
        shift[which] = signed(take(which, 5), 5)
        if (precision == 16).any() or (shift < 0).any():
            raise ValueError("reserved predictor")
        for i in range(deepest):
            here = order[which] > i
            coefficients[i, which[here]] = signed(take(which[here], precision[here]), precision[here])
    method = take(every, 2)
    if (method > 1).any():
        raise ValueError("reserved residual coding")
    each = size >> take(every, 4)
    # The residuals, as coded; raw marks frames in an escaped partition.
    coded = np.zeros((longest, len(chosen)), np.int64)
    k, raw, ends = np.zeros(len(chosen), np.int64), np.zeros(len(chosen), bool), np.zeros(len(chosen), np.int64)
    changes = {*order.tolist(), *size.tolist()}
    active = every
    for i in range(longest):
        if i in changes or not i:
            active = np.flatnonzero((order <= i) & (size > i))
        at_end = active[ends[active] <= i] if i in changes or not i or (ends[active] <= i).any() else active[:0]
        if len(at_end):
            width = 4 + method[at_end]
            k[at_end] = take(at_end, width)
            ends[at_end] = (i // each[at_end] + 1) * each[at_end]
            raw[at_end] = k[at_end] == (1 << width) - 1
            escaped = at_end[raw[at_end]]
            if len(escaped):
                k[escaped] = take(escaped, 5)
        at, own = pos[active], k[active]
        w = window[at >> 3] << (at & 7).astype(np.uint64)
        q = 53 - np.frexp((w >> np.uint64(11)).astype(np.float64))[1]
        far = q + 1 + own > 53
        if far.any() or raw[active].any():
            q = q.astype(np.int64)
            for j in np.flatnonzero(far & ~raw[active]).tolist():
                q[j] = _slow_zeros(data, int(at[j]))
            u = np.zeros(len(active), np.int64)
            rice = active[~raw[active]]
            zeros = q[~raw[active]]
            pos[rice] += zeros + 1
            u[~raw[active]] = zeros << k[rice] | take(rice, k[rice])
            plain = active[raw[active]]
            if len(plain):
                v = take(plain, k[plain])
                v = np.where(k[plain] > 0, signed(v, np.maximum(k[plain], 1)), 0)
                u[raw[active]] = v << 1 ^ v >> 63
            coded[i, active] = u
        else:
            low = (w << (q + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - own).astype(np.uint64)
            coded[i, active] = q.astype(np.int64) << own | low.astype(np.int64)
            pos[active] = at + q + 1 + own
    residual = (coded >> 1 ^ -(coded & 1)).astype(np.int64)
    wide = samples.astype(np.int64)
    for i in range(longest):
        guess = residual[i] + 0
        if deepest:
            total = (coefficients * wide[deepest + i - 1 : (i - 1 if i else None) : -1][:deepest]).sum(axis=0) if deepest + i else 0
            guess += total >> shift
        here = order <= i
        wide[deepest + i, here] = guess[here]
    for j, i in enumerate(chosen):
        out[i] = wide[deepest : deepest + sizes[i], j].astype(np.int32)
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams, with every checksum verified."""
    out = []
    for batch in _batches(streams):
        layouts = [Layout(s) for s in batch]
        payloads, sums = [bytearray() for _ in batch], [hashlib.md5() for _ in batch]
        held: list[tuple[int, bytes]] = []

        def take(payloads=payloads, sums=sums, held=held) -> None:
            for (i, _), samples in zip(held, decode_frames([f for _, f in held]), strict=True):
                sums[i].update(samples.astype(np.int8).tobytes())
                payloads[i] += (samples + 128).astype(np.uint8).tobytes()
            held.clear()

        for i, (stream, layout) in enumerate(zip(batch, layouts, strict=True)):
            for frame in _cut(stream, layout):
                held.append((i, frame))
                if len(held) >= TOGETHER:
                    take()
        take()
        for payload, md5, layout in zip(payloads, sums, layouts, strict=True):
            if len(payload) != layout.samples or md5.digest() != layout.md5:
                raise ValueError("wrong MD5 of the samples")
            out.append(bytes(payload))
    return out


def _cut(stream: bytes, layout: Layout, first: int = 0, last: int | None = None) -> Iterator[bytes]:
    """The frames from a seek point on, up to another; all without points."""
    ends = [*(layout.start + layout.offsets).tolist(), len(stream)] if len(layout.offsets) else [layout.start, len(stream)]
    samples = [*layout.first.tolist(), layout.samples] if len(layout.offsets) else [0, layout.samples]
    for i in range(first, len(ends) - 1 if last is None else last):
        if samples[i + 1] - samples[i] <= layout.block:
            yield stream[ends[i] : ends[i + 1]]
        else:
            yield from _between(stream, ends[i], ends[i + 1])


def _between(stream: bytes, at: int, end: int) -> Iterator[bytes]:
    """The frames of a stretch without seek points: each ends where its CRC-16 is right and a header, or the stretch's end, follows."""
    while at < end:
        after = at + 9
        while after < end:
            after = stream.find(b"\xff\xf8", after, end)
            if after < 0:
                after = end
            elif _is_header(stream[after : after + 16]) and crc16([stream[at : after - 2]])[0] == int.from_bytes(stream[after - 2 : after], "big"):
                break
            else:
                after += 1
        yield stream[at : min(after, end)]
        at = after


def _is_header(head: bytes) -> bool:
    try:
        return _parse_header(head)[1] > 0
    except ValueError:
        return False


def _batches(items: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for x in items:
        held.append(x)
        size += len(x)
        if size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def seek(stream: bytes, sample: int, count: int) -> bytes:
    """Some bytes of the payload: only the frames that hold them are decoded."""
    layout = Layout(stream)
    first = max(0, int(np.searchsorted(layout.first, sample, side="right")) - 1)
    last = int(np.searchsorted(layout.first, min(sample + count, layout.samples), side="left"))
    samples = np.concatenate(decode_frames(list(_cut(stream, layout, first, max(first, last)))) or [np.zeros(0, int)])
    at = sample - int(layout.first[first])
    return (samples[at : at + count] + 128).astype(np.uint8).tobytes()


def payload_of(text: bytes) -> bytes:
    """The bytes, filled with zero bytes to a positive multiple of 64."""
    return text + bytes(-len(text) % ALIGN if text else ALIGN)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the FLAC stream of each text's UTF-8 bytes, for every row of docs.

    A null text is an empty one: 64 zero bytes. Equal texts give equal streams. Other columns are ignored.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                texts, size, end = [], 0, at
                while end < whole.num_rows and size < BATCH:
                    texts.append(whole.column(1)[end].as_py() or b"")
                    size += len(texts[-1])
                    end += 1
                media = encode([payload_of(t) for t in texts])
                arrays = [whole.column(0).slice(at, end - at), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                at = end

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(write, schema)


def _describe(payload: bytes) -> tuple[int, str, int, str]:
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    size = np.abs(x)
    feature = f"crossings={crossings};magnitude={int(size.sum(dtype=np.int64))};peak={int(size.max())};frames={-(-len(x) // FRAME)}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature


def read_features(stored: DataFrame) -> DataFrame:
    """Decode stored media, verify it, and describe it; raises if a checksum is wrong.

    feature: zero crossings, sum of magnitudes, peak and frames of the signal, which depend on its samples only.
    """
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType())
    schema = T.StructType([stored.schema["doc_id"], stored.schema["n_bytes"], *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(2).to_pylist()
            columns: list[list] = [[] for _ in names]
            for stream, payload in zip(media, decode(media), strict=True):
                size, digest, tail, feature = _describe(payload)
                row = (size, digest, tail, len(stream), hashlib.sha256(stream).hexdigest(), feature)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            arrow = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns, arrow)], names=schema.names)

    return stored.mapInArrow(read, schema)


def pcm_blocks(stored: DataFrame, block: int = 1 << 16) -> DataFrame:
    """doc_id, sample_offset and pcm, unsigned 8-bit samples: blocks of stored media that can be sought by offset."""
    schema = T.StructType([stored.schema["doc_id"], T.StructField("sample_offset", T.LongType()), T.StructField("pcm", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stream in enumerate(batch.column(2)):
                payload = decode([stream.as_py()])[0]
                at = list(range(0, len(payload), block))
                blocks = [payload[a : a + block] for a in at]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(at))), pa.array(at, pa.int64()), pa.array(blocks, pa.binary())], names=schema.names)

    return stored.mapInArrow(read, schema)


def decoded(stored: DataFrame, block: int = 1 << 16) -> DataFrame:
    """A row for every row of stored media: its size and hash, and blocks, its PCM by sample_offset."""
    blocks = T.ArrayType(T.StructType([T.StructField("sample_offset", T.LongType()), T.StructField("pcm", T.BinaryType())]))
    added = [T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("blocks", blocks)]
    schema = T.StructType([stored.schema["doc_id"], stored.schema["n_bytes"], *added])
    arrow = pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            for media in _batches(whole.column(2).to_pylist()):
                cut = [[{"sample_offset": a, "pcm": p[a : a + block]} for a in range(0, len(p), block)] for p in decode(media)]
                kept = [whole.column(0).slice(at, len(media)), whole.column(1).slice(at, len(media))]
                sizes, hashes = pa.array(list(map(len, media)), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media])
                yield pa.RecordBatch.from_arrays([*kept, sizes, hashes, pa.array(cut, arrow)], names=schema.names)
                at += len(media)

    return stored.mapInArrow(read, schema)


def block_features(table: DataFrame) -> DataFrame:
    """What read_features gives, from the PCM blocks of decoded(); raises if blocks do not follow each other."""
    numbers, texts = T.LongType(), T.StringType()
    kinds = {"payload_bytes": numbers, "payload_sha256": texts, "tail_crc32": numbers, "media_bytes": numbers, "media_sha256": texts, "feature": texts}
    schema = T.StructType([table.schema["doc_id"], table.schema["n_bytes"], *(T.StructField(n, k) for n, k in kinds.items())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for held in batch.column(4):
                payload = bytearray()
                for b in sorted(held.as_py(), key=lambda b: b["sample_offset"]):
                    if b["sample_offset"] != len(payload):
                        raise ValueError("a PCM block is missing")
                    payload += b["pcm"]
                rows.append(_describe(bytes(payload)))
            size, digest, tail, feature = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
            made = [pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(tail, pa.int64()), batch.column(2), batch.column(3), pa.array(feature, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=schema.names)

    return table.mapInArrow(read, schema)


def through_storage(docs: DataFrame, block: int = 1 << 16, wave: int = WAVE) -> DataFrame:
    """block_features of docs, by two written tables: the media, and the PCM blocks decoded from it as read again.

    Both are written with Zstandard: PCM is as large as the text, and of media it saves a twentieth, seek tables and headers. Of media beyond `wave` bytes the PCM blocks
    are written, read again and removed in WAVES waves of its files, so that all of the PCM never lies beside all of the media; the features
    of each wave are written instead. Every row goes through both tables in either case.
    """
    spark = docs.sparkSession
    media = materialize(store(docs), codec="zstd")
    files = sorted(media.inputFiles())
    if len(files) < 2 or media.agg(F.sum(F.octet_length("media"))).first()[0] <= wave:
        return block_features(materialize(decoded(media, block), codec="zstd"))
    done = []
    for i in range(min(WAVES, len(files))):
        part = spark.read.schema(media.schema).parquet(*files[i::WAVES])
        first = written()
        blocks = materialize(decoded(part, block), codec="zstd")
        done.append(materialize(block_features(blocks), codec="zstd"))
        clean_up(spark, first, first + 1)
    return reduce(DataFrame.unionByName, done)
