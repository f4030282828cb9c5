"""Media columns: texts as lossless 8-bit FLAC streams.

The decoder reads any mono stream with a seek table or none: constant, verbatim, fixed and LPC subframes, Rice
partitions with 4- and 5-bit parameters and escapes, and checks every frame's CRC-8 and CRC-16. Frames of many streams
are decoded side by side, sample by sample, so that Python's cost is shared. The encoder gives each block the cheapest
of constant, verbatim, fixed predictors of order 0 to 2 and one Rice parameter per block, and a seek point per block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 4096
#: Sample rates coded by number in frame headers (fixed values): 8 = 32 kHz.
RATE, RATE_CODE, BITS = 32000, 8, 8


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.zeros(256, np.uint32)
    for i in range(256):
        x = i << (bits - 8)
        for _ in range(8):
            x = (x << 1) ^ (poly if x >> (bits - 1) & 1 else 0)
        table[i] = x & ((1 << bits) - 1)
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8_LIST = _CRC8.tolist()


def crc8(data: bytes) -> int:
    x = 0
    for b in data:
        x = _CRC8_LIST[x ^ b]
    return x


def _crc16_pairs() -> np.ndarray:
    """The CRC-16 of every two bytes."""
    pair = np.arange(1 << 16, dtype=np.uint32)
    x = _CRC16[pair >> 8]
    return ((x << 8) & 0xFFFF) ^ _CRC16[(x >> 8) ^ (pair & 0xFF)]


_CRC16_PAIRS = _crc16_pairs().astype(np.uint16)


def crc16_many(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 0x8005) of data[start:end] for every frame at once, two bytes at a time. A zero byte in front
    changes nothing, so odd frames get one."""
    if not len(starts):
        return np.empty(0, np.uint16)
    order = np.argsort(starts - ends, kind="stable")
    starts, ends = starts[order], ends[order]
    odd = (ends - starts) & 1
    x = _CRC16_PAIRS[np.where(odd, data[starts], 0)]
    starts = starts + odd
    falling = (starts - ends) >> 1
    view = np.ndarray(len(data) - 1, ">u2", data.tobytes(), strides=(1,)).astype(np.uint16)
    alive = len(starts)
    for i in range(int(-falling[0])):
        while falling[alive - 1] > -i - 1:
            alive -= 1
        x[:alive] = _CRC16_PAIRS[x[:alive] ^ view[starts[:alive] + 2 * i]]
    out = np.empty_like(x)
    out[order] = x
    return out


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 code."""
    if n < 0x80:
        return bytes([n])
    k = 1
    while n >= 1 << (6 * k + 6 - k):
        k += 1
    head = (0xFF << (7 - k)) & 0xFF
    return bytes([head | n >> (6 * k), *(0x80 | (n >> (6 * i)) & 0x3F for i in reversed(range(k)))])


# --- encoder ----------------------------------------------------------------------------------------------------------


def _header(number: int, size: int) -> bytes:
    if size == BLOCK:
        code, tail = 12, b""
    else:
        code, tail = 7, (size - 1).to_bytes(2, "big")
    head = bytes([0xFF, 0xF8, code << 4 | RATE_CODE, 0b00000010]) + _number(number) + tail
    return head + bytes([crc8(head)])


def _rice_parameter(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A Rice parameter that fits the mean of zigzag numbers with this sum."""
    mean = total / np.maximum(n, 1)
    return np.clip(np.floor(np.log2(np.maximum(mean * np.log(2), 1))) + (mean >= 1), 0, 14).astype(np.int64)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of at least one byte. Bytes are samples less 128."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    blocks = -(-sizes // BLOCK)
    stream = np.repeat(np.arange(len(payloads)), blocks)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    length = np.minimum(BLOCK, sizes[stream] - number * BLOCK)
    bodies: list[bytes] = [b""] * len(stream)
    every = np.frombuffer(b"".join(payloads), np.uint8)
    at = (np.cumsum(sizes) - sizes)[stream] + number * BLOCK
    by_length = np.argsort(length, kind="stable")
    for part in np.array_split(by_length, max(1, int(length.sum()) // 2_000_000)):
        _encode_blocks(every, at[part], length[part], number[part], part, bodies)
    out, done = [], 0
    for p, n in zip(payloads, blocks.tolist(), strict=True):
        frames = bodies[done : done + n]
        lengths = length[done : done + n].tolist()
        done += n
        out.append(_stream_head(p, frames, lengths) + b"".join(frames))
    return out


def _stream_head(payload: bytes, frames: list[bytes], lengths: list[int]) -> bytes:
    sizes = [len(f) for f in frames]
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | (BITS - 1) << 36 | len(payload)).to_bytes(8, "big")
    info += hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes(), usedforsecurity=False).digest()
    points, offset, sample = [], 0, 0
    for size, n in zip(sizes, lengths, strict=True):
        points.append(sample.to_bytes(8, "big") + offset.to_bytes(8, "big") + n.to_bytes(2, "big"))
        offset, sample = offset + size, sample + n
    table = b"".join(points)
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x80 | 3]) + len(table).to_bytes(3, "big") + table


def _encode_blocks(every: np.ndarray, at: np.ndarray, length: np.ndarray, number: np.ndarray, into: np.ndarray, bodies: list[bytes]) -> None:
    if not len(at):
        return
    width = int(length.max())
    columns = np.arange(width)
    x = every[np.minimum(at[:, None] + columns, len(every) - 1)].astype(np.int16) - 128
    short = np.flatnonzero(length < width)
    for i in short:
        x[i, length[i] :] = 0
    constant = np.array([(r[:n] == r[0]).all() for r, n in zip(x, length.tolist(), strict=True)])
    best, choice, residuals = 8 + length * BITS, np.full(len(at), 3), []
    parameter = np.zeros((3, len(at)), np.int64)
    r = x
    for order in range(3):
        r = r if not order else np.diff(r, axis=1, prepend=np.int16(0))
        for i in short:
            r[i, length[i] :] = 0
        zigzag = (r << 1) ^ (r >> 15)  # at most 2 * 4 * 128 in size
        total = zigzag[:, order:].sum(1, dtype=np.int64)
        k = _rice_parameter(total, length - order)
        low = zigzag[:, order:] >> k[:, None].astype(np.int16)
        bits = low.sum(1, dtype=np.int64) + (length - order) * (k + 1) + 18 + order * BITS
        better = (bits < best) & (length > order)
        best[better], choice[better] = bits[better], order
        parameter[order] = k
        residuals.append(zigzag)
    for i in np.flatnonzero(constant):
        bodies[into[i]] = bytes([0, int(x[i, 0]) & 0xFF])
    for i in np.flatnonzero(~constant & (choice == 3)):
        bodies[into[i]] = bytes([0b00000010]) + (x[i, : length[i]] & 0xFF).astype(np.uint8).tobytes()
    for order in range(3):
        chosen = ~constant & (choice == order)
        for k in np.unique(parameter[order][chosen]):
            rows = np.flatnonzero(chosen & (parameter[order] == k))
            _rice_frames(x[rows], residuals[order][rows], length[rows], int(k), order, into[rows], bodies)
    for i in range(len(at)):
        bodies[into[i]] = _header(int(number[i]), int(length[i])) + bodies[into[i]]
    ends = np.cumsum([len(bodies[i]) for i in into])
    data = np.frombuffer(b"".join(bodies[i] for i in into), np.uint8)
    sums = crc16_many(data, np.concatenate([[0], ends[:-1]]), ends)
    for i, c in zip(into, sums.tolist(), strict=True):
        bodies[i] += c.to_bytes(2, "big")


def _rice_frames(x: np.ndarray, zigzag: np.ndarray, length: np.ndarray, k: int, order: int, into: np.ndarray, bodies: list[bytes]) -> None:
    """Fixed-predictor subframes: header, warm-up samples, a single partition with its parameter, and the residual."""
    own = length - order
    if (length == x.shape[1]).all():
        u = zigzag[:, order:].ravel().astype(np.int64)
    else:
        u = zigzag[:, order:][np.arange(order, x.shape[1]) < length[:, None]].astype(np.int64)
    ends = np.cumsum((u >> k) + (1 + k))
    last = np.cumsum(own)
    per_row = np.diff(ends[last - 1], prepend=0)
    head = 18 + order * BITS
    padded = -(-(per_row + head) // 8) * 8
    first = np.cumsum(padded) - padded
    gap = first + head - (ends[last - 1] - per_row)  # from the bits without heads to those with
    stop = ends + (np.repeat(gap, own) - (1 + k))
    bit = np.zeros(int(padded.sum()), np.uint8)
    bit[stop] = 1
    low = (u & ((1 << k) - 1)).astype(np.uint16)
    for b in range(k):
        stop += 1
        bit[stop] = (low >> np.uint16(k - 1 - b)) & np.uint16(1)

    def put(values: np.ndarray, offset: int, n: int) -> None:
        for b in range(n):
            bit[first + offset + b] = (values >> (n - 1 - b)) & 1

    put(np.full(len(x), (8 | order) << 1), 0, 8)
    for i in range(order):
        put(x[:, i].astype(np.int64) & 0xFF, 8 + i * BITS, BITS)
    # 4-bit parameters and one partition are zeros
    put(np.full(len(x), k), 14 + order * BITS, 4)
    packed = np.packbits(bit).tobytes()
    for i, a, n in zip(into, (first // 8).tolist(), (padded // 8).tolist(), strict=True):
        bodies[i] = packed[a : a + n]


# --- decoder ----------------------------------------------------------------------------------------------------------


class Broken(ValueError):
    """A stream that is no valid FLAC, or whose checksums do not hold."""


def _metadata(data: bytes) -> tuple[int, int, int, bytes, list[tuple[int, int, int]], int]:
    """Sample bits, channels, samples, MD5, seek points, and where frames begin."""
    if data[:4] != b"fLaC":
        raise Broken("no fLaC marker")
    at, last, info, points = 4, False, None, []
    while not last:
        last, kind, n = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = (packed >> 36 & 31) + 1, (packed >> 41 & 7) + 1, packed & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, n, 18)]
        at += 4 + n
    if info is None:
        raise Broken("no stream information")
    return *info, points, at


#: Block sizes by code (fixed values); 6 and 7 stand for an explicit size.
_SIZES = {1: 192} | {i: 576 << (i - 2) for i in range(2, 6)} | {i: 256 << (i - 8) for i in range(8, 16)}


def _frame_header(data: bytes, at: int) -> tuple[int, int, int]:
    """Block size, frame number, and where the subframe begins; checks the header's CRC-8."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise Broken("no frame where one is due")
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    p, lead = at + 4, data[at + 4]
    if lead < 0x80:
        number, more = lead, 0
    else:
        more = 7 - (lead ^ 0xFF).bit_length()
        number = lead & (0x3F >> more)
    for i in range(more):
        number = number << 6 | data[p + 1 + i] & 0x3F
    p += 1 + more
    if code in (6, 7):
        size = int.from_bytes(data[p : p + code - 5], "big") + 1
        p += code - 5
    else:
        size = _SIZES[code]
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:p]) != data[p]:
        raise Broken("frame header checksum")
    return size, number, p + 1


_LEADING = np.array([16] + [15 - i.bit_length() + 1 for i in range(1, 1 << 16)], np.int64)


class _Reader:
    """64-bit windows of many bit positions at once."""

    def __init__(self, data: bytes):
        self.words = np.ndarray(len(data) + 8, ">u8", data + b"\0" * 16, strides=(1,)).astype(np.uint64)

    def window(self, bit: np.ndarray) -> np.ndarray:
        """The next 57 bits at least, from the top."""
        return self.words[bit >> 3] << (bit & 7).astype(np.uint64)

    def unsigned(self, bit: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        w = self.window(bit)
        n = np.asarray(n, np.uint64)
        return np.where(n == 0, np.uint64(0), w >> (np.uint64(64) - np.maximum(n, np.uint64(1)))).astype(np.int64)

    def signed(self, bit: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        v = self.unsigned(bit, n)
        half = np.int64(1) << np.maximum(np.asarray(n, np.int64) - 1, 0)
        return np.where((v >= half) & (np.asarray(n) > 0), v - 2 * half, v)

    def unary(self, bit: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        w = self.window(bit)
        q = _LEADING[(w >> np.uint64(48)).astype(np.int64)]
        long = np.flatnonzero(q == 16)
        done = np.full(len(long), 16, np.int64)
        while len(long):
            more = _LEADING[(self.window(bit[long] + done) >> np.uint64(48)).astype(np.int64)]
            done += more
            q[long] = done
            go = more == 16
            if go.any() and int((bit[long] + done).max()) >= 8 * len(self.words):
                raise Broken("a code runs over the end")
            long, done = long[go], done[go]
        return q


def _decode_frames(reader: _Reader, bit: np.ndarray, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (a row per frame) and the bit after each subframe. bit: where subframes begin."""
    n = len(bit)
    width = int(size.max())
    x = np.zeros((n, width), np.int64)
    head = reader.unsigned(bit, 8)
    kind, wasted = head >> 1 & 63, np.zeros(n, np.int64)
    bit = bit + 8
    flagged = np.flatnonzero(head & 1)
    if len(flagged):
        wasted[flagged] = reader.unary(bit[flagged]) + 1
        bit[flagged] += wasted[flagged]
    bits = bits - wasted
    order = np.select([kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32], [0, 0, kind - 8, kind - 31], -1)
    if (order < 0).any():
        raise Broken("reserved subframe type")
    for i in np.flatnonzero(kind == 0):
        x[i, : size[i]] = reader.signed(bit[i : i + 1], bits[i])[0]
        bit[i] += bits[i]
    for i in np.flatnonzero(kind == 1):
        x[i, : size[i]] = reader.signed(bit[i] + np.arange(size[i]) * bits[i], bits[i])
        bit[i] += size[i] * bits[i]
    rice = np.flatnonzero(kind >= 8)
    if len(rice):
        _decode_rice(reader, rice, kind, order, bit, size, bits, x)
    if wasted.any():
        x <<= wasted[:, None]
    return x, bit


def _decode_rice(reader: _Reader, rice: np.ndarray, kind: np.ndarray, order: np.ndarray, bit: np.ndarray, size: np.ndarray, bits: np.ndarray, x: np.ndarray) -> None:
    for i in range(int(order[rice].max())):  # warm-up samples
        own = rice[order[rice] > i]
        x[own, i] = reader.signed(bit[own], bits[own])
        bit[own] += bits[own]
    lpc = rice[kind[rice] >= 32]
    shift = np.zeros(len(bit), np.int64)
    weights = np.zeros((len(bit), max(1, int(order[rice].max()))), np.int64)
    if len(lpc):
        precision = reader.unsigned(bit[lpc], 4) + 1
        shift[lpc] = reader.signed(bit[lpc] + 4, 5)
        bit[lpc] += 9
        for i in range(int(order[lpc].max())):
            own = order[lpc] > i
            weights[lpc[own], i] = reader.signed(bit[lpc[own]], precision[own])
            bit[lpc[own]] += precision[own]
    #: Weights of the fixed predictors by order (fixed values), the nearest sample first.
    fixed = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
    for o, w in fixed.items():
        own = rice[(kind[rice] < 32) & (order[rice] == o)]
        if len(own):
            weights[own, : len(w)] = w
    wide = reader.unsigned(bit[rice], 2)
    if (wide > 1).any():
        raise Broken("reserved residual coding")
    parts = np.int64(1) << reader.unsigned(bit[rice] + 2, 4)
    down = np.argsort(-size[rice], kind="stable")
    rows, wide, parts = rice[down], wide[down], parts[down]
    p = bit[rows] + 6
    length, o = size[rows], order[rows]
    residual = _residuals(reader, p, length, o, wide, length // parts)
    bit[rows] = p
    for i in range(len(rows)):
        x[rows[i], o[i] : length[i]] = residual[o[i] : length[i], i]
    for a in range(0, len(rows), 64):  # predictors, a few frames at a time
        some = rows[a : a + 64]
        if (order[some] == 0).all():
            continue
        depth = int(order[some].max())
        y = np.zeros((int(size[some].max()) + depth, len(some)), np.int64)
        y[depth:] = x[some, : len(y) - depth].T
        w = [weights[some, i] for i in range(depth)]
        for t in range(1, len(y) - depth):
            guess = sum(y[depth + t - 1 - i] * w[i] for i in range(depth)) >> shift[some]
            y[depth + t] += np.where(t >= order[some], guess, 0)
        x[some, : len(y) - depth] = y[depth:].T
        for i, f in enumerate(some):
            x[f, size[f] :] = 0


def _residuals(reader: _Reader, p: np.ndarray, length: np.ndarray, order: np.ndarray, wide: np.ndarray, per_part: np.ndarray) -> np.ndarray:
    """Residuals, a column per frame, of frames by falling length. p: where the first partitions begin; it ends where
    the last ones do. All frames are read side by side, a sample of each at a time."""
    words, width = reader.words, int(length[0])
    out = np.zeros((width, len(p)), np.int64)
    k, raw, due_at = np.zeros(len(p), np.int64), np.full(len(p), -1), order.copy()
    part = np.zeros(len(p), np.int64)
    falling = (-length).tolist()
    plain = bool((order == 0).all())
    n, event, escapes = len(p), 0, False
    for t in range(width):
        while falling[n - 1] > -t - 1:
            n -= 1
        if t >= event:
            due = np.flatnonzero(due_at[:n] == t)
            while len(due):
                b = 4 + wide[due]
                k[due] = reader.unsigned(p[due], b)
                p[due] += b
                raw[due] = -1
                e = due[k[due] == (1 << b) - 1]
                if len(e):
                    raw[e], k[e] = reader.unsigned(p[e], 5), 0
                    p[e] += 5
                part[due] += 1
                due_at[due] = part[due] * per_part[due]
                due = due[due_at[due] <= t]
            event = int(due_at[:n][due_at[:n] > t].min(initial=width))
            escapes = bool((raw[:n] >= 0).any())
            more, low = (k + 1), (np.uint64(63) - k.view(np.uint64))
        pos, kk = p[:n], k[:n]
        w = words[pos >> 3] << (pos & 7).view(np.uint64)
        q = _LEADING[(w >> np.uint64(48)).view(np.int64)]
        if q.max() == 16:
            live = np.flatnonzero((q == 16) & (order[:n] <= t) & (raw[:n] < 0))
            q[live] = reader.unary(pos[live])
            w[live] = reader.window(pos[live] + q[live] - 15)
            shown = q.copy()
            shown[live] = 15
        else:
            shown = q
        rest = (w << (shown + 1).view(np.uint64)) >> np.uint64(1)
        u = (q << kk) | (rest >> low[:n]).view(np.int64)
        if plain and not escapes:
            out[t, :n] = u
            pos += q
            pos += more[:n]
            continue
        live = order[:n] <= t
        used = q + more[:n]
        if escapes:
            code = raw[:n]
            value = reader.signed(pos, np.maximum(code, 0))
            u = np.where(code >= 0, (value << 1) ^ (value >> 63), u)
            used = np.where(code >= 0, code, used)
        out[t, :n] = np.where(live, u, 0)
        pos += np.where(live, used, 0)
    return (out >> 1) ^ -(out & 1)


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of mono streams. With a seek table all frames of all streams are decoded side by side; frames are
    checked by both checksums, and each stream by its length and MD5."""
    heads = [_metadata(s) for s in streams]
    for bits, channels, *_ in heads:
        if channels != 1:
            raise Broken("only mono streams are read")
    data, base = b"".join(streams), 0
    owner, frame_at, frame_end = [], [], []
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(streams)
    for i, (s, (_, _, _, _, points, begin)) in enumerate(zip(streams, heads, strict=True)):
        points = [q for q in points if q[0] != (1 << 64) - 1]
        if sum(q[2] for q in points) != heads[i][2]:  # not a point for every frame
            out[i] = _decode_in_order(s, heads[i])
        else:
            offsets = [begin + q[1] for q in points]
            owner += [i] * len(offsets)
            frame_at += [base + q for q in offsets]
            frame_end += [base + q for q in [*offsets[1:], len(s)]]
        base += len(s)
    if owner:
        start, end = np.array(frame_at, np.int64), np.array(frame_end, np.int64)
        parsed = [_frame_header(data, a) for a in frame_at]
        size = np.array([q[0] for q in parsed], np.int64)
        bit = np.array([q[2] for q in parsed], np.int64) * 8
        reader = _Reader(data)
        view = np.frombuffer(data, np.uint8)
        if (crc16_many(view, start, end - 2) != (view[end - 2].astype(np.uint32) << 8 | view[end - 1])).any():
            raise Broken("frame checksum")
        bits = np.array([heads[i][0] for i in owner], np.int64)
        parts: list[list[np.ndarray]] = [[] for _ in streams]
        x, after = _decode_frames(reader, bit, size, bits)
        if (-(-after // 8) != end - 2).any():
            raise Broken("frame length")
        for row, i, n in zip(x, owner, size.tolist(), strict=True):
            parts[i].append(row[:n])
        for i, rows in enumerate(parts):
            if rows:
                out[i] = np.concatenate(rows)
    for samples, (bits, _, total, md5, _, _) in zip(out, heads, strict=True):
        if len(samples) != total:
            raise Broken("number of samples")
        kind = "<i1" if bits <= 8 else "<i2" if bits <= 16 else "<i4"  # 24-bit samples are three bytes of these
        raw = samples.astype(kind).tobytes() if bits <= 16 or bits > 24 else samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        if any(md5) and hashlib.md5(raw, usedforsecurity=False).digest() != md5:  # all zeros: none was stored
            raise Broken("MD5")
    return out


def _decode_in_order(stream: bytes, head: tuple) -> np.ndarray:
    bits, _, total, _, _, at = head
    reader, view, parts, done = _Reader(stream), np.frombuffer(stream, np.uint8), [], 0
    while done < total:
        size, _, sub = _frame_header(stream, at)
        x, after = _decode_frames(reader, np.array([sub * 8], np.int64), np.array([size], np.int64), np.array([bits], np.int64))
        end = int(-(-after[0] // 8))
        if int(crc16_many(view, np.array([at]), np.array([end]))[0]) != int.from_bytes(stream[end : end + 2], "big"):
            raise Broken("frame checksum")
        parts.append(x[0, :size])
        at, done = end + 2, done + size
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


# --- DataFrames -------------------------------------------------------------------------------------------------------

#: Bytes of payload that are coded side by side.
SIDE_BY_SIDE = 2_500_000


def _groups(sizes: list[int]) -> Iterator[slice]:
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > SIDE_BY_SIDE:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as a FLAC stream of its UTF-8 bytes, with zeros up to a positive multiple of
    64. Null is as empty."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            payloads = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            sizes = [len(p) for p in payloads]
            for part in _groups(sizes):
                padded = [p + b"\0" * (-len(p) % 64 if p else 64) for p in payloads[part]]
                yield common.with_columns(batch.slice(part.start, part.stop - part.start), ["doc_id"], n_bytes=pa.array(sizes[part], pa.int64()), media=pa.array(encode(padded), pa.binary()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[np.ndarray]]]:
    """Rows of a media column with their streams and samples, a bounded number of bytes at a time."""
    for batch in common.slices(batches):
        stored = batch.column("media").to_pylist()
        for part in _groups([len(m) for m in stored]):
            yield batch.slice(part.start, part.stop - part.start), stored[part], decode(stored[part])


def pcm_blocks(media: DataFrame) -> DataFrame:
    """The decoded 8-bit blocks of a media column: doc_id, sample_offset, and pcm as unsigned bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, samples in _decoded(batches):
            pcm = [(x + 128).astype(np.uint8).tobytes() for x in samples]
            times = np.array([-(-len(p) // BLOCK) for p in pcm], np.int64)
            yield common.repeat_rows(batch, ["doc_id"], times, sample_offset=pa.array([a for p in pcm for a in range(0, len(p), BLOCK)], pa.int64()), pcm=pa.array([p[a : a + BLOCK] for p in pcm for a in range(0, len(p), BLOCK)], pa.binary()))

    return media.select("doc_id", "media").mapInArrow(read, "doc_id long, sample_offset long, pcm binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(media: DataFrame) -> DataFrame:
    """Per stored stream, read back: sizes, digests, and as feature the mean, root mean square and zero crossings."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, stored, decoded in _decoded(batches):
            rows = []
            for m, x in zip(stored, decoded, strict=True):
                pcm = (x + 128).astype(np.uint8).tobytes()
                crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
                feature = f"mean={int(x.sum()) / len(x):.6f};rms={(int((x * x).sum()) / len(x)) ** 0.5:.6f};crossings={crossings}"
                rows.append((len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            names = [c.split()[0] for c in DIGEST.split(", ")][2:]
            yield common.with_columns(batch, ["doc_id", "n_bytes"], **dict(zip(names, map(pa.array, zip(*rows, strict=True)), strict=True)))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, DIGEST)
