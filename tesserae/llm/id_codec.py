"""Token ids in files of independently reset, checksummed blocks, by an adaptive context-mixing range coder.

The ids of a segment are cut into blocks of ``BLOCK``. A block is coded by itself from an untrained model, so any block can be
read alone. The coder works on many blocks at a time, one id of each in every step, so that a step is a few dozen
numpy operations however many blocks there are.

Model of the next id, all adaptive within the block:
* order 2: the id that last followed the two ids before, with the measured rate at which such a guess holds;
* order 1: the same for the one id before;
* order 0: the class of the id (its size as a power of two, and the next binary digit), from the sum of class counts without
  context and by the class before; the digits below the class are coded as they are.
The guesses get their share of the probability by mixing weights that move towards whichever was right; order 0 gets the rest.
The mixture drives a carry-less range coder (64-bit low and range, 16-bit words, Subbotin's bounds).

Payload: ``CMR1``, then little-endian n_ids u64, block u32, n_blocks u32; for each block its words u32 and the CRC-32 of its ids
(as little-endian u32) u32; then the blocks' words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, HEAD = b"CMR1", struct.Struct("<4sQII")
BLOCK, LANES = 2048, 1024
T1, T2 = 256, 512  # places of each block's tables of guesses
CLASSES, MAX_ID = 36, (1 << 18) - 2
SCALE, TOP, BOT = 20, np.uint64(1 << 48), np.uint64(1 << 36)
U = np.uint64
W_MAX = 28672  # of 65536: the two guesses together leave at least an eighth to order 0
ONES = U(0xFFFFFFFFFFFFFFFF)


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = np.arange(1, MAX_ID + 2, dtype=np.int64)
    b = np.frexp(y.astype(np.float64))[1] - 1
    digit = np.where(b > 0, (y >> np.maximum(b - 1, 0)) & 1, 0)
    k = np.maximum(b - 1, 0)
    return 2 * b + digit, k, y & ((1 << k) - 1)


CLASS, DIGITS, REST = _classes()
CLASS_BITS = np.array([max(0, c // 2 - 1) for c in range(CLASSES)], dtype=np.int64)
CLASS_BASE = np.array([(1 << (c // 2)) + ((c & 1) << max(0, c // 2 - 1)) if c > 1 else 1 for c in range(CLASSES)], dtype=np.int64)


class _Model:
    """The state of ``n`` blocks, and what it says of their next id. Class counts are kept in groups of six with their sums, so
    that a cumulative count takes two sums over six numbers."""

    def __init__(self, n: int):
        i4 = np.int32
        self.lane = np.arange(n, dtype=np.int64)
        self.t1, self.t2 = np.zeros(n * T1, dtype=i4), np.zeros(n * T2, dtype=i4)
        self.o1, self.o2, self.o8 = self.lane * T1, self.lane * T2, self.lane * 8
        self.a1, self.a2 = np.full(n * 8, 20000, dtype=i4), np.full(n * 8, 30000, dtype=i4)
        self.w1, self.w2 = np.full(n, 9000, dtype=i4), np.full(n, 18000, dtype=i4)
        self.f0, self.s0 = np.ones((n * 6, 6), dtype=i4), np.full((n, 6), 6, dtype=i4)
        self.f1, self.s1 = np.zeros((n * CLASSES * 6, 6), dtype=np.int16), np.zeros((n * CLASSES, 6), dtype=np.int16)
        self.p1, self.p2 = np.zeros(n, dtype=i4), np.zeros(n, dtype=i4)  # the ids before
        self.base, self.c1 = self.lane * CLASSES, np.zeros(n, dtype=np.int64)  # the class before

    def predict(self) -> None:
        self.i1 = self.o1 + (self.p1 & (T1 - 1))
        self.i2 = self.o2 + ((self.p1 * 2531 + self.p2 * 127) & (T2 - 1))
        e1, e2 = self.t1.take(self.i1), self.t2.take(self.i2)
        self.k1, self.k2 = e1 & 7, e2 & 7
        self.g1, self.g2 = e1 >> 3, e2 >> 3
        self.j1, self.j2 = self.o8 + self.k1, self.o8 + self.k2
        self.has2 = self.k2 > 0
        self.has1 = (self.k1 > 0) & ((self.g1 != self.g2) | ~self.has2)
        self.b1, self.b2 = self.a1.take(self.j1), self.a2.take(self.j2)
        self.q2 = ((((self.w2 * self.b2) >> 16) + 16) * self.has2) << (SCALE - 16)
        self.q1 = ((((self.w1 * self.b1) >> 16) + 16) * self.has1) << (SCALE - 16)
        self.q12 = self.q1 + self.q2
        self.r1 = self.base + self.c1
        self.groups = np.cumsum(self.s0 + self.s1.take(self.r1, axis=0), axis=1, dtype=np.int64)
        self.sum = self.groups[:, 5]
        self.left = (1 << SCALE) - self.q12.astype(np.int64)

    def group(self, g) -> None:
        """Looks at the classes of one group."""
        self.x0, self.x1 = self.lane * 6 + g, self.r1 * 6 + g
        inside = np.cumsum(self.f0.take(self.x0, axis=0) + self.f1.take(self.x1, axis=0), axis=1, dtype=np.int64)
        self.high = inside + (self.groups.ravel().take(self.x0) - inside[:, 5])[:, None]

    def interval(self, hit2, hit1, plain, cls) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of what is coded, out of 2 ** SCALE. A guess that holds leaves cls at the first class of its group."""
        at = self.lane * 6 + cls
        h = self.high.ravel().take(at)
        w = self.f0.ravel().take(self.x0 * 6 + cls) + self.f1.ravel().take(self.x1 * 6 + cls)
        low = ((h - w) * self.left) // self.sum
        wide = (h * self.left) // self.sum - low
        return plain * (self.q12 + low) + hit1 * self.q2, plain * wide + hit1 * self.q1 + hit2 * self.q2

    def update(self, ids, hit2, hit1, cls, inside) -> None:
        right1, right2 = self.g1 == ids, self.g2 == ids
        self.a1[self.j1] = self.b1 + ((right1 * 65535 - self.b1) >> 4)
        self.a2[self.j2] = self.b2 + ((right2 * 65535 - self.b2) >> 4)
        lost = hit2 & self.has1
        self.w2 += (hit2 * (W_MAX - self.w2) - hit1 * self.w2) >> 5
        self.w1 += (hit1 * (W_MAX - self.w1) - lost * self.w1) >> 5
        new = ids << 3
        for t, i, g, k, right in ((self.t1, self.i1, self.g1, self.k1, right1), (self.t2, self.i2, self.g2, self.k2, right2)):
            keep = k > 2  # a guess that has held lately stays, with half its count
            t[i] = np.where(right, new + np.minimum(k + 1, 7), np.where(keep, (g << 3) + (k >> 1), new + 1))
        self.f0.reshape(-1)[self.x0 * 6 + inside] += 8
        self.s0.reshape(-1)[self.x0] += 8
        self.f1.reshape(-1)[self.x1 * 6 + inside] += 8
        self.s1.reshape(-1)[self.x1] += 8
        self.p2, self.p1, self.c1 = self.p1, ids, cls


def _shift(low, span, send) -> None:
    """Sends words while the top one is settled, or the range is too narrow to go on without."""
    while True:
        same = (low ^ (low + span)) < TOP
        go = np.flatnonzero(same | (span < BOT))
        if not len(go):
            return
        lo, sp = low.take(go), span.take(go)
        short = ~same.take(go)
        if short.any():
            sp[short] = (~lo[short] + U(1)) & (BOT - U(1))
        send(go, lo)
        low[go], span[go] = lo << U(16), sp << U(16)


def _encode_lanes(ids: np.ndarray) -> list[bytes]:
    """ids: (steps, blocks)."""
    steps, n = ids.shape
    m = _Model(n)
    low, span = np.zeros(n, dtype=U), np.full(n, ONES, dtype=U)
    out, at = np.zeros((n, 3 * steps + 8), dtype="<u2"), np.zeros(n, dtype=np.int64)

    def send(go, lo):
        place = at.take(go)
        out[go, place] = lo >> U(48)
        at[go] = place + 1

    for t in range(steps):
        x = ids[t]
        cls = CLASS.take(x)
        m.predict()
        hit2 = m.has2 & (m.g2 == x)
        hit1 = m.has1 & (m.g1 == x) & ~hit2
        plain = ~(hit2 | hit1)
        g = cls // 6
        inside = cls - 6 * g
        m.group(g)
        cum, freq = m.interval(hit2, hit1, plain, inside)
        unit = span >> U(SCALE)
        low += unit * cum.astype(U)
        span = (unit * freq.astype(U)) >> (DIGITS.take(x) * plain).astype(U)
        low += span * (REST.take(x) * plain).astype(U)
        _shift(low, span, send)
        m.update(x, hit2, hit1, cls, inside)
    for s in (48, 32, 16, 0):
        out[np.arange(n), at] = (low >> U(s)) & U(0xFFFF)
        at += 1
    return [out[i, : at[i]].tobytes() for i in range(n)]


def _decode_lanes(streams: list[bytes], steps: int) -> np.ndarray:
    n = len(streams)
    words = np.zeros((n, max(len(s) for s in streams) // 2 + 8), dtype="<u2")
    for i, s in enumerate(streams):
        words[i, : len(s) // 2] = np.frombuffer(s, dtype="<u2")
    m = _Model(n)
    low, span, code = np.zeros(n, dtype=U), np.full(n, ONES, dtype=U), np.zeros(n, dtype=U)
    for j in range(4):
        code = (code << U(16)) | words[:, j].astype(U)
    at = np.full(n, 4, dtype=np.int64)
    last = words.shape[1] - 1
    ids = np.zeros((steps, n), dtype=np.int32)

    def send(go, _):
        place = np.minimum(at.take(go), last)
        code[go] = (code.take(go) << U(16)) | words[go, place].astype(U)
        at[go] = place + 1

    for t in range(steps):
        m.predict()
        unit = span >> U(SCALE)
        v = np.minimum((code - low) // unit, U((1 << SCALE) - 1)).astype(np.int64)
        hit2 = v < m.q2
        hit1 = (v < m.q12) & ~hit2
        plain = ~(hit2 | hit1)
        want = ((v - m.q12 + 1) * m.sum - 1) // m.left
        guess = np.where(hit2, m.g2, m.g1)
        known = CLASS.take(np.minimum(guess, MAX_ID))
        g = np.where(plain, np.minimum((m.groups <= want[:, None]).sum(axis=1), 5), known // 6)
        m.group(g)
        inside = np.where(plain, np.minimum((m.high <= want[:, None]).sum(axis=1), 5), known - 6 * g)
        cls = 6 * g + inside
        cum, freq = m.interval(hit2, hit1, plain, inside)
        bits = CLASS_BITS.take(cls) * plain
        low += unit * cum.astype(U)
        span = (unit * freq.astype(U)) >> bits.astype(U)
        rest = np.minimum(((code - low) // np.maximum(span, U(1))).astype(np.int64), (1 << bits) - 1)
        rest *= plain
        low += span * rest.astype(U)
        x = np.where(plain, np.minimum(CLASS_BASE.take(cls) + rest - 1, MAX_ID), guess).astype(np.int32)
        _shift(low, span, send)
        ids[t] = x
        m.update(x, hit2, hit1, cls, inside)
    return ids


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) > MAX_ID:
        raise ValueError(f"ids above {MAX_ID} are not supported")
    blocks = -(-len(ids) // block)
    streams: list[bytes] = []
    for a in range(0, blocks, LANES):
        part = ids[a * block : min(len(ids), (a + LANES) * block)]
        lanes = -(-len(part) // block)
        steps = min(block, len(part))
        square = np.zeros(lanes * block, dtype=np.int32)
        square[: len(part)] = part
        streams += _encode_lanes(np.ascontiguousarray(square.reshape(lanes, block)[:, :steps].T))
    table = b"".join(struct.pack("<II", len(s) // 2, zlib.crc32(ids[i * block : (i + 1) * block].tobytes())) for i, s in enumerate(streams))
    return HEAD.pack(MAGIC, len(ids), block, blocks) + table + b"".join(streams)


def decode(payload: bytes, only: int | None = None) -> np.ndarray:
    """All ids, or those of one block. A wrong checksum raises ValueError."""
    magic, n, block, blocks = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a payload of this format")
    table = np.frombuffer(payload, dtype="<u4", count=2 * blocks, offset=HEAD.size).reshape(blocks, 2)
    begin = HEAD.size + 8 * blocks + 2 * np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
    wanted = range(blocks) if only is None else range(only, only + 1)
    out = []
    for a in range(0, len(wanted), LANES):
        part = list(wanted[a : a + LANES])
        size = [min(block, n - i * block) for i in part]
        got = _decode_lanes([payload[begin[i] : begin[i + 1]] for i in part], max(size)).T
        for row, i, k in zip(got, part, size, strict=True):
            one = row[:k].astype("<u4")
            if zlib.crc32(one.tobytes()) != table[i, 1]:
                raise ValueError(f"block {i} fails its checksum")
            out.append(one)
    return np.concatenate(out) if out else np.zeros(0, dtype="<u4")
