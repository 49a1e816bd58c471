"""A range coder for token ids whose model mixes predictions of three orders.

A segment is cut into frames of at most ``FRAME`` ids, a frame into blocks of equal length. The model is fitted to the ids
of a frame and written before its blocks. Every block is coded from a fresh state and carries its own checksum, so with the
model it can be read alone; blocks are coded side by side, one id of each block per step, which is what makes numpy fast here.

Model of a frame. Its ids are numbered by the list of different ids in its head. Order 0 is their frequencies. Orders 1 and 2
each predict one id: the one that most often follows the previous id, or a hash of the two before, told apart by how often
that is so (``CLASSES``). How far both predictions are trusted is counted for every pair of classes. The three are added up,
so an id's interval is its order-0 share plus what the predictions that name it put on it, and a carry-less range coder with
64-bit state turns the intervals into 32-bit words.

Segment: ``TLSH``, ids (u64), then frames. Frame: ``TLFR``, ids, blocks, different ids, bits of the hash, bytes of the packed
model, its crc32 (u32 each); the model (zlib: u32 gaps of the id list, order-0 widths, two tables of predictions, trusts); the
blocks. Block: ``TLRC``, ids, bytes of code, crc32 of the ids as little-endian u32 and then of the code (u32 each); the code.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

TOTAL = 26  # intervals are out of 2 ** TOTAL
TRUST = 16  # a written trust is out of 2 ** TRUST
CLASS = 4  # bits of a class
#: Shares of a prediction at which classes part. Class 0 predicts nothing.
CLASSES = np.array([0.02, 0.04, 0.07, 0.11, 0.17, 0.25, 0.35, 0.45, 0.55, 0.67, 0.79, 0.89, 0.95, 0.99])
LEAST = 3  # a prediction was right that often, or it is not written
FRAME = 1 << 22
BLOCK = 4096
WIDTH = 2048  # blocks wished for side by side
ROWS = 16  # steps whose intervals are worked out at a time
TOP, BOTTOM = np.uint64(1 << 32), np.uint64(1 << 28)
S32, STOTAL = np.uint64(32), np.uint64(TOTAL)


def hashed(p1: np.ndarray, p2: np.ndarray, bits: int) -> np.ndarray:
    h = p1.astype(np.uint32) * np.uint32(0x9E3779B1) + p2.astype(np.uint32) * np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - bits)


def followers(context: np.ndarray, x: np.ndarray, n_contexts: int, n_ids: int) -> np.ndarray:
    """For each context the id that follows most often, times 2 ** CLASS, and its class."""
    wide = np.uint32 if n_contexts * n_ids <= 1 << 32 else np.uint64
    key = context.astype(wide) * wide(n_ids) + x.astype(wide)
    key.sort()
    at = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
    often, key = np.diff(at, append=len(key)), key[at].astype(np.int64)
    context = key // n_ids
    at = np.append(0, np.flatnonzero(context[1:] != context[:-1]) + 1)
    best = np.maximum.reduceat(often << 32 | key - context * n_ids, at)
    right, seen = best >> 32, np.add.reduceat(often, at)
    told = 1 + np.searchsorted(CLASSES, right / (seen + 0.5))
    table = np.zeros(n_contexts, np.int64)
    table[context[at]] = np.where(right >= LEAST, (best & 0xFFFFFFFF) << CLASS | told, 0)
    return table


class Model:
    """What is known of a frame: order-0 widths, predictions of both orders, trust per pair of classes."""

    def __init__(self, widths: np.ndarray, table1: np.ndarray, table2: np.ndarray, trust: np.ndarray):
        self.widths, self.table1, self.table2, self.trust = widths, table1, table2, trust
        self.cum = np.append(0, np.cumsum(widths, dtype=np.int64))
        self.share, self.bits = int(self.cum[-1]).bit_length() - 1, len(table2).bit_length() - 1
        room = (1 << TOTAL) - (1 << self.share)  # order 0 keeps at least 2 ** share, so that each id has an interval
        self.f2 = np.minimum(trust[1].astype(np.int64) << TOTAL - TRUST, room)
        self.f1 = np.minimum(trust[0].astype(np.int64) << TOTAL - TRUST, room - self.f2)
        self.f0 = (1 << TOTAL) - self.f1 - self.f2

    @staticmethod
    def fitted(x: np.ndarray, p1: np.ndarray, p2: np.ndarray, often: np.ndarray) -> Model:
        """``x``: numbered ids; ``p1``, ``p2``: the one and the two before; ``often``: frequency of each number."""
        n, n_ids = len(x), len(often)
        whole = 1 << max(14, n_ids.bit_length() + 2)
        widths = 1 + often * (whole - n_ids) // n
        widths[np.argmax(often)] += whole - widths.sum()
        bits = min(16, max(4, n.bit_length() - 4))
        model = Model(widths, followers(p1, x, n_ids, n_ids), followers(hashed(p1, p2, bits), x, 1 << bits, n_ids), np.zeros((2, 2 << 2 * CLASS), np.uint16))
        seen, right1, right2 = np.zeros((3, 2 << 2 * CLASS), np.int64)
        for lo in range(0, n, 1 << 18):
            cut = slice(lo, lo + (1 << 18))
            g1, g2, pair = model.predict(p1[cut], p2[cut])
            hit2 = g2 == x[cut]
            for held, of in ((seen, pair), (right2, pair[hit2]), (right1, pair[(g1 == x[cut]) & ~hit2])):
                held += np.bincount(of, minlength=len(held))
        pair, most = np.arange(len(seen)), (1 << TRUST) - 1
        trust = [np.where((pair >> by & (1 << CLASS) - 1 > 0) & (seen > 0), most * right // (seen + 1), 0) for by, right in ((CLASS, right1), (0, right2))]
        return Model(widths, model.table1, model.table2, np.array(trust, np.uint16))

    def packed(self, names: np.ndarray) -> bytes:
        raw = [np.diff(names.astype(np.int64), prepend=0).astype("<u4").tobytes(), self.widths.astype("<u4").tobytes()]
        for t in (self.table1, self.table2):
            raw += [(t >> CLASS).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), (t & (1 << CLASS) - 1).astype(np.uint8).tobytes()]
        return zlib.compress(b"".join([*raw, self.trust.astype("<u2").tobytes()]), 1)

    @staticmethod
    def unpacked(data: bytes, n_ids: int, bits: int) -> tuple[np.ndarray, Model]:
        raw, at = zlib.decompress(data), 8 * n_ids
        names, widths = np.frombuffer(raw, "<u4", 2 * n_ids).astype(np.int64).reshape(2, -1)
        tables = []
        for n in (n_ids, 1 << bits):
            guess = np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4").ravel()
            tables.append(guess.astype(np.int64) << CLASS | np.frombuffer(raw, np.uint8, n, at + 4 * n))
            at += 5 * n
        return np.cumsum(names), Model(widths, *tables, np.frombuffer(raw, "<u2", -1, at).reshape(2, -1))

    def predict(self, p1: np.ndarray, p2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What orders 1 and 2 say next, and the pair of their classes (other pairs if both say the same)."""
        t1, t2 = self.table1.take(p1), self.table2.take(hashed(p1, p2, self.bits))
        g1, g2 = t1 >> CLASS, t2 >> CLASS
        low = (1 << CLASS) - 1
        return g1, g2, ((g1 == g2) * (1 << CLASS) + (t1 & low)) * (1 << CLASS) + (t2 & low)

    def interval(self, x: np.ndarray, g1: np.ndarray, g2: np.ndarray, f0: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the interval of x begins, and its width."""
        begin = self.cum.take(x) * f0 >> self.share
        wide = (self.cum.take(x + 1) * f0 >> self.share) - begin
        wide += f2 * (g2 == x)
        wide += f1 * (g1 == x)
        begin += f2 * (g2 < x)
        begin += f1 * (g1 < x)
        return begin, wide

    def lookup(self, v: np.ndarray, g1: np.ndarray, g2: np.ndarray, f0: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
        """The id whose interval holds v: what the predictions put before a share is taken out again, then shares are looked up."""
        z1, z2 = self.cum.take(g1) * f0 >> self.share, self.cum.take(g2) * f0 >> self.share
        z1 += f2 * (g2 < g1)
        v = v - np.minimum(np.maximum(v - z1, 0), f1)
        v -= np.minimum(np.maximum(v - z2, 0), f2)
        # the largest share s with s * f0 >> share <= v; a quotient of integers below 2 ** 53 rounds to no other integer here
        return self.find.take((((v + 1 << self.share) - 1) / f0).astype(np.int64))

    def ready(self) -> Model:
        """For decoding: the id of each share."""
        self.find = np.repeat(np.arange(len(self.widths)), self.widths)
        return self


def blocks_of(n: int) -> int:
    """Ids of a block in a frame of n ids."""
    return max(1024, min(BLOCK, -(-n // WIDTH)))


def numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids, the number of each id among them, and how often each occurs."""
    if ids.max() >= 1 << 22:
        names, x, often = np.unique(ids, return_inverse=True, return_counts=True)
        return names, x, often
    often = np.bincount(ids)
    names = np.flatnonzero(often)
    number = np.zeros(len(often), np.int64)
    number[names] = np.arange(len(names))
    return names, number[ids], often[names]


def encode_frame(ids: np.ndarray) -> bytes:
    n, long = len(ids), blocks_of(len(ids))
    names, x, often = numbered(ids)
    n_blocks = -(-n // long)
    last = n - (n_blocks - 1) * long
    grid = np.zeros((long + 2, n_blocks), np.int64)  # two steps before the first: number 0
    grid[2:] = np.pad(x, (0, n_blocks * long - n)).reshape(n_blocks, long).T
    p1 = np.append(0, x[:-1])
    p1[::long] = 0
    p2 = np.append(0, p1[:-1])
    p2[::long] = 0
    model = Model.fitted(x, p1, p2, often)
    del x, p1, p2
    width = long + 64
    out, at = np.zeros((n_blocks, width), np.uint32), np.zeros(n_blocks, np.int64)
    low, span = np.zeros(n_blocks, np.uint64), np.full(n_blocks, 2**64 - 1, np.uint64)
    for t in range(long):
        if t == last and n_blocks == 1:
            break
        if t % ROWS == 0:
            rows = min(ROWS, long - t)
            g1, g2, pair = model.predict(grid[t + 1 : t + 1 + rows].ravel(), grid[t : t + rows].ravel())
            begins, wides = (a.view(np.uint64).reshape(rows, -1) for a in model.interval(grid[t + 2 : t + 2 + rows].ravel(), g1, g2, *(f.take(pair) for f in (model.f0, model.f1, model.f2))))
            if at.max() + ROWS * 6 > out.shape[1]:
                out = np.pad(out, ((0, 0), (0, width)))
        n_on = n_blocks if t < last else n_blocks - 1  # the last block may end first
        lo, sp = low[:n_on], span[:n_on]  # views
        r = sp >> STOTAL
        lo += r * begins[t % ROWS, :n_on]
        np.multiply(r, wides[t % ROWS, :n_on], out=sp)
        i = np.flatnonzero(((lo ^ lo + sp) < TOP) | (sp < BOTTOM))
        while len(i):
            a, s = lo[i], sp[i]
            s = np.where((a ^ a + s) < TOP, s, (~a + np.uint64(1)) & BOTTOM - np.uint64(1))
            out[i, at[i]] = a >> S32
            at[i] += 1
            a, s = a << S32, s << S32
            lo[i], sp[i] = a, s
            i = i[((a ^ a + s) < TOP) | (s < BOTTOM)]
    if at.max() + 2 > out.shape[1]:
        out = np.pad(out, ((0, 0), (0, 8)))
    for k in range(2):
        out[np.arange(n_blocks), at + k] = low >> np.uint64(32 - 32 * k) & np.uint64(0xFFFFFFFF)
    packed = model.packed(names)
    made = [struct.pack("<4sIIIIII", b"TLFR", n, n_blocks, len(names), model.bits, len(packed), zlib.crc32(packed)), packed]
    for b in range(n_blocks):
        code = out[b, : at[b] + 2].astype("<u4").tobytes()
        held = ids[b * long : (b + 1) * long].astype("<u4").tobytes()
        made += [struct.pack("<4sIII", b"TLRC", len(held) // 4, len(code), zlib.crc32(code, zlib.crc32(held))), code]
    return b"".join(made)


def encode(ids: np.ndarray) -> bytes:
    """A segment."""
    ids = np.asarray(ids)
    return b"".join([struct.pack("<4sQ", b"TLSH", len(ids)), *(encode_frame(ids[lo : lo + FRAME]) for lo in range(0, len(ids), FRAME))])


def decode_frame(segment: bytes, at: int) -> tuple[np.ndarray, int]:
    """The ids of the frame at a place of the segment, and the place behind it."""
    magic, n, n_blocks, n_ids, bits, packed, crc = struct.unpack_from("<4sIIIIII", segment, at)
    at += 28
    if magic != b"TLFR" or zlib.crc32(segment[at : at + packed]) != crc:
        raise ValueError("not a frame of tokens, or its model is damaged")
    names, model = Model.unpacked(segment[at : at + packed], n_ids, bits)
    model.ready()
    at += packed
    sizes, codes, sums = [], [], []
    for _ in range(n_blocks):
        magic, size, coded, crc = struct.unpack_from("<4sIII", segment, at)
        if magic != b"TLRC":
            raise ValueError("not a token block")
        codes.append(np.frombuffer(segment, "<u4", coded // 4, at + 16))
        at += 16 + coded
        sizes.append(size)
        sums.append(crc)
    if sum(sizes) != n or len({*sizes[:-1]}) > 1 or sizes[-1] > sizes[0]:
        raise ValueError("the blocks of a frame do not fit")
    words = np.zeros((n_blocks, max(map(len, codes)) + 8), np.uint32)
    for b, c in enumerate(codes):
        words[b, : len(c)] = c
    long, last = sizes[0], sizes[-1]
    low, span = np.zeros(n_blocks, np.uint64), np.full(n_blocks, 2**64 - 1, np.uint64)
    code = np.zeros(n_blocks, np.uint64)
    for k in range(2):
        code = code << S32 | words[:, k].astype(np.uint64)
    pos = np.full(n_blocks, 2)
    grid = np.zeros((long + 2, n_blocks), np.int64)
    for t in range(long):
        n_on = n_blocks if t < last else n_blocks - 1
        g1, g2, pair = model.predict(grid[t + 1, :n_on], grid[t, :n_on])
        f0, f1, f2 = model.f0.take(pair), model.f1.take(pair), model.f2.take(pair)
        lo, sp, co = low[:n_on], span[:n_on], code[:n_on]  # views
        r = sp >> STOTAL
        v = np.minimum((co - lo) // r, np.uint64((1 << TOTAL) - 1)).view(np.int64)
        x = model.lookup(v, g1, g2, f0, f1, f2)
        begin, wide = model.interval(x, g1, g2, f0, f1, f2)
        lo += r * begin.view(np.uint64)
        np.multiply(r, wide.view(np.uint64), out=sp)
        i = np.flatnonzero(((lo ^ lo + sp) < TOP) | (sp < BOTTOM))
        while len(i):
            a, s = lo[i], sp[i]
            s = np.where((a ^ a + s) < TOP, s, (~a + np.uint64(1)) & BOTTOM - np.uint64(1))
            co[i] = co[i] << S32 | words[i, np.minimum(pos[i], words.shape[1] - 1)].astype(np.uint64)
            pos[i] += 1
            a, s = a << S32, s << S32
            lo[i], sp[i] = a, s
            i = i[((a ^ a + s) < TOP) | (s < BOTTOM)]
        grid[t + 2, :n_on] = x
    ids = names.astype("<u4")[grid[2:].T.ravel()[:n]]
    lo = 0
    for b, size in enumerate(sizes):
        if zlib.crc32(codes[b].tobytes(), zlib.crc32(ids[lo : lo + size].tobytes())) != sums[b]:
            raise ValueError(f"block {b} is damaged")
        lo += size
    return ids, at


def decode(segment: bytes) -> np.ndarray:
    """The ids (u32) of a segment; a damaged one raises."""
    magic, n = struct.unpack_from("<4sQ", segment)
    if magic != b"TLSH":
        raise ValueError("not a token segment")
    frames, at = [np.zeros(0, np.uint32)], 12
    while at < len(segment):
        ids, at = decode_frame(segment, at)
        frames.append(ids)
    if sum(map(len, frames)) != n:
        raise ValueError("frames are missing")
    return np.concatenate(frames)
