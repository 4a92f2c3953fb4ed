"""Golomb-coded sets: sorted reduced hashes stored as compressed gaps in blocks."""

from __future__ import annotations

import numpy as np

#: Values in a block: a probe decodes one block, so this bounds its work.
BLOCK = 128
#: Neighbouring blocks decoded at a time, and remainders packed at a time (a multiple of 8): they bound the work space.
RUN, PACK = 512, 1 << 16


def reduce_hash(h: np.ndarray, bits: int) -> np.ndarray:
    """The upper `bits` of 64-bit hashes: uniform in [0, 2**bits)."""
    return h.astype(np.int64).view(np.uint64) >> np.uint64(64 - bits)


def _pack(rest: np.ndarray, width: int) -> np.ndarray:
    """The lowest `width` bits of each value, one after another."""
    if not width or not len(rest):
        return np.empty(0, np.uint8)
    bits = lambda v: np.unpackbits(v.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width :]
    return np.concatenate([np.packbits(bits(rest[i : i + PACK]).reshape(-1)) for i in range(0, len(rest), PACK)])


def _unpack(bits: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits each out of single bits."""
    wide = np.zeros((len(bits) // width, 64), np.uint8)
    wide[:, 64 - width :] = bits.reshape(-1, width)
    return np.packbits(wide, axis=1).view(">u8").reshape(-1).astype(np.uint64)


class GolombSet:
    """A set of integers in [0, 2**bits). Gaps within a block are Golomb-Rice coded.

    Each block keeps its first value in plain and the rest as gaps: the quotient by 2**rice in unary, the remainder
    in `rice` bits. Remainders have a fixed width, so their place follows from the index; unary codes are found
    through the bit offset of their block.
    """

    def __init__(self, bits: int, values: np.ndarray | None = None) -> None:
        self.bits = bits
        self.n = 0
        self.decoded_blocks = 0
        self._build(np.unique(values) if values is not None and len(values) else np.empty(0, np.uint64))

    def _build(self, v: np.ndarray) -> None:
        v = v.astype(np.uint64)
        self.n = len(v)
        self.firsts = v[::BLOCK].copy()
        blocks = len(self.firsts)
        self.counts = np.full(blocks, BLOCK - 1, np.int64)
        if blocks:
            self.counts[-1] = self.n - (blocks - 1) * BLOCK - 1
        inside = np.ones(self.n, bool)
        inside[::BLOCK] = False
        gaps = (np.diff(v, prepend=v[:1]) if self.n else v)[inside]
        mean = (2.0**self.bits) / max(self.n, 1)
        self.rice = int(max(0, np.floor(np.log2(max(mean * np.log(2), 1)))))
        k = np.uint64(self.rice)
        rest = gaps & ((np.uint64(1) << k) - np.uint64(1))
        quotient = (gaps >> k).astype(np.int64)
        ends = np.cumsum(quotient + 1)  # position behind each code's closing 1
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])  # index of a block's first gap
        self.unary_at = np.concatenate([[0], ends])[self.starts]
        unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        if len(ends):
            unary[ends - 1] = 1
        self.unary = np.packbits(unary)
        self.rest = _pack(rest, self.rice)

    @staticmethod
    def _slice(data: np.ndarray, a: int, b: int) -> np.ndarray:
        return np.unpackbits(data[a >> 3 : (b + 7) >> 3])[a & 7 : (a & 7) + b - a]

    def _decode(self, i: int, j: int) -> np.ndarray:
        """The values of blocks i to j - 1."""
        a, b = int(self.starts[i]), int(self.starts[j])
        ones = np.flatnonzero(self._slice(self.unary, int(self.unary_at[i]), int(self.unary_at[j])))
        gaps = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(self.rice)
        if self.rice and b > a:
            gaps += _unpack(self._slice(self.rest, a * self.rice, b * self.rice), self.rice)
        total = b - a + (j - i)
        steps = np.empty(total, np.uint64)
        heads = self.starts[i:j] - a + np.arange(j - i)
        mask = np.ones(total, bool)
        mask[heads] = False
        steps[mask] = gaps
        steps[heads] = np.diff(self.firsts[i:j], prepend=np.uint64(0))
        # a head's step counts from the previous head, but the running sum stands at the previous block's last value
        run = np.cumsum(np.where(mask, steps, 0))
        base = np.concatenate([[0], run[heads[1:] - 1]]).astype(np.uint64) if j - i > 1 else np.zeros(1, np.uint64)
        which = np.cumsum(~mask) - 1
        return self.firsts[i:j][which] + run.astype(np.uint64) - base[which]

    def values(self) -> np.ndarray:
        return self._decode(0, len(self.firsts)) if self.n else np.empty(0, np.uint64)

    def contains(self, probes: np.ndarray) -> np.ndarray:
        """For each probe whether it is in the set; decodes only the blocks that probes fall into."""
        hit = np.zeros(len(probes), bool)
        if not self.n or not len(probes):
            return hit
        order = np.argsort(probes, kind="stable")
        p = probes[order]
        at = np.searchsorted(self.firsts, p, side="right") - 1
        wanted = np.unique(at[at >= 0])
        # neighbouring blocks are decoded together
        for run in np.split(wanted, np.flatnonzero(np.diff(wanted) != 1) + 1):
            for i in range(0, len(run), RUN):
                lo, hi = int(run[i]), int(run[min(i + RUN, len(run)) - 1]) + 1
                self.decoded_blocks += hi - lo
                values = self._decode(lo, hi)
                a, b = np.searchsorted(at, [lo, hi])
                j = np.minimum(np.searchsorted(values, p[a:b]), len(values) - 1)
                hit[order[a:b]] = values[j] == p[a:b]
        return hit

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self._build(np.union1d(self.values(), values.astype(np.uint64)))

    @property
    def size_bytes(self) -> int:
        return len(self.unary) + len(self.rest) + 8 * len(self.firsts) + 8 * len(self.unary_at)

    @property
    def false_positive_rate(self) -> float:
        """Theoretical: the share of the range that is taken."""
        return self.n / 2.0**self.bits


class GrowingSet:
    """Golomb-coded sets of falling size, each at least twice the next: adding re-encodes a value a logarithmic number of
    times, a probe looks into each set."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.parts: list[GolombSet] = []

    def probe_and_add(self, values: np.ndarray) -> np.ndarray:
        """For each value, in order, whether it was there when its turn came; it is there afterwards."""
        distinct, first, which = np.unique(values, return_index=True, return_inverse=True)
        known = np.zeros(len(distinct), bool)
        for part in self.parts:
            open_ = np.flatnonzero(~known)
            known[open_] = part.contains(distinct[open_])
        hit = known[which]
        later = np.ones(len(values), bool)
        later[first] = False
        if not known.all():
            self.parts.append(GolombSet(self.bits, distinct[~known]))
            while len(self.parts) > 1 and self.parts[-2].n < 2 * self.parts[-1].n:
                last = self.parts.pop()
                self.parts[-1].add(last.values())
        return hit | later

    @property
    def n(self) -> int:
        return sum(p.n for p in self.parts)

    @property
    def size_bytes(self) -> int:
        return sum(p.size_bytes for p in self.parts)
