"""Canonical length-limited Huffman codes over integer symbols, coded and decoded by array operations."""

from __future__ import annotations

import numpy as np

#: Longest code in bits; a decoding table has 2 ** MAX_BITS entries.
MAX_BITS = 18


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 for symbols that never occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need more than {max_bits} bits")
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    packages, single = np.zeros(0), []
    for _ in range(max_bits):
        merged = np.concatenate([leaves, packages])
        order = np.argsort(merged, kind="stable")
        single.append(order < len(leaves))
        merged = merged[order]
        packages = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    depth, take = np.zeros(len(used), np.int64), 2 * len(used) - 2
    for is_leaf in reversed(single):
        n = int(is_leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[used] = depth
    return lengths


class Code:
    """The canonical code of given lengths: by length, then by symbol."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.uint8)
        symbols = np.flatnonzero(lengths)
        symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
        size = lengths[symbols].astype(np.int64)
        self.bits = int(size.max(initial=1))
        spans = np.int64(1) << (self.bits - size)
        first = np.cumsum(spans) - spans
        self.lengths, self.codes = lengths.astype(np.int64), np.zeros(len(lengths), np.uint64)
        self.codes[symbols] = (first >> (self.bits - size)).astype(np.uint64)
        table = np.repeat(symbols.astype(np.int64) << 5 | size, spans)
        self.table = np.zeros(1 << self.bits, np.int64)
        self.table[:len(table)] = table

    def encode(self, ids: np.ndarray, block: int) -> tuple[bytes, np.ndarray]:
        """(payload, bit offset of the first of every ``block`` ids)."""
        size = self.lengths[ids]
        if len(ids) and not size.all():
            raise ValueError("an id has no code")
        at = np.cumsum(size) - size
        total = int(at[-1] + size[-1]) if len(ids) else 0
        word = at >> 5
        shifted = self.codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
        n = (total + 31 >> 5) + 1
        out = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n)
        out += np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:n]
        return out.astype(np.uint32).astype(">u4").tobytes()[:total + 7 >> 3], at[::block].copy()

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int, block: int) -> np.ndarray:
        """The ``n`` ids of a payload; its blocks are decoded side by side, one table look-up per id."""
        if n == 0:
            return np.zeros(0, np.int64)
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at = np.asarray(checkpoints, np.int64).copy()
        full, rest = divmod(n, block)
        out = np.zeros((block, len(at)), np.int64)
        drop = np.uint32(32 - self.bits)
        for step in range(min(block, n)):
            live = at if rest == 0 or step < rest else at[:full]
            entry = self.table[(window[live >> 3] << (live & 7).astype(np.uint32)) >> drop]
            out[step, :len(live)] = entry >> 5
            live += entry & 31
        return out.T.reshape(-1)[:n]
