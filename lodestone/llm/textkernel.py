"""Vectorised word segmentation and hashing over the bytes of many texts at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """Powers 0..n-1 of base modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            have = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(size, base, np.uint64))))
        if size <= 1 << 24:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fold_table() -> np.ndarray:
    """Byte map: A-Z to lower case; ASCII that is no letter or digit to a space; all else stays."""
    table = np.arange(256, dtype=np.uint8)
    ascii_ = np.arange(128)
    word = ((ascii_ >= 48) & (ascii_ <= 57)) | ((ascii_ >= 65) & (ascii_ <= 90)) | ((ascii_ >= 97) & (ascii_ <= 122))
    table[:128][~word] = 32
    table[65:91] += 32
    return table


FOLD = fold_table()


class Words(NamedTuple):
    hashes: np.ndarray  #: a 64-bit hash of each word
    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray  #: byte after each word
    segment: np.ndarray  #: index of the segment (text or line) of each word


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = FOLD) -> Words:
    """Words of all segments: runs of bytes that ``table`` doesn't map to a space.

    No word spans two segments; ``offsets`` has one entry more than there are segments."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none)
    folded = np.frombuffer(data.tobytes().translate(table.tobytes()), np.uint8)
    inside = folded != 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    finish = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    first[begins] = inside[begins]
    last[finish] = inside[finish]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        terms = folded.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _table(_BASE, n)
        np.cumsum(terms, out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * _table(_INVERSE, n)[starts])
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(hashes, starts, ends, np.repeat(np.arange(len(counts)), counts))


def range_sums(hashes: np.ndarray) -> np.ndarray:
    """Sums from which range_hash takes the hash of any run."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((hashes | np.uint64(1)) * _table(_BASE, len(hashes)), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of hashes from begin to end (exclusive), wherever it stands."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[begin]) * _table(_INVERSE, len(sums))[begin])


def sequence_hash(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each run hashes[bounds[i]:bounds[i + 1]], in order."""
    return range_hash(range_sums(hashes), bounds[:-1], bounds[1:])


_LANES = np.array([sum(((x >> i) & 1) << (8 * i) for i in range(8)) for x in range(256)], np.uint64)  # a byte's bits, a byte each


def majority_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64-bit word of bits set in over half of them; 0 for an empty run.

    Eight bits are counted at once, in the bytes of a word, over pieces of at most 255 hashes."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    cut = 0
    while cut < len(full):  # some hundred thousand hashes at a time, or one run
        upto = max(cut + 1, int(np.searchsorted(bounds[full + 1], bounds[full[cut]] + (1 << 18), "right")))
        rows = full[cut:upto]
        cut = upto
        n = bounds[rows + 1] - bounds[rows]
        pieces = -(-n // 255)
        run = np.cumsum(pieces) - pieces
        start = np.repeat(bounds[rows], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(run, pieces))
        a, b = bounds[rows[0]], bounds[rows[-1] + 1]
        raw = np.ascontiguousarray(hashes[a:b], dtype="<u8").view(np.uint8).reshape(-1, 8)
        word = np.zeros((len(rows), 8), np.uint8)
        for i in range(8):
            # runs of other rows between two of these are none: empty runs have no hashes
            lanes = np.add.reduceat(_LANES[raw[:, i]], start - a).astype("<u8").view(np.uint8).reshape(-1, 8)
            counts = np.add.reduceat(lanes.astype(np.int64), run, axis=0)
            word[:, i] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little")[:, 0]
        out[rows] = word.view("<u8").reshape(-1)
    return out


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of bytes, side by side; ``data`` has at least eight bytes after the last run."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    by = np.argsort(lengths.astype(np.uint16) if lengths.max() < 1 << 16 else lengths, kind="stable")
    at, size = starts[by], lengths[by]
    low, high = int(starts.min()), int((starts + lengths).max())
    eight = np.ascontiguousarray(np.ndarray((high - low + 1,), "<u8", data[low : high + 8].tobytes(), 0, (1,)))  # from each byte on
    at -= low
    with np.errstate(over="ignore"):
        seed_ = np.uint64(seed)
        h = np.full(len(at), seed_ + _P5, np.uint64)
        long = int(np.searchsorted(size, 32))
        if long < len(at):
            lanes = [np.full(len(at) - long, v, np.uint64) for v in (seed_ + _P1 + _P2, seed_ + _P2, seed_, seed_ - _P1)]
            go, done = 0, 0
            while go < len(lanes[0]):  # the longer ones come last
                place = at[long + go :] + done
                for i, v in enumerate(lanes):
                    v[go:] = _rotl(v[go:] + eight[place + 8 * i] * _P2, 31) * _P1
                done += 32
                go = int(np.searchsorted(size, done + 32)) - long
            x = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for v in lanes:
                x = (x ^ (_rotl(v * _P2, 31) * _P1)) * _P1 + _P4
            h[long:] = x
        h += size.astype(np.uint64)
        at += size & ~31
        rest = size & 31
        for i in range(3):
            some = np.flatnonzero(rest >= 8 * (i + 1))
            h[some] = _rotl(h[some] ^ (_rotl(eight[at[some] + 8 * i] * _P2, 31) * _P1), 27) * _P1 + _P4
        at += rest & ~7
        some = np.flatnonzero(rest & 4)
        h[some] = _rotl(h[some] ^ ((eight[at[some]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at += rest & 4
        for i in range(3):
            some = np.flatnonzero((rest & 3) > i)
            h[some] = _rotl(h[some] ^ ((eight[at[some] + i] & np.uint64(255)) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[by] = h ^ (h >> np.uint64(32))
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32

_MANY = 1 << 16  #: So many shingles are hashed at once.


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of each text's shingles of k words, repeats included: XXH64 (seed 42) of the words with
    one space between them, A-Z in lower case. Fewer words than k: of all together; none: no shingle."""
    n = len(offsets) - 1
    breaks = offsets[1:] + np.arange(n)
    spaced = np.full(len(data) + n, 32, np.uint8)
    inside = np.ones(len(spaced), bool)
    inside[breaks] = False
    spaced[inside] = data
    spaced = np.frombuffer(spaced.tobytes().translate(_LOWER.tobytes()), np.uint8)
    inside = spaced != 32
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # and the space after each word
    ends = np.searchsorted(np.flatnonzero(keep & ~inside), breaks, "right")  # words up to the end of each text
    joined = np.concatenate((spaced[keep], np.zeros(8, np.uint8)))
    stop = np.flatnonzero(joined == 32)
    start = np.concatenate(([0], stop + 1))
    first = np.concatenate(([0], ends[:-1]))
    count = np.where(ends > first, np.maximum(ends - first - k + 1, 1), 0)
    bounds = np.concatenate(([0], np.cumsum(count)))
    from_ = np.repeat(first - bounds[:-1], count) + np.arange(bounds[-1])
    to = np.minimum(from_ + k, np.repeat(ends, count)) - 1
    out = np.zeros(len(from_), np.uint64)
    for a in range(0, len(from_), _MANY):
        own = slice(a, a + _MANY)
        out[own] = xxh64(joined, start[from_[own]], stop[to[own]] - start[from_[own]])
    return out, bounds
