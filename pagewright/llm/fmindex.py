"""A compressed FM-index of one shard of text, searched for many patterns at once."""

from __future__ import annotations

import numpy as np

_WORD = 64


class BitVector:
    """Bits in 64-bit words with a count before each word; rank by one popcount."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // _WORD + 1) * _WORD, dtype=np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(counts[:-1])]).astype(np.int32)
        self.zeros = self.n - int(bits.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = i >> 6
        low = self.words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at] + np.bitwise_count(low)


class WaveletMatrix:
    """The wavelet tree of a sequence in its level-wise form."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels: list[BitVector] = []
        self.shifts = list(range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1))
        current = sequence
        for shift in self.shifts:
            bits = ((current >> shift) & 1).astype(np.uint8)
            self.levels.append(BitVector(bits))
            current = np.concatenate([current[bits == 0], current[bits == 1]])

    def walk(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position ``i`` of the sequence ends up among the occurrences of its symbol."""
        for shift, level in zip(self.shifts, self.levels, strict=True):
            ones = level.rank1(i)
            i = np.where((symbols >> shift) & 1, level.zeros + ones, i - ones)
        return i


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    """Each place's value ``by`` places further on, 0 behind the end."""
    out = np.zeros_like(values)
    if by < len(values):
        out[: len(values) - by] = values[by:]
    return out


def _starts(ranked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For sorted keys whose places in the order are ``at``, the place at which each one's run of equal keys starts."""
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    return at[np.flatnonzero(new)[np.cumsum(new) - 1]]


def suffix_order(codes: np.ndarray, span: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by their first ``span + 1`` codes at least, and which of them begin a new run of ``span`` codes.

    By prefix doubling, whose ranks (the place at which a run of equal prefixes starts) are exact; positions
    that are alone under their rank are not sorted again. What the first ``span`` codes are is told by the
    ranks of two overlapping stretches of the longest doubled length below that.
    """
    n = len(codes)
    length = max(1, min(62 // bits, span))
    key = np.zeros(n, dtype=np.int64)
    for k in range(length):
        key = key << bits | _ahead(codes, k)
    order = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = _starts(key[order], np.arange(n)) + 1

    def refined(by: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the order that are not alone, their positions sorted by the rank ``by`` places on too, and their new ranks."""
        ranked = rank[order]
        same = ranked[1:] == ranked[:-1]
        at = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        places = order[at]
        ahead = places + by
        keys = rank[places] << 31 | np.where(ahead < n, rank[np.minimum(ahead, n - 1)], 0)
        chosen = np.argsort(keys)
        return at, places[chosen], (_starts(keys[chosen], at) + 1 if len(at) else at)

    equal = None
    while True:
        if equal is None and 2 * length >= span:
            equal = rank.copy()
            _, places, ranks = refined(span - length)
            equal[places] = ranks
        if length > span:
            break
        at, places, ranks = refined(length)
        if not len(at):
            equal = rank if equal is None else equal
            break
        order[at] = places
        rank[places] = ranks
        length *= 2
    told = equal[order]
    return order, np.concatenate([[True], told[1:] != told[:-1]])


class FMIndex:
    """Index of texts, joined with separators, for patterns of up to ``span`` code points.

    Suffixes are ordered by ``span + 1`` code points, which is as far as such patterns can tell them
    apart. Kept are the wavelet matrix of the characters before them, a bit vector of the places at which
    their first ``span`` code points change, and the alphabet: about 1.5 bits a level and 1.5 bits a
    character. What building needs besides is dropped.
    """

    def __init__(self, texts: list[str], span: int):
        self.span = span
        joined = "\x00".join(texts) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.symbols, codes = np.unique(points, return_inverse=True)
        codes = codes.astype(np.int64) + 2
        codes[np.cumsum(lengths + 1) - 1] = 1
        self.sigma, self.n = len(self.symbols) + 2, len(codes)
        order, new = suffix_order(codes, span, int(self.sigma - 1).bit_length())
        self.matrix = WaveletMatrix(codes[order - 1], self.sigma)
        self.new = BitVector(new)
        alphabet = np.arange(self.sigma)
        smaller = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=self.sigma))[:-1]])
        self.shift = smaller - self.matrix.walk(alphabet, np.zeros(self.sigma, dtype=np.int64))

    def size(self) -> int:
        """Bytes of the index."""
        held = [*self.matrix.levels, self.new]
        return sum(v.words.nbytes + v.before.nbytes for v in held) + self.symbols.nbytes + self.shift.nbytes

    def extend(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """One backward step of interval ends: the suffixes that a symbol before them gives."""
        return self.shift[symbols] + self.matrix.walk(symbols, i)

    def _codes(self, texts: list[str]) -> np.ndarray:
        """The joined code points of indexed texts as symbols."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return (np.searchsorted(self.symbols, points) + 2).astype(np.int32)

    def matching_statistics(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stream indexed texts through the index from their ends, by backward search in step.

        Statistics are capped at ``span``: whenever a match has grown to it, the interval of all suffixes
        with the same ``span`` code points, whose bounds are the nearest places at which these change, is
        reported and the match goes on from there. Returns, for each such place, the text's number, the
        offset in it and the interval's number.
        """
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(lengths)
        codes = self._codes(texts)
        bits = np.unpackbits(self.new.words.view(np.uint8), bitorder="little")[: self.n]
        begins = np.append(np.flatnonzero(bits), self.n).astype(np.int64)
        active = np.argsort(-lengths, kind="stable")
        ranked = -lengths[active]
        lo, hi = np.zeros(len(texts), dtype=np.int64), np.full(len(texts), self.n, dtype=np.int64)
        which, offsets, intervals = [], [], []
        for step in range(1, int(lengths.max(initial=0)) + 1):
            active = active[: np.searchsorted(ranked[: len(active)], -step, side="right")]
            at = ends[active] - step
            symbols = codes[at]
            both = self.extend(np.concatenate([symbols, symbols]), np.concatenate([lo[active], hi[active]]))
            low, high = both[: len(active)], both[len(active) :]
            if step >= self.span:
                number = (self.new.rank1(low + 1) - 1).astype(np.int64)
                low, high = begins[number], begins[number + 1]
                which.append(active)
                offsets.append(at - (ends - lengths)[active])
                intervals.append(number)
            lo[active], hi[active] = low, high
        if not which:
            nothing = np.empty(0, dtype=np.int64)
            return nothing, nothing, nothing
        return np.concatenate(which), np.concatenate(offsets), np.concatenate(intervals)
