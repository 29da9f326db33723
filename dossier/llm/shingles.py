"""Hashed word shingles of whole texts, and the segment signatures of their sets."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np

SHINGLE_WORDS = 5
BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)
LETTERS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 64, 256, dtype=np.uint64)

# Bands of set sizes: band k holds 64^k to 64^(k+1) - 1 shingles and has 64 * 4096^(k+1) segments, so that
# hardly ever two shingles of a set share one.
BAND_BITS = 6
MOST_BITS = 60
WHOLE = 256
SLACK = 6.0
# Sketches of sets have at most so many numbers of 64 bits.
SKETCH_MOST = 64

_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int):
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for i, base in enumerate((BASE, INVERSE)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _POWERS[i] = np.multiply.accumulate(factors)
    return _POWERS


def mix(x):
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain_words(text: str | None) -> bytes:
    """The words of a text, A-Z in lower case, each pair parted by one space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def content_key(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def text_node(key: bytes) -> int:
    """Signed 64-bit number of a text, from its content key."""
    return int.from_bytes(key[:8], "little", signed=True)


def shingle_set(words: bytes):
    """Sorted 64-bit hashes of the distinct five-word shingles; of fewer words the whole is one.

    A shingle is a stretch of the text, hashed as a difference of prefix sums.
    """
    if not words:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(words, dtype=np.uint8)
    powers, inverse = _powers(len(raw) + 1)[0], _POWERS[1]
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(LETTERS[raw] * powers[: len(raw)], out=sums[1:])
    spaces = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], spaces + 1))
    ends = np.concatenate((spaces, [len(raw)]))
    if len(starts) >= SHINGLE_WORDS:
        starts, ends = starts[: 1 - SHINGLE_WORDS], ends[SHINGLE_WORDS - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))


def band(n: int) -> int:
    return (n.bit_length() - 1) // BAND_BITS


def segment_bits(band_number: int) -> int:
    return min(MOST_BITS, BAND_BITS * (2 * band_number + 3))


def needed(n: int) -> int:
    """Segments of a set of n shingles of which a linked set at least as large must have one.

    A linked set of m >= n shingles lacks at most (4 n - 3 m) / 7 of them.
    """
    return n // 7 + 1


def share(n: int) -> float:
    """Share of the segments that is indexed for sets of n shingles: enough for ``needed`` and some to spare."""
    return 1.0 if n < WHOLE else min(1.0, 1 / 7 + SLACK / math.sqrt(n))


def _segments(hashes, bits: int, part: float):
    """Sorted tokens of the first part of the segments: tokens, their segments, where segments start."""
    if part < 1:
        hashes = hashes[(hashes >> np.uint64(64 - bits)) < np.uint64(int(part * (1 << bits)))]
    tokens = np.sort(hashes)
    segments = tokens >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.concatenate(([True], segments[1:] != segments[:-1]))) if len(tokens) else np.empty(0, dtype=np.int64)
    return tokens, segments, starts


def own_segments(shingles) -> int:
    """Segments that a set can ask for."""
    n = len(shingles)
    return len(_segments(mix(shingles), segment_bits(band(n)), share(n))[2]) if n else 0


def signatures(shingles):
    """Signature of every indexed segment of a set, and whether the set may ask for it.

    A set indexes its segments for sets of its own band and, if a set of 3/4 of
    its size falls there, of the band below. A segment of several shingles is
    indexed by its deletion neighbourhood as well: each single shingle for the
    usual two, all smaller selections if there are more. So the segment of a
    smaller set is found in that of a larger one whenever its shingles are all
    there, whatever else is.
    """
    n = len(shingles)
    if not n:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
    hashes, k = mix(shingles), band(n)
    least = -(-3 * n // 4)
    found, asking = [], []
    for scheme in (k, k - 1):
        if scheme < 0 or (scheme < k and least >= 1 << BAND_BITS * k):
            continue
        bits = segment_bits(scheme)
        tokens, segments, starts = _segments(hashes, bits, share(least))
        if not len(tokens):
            continue
        inner = mix(tokens + np.uint64(0x632BE59BD9B4E019))
        place = (segments + np.uint64(scheme << 61)) * np.uint64(BASE)
        found.append(mix(np.add.reduceat(inner, starts) + place[starts]))
        asks = segments[starts] < np.uint64(int(share(n) * (1 << bits))) if share(n) < 1 else np.ones(len(starts), dtype=bool)
        asking.append(asks & (scheme == k))
        ends = np.append(starts[1:], len(tokens))
        for group in np.flatnonzero(ends - starts > 1):
            first, last = int(starts[group]), int(ends[group])
            for size in range(1, last - first):
                for chosen in itertools.combinations(range(first, last), size):
                    found.append(mix(inner[list(chosen)].sum(keepdims=True) + place[first]))
                    asking.append(np.zeros(1, dtype=bool))
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64), np.concatenate(asking) if asking else np.empty(0, dtype=bool)


def parity_sketch(shingles):
    """A bit of parity for every half shingle or less, as a power of two of 64-bit numbers, at most ``SKETCH_MOST``.

    Folded in halves it is the sketch of fewer numbers; a shingle more or less turns one bit.
    """
    numbers = min(SKETCH_MOST, 1 << max(0, -(-len(shingles) // 32) - 1).bit_length())
    hashes = mix(shingles ^ np.uint64(0xD6E8FEB86659FD93))
    found = np.zeros(numbers, np.uint64)
    np.bitwise_xor.at(found, ((hashes >> np.uint64(32)) % np.uint64(numbers)).astype(np.int64), np.uint64(1) << (hashes >> np.uint64(58)))
    return found.view(np.int64)


def overlap(a, b) -> int:
    """Shingles that two sorted sets share."""
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def linked(n: int, m: int, same: int) -> bool:
    """Whether sets of n and m shingles that share ``same`` of them overlap in 75 % of their union."""
    return same > 0 and 100 * same >= 75 * (n + m - same)
