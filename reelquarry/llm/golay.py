"""The perfect binary Golay code (23, 12, 7) as a fuzzy hash of 23-bit segments."""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH = 23
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the code.
GENERATOR = 0b110001110101


def _remainder(x: int) -> int:
    for i in range(LENGTH - 1, 10, -1):
        if x >> i & 1:
            x ^= GENERATOR << (i - 11)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bit = [_remainder(1 << i) for i in range(LENGTH)]
    low = np.zeros(1 << 12, np.uint32)
    high = np.zeros(1 << 11, np.uint32)
    for i in range(12):
        low[(np.arange(1 << 12) >> i & 1) == 1] ^= bit[i]
    for i in range(11):
        high[(np.arange(1 << 11) >> i & 1) == 1] ^= bit[12 + i]
    leader = np.zeros(1 << 11, np.uint32)
    weight = np.full(1 << 11, 9)
    at_four: dict[int, list[int]] = {}
    for size in range(5):
        for places in combinations(range(LENGTH), size):
            syndrome, error = 0, 0
            for p in places:
                syndrome ^= bit[p]
                error |= 1 << p
            if size == 4:
                at_four.setdefault(syndrome, []).append(error)
            else:
                leader[syndrome], weight[syndrome] = error, size
    four = np.zeros((1 << 11, 5), np.uint32)
    for syndrome, errors in at_four.items():
        four[syndrome] = errors
    return low, high, leader, four


_LOW, _HIGH, _LEADER, _FOUR = _tables()


def syndromes(x: np.ndarray) -> np.ndarray:
    return _LOW[x & 0xFFF] ^ _HIGH[x >> 12]


def nearest(x: np.ndarray) -> np.ndarray:
    """The 12-bit index of the one codeword within three bits of each 23-bit word."""
    return (x ^ _LEADER[syndromes(x)]) >> 11


def fuzzy_indices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (n, 6) for 23-bit words, and which of them count.

    Two words that differ in at most one bit share an index. A word of even parity gives the index of its nearest
    codeword, at most three bits away. One of odd parity gives every codeword at most four bits away: if the words differ
    in a bit, just one of them is odd, and the codeword nearest to the even one is among its indices.
    """
    x = x.astype(np.uint32)
    syndrome = syndromes(x)
    lead = _LEADER[syndrome]
    out = np.concatenate([(x ^ lead)[:, None], x[:, None] ^ _FOUR[syndrome]], axis=1) >> 11
    more = (np.bitwise_count(x) & 1 == 1) & (np.bitwise_count(lead) == 3)
    counts = np.ones((len(x), 6), bool)
    counts[:, 1:] = more[:, None]
    return out, counts
