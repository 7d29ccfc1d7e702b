"""The codecs against a plain decoder that goes block by block, bit by bit."""

import random

import numpy as np
import pytest

from reelquarry.sources.codec import BLOCK_BYTES, LAYOUTS, RUNS, decode, pattern_table

ORDER = {2: [3, 1, 5, 11, 9, 13, 0, 2, 4, 6, 8, 10, 12, 14], 4: [1, 5, 9, 13, 0, 2, 4, 6, 8, 10, 12, 14], 8: [0, 2, 4, 6, 8, 10, 12, 14]}
REACH = {3: 4, 11: 4, 1: 2, 5: 2, 9: 2, 13: 2}


def slow(data, code):
    size, most, d0, out, unknown = BLOCK_BYTES[code], 1 << {0: 15, 1: 15, 5: 23}[code], 0, [], []
    rules = {first + k: (layout, shift + k, how) for first, layout, shift, count, how in RUNS[code] for k in range(count)}
    for number in range(len(data) // size):
        block = data[number * size : (number + 1) * size]
        rule = rules.get(int(pattern_table()[(block[0] & 0xF0) | (block[2] & 0xF0) >> 4]))
        if rule is None:
            out += [0] * 16
            unknown.append(number)
            d0 = 0
            continue
        layout, shift, how = rule
        groups, bits, s = LAYOUTS[layout].split(), [0] * 16, [0] * 16
        for byte in reversed(range(size)):
            for bit in range(8):
                symbol = groups[byte][7 - bit]
                if symbol != "p":
                    k = "123456789abcdefg".index(symbol)
                    s[k] |= (block[byte] >> bit & 1) << bits[k]
                    bits[k] += 1
        s = [v - (1 << n) if v >> n - 1 & 1 else v for v, n in zip(s, bits, strict=True)]
        if shift:
            s = [v << shift | 1 << shift - 1 for v in s]
        if how:
            for k in ORDER[how]:
                reach = REACH.get(k, 1)
                s[k] += (d0 if k < reach else s[k - reach]) + s[k + reach] >> 1
        else:
            s[0::2] = [2 * v for v in s[0::2]]
        s = [max(-most, min(most - 1, v)) for v in s]
        out += s
        d0 = s[15]
    return out, unknown


@pytest.mark.parametrize("code", sorted(BLOCK_BYTES))
def test_decode(code):
    random.seed(code)
    size = BLOCK_BYTES[code]
    blocks = []
    for index in range(256):
        for _ in range(3):
            b = bytearray(random.randbytes(size))
            b[0], b[2] = b[0] & 15 | index & 0xF0, b[2] & 15 | (index & 15) << 4
            blocks.append(bytes(b))
    random.shuffle(blocks)
    data = b"".join([bytes(size), *blocks])
    want, unknown = slow(data, code)
    got, missing = decode(data, code)
    assert got.tolist() == want and missing.tolist() == unknown
    for at in (1, 5, 300):  # any part, from the block before it on
        part, _ = decode(data[at * size : (at + 200) * size], code, data[(at - 1) * size : at * size])
        assert part.tolist() == want[at * 16 : (at + 200) * 16]


def test_layouts_are_whole():
    for name, layout in LAYOUTS.items():
        groups = layout.split()
        assert len(groups) == (12 if name.startswith("12") else 16) and all(len(g) == 8 for g in groups)
        assert set("".join(groups)) == set("p123456789abcdefg")


def test_zero_blocks():
    assert not decode(bytes(160), 0)[0].any() and not decode(bytes(120), 1)[0].any() and decode(bytes(160), 5)[0].any()


def test_pattern_table():
    table = pattern_table()
    assert table.min() == 0 and table.max() == 36 and len(np.unique(table)) == 37
