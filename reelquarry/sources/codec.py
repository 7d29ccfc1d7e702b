"""The recorders' block codecs. A block of 12 or 16 bytes is 16 samples: packed differences that are scaled and added to interpolations.

A block's last sample depends on that block alone, and is all that the next block needs of it. So blocks decode side by
side, in any part of a take, from the block before the part on.
"""

from __future__ import annotations

from functools import cache

import numpy as np

# Fixed values of the formats. In a layout each character is a bit of the block, bytes in order, highest bit first: the
# sample (1-9, a-g) that the bit belongs to, or p for none.
LAYOUTS = {
    "A": "ppp88888 88888888 pppggggg gggggggg 87777776 66666655 gffffffe eeeeeedd 55554444 44444333 ddddcccc cccccbbb 33322222 22111111 bbbaaaaa aa999999",
    "B": "pp888888 88888887 ppgggggg gggggggf 77777666 66666555 fffffeee eeeeeddd 55544444 44443333 dddccccc ccccbbbb 33222222 22111111 bbaaaaaa aa999999",
    "B3": "ppp88888 88888887 pppggggg gggggggf 77777666 66666555 fffffeee eeeeeddd 55544444 44443333 dddccccc ccccbbbb 33222222 22111111 bbaaaaaa aa999999",
    "B4": "pppp8888 88888887 ppppgggg gggggggf 77777766 66666555 ffffffee eeeeeddd 55554444 44433333 ddddcccc cccbbbbb 33222222 21111111 bbaaaaaa a9999999",
    "C": "ppp88888 88888877 pppggggg ggggggff 77776666 66665555 ffffeeee eeeedddd 55444444 44443333 ddcccccc ccccbbbb 33222222 22111111 bbaaaaaa aa999999",
    "D": "pp888888 88877777 ppgggggg gggfffff 77666666 66555555 ffeeeeee eedddddd 54444444 44333333 dccccccc ccbbbbbb 32222222 21111111 baaaaaaa a9999999",
    "E": "pppp8888 88888877 ppppgggg ggggggff 77776666 66665555 ffffeeee eeeedddd 55444444 44443333 ddcccccc ccccbbbb 33222222 22111111 bbaaaaaa aa999999",
    "F": "pppp8888 88887777 ppppgggg ggggffff 77766666 66655555 fffeeeee eeeddddd 55444444 44333333 ddcccccc ccbbbbbb 32222222 21111111 baaaaaaa a9999999",
    "12A": "pp888888 88888777 ppgggggg gggggfff 76666665 55544444 feeeeeed dddccccc 44333322 22221111 ccbbbbaa aaaa9999",
    "12B": "pp888888 87777766 ppgggggg gfffffee 66665555 54444444 eeeedddd dccccccc 33333222 22211111 bbbbbaaa aaa99999",
    "12C": "pppp8888 88777776 ppppgggg ggfffffe 66666555 55444444 eeeeeddd ddcccccc 33333222 22211111 bbbbbaaa aaa99999",
    "12D": "pppp8888 88887777 ppppgggg ggggffff 66666655 55444444 eeeeeedd ddcccccc 44333322 22221111 ccbbbbaa aaaa9999",
    "12E": "ppp88888 88887777 pppggggg ggggffff 66666655 55444444 eeeeeedd ddcccccc 44333322 22221111 ccbbbbaa aaaa9999",
    "12F": "ppp88888 88888887 pppggggg gggggggf 77766666 55554444 fffeeeee ddddcccc 44433332 22221111 cccbbbba aaaa9999",
    "12G": "ppp88888 88888777 pppggggg gggggfff 76666665 55544444 feeeeeed dddccccc 44333322 22221111 ccbbbbaa aaaa9999",
}

# By format, for runs of patterns (first, layout, first shift, how many, how to rebuild). Shifts go up by one
# along a run; a shift of 0 is none. Patterns that no run has are unknown.
RUNS = {
    5: [(0, "B", 6, 6, 2), (6, "D", 10, 6, 4), (12, "A", 5, 6, 2), (18, "B3", 12, 1, 2), (19, "C", 8, 6, 2), (25, "F", 12, 5, 8), (30, "F", 16, 1, 0),
        (31, "E", 14, 1, 4), (32, "B4", 4, 2, 2), (34, "B4", 0, 1, 2), (35, "B4", 2, 2, 2)],
    0: [(2, "B", 0, 4, 2), (6, "D", 2, 6, 4), (15, "A", 0, 3, 2), (18, "B3", 4, 1, 2), (19, "C", 0, 6, 2), (25, "F", 4, 5, 8), (30, "F", 8, 1, 0), (31, "E", 6, 1, 4)],
    1: [(0, "12A", 0, 6, 2), (6, "12B", 4, 6, 4), (13, "12F", 0, 5, 2), (18, "12G", 6, 1, 2), (19, "12E", 2, 6, 2), (25, "12C", 6, 5, 8), (30, "12C", 10, 1, 0), (31, "12D", 8, 1, 4)],
}

BLOCK_BYTES = {0: 16, 1: 12, 5: 16}
BITS = {0: 16, 1: 16, 3: 16, 5: 24, 8: 24}
SAMPLES = 16


def pattern_table() -> np.ndarray:
    """The pattern for each index, made of the high half-bytes of a block's bytes 0 and 2.

    The index's top two bits choose how many of its low four say more: two of them for the first twelve patterns, three
    for the next thirteen, and all, with one more bit of the upper half, for the last twelve.
    """
    table = np.zeros(256, np.int64)
    for index in range(256):
        top, low = index >> 4, index & 15
        if top < 12:
            table[index] = 4 * (top >> 2) + (low >> 2)
        elif top < 14:
            table[index] = 12 + (low >> 1)
        elif low < 10:
            table[index] = 20 + (low >> 1)
        else:
            table[index] = (25 if top == 14 else 31) + low - 10
    return table


_PATTERNS = pattern_table()


@cache
def _bits(layout: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each sample its (bytes, bits in them), from the lowest: bytes go backward, bits of a byte forward."""
    groups = LAYOUTS[layout].split(" ")
    found: list[list[tuple[int, int]]] = [[] for _ in range(SAMPLES)]
    for byte in range(len(groups) - 1, -1, -1):
        for bit in range(8):
            if (c := groups[byte][7 - bit]) != "p":
                found[int(c, 17) - 1].append((byte, bit))
    return [(np.array([a for a, _ in x]), np.array([b for _, b in x])) for x in found]


def _unpack(blocks: np.ndarray, layout: str) -> np.ndarray:
    out = np.zeros((len(blocks), SAMPLES), np.int64)
    for s, (byte, bit) in enumerate(_bits(layout)):
        value = ((blocks[:, byte] >> bit & 1).astype(np.int64) << np.arange(len(byte))).sum(axis=1)
        out[:, s] = value - ((value >> len(byte) - 1 & 1) << len(byte))
    return out


def _rebuild(out: np.ndarray, before: np.ndarray, how: int) -> None:
    """Add to each sample the mean of its neighbours, from far ones to near. how: anchors in the block; 0 doubles instead."""
    if how == 0:
        out[:, 0::2] <<= 1
        return
    for step in (4, 2, 1):
        if step * how >= 16:
            continue
        for s in range(step - 1, SAMPLES, 2 * step):
            left = before if s < step else out[:, s - step]
            out[:, s] += left + out[:, s + step] >> 1


def decode(data: bytes, code: int, before: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(samples, numbers of unknown blocks) of whole blocks; before: the block in front of them, if there is one.

    Unknown blocks are silent, and the block after them starts from 0.
    """
    size = BLOCK_BYTES[code]
    blocks = np.frombuffer(before + data, np.uint8)
    blocks = blocks[: len(blocks) // size * size].reshape(-1, size)
    pattern = _PATTERNS[(blocks[:, 0] & 0xF0) | blocks[:, 2] >> 4]
    out, known, most = np.zeros((len(blocks), SAMPLES), np.int64), np.zeros(len(blocks), bool), 1 << BITS[code] - 1
    rebuild = []
    for first, layout, shift, count, how in RUNS[code]:
        for k in range(count):
            rows = np.nonzero(pattern == first + k)[0]
            if len(rows):
                n = shift + k
                value = _unpack(blocks[rows], layout)
                out[rows] = value << n | 1 << n - 1 if n else value
                known[rows] = True
                rebuild.append((rows, how))
    last = np.clip(out[:, -1], -most, most - 1)
    carry = np.concatenate([[0], last[:-1]])
    for rows, how in rebuild:
        part = out[rows]
        _rebuild(part, carry[rows], how)
        out[rows] = part
    out = np.clip(out, -most, most - 1)
    skip = len(before) // size
    return out[skip:].reshape(-1).astype("<i4"), np.nonzero(~known[skip:])[0]
