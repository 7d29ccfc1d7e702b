"""N-best SentencePiece segmentation: forward Viterbi scores guide a backward A-star search over the piece lattice.

A place between two characters that stand side by side in no piece is spanned by no piece, so there a text's lattice falls
into the lattices of its parts (words and runs of signs), end to end. The forward pass keeps the two best scores at every
place, for all distinct parts of a batch at once. The best path of a text is that of its parts. Of the N best only the N - 1
parts whose second best is closest can differ from it, so the A-star search goes over these parts and then over their chain.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, prepare

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: What a character without a piece costs below the least score of a piece.
UNKNOWN_COST = 10.0
#: Characters of texts, and cells of lattices, that are worked on at once.
SLICE_CHARS, SLICE_CELLS = 1 << 20, 1 << 18

SPACE = "▁"
_NONE = -1e300

#: A way to spell a part: (score, ids).
Path = tuple[float, tuple[int, ...]]
Edges = list[list[tuple[int, float, tuple[int, ...]]]]


def zipf_scores(ranks: np.ndarray) -> np.ndarray:
    """Log-probabilities of pieces by Zipf's law on their ranks: a BPE model has ranks as scores, which are no likelihood."""
    weight = 1.0 / (ranks + 1.0)
    return np.log(weight / weight.sum())


class _Table:
    """Numbers by key (both not negative), in open addressing; lookups go over whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int32)
        rest, at = np.arange(len(keys)), self._first(keys)
        while len(rest):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[rest[free]]  # of several that want a place the last gets it
            self.values[at[free]] = values[rest[free]]
            lost = self.keys[at] != keys[rest]
            rest, at = rest[lost], at[lost] + 1 & (1 << self.bits) - 1

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        at, out = self._first(keys), np.full(len(keys), -1, np.int32)
        found = self.keys[at]
        hit = found == keys
        out[hit] = self.values[at[hit]]
        rest = np.nonzero(~hit & (found >= 0))[0]
        while len(rest):
            at[rest] = at[rest] + 1 & (1 << self.bits) - 1
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class Vocabulary:
    """Pieces (text: (id, score)) as a trie in arrays.

    `texts` are the bytes of each id; `bytes_at` is the id of the byte piece for 0, or None: then `unknown` stands for a
    character without a piece. Whole numbers as scores are ranks and become log-probabilities by Zipf's law, unless
    `as_they_are`; pieces that training never chose (with a score far below all others) count as the last rank.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], texts: list[bytes], bytes_at: int | None, unknown: int, as_they_are: bool = False) -> None:
        self.bytes_at, self.unknown = bytes_at, unknown
        names = sorted(pieces)
        scores = np.array([pieces[p][1] for p in names], float)
        chosen = scores > -1e8
        if not as_they_are and chosen.any() and (scores[chosen] <= 0).all() and (scores[chosen] == np.round(scores[chosen])).all():
            scores = zipf_scores(np.where(chosen, -scores, -scores[chosen].min() + 1))
        self.unknown_score = float(scores[chosen].min() if chosen.any() else 0.0) - UNKNOWN_COST
        self.scores = np.zeros(len(texts))
        ids = np.array([pieces[p][0] for p in names], np.int64)
        self.scores[ids] = np.maximum(scores, self.unknown_score)
        self.texts = texts
        letters = sorted(set("".join(names)))
        self.letters = np.zeros(0x110000, np.int32)  # 0 is in no piece
        self.letters[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.size, self.longest = len(letters) + 1, max(map(len, names), default=1)
        nodes: dict[tuple[int, str], int] = {}
        piece_at = [-1]
        self.pairs = np.zeros(-(-self.size * self.size // 8), np.uint8)
        for name, number in zip(names, ids.tolist(), strict=True):
            node = 0
            for c in name:
                if (node, c) not in nodes:
                    nodes[node, c] = len(piece_at)
                    piece_at.append(-1)
                node = nodes[node, c]
            piece_at[node] = number
            own = self.letters[[ord(c) for c in name]].astype(np.int64)
            pair = own[:-1] * self.size + own[1:]
            np.bitwise_or.at(self.pairs, pair >> 3, (1 << (pair & 7)).astype(np.uint8))
        keys = np.array([n * self.size + int(self.letters[ord(c)]) for n, c in nodes], np.int64)
        self.trie = _Table(keys, np.fromiter(nodes.values(), np.int32, len(nodes)))
        self.piece_at = np.array(piece_at, np.int32)

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, texts, bytes_at = {}, [], None
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                bytes_at = i if bytes_at is None else bytes_at
                texts.append(bytes([int(text[3:5], 16)]))
            elif model.is_control(i) or model.is_unused(i) or model.is_unknown(i):
                texts.append(b"")
            else:
                pieces[text] = (i, model.get_score(i))
                texts.append(text.encode())
        return cls(pieces, texts, bytes_at, model.unk_id())

    def spelled(self, character: int) -> list[int]:
        """The ids that stand for a character without a piece."""
        return [self.unknown] if self.bytes_at is None else [self.bytes_at + b for b in chr(character).encode("utf-8", "surrogatepass")]


@dataclass
class Lattice:
    """Edges of several parts, a cell being (place, part): sorted by the cell in which they end, then longest first.

    A piece is an id, or the complement of the character that has none. `length` is of each part.
    """

    length: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    score: np.ndarray


def lattice(codes: np.ndarray, start: np.ndarray, length: np.ndarray, words: Vocabulary) -> Lattice:
    """The edges of parts codes[start : start + length]; longer parts come first. All places of all parts go down the trie together."""
    count, most = len(start), int(length[0])
    place, part = np.nonzero(np.arange(most)[:, None] < length[None, :])
    cells = np.zeros((most + words.longest, count), np.int32)
    own = codes[start[part] + place]
    cells[place, part] = words.letters[own]
    cells, at = cells.reshape(-1), place * count + part
    begins, ends, pieces = [], [], []
    node, alive = np.zeros(len(at), np.int64), at
    for depth in range(words.longest):
        node = words.trie.get(node * words.size + cells[alive + depth * count]).astype(np.int64)
        on = node >= 0
        node, alive = node[on], alive[on]
        if not len(node):
            break
        piece = words.piece_at[node]
        hit = piece >= 0
        begins.append(alive[hit])
        ends.append(alive[hit] + (depth + 1) * count)
        pieces.append(piece[hit])
    single = np.zeros(len(cells), bool)
    if begins:
        single[begins[0]] = True
    none = ~single[at]
    begins.insert(0, at[none])
    ends.insert(0, at[none] + count)
    pieces.insert(0, -1 - own[none].astype(np.int32))
    begin, end, piece = (np.concatenate(x[::-1]) for x in (begins, ends, pieces))
    order = np.argsort(end, kind="stable")
    begin, end, piece = begin[order], end[order], piece[order]
    return Lattice(length, begin, end, piece, np.where(piece >= 0, words.scores[np.maximum(piece, 0)], words.unknown_score))


def forward(found: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, second best score, edge) of the best path to each cell; of equal paths that with the longest last piece."""
    count, most = len(found.length), int(found.length[0])
    first, second = np.full((most + 1) * count, _NONE), np.full((most + 1) * count, _NONE)
    first[:count] = 0.0
    chosen = np.zeros((most + 1) * count, np.int64)
    starts = np.concatenate([[0], np.nonzero(np.diff(found.end))[0] + 1])
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(found.end))))
    rows = np.searchsorted(found.end[starts], np.arange(1, most + 2) * count)  # groups of each place
    bounds = np.append(starts, len(found.end))
    for k in range(most):
        lo, hi = rows[k], rows[k + 1]
        a, b = bounds[lo], bounds[hi]
        if a == b:
            continue
        begin, score, own, local = found.begin[a:b], found.score[a:b], group[a:b] - lo, starts[lo:hi] - a
        value = first[begin] + score
        best = np.maximum.reduceat(value, local)
        top = np.nonzero(value == best[own])[0][::-1]
        winner = np.zeros(hi - lo, np.int64)
        winner[own[top]] = top  # the first of equal ones stays
        value[winner] = second[begin[winner]] + score[winner]
        cell = found.end[starts[lo:hi]]
        first[cell], second[cell], chosen[cell] = best, np.maximum.reduceat(value, local), winner + a
    return first, second, chosen


@dataclass
class Parts:
    """The best of distinct parts: scores, how much worse their second best are, and ids, part by part."""

    score: np.ndarray
    gap: np.ndarray
    ids: np.ndarray
    offset: np.ndarray


def _slices(length: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of parts, longest first, whose cells together are not many more than `most`."""
    at = 0
    while at < len(length):
        end = min(len(length), at + max(1, most // (int(length[at]) + 1)))
        yield at, end
        at = end


def best_of(codes: np.ndarray, start: np.ndarray, length: np.ndarray, words: Vocabulary) -> Parts:
    """The best of each of the parts codes[start : start + length]."""
    order = np.argsort(-length, kind="stable")
    score, gap, count = np.zeros(len(start)), np.zeros(len(start)), np.zeros(len(start), np.int64)
    owners, places, pieces = [], [], []
    for a, b in _slices(length[order], SLICE_CELLS):
        which = order[a:b]
        found = lattice(codes, start[which], length[which], words)
        first, second, chosen = forward(found)
        n = b - a
        last = length[which] * n + np.arange(n)
        score[which], gap[which] = first[last], first[last] - second[last]
        cell, alive, step = last, np.arange(n), 0
        while len(alive):
            edge = chosen[cell]
            owners.append(which[alive])
            places.append(np.full(len(alive), step))
            pieces.append(found.piece[edge])
            cell = found.begin[edge]
            on = cell >= n
            cell, alive, step = cell[on], alive[on], step + 1
    if not owners:
        return Parts(score, gap, np.zeros(0, np.int32), np.zeros(1, np.int64))
    owner, place, piece = np.concatenate(owners), np.concatenate(places), np.concatenate(pieces)
    np.maximum.at(count, owner, place + 1)
    offset = np.concatenate([[0], np.cumsum(count)])
    ids = np.zeros(offset[-1], np.int32)
    ids[offset[owner + 1] - 1 - place] = piece
    return Parts(score, gap, *_spell(ids, offset, words))


def _spell(ids: np.ndarray, offset: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets with the ids of characters that have no piece put in."""
    unknown = np.nonzero(ids < 0)[0]
    if not len(unknown):
        return ids, offset
    kinds, which = np.unique(-1 - ids[unknown], return_inverse=True)
    spelled = [words.spelled(int(c)) for c in kinds]
    size = np.ones(len(ids), np.int64)
    size[unknown] = np.array([len(s) for s in spelled])[which]
    place = np.concatenate([[0], np.cumsum(size)])
    out = np.repeat(ids, size)
    for k, own in enumerate(spelled):
        at = place[unknown[which == k]]
        for j, i in enumerate(own):
            out[at + j] = i
    return out, place[offset]


def _span(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, start[1] .., end to end."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + count, count)


def _edges(codes: np.ndarray, start: np.ndarray, length: np.ndarray, words: Vocabulary) -> list[Edges]:
    """For each of the parts, and each place in it, the edges that end there: (where it begins, score, ids)."""
    out: list[Edges] = [[[] for _ in range(n + 1)] for n in length.tolist()]
    order = np.argsort(-length, kind="stable")
    for a, b in _slices(length[order], SLICE_CELLS):
        which, n = order[a:b], b - a
        found = lattice(codes, start[which], length[which], words)
        for begin, end, piece, score in zip(found.begin.tolist(), found.end.tolist(), found.piece.tolist(), found.score.tolist(), strict=True):
            ids = (piece,) if piece >= 0 else tuple(words.spelled(-1 - piece))
            out[which[end % n]][end // n].append((begin // n, score, ids))
    return out


def search(ends: Edges, count: int) -> list[Path]:
    """The `count` best paths through a lattice, best first; among equal scores the order is that of the search.

    The forward pass finds the best score up to each place. The search goes backward from the end: a partial path's score
    plus the forward score where it begins is just what its best completion scores, so paths are complete in order. A
    place need not be left more than `count` times.
    """
    best = [0.0] + [float("-inf")] * (len(ends) - 1)
    for end in range(1, len(ends)):
        best[end] = max((best[begin] + score for begin, score, _ in ends[end]), default=float("-inf"))
    heap: list = [(-best[-1], 0, len(ends) - 1, 0.0, None)]
    left, number, found = [0] * len(ends), 0, []
    while heap and len(found) < count:
        _, _, place, score, tail = heapq.heappop(heap)
        if place == 0:
            ids: list[int] = []
            while tail:
                ids += tail[0]
                tail = tail[1]
            found.append((score, tuple(ids)))
            continue
        if left[place] >= count:
            continue
        left[place] += 1
        for begin, own, ids in ends[place]:
            number += 1
            heapq.heappush(heap, (-(score + own + best[begin]), number, begin, score + own, (ids, tail)))
    return found


@dataclass
class Encoding:
    """The best ids with their score, and the other paths: (score, [(place, ids dropped there, ids put there)])."""

    ids: np.ndarray
    score: float
    others: list[tuple[float, list[tuple[int, int, list[int]]]]]


def _parts(codes: np.ndarray, first: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, a hash of the characters) of each part; `first`: where texts start, which parts don't run over."""
    cuts, prints = [], []
    for at in range(0, len(codes), SLICE_CHARS):
        letter = words.letters[codes[max(0, at - 1) : at + SLICE_CHARS]].astype(np.int64)
        pair = letter[:-1] * words.size + letter[1:]
        spanned = (words.pairs[pair >> 3] >> (pair & 7).astype(np.uint8) & 1).astype(bool)
        cuts.append(np.nonzero(~(spanned & (letter[:-1] > 0) & (letter[1:] > 0)))[0] + max(0, at - 1) + 1)
    start = np.unique(np.concatenate([*cuts, first]))
    length = np.diff(np.append(start, len(codes)))
    at = 0
    while at < len(start):
        end = max(at + 1, int(np.searchsorted(start, start[at] + SLICE_CHARS)))
        lo = int(start[at])
        hi = int(start[end]) if end < len(start) else len(codes)
        place = np.arange(lo, hi) - np.repeat(start[at:end], length[at:end])
        x = codes[lo:hi].astype(np.uint64) << np.uint64(40) ^ place.astype(np.uint64)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        prints.append(np.add.reduceat(x, start[at:end] - lo))
        at = end
    return start, length, np.concatenate(prints)


def encode_texts(texts: list[str], words: Vocabulary, count: int = N_BEST) -> Iterator[Encoding]:
    """The `count` best segmentations of whole texts; a space mark is put before each, as these models do. An empty text has no pieces."""
    some = [t for t in texts if t]
    if not some:
        yield from (Encoding(np.zeros(0, np.int32), 0.0, []) for _ in texts)
        return
    codes = np.frombuffer((SPACE + SPACE.join(some)).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in some])])
    start, length, prints = _parts(codes, first[:-1], words)
    # equal hashes of 64 bits are taken for equal parts; a text that this got wrong would not decode to itself
    coded = pa.array(prints).dictionary_encode()
    which = coded.indices.to_numpy()
    sample = np.zeros(len(coded.dictionary), np.int64)
    sample[which[::-1]] = np.arange(len(which))[::-1]
    best = best_of(codes, start[sample], length[sample], words)
    size = np.diff(best.offset)
    bounds = np.searchsorted(start, first)
    close = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        gap = best.gap[which[a:b]]
        if count < 2:
            close.append(np.zeros(0, np.int64))
        elif len(gap) <= count - 1:
            close.append(np.nonzero(gap < 1e200)[0])
        else:
            limit = np.partition(gap, count - 2)[count - 2]
            under = np.nonzero(gap < limit)[0]
            even = np.nonzero(gap == limit)[0][: count - 1 - len(under)]
            near = np.sort(np.concatenate([under, even]))
            close.append(near[gap[near] < 1e200])
    kinds = np.unique(np.concatenate([which[a + c] for a, c in zip(bounds[:-1], close, strict=True)]))
    edges = _edges(codes, start[sample[kinds]], length[sample[kinds]], words)
    paths = {k: search(e, count) for k, e in zip(kinds.tolist(), edges, strict=True)}
    number = 0
    for text in texts:
        if not text:
            yield Encoding(np.zeros(0, np.int32), 0.0, [])
            continue
        own = which[bounds[number] : bounds[number + 1]]
        sizes = size[own]
        ids = best.ids[_span(best.offset[own], sizes)]
        score = float(best.score[own].sum())
        places = np.cumsum(sizes) - sizes
        near = close[number]
        number += 1
        # the chain of the close parts' own N best, as a lattice: its ids are (part, path) numbers
        mine = [paths[int(own[k])] for k in near]
        chain: Edges = [[]]
        for n, found in enumerate(mine):
            chain.append([(n, path[0] - found[0][0], ((n, i),)) for i, path in enumerate(found)])
        others = []
        for less, choice in search(chain, count):
            changes = []
            for n, i in choice:
                k = near[n]
                at, drop = int(places[k]), int(sizes[k])
                # a part's first path may differ from its best where their scores are equal
                if mine[n][i][1] != tuple(ids[at : at + drop].tolist()):
                    changes.append((at, drop, list(mine[n][i][1])))
            if changes:
                others.append((score + less, changes))
        yield Encoding(ids, score, others[: count - 1])


def encode(text: str | None, words: Vocabulary, count: int = N_BEST) -> Encoding:
    """encode_texts() for one text; null is empty."""
    return next(encode_texts([text or ""], words, count))


def changed(ids: list[int], changes: list[tuple[int, int, list[int]]]) -> list[int]:
    """The ids of another path, from the best ones and its changes."""
    out, at = [], 0
    for place, drop, put in sorted(changes):
        out += list(ids[at:place]) + list(put)
        at = place + drop
    return out + list(ids[at:])


def decode(ids: list[int], words: Vocabulary) -> str:
    """The text of ids: byte pieces make characters (bad UTF-8 the replacement character), space marks spaces; the first mark goes."""
    texts = words.texts
    text = b"".join([texts[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text[:1] == " " else text


_PLAIN = "n_pieces long, ids array<int>, score double, others array<struct<score:double,changes:array<struct<at:int,drop:int,ids:array<int>>>>>, round_trip boolean"
_OTHERS = pa.list_(
    pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))])
)
_NAMES = ["n_pieces", "ids", "score", "others", "round_trip"]


def _in_slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= SLICE_CHARS):
            total += len(texts[end])
            end += 1
        yield at, end
        at = end


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Vocabulary | None = None, count: int = N_BEST, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id column, n_pieces, ids, score, others, round_trip, keep...) for each row.

    ids are the best segmentation of the whole text, others the next best as changes to it (see changed()), round_trip
    whether decoding the ids gives the text again, which fails only for texts that hold the space mark itself. Null and
    empty texts have no pieces and score 0. Of segmentations with equal scores that with longer last pieces comes first. The
    vocabulary is read on the driver and sent along: workers open no file, and keep nothing from batch to batch.
    Repeated rows and ids each get a row, an empty table an empty result; other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    words = words or Vocabulary.load()
    kept = [column(c).alias(f"keep{k}") for k, c in enumerate(keep)]
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"), *kept)
    names = [f"keep{k}" for k in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _in_slices(texts):
                part, found = batch.slice(a, b - a), list(encode_texts(texts[a:b], words, count))
                sizes = [len(e.ids) for e in found]
                others = [
                    [{"score": s, "changes": [{"at": at, "drop": d, "ids": put} for at, d, put in sorted(c)]} for s, c in e.others] for e in found
                ]
                ids = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([e.ids for e in found]), pa.int32())
                )
                same = [decode(e.ids.tolist(), words) == t for e, t in zip(found, texts[a:b], strict=True)]
                made = [pa.array(sizes, pa.int64()), ids, pa.array([e.score for e in found], pa.float64()), pa.array(others, _OTHERS), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0), *made, *part.columns[2:]], ["id", *_NAMES, *names])

    kinds = "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in names)
    out = rows.mapInArrow(run, f"id long, {_PLAIN}{kinds}")
    return out.select(F.col("id").alias(id_col), *_NAMES, *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)])
