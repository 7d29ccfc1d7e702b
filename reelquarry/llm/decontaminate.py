"""Benchmark decontamination: exact containment of item-sized windows, found by a prefix-filtered set join.

A window is the set of its five-word shingles. For exact containment one shingle of a window is a necessary token, and the
rarest one over all documents gives the fewest candidates: so each distinct window is filed under its rarest shingle and that
shingle's place in the window. A document's shingles that are filed are joined with the windows; the places bound where a
window would start and end in the document, and its words are then compared one by one.

Both sides are tables: neither the benchmark nor its windows come to the driver. What tasks hold of it is a bitmap of bounded
size that most shingles of clean documents miss; of a benchmark that fills the bitmap, more shingles are joined in vain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, prepare, utf8, written

#: Words of a window, words of a shingle.
WINDOW_WORDS, SHINGLE_WORDS = 13, 5
#: Bits of a bitmap of shingles, at most, as a power of two; and bits a shingle where there are fewer.
MOST_BITS, BITS_EACH = 24, 16
#: Parts to which documents with one filed shingle are dealt.
SALTS = 16

#: Byte by byte: A-Z become lower case, 0-9, a-z and all of other scripts stay, the rest parts words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased."""
    return text.translate(_WORD_BYTES).split() if text else []


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def _shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each place where a shingle of `size` words starts."""
    count = max(0, len(hashes) - size + 1)
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total = (total + hashes[k : k + count]) * _BASE
        total ^= total >> np.uint64(29)
    return total * _MIX + np.uint64(size)


@dataclass
class _Lookup:
    """Distinct hashes of shingles, with a bitmap that most other hashes miss."""

    hashes: np.ndarray
    sizes: tuple[int, ...]
    bits: int = 20

    def __post_init__(self) -> None:
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self.hashes >> np.uint64(64 - self.bits)] = True

    def find(self, words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shingle size, places in `words`, numbers in `hashes`) of the shingles that are there."""
        own = _word_hashes(words)
        for size in self.sizes:
            h = _shingle_hashes(own, size)
            places = np.nonzero(self.bitmap[h >> np.uint64(64 - self.bits)])[0]
            if len(places):
                numbers = np.minimum(np.searchsorted(self.hashes, h[places]), len(self.hashes) - 1)
                same = self.hashes[numbers] == h[places]
                if same.any():
                    yield size, places[same], numbers[same]


@dataclass
class _Bitmap:
    """Bits of shingle hashes. `sizes` are the words of shingles that there are: five at most."""

    bits: int
    packed: np.ndarray
    sizes: tuple[int, ...]

    def places(self, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shingle size, places, hashes) of a text's shingles that the bitmap has, by its words' hashes."""
        for size in self.sizes:
            h = _shingle_hashes(own, size)
            bit = h >> np.uint64(64 - self.bits)
            on = np.nonzero(self.packed[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)[0]
            if len(on):
                yield size, on, h[on]


def _bitmap(shingles: DataFrame) -> _Bitmap:
    """The bitmap of `shingles`(shingle, size). At most 2^(MOST_BITS - 5) words of 32 bits come to the driver, however many shingles there are."""
    known = shingles.agg(F.approx_count_distinct("shingle").alias("n"), F.collect_set("size").alias("sizes")).first()
    bits = min(MOST_BITS, max(14, int(BITS_EACH * known["n"]).bit_length()))
    place = F.shiftrightunsigned("shingle", 64 - bits)
    bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(shingle, {64 - bits}) % 32 AS INT))")
    found = shingles.select(F.shiftright(place, 5).alias("k"), bit.alias("b")).groupBy("k").agg(F.bit_or("b").alias("b")).toArrow()
    packed = np.zeros(1 << bits - 5, np.uint32)
    packed[found["k"].to_numpy()] = found["b"].to_numpy().astype(np.uint32)
    return _Bitmap(bits, packed.view(np.uint8), tuple(sorted(known["sizes"])))


def _windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words, size, shingles) of each item's distinct windows: an item with fewer words is one window, one without words has none."""
    rows = benchmark.select(F.coalesce(column(id_col).cast("string"), F.lit("")).alias("item"), utf8(text_col).alias("text"))
    schema = pa.schema([("item", pa.string()), ("words", pa.string()), ("size", pa.int32()), ("shingles", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                window, size = min(WINDOW_WORDS, len(words)), min(SHINGLE_WORDS, len(words))
                if not words:
                    continue
                hashes = _shingle_hashes(_word_hashes(words), size).view(np.int64)
                for a in range(0, len(words) - window + 1, 4096):  # a very long item in batches
                    starts = range(a, min(a + 4096, len(words) - window + 1))
                    own = {b" ".join(words[s : s + window]).decode(): hashes[s : s + window - size + 1].tolist() for s in starts}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array([size] * len(own), pa.int32()), pa.array(list(own.values()), schema.field("shingles").type)],
                        schema=schema,
                    )

    return rows.mapInArrow(cut, "item string, words string, size int, shingles array<long>").distinct()


def _frequencies(docs: DataFrame, bitmap: _Bitmap) -> DataFrame:
    """(shingle, n): in how many documents each shingle of the bitmap stands. Each task counts before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                if own := [h for _, _, h in bitmap.places(_word_hashes(words_of(text)))]:
                    found.append(np.unique(np.concatenate(own)))
            if found:
                shingles, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(n, pa.int64())], ["shingle", "n"])

    return docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, bitmap: _Bitmap | None) -> DataFrame:
    """(id, text_hash, n_words, found) for each document; found: its shingles that the bitmap has, with the words around them.

    `around` are the words from `first` on that a window with the shingle at `place` could take, with a space between them.
    """
    one = pa.struct([("shingle", pa.int64()), ("place", pa.int64()), ("first", pa.int64()), ("around", pa.string())])
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("found", pa.list_(one))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                own = []
                for size, places, hashes in bitmap.places(_word_hashes(words)) if bitmap else ():
                    reach = WINDOW_WORDS - size
                    for place, h in zip(places.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        first = max(0, place - reach)
                        own.append({"shingle": h, "place": place, "first": first, "around": b" ".join(words[first : place + size + reach]).decode()})
                counts.append(len(words))
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(found, pa.list_(one))], schema=schema)

    return docs.select("id", "text_hash", "text").mapInArrow(
        find, "id long, text_hash long, n_words long, found array<struct<shingle:long,place:long,first:long,around:string>>"
    )


def _file(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """(shingle, offset, words, window, size) of distinct windows under their rarest shingle. One that no document has is necessary too, so such windows occur nowhere."""
    distinct = windows.select("words", "shingles").dropDuplicates(["words"]).select("words", F.xxhash64("words").alias("window"), F.posexplode("shingles").alias("offset", "shingle"))
    counted = distinct.join(frequency, "shingle", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "shingle", "offset")).alias("r")
    found = counted.groupBy("words", "window").agg(rarest).filter("r.n > 0")
    return found.select("r.shingle", "r.offset", "words", "window", F.size(F.split("words", " ")).alias("size"))


def _covered(spans: Column) -> Column:
    """How many words the sorted spans [start, end) cover."""
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")
    )
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step, lambda a: a["n"])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(id column, n_words, n_hit, n_items, items_sha256, contaminated, items, spans) for each document.

    spans: [start, end) word numbers that occurrences of windows take; items: ids of items with such a window, as text in
    order. A document is contaminated if at least a twentieth of its words are hit. The documents are read twice, whatever
    the benchmark's size: to count shingles and to look them up. Documents with one filed shingle, as copies have, are dealt
    to SALTS parts. Hits are collected by id and text, so repeated rows each get their row and share what was found. Null
    texts have no words; a null item id counts as the empty text; repeated ids of items are one item. Without items or
    documents the result is complete all the same. Other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    text = column(text_col).cast("string")
    rows = docs.select(column(id_col).cast("long").alias("id"), F.xxhash64(text, F.lit(5)).alias("text_hash"), utf8(text_col).alias("text"))
    windows = written(_windows(benchmark, item_col, item_text_col), "windows")
    if windows.isEmpty():
        filed, bitmap = None, None
    else:
        shingles = windows.select(F.explode("shingles").alias("shingle"), "size")
        filed = written(_file(windows, _frequencies(rows, _bitmap(shingles))), "filed")
        sized = filed.select("shingle", F.least("size", F.lit(SHINGLE_WORDS)).alias("size"))
        bitmap = None if filed.isEmpty() else _bitmap(sized)
    looked = written(_candidates(rows, bitmap), "looked")
    no_spans, no_items = F.array().cast("array<struct<start:long,end:long>>"), F.array().cast("array<string>")
    out = looked.filter("size(found) = 0").select("id", "text_hash", "n_words", no_spans.alias("spans"), no_items.alias("items"))
    if bitmap is not None:
        salt = F.pmod(F.xxhash64("id", "text_hash"), F.lit(SALTS)).cast("int")
        found = looked.filter("size(found) > 0").select("id", "text_hash", salt.alias("salt"), F.explode("found").alias("f")).select("id", "text_hash", "salt", "f.*")
        salted = filed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # where the window would start and end bounds it; then all of its words must be there
        begin, size, words = F.col("place") - F.col("offset"), F.col("size"), F.split("around", " ")
        inside = (begin >= F.col("first")) & (begin + size <= F.col("first") + F.size(words))
        own = F.array_join(F.slice(words, F.greatest(F.lit(1), begin - F.col("first") + 1).cast("int"), size), " ")
        # sorted and merged at every size: what is filed grows with the benchmark, and with what documents have of it
        hits = found.join(salted.hint("merge"), ["shingle", "salt"]).filter(inside & (own == F.col("words")))
        hits = written(hits.select("id", "text_hash", begin.alias("start"), (begin + size).alias("end"), "words", "window"), "hits")
        spans = hits.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
        of_items = hits.select("id", "text_hash", "words", "window").distinct().join(windows.select("item", "words", F.xxhash64("words").alias("window")), ["window", "words"])
        items = of_items.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
        known = spans.join(items, spans["id"].eqNullSafe(items["id"]) & (spans["text_hash"] == items["text_hash"])).select(spans["id"], spans["text_hash"], "spans", "items")
        known = written(known, "known")
        some = looked.filter("size(found) > 0").select("id", "text_hash", "n_words")
        joined = some.join(known, some["id"].eqNullSafe(known["id"]) & (some["text_hash"] == known["text_hash"]), "left")
        out = out.unionByName(joined.select(some["id"], some["text_hash"], "n_words", F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", no_items).alias("items")))
    out = out.withColumn("n_hit", _covered(F.col("spans")))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"), "items", F.transform("spans", lambda s: F.array(s["start"], s["end"])).alias("spans"),
    )
