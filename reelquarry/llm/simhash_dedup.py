"""Near-duplicates by SimHash, with Golay-code fuzzy hashing for the candidates.

A fingerprint's 64 bits are cut into segments of 23, 23 and 18 bits (the last padded with zeros). If two fingerprints
differ in at most three bits, at most one segment holds two or more of them, so two segments hold at most one each. Every
segment is decoded to indices of nearby Golay codewords that two words within one bit always share (see golay.py), and
each pair of segments with each pair of their indices is one key: about 30 keys of 24 bits and a pair's number for each
fingerprint. So every link meets under a key; candidates are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, may_hold, prepare, utf8, written
from .components import connected_components
from .golay import fuzzy_indices

#: Words of a shingle, and bits in which linked fingerprints may differ. The keys guarantee no more than three bits.
SHINGLE_WORDS, MOST_BITS = 3, 3
#: From this many fingerprints, a bucket is cut once more by equal quarters before it is searched.
LARGE_BUCKET = 4096
_CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """SimHash of a text: words `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased, 3-word shingles with repeats.

    Fewer words make one shingle; no word, or null, gives zero. XXH64 with seed 42; a bit is 1 if set in over half.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    count = max(1, len(words) - SHINGLE_WORDS + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, count, _CHUNK):
        part = words[at : min(at + _CHUNK, count) + SHINGLE_WORDS - 1]
        if len(part) < SHINGLE_WORDS:
            hashes = [digest(b" ".join(part), 42)]
        else:
            hashes = [digest(b"%b %b %b" % s, 42) for s in zip(part, part[1:], part[2:], strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], ["id", "fp", "text_hash"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp: the fingerprint as a signed long, text_hash) for each row."""
    prepare(docs.sparkSession)
    rows = docs.select(column(id_col).cast("long").alias("id"), utf8(text_col).alias("text"), text_hash(text_col).alias("text_hash"))
    return rows.mapInArrow(_fingerprints, "id long, fp long, text_hash long")


def text_hash(text_col: str) -> Column:
    """A hash of the text, another one for null than for the empty text."""
    return F.xxhash64(column(text_col).cast("string"), F.lit(5))


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of uint64 fingerprints: (positions, keys)."""
    low = np.uint64((1 << 23) - 1)
    segments = [prints & low, prints >> np.uint64(23) & low, prints >> np.uint64(46)]
    indices = [fuzzy_indices(s.astype(np.uint32)) for s in segments]
    where, keys = [], []
    for number, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (x, use_x), (y, use_y) = indices[i], indices[j]
        both = use_x[:, :, None] & use_y[:, None, :]
        key = x[:, :, None].astype(np.int32) << 12 | y[:, None, :].astype(np.int32) | number << 24
        where.append(np.nonzero(both)[0])
        keys.append(key[both])
    return np.concatenate(where), np.concatenate(keys)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        where, keys = golay_keys(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[where])], ["key", "fp"])


def _forest(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.uint64]]:
    """(members, root) of the groups of distinct fingerprints that links connect: each is compared with those not yet reached."""
    rest = values
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            hit = np.bitwise_count(rest ^ frontier.pop()) <= MOST_BITS
            if hit.any():
                found = rest[hit]
                rest = rest[~hit]
                frontier.extend(found)
                yield found, root


def bucket_links(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.uint64]]:
    """Links that connect just what the fingerprints of a bucket's links connect, at most one for each fingerprint and quarter.

    A large bucket is cut by each of the four 16-bit quarters in turn: of two linked fingerprints one quarter is equal.
    """
    if len(values) < LARGE_BUCKET:
        yield from _forest(values)
        return
    for quarter in range(4):
        part = values >> np.uint64(16 * quarter) & np.uint64(0xFFFF)
        order = np.argsort(part, kind="stable")
        for run in np.split(values[order], np.nonzero(np.diff(part[order]))[0] + 1):
            yield from _forest(run)


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key: pairs are compared at once, larger buckets are searched one by one."""
    held: list[np.ndarray] = []
    last: int | None = None
    out_a: list[np.ndarray] = []
    out_b: list[np.ndarray] = []

    def put(a: np.ndarray, b: np.ndarray) -> None:
        out_a.append(a)
        out_b.append(b)

    def search(values: np.ndarray) -> None:
        for found, root in bucket_links(values):
            put(found, np.full(len(found), root))

    def flush() -> Iterator[pa.RecordBatch]:
        if out_a:
            a, b = (np.concatenate(x).view(np.int64) for x in (out_a, out_b))
            out_a.clear(), out_b.clear()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(keys):
            continue
        starts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]])
        first, final = 0, len(starts) - 2
        if last is not None and keys[0] == last:
            held.append(prints[: starts[1]])
            first = 1
        if first <= final:  # the held bucket is whole
            if held:
                search(np.concatenate(held))
            middle = np.arange(first, final)
            sizes = starts[middle + 1] - starts[middle]
            two = starts[middle[sizes == 2]]
            linked = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= MOST_BITS]
            if len(linked):
                put(prints[linked + 1], prints[linked])
            for k in middle[sizes > 2]:
                search(prints[starts[k] : starts[k + 1]])
            held, last = [prints[starts[final] :]], keys[-1]
        yield from flush()
    if held:
        search(np.concatenate(held))
    yield from flush()


def link_edges(distinct: DataFrame) -> DataFrame:
    """(a, b) fingerprints whose components are those of all links among `distinct`(fp), with no repeated fp."""
    keys = distinct.mapInArrow(_key_rows, "key int, fp long")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_edges, "a long, b long").distinct()


def _rooted(prints: DataFrame) -> DataFrame:
    """(fp, least: the smallest id that has it, root: a fingerprint that stands for its component)."""
    least = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(link_edges(least.select("fp"))).withColumnRenamed("node", "fp")
    return written(least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id column, fingerprint: 16 lowercase hex digits, component_id: the smallest id reachable over links) for each row.

    Copies share a fingerprint and are one node, so groups of copies cost nothing after the first aggregation. Null and
    wordless texts have fingerprint zero and are linked like any other. Null ids get a row; they are never a
    component_id unless the whole component has no other. Repeated rows and ids are kept as they come; other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = _rooted(prints)
    reached = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(rooted.join(reached, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(prints: DataFrame) -> DataFrame:
    """(id, text_hash) of one row of each component of fingerprints(): that with the smallest id, then the smallest hash; null ids come last."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    first = prints.groupBy("fp").agg(F.min(order).alias("row"))
    chosen = first.join(_rooted(prints).select("fp", "root"), "fp").groupBy("root").agg(F.min("row").alias("row"))
    return written(chosen.select("row.id", "row.text_hash"), "representatives")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, one of each component: that of representatives(), and of repeated rows any one. All columns stay.

    Rows whose id and text are neither repeated nor dropped stay where they are, so only the others' texts are shuffled.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    first = representatives(prints).select("id", "text_hash", F.lit(True).alias("chosen"))
    keys = prints.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    judged = keys.join(first, keys["id"].eqNullSafe(first["id"]) & (keys["text_hash"] == first["text_hash"]), "left")
    judged = judged.select(keys["id"].alias("__id"), keys["text_hash"].alias("__text"), F.coalesce("chosen", F.lit(False)).alias("__chosen"), "n")
    special = written(judged.filter("NOT __chosen OR n > 1").drop("n"), "special")
    test = may_hold(special.select(F.xxhash64("__id", "__text").alias("key")))
    rows = docs.withColumns({"__own": column(id_col).cast("long"), "__hash": text_hash(text_col)})
    met = test(F.xxhash64("__own", "__hash"))
    joined = rows.filter(met).join(special, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text")), "left")
    others = joined.filter("__chosen IS NULL")
    once = joined.filter("__chosen").dropDuplicates(["__own", "__hash"])
    out = rows.filter(~met)
    for more in (others, once):
        out = out.union(more.select(*[column(c) for c in out.columns]))
    return out.drop("__own", "__hash")
