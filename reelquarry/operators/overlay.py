"""Edit-list replay: where events overlap, the last in order wins, even if it is silent."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Events that a task replays at once. Timelines are cut to at most 2 ** SLICE_BITS slices.
ROWS, SLICE_BITS = 1 << 16, 8


def _log2(n: Column) -> Column:
    """The place of a positive number's highest bit."""
    return (F.length(F.bin(n)) - 1).cast("int")


def _winners(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """For pieces 0 to n - 1, the last event k that covers first[k] to last[k] - 1; -1 where none does."""
    size = 1 << max(0, n - 1).bit_length()
    tree, k = np.full(2 * size, -1, np.int64), np.arange(len(first))
    a, b = first + size, last + size
    while len(k):
        left, right = (a & 1) == 1, (b & 1) == 1
        np.maximum.at(tree, a[left], k[left])
        np.maximum.at(tree, b[right] - 1, k[right])
        a, b = (a + 1) >> 1, b >> 1
        on = a < b
        a, b, k = a[on], b[on], k[on]
    at = 1
    while at < size:
        np.maximum(tree[2 * at : 4 * at], np.repeat(tree[at : 2 * at], 2), out=tree[2 * at : 4 * at])
        at *= 2
    return tree[size : size + n]


def _groups(rows: pa.RecordBatch, n: int) -> np.ndarray:
    """Numbers of the groups, in rows that are sorted by their first n columns."""
    new = np.zeros(rows.num_rows, bool)
    for column in rows.columns[:n]:
        code = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def _replay(rows: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """Events (n columns of a sorted group, start, end, ordinal, carry...) to the pieces that are heard, in the same columns."""
    ends = pa.concat_arrays(rows.columns[n : n + 2])
    rank = pc.rank(ends, tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    group = _groups(rows, n)
    _, at, place = np.unique(np.concatenate([group, group]) * (rank.max() + 1) + rank, return_index=True, return_inverse=True)
    order = pc.rank(rows.column(n + 2), null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    later = np.argsort(order, kind="stable")
    won = _winners(place[: rows.num_rows][later], place[rows.num_rows :][later], len(at))
    heard, won = won >= 0, later[won]
    same = heard[1:] & heard[:-1] & (order[won[1:]] == order[won[:-1]])
    first, last = np.flatnonzero(heard & ~np.append(False, same)), np.flatnonzero(heard & ~np.append(same, False)) + 1
    out = rows.take(pa.array(won[first])).columns
    out[n : n + 2] = ends.take(pa.array(at[first])), ends.take(pa.array(at[last]))
    return pa.RecordBatch.from_arrays(out, schema=rows.schema)


def _replayed(events: DataFrame, group: list[str]) -> DataFrame:
    """`_replay` over whole tables: one shuffle by group, then a pass that holds ROWS events, or the pieces of one group."""
    n = len(group)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, room = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < room:
                continue
            whole = pa.concat_batches(held)
            number = _groups(whole, n)
            if cut := int(np.searchsorted(number, number[-1])):
                yield _replay(whole.slice(0, cut), n)
            open_group = whole.slice(cut)
            held = [_replay(open_group, n) if open_group.num_rows >= ROWS else open_group]
            rows = held[0].num_rows
            room = max(ROWS, 2 * rows)
        if rows:
            yield _replay(pa.concat_batches(held), n)

    return events.repartition(*group).sortWithinPartitions(*group).mapInArrow(sweep, events.schema)


def _sliced(live: DataFrame, crowded: DataFrame, keys: list[str], ordinal: str, carry: list[str], most: int) -> DataFrame:
    """The pieces of crowded keys: their timelines are cut at quantiles of all starts and ends, so that slices are dealt over all tasks.

    What begins or ends inside a slice goes to it cut to size. What covers whole slices is the candidate of the two blocks of
    2 ** level slices that make up its span, overlapping or not; of it, only the last over each slice goes there. Pieces that
    touch a cut are then merged with those across it.
    """
    live, got = live.join(F.broadcast(crowded), keys), ["seg_start", "seg_end", ordinal, *carry]
    step = F.pow(F.lit(2), F.greatest(F.lit(0), SLICE_BITS - F.ceil(F.log2(2 * F.max("__n") / most)))).cast("int")
    quantiles = F.percentile_approx("point", [k / 2**SLICE_BITS for k in range(1, 2**SLICE_BITS)])
    cuts = live.select(*keys, "__n", F.explode(F.array("seg_start", "seg_end")).alias("point")).groupBy(*keys).agg(quantiles.alias("q"), step.alias("step"))
    cuts = cuts.select(*keys, F.array_distinct(F.filter("q", lambda _, k: (k + 1) % F.col("step") == 0)).alias("__cuts"))

    def slice_of(point: Column) -> Column:
        steps = F.array(*[F.lit(2**k) for k in reversed(range(SLICE_BITS))])
        return F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.get("__cuts", at + k - 1) <= point, at + k).otherwise(at))

    cut = live.drop("__n").join(F.broadcast(cuts), keys).withColumns({"__a": slice_of(F.col("seg_start")), "__b": slice_of(F.col("seg_end"))})
    whole = F.coalesce(F.get("__cuts", F.col("__a") - 1) == F.col("seg_start"), F.lit(False))
    cut = cut.withColumn("__first", F.when(whole, F.col("__a")).otherwise(F.col("__a") + 1))
    from_last = F.get("__cuts", F.col("__b") - 1)
    ends = F.array(
        F.when(F.col("__first") > F.col("__a"), F.struct(F.col("__a").alias("s"), F.col("seg_start").alias("x"), F.least("seg_end", F.get("__cuts", "__a")).alias("y"))),
        F.when((F.col("__first") <= F.col("__b")) & (F.col("seg_end") > from_last), F.struct(F.col("__b").alias("s"), from_last.alias("x"), F.col("seg_end").alias("y"))),
    )
    parts = cut.select(*keys, ordinal, *carry, F.explode(ends).alias("e")).filter("e IS NOT NULL")
    parts = parts.select(*keys, F.col("e.s").alias("__slice"), F.col("e.x").alias("seg_start"), F.col("e.y").alias("seg_end"), ordinal, *carry)
    level = _log2(F.col("__b") - F.col("__first"))
    blocks = F.array(*[F.struct(level.alias("level"), x.cast("long").alias("from")) for x in (F.col("__first"), F.col("__b") - F.pow(F.lit(2), level))])
    blocks = cut.filter("__first < __b").select(*keys, F.struct(ordinal, *carry).alias("w"), F.explode(blocks).alias("at"))
    blocks = blocks.groupBy(*keys, "at.level", "at.from").agg(F.max_by("w", f"w.{ordinal}").alias("w"))
    until = F.col("from") + F.pow(F.lit(2), F.col("level")).cast("long") - 1
    covered = blocks.select(*keys, "w", F.explode(F.sequence(F.col("from"), until)).alias("s")).groupBy(*keys, F.col("s").cast("int").alias("__slice")).agg(F.max_by("w", f"w.{ordinal}").alias("w"))
    covered = covered.join(F.broadcast(cuts), keys).withColumns({"seg_start": F.get("__cuts", F.col("__slice") - 1), "seg_end": F.get("__cuts", "__slice")})
    covered = covered.select(*keys, "__slice", "seg_start", "seg_end", *[F.col(f"w.{c}").alias(c) for c in (ordinal, *carry)])
    pieces = _replayed(parts.unionByName(covered), [*keys, "__slice"]).join(F.broadcast(cuts), keys)
    inside = F.coalesce(F.col("seg_start") > F.get("__cuts", F.col("__slice") - 1), F.lit(True)) & F.coalesce(F.col("seg_end") < F.get("__cuts", "__slice"), F.lit(True))
    pieces = pieces.withColumn("__where", F.when(inside, F.col("__slice")).otherwise(-1)).select(*keys, "__where", *got)
    before = Window.partitionBy(*keys, "__where").orderBy("seg_start")
    fresh = F.lag("seg_end").over(before).eqNullSafe(F.col("seg_start")) & F.lag(ordinal).over(before).eqNullSafe(F.col(ordinal))
    marked = pieces.withColumn("__run", F.sum(F.when(fresh, 0).otherwise(1)).over(before))
    return marked.groupBy(*keys, "__where", "__run").agg(
        F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end"), F.first(F.struct(ordinal, *carry)).alias("w")
    ).select(*keys, "seg_start", "seg_end", *[F.col(f"w.{c}").alias(c) for c in (ordinal, *carry)])


def later_wins(events: DataFrame, keys: list[str], ordinal: str, start: str, end: str, carry: list[str], most: int = ROWS) -> DataFrame:
    """(keys, seg_start, seg_end, ordinal, carry...) of the event with the highest ordinal over each piece of a timeline.

    Events with end <= start or a null key take no part. The timeline of a key is cut to pieces at all starts and ends. Over
    the pieces of a batch of whole keys stands a tree of dyadic nodes in arrays: an event is the winner's candidate of the few
    nodes that make up its span, and a piece takes the last of those above it. So the work is n log n for n events however they
    overlap, each event is shuffled once, and a task holds a batch. Neighbouring pieces of one winner are merged. Where no
    event is, there is no row.

    The events of each key are counted at once. Keys of more than `most` are cut to slices, which are dealt over all tasks.
    """
    point = F.array(start, end)
    live = events.filter(F.col(end) > F.col(start)).filter(reduce(and_, [F.col(k).isNotNull() for k in keys])).select(
        *keys, point[0].alias("seg_start"), point[1].alias("seg_end"), ordinal, *[F.when(F.col(ordinal).isNotNull(), F.col(c)).alias(c) for c in carry]
    )
    crowded = live.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    if crowded.isEmpty():
        return _replayed(live, keys)
    others = _replayed(live.join(F.broadcast(crowded.select(*keys)), keys, "left_anti"), keys)
    return others.unionByName(_sliced(live, crowded, keys, ordinal, carry, most))


def place_takes(segments: DataFrame, origin: str, start: str, trimmed: str, length: str) -> DataFrame:
    """Where each piece reads its take, after the copy's limits: adds dst_from, dst_to, src_from in samples of a mono timeline.

    A frame is 16 samples. What lies before the origin, or after the take's end, stays silent.
    """
    first = F.greatest(F.col("seg_start"), F.col(origin))
    skip = (first - F.col(start) + F.col(trimmed)) * 16
    room = F.greatest(F.lit(0), F.col(length) - skip)
    count = F.least((F.col("seg_end") - first) * 16, room)
    return (
        segments.withColumn("dst_from", (first - F.col(origin)) * 16)
        .withColumn("src_from", skip)
        .withColumn("dst_to", F.col("dst_from") + count)
        .filter((F.col("seg_end") > first) & (count > 0))
    )
