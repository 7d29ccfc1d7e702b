"""Queries over a recorder's media: catalog, detail, timelines, takes, tracks, deviations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import grouping, lookup, ordering, overlay
from ..sources.archive import corrupt_frames, open_archive
from ..sources.disk import open_disk
from ..sources import codec
from ..sources.layouts import LAYOUTS, PARSERS, SAMPLE_BYTES
from ..sources.listing import Deviation, Listing, read_content

#: Bytes of a take that a task decodes at once: whole samples of either size.
CHUNK = 0x8000 * 3
_EVENTS = "song_seq long, group_seq int, track int, vtrack int, name string, ordinal int, start long, end long, trimmed long, file_id int, cluster_count int, stamp timestamp_ntz"
_PARSED = f"{_EVENTS}, severity int, message string"
_EVENT_FIELDS = ["group_seq", "track", "vtrack", "name", "ordinal", "start", "end", "trimmed", "file_id", "cluster_count", "stamp"]
GROUP = ["song_seq", "group_seq", "track", "vtrack", "name"]


def open_media(spark: SparkSession, paths: list[str], kind: str = "") -> Media:
    """A disk image, an archive's dump, or dumps of a set (several paths, or a folder). kind: empty, hdd, cd, vr9 or vr5."""
    kind = kind.strip().lower()
    if kind not in ("", "hdd", "cd", "vr9", "vr5"):
        raise ValueError(f"unknown kind of source: {kind}")
    found = open_disk(paths[0]) if len(paths) == 1 and kind in ("", "hdd") and not _is_folder(paths[0]) else None
    if found is None and kind == "hdd":
        raise ValueError("not a recorder's disk")
    if found is None:
        found = open_archive(spark, paths, kind.upper() if kind in ("vr9", "vr5") else None)
    return Media(spark, found)


def _is_folder(path: str) -> bool:
    from ..sources.bytes import list_files

    return list_files(path) != [path]


@dataclass
class Media:
    """An opened source. Its tables are lazy; the listing behind them is directory data."""

    spark: SparkSession
    listing: Listing

    @cached_property
    def songs(self) -> DataFrame:
        songs = self.listing.song_table(self.spark)
        rate, known = lookup.coded(F.col("rate_byte").bitwiseAND(15), fn.RATES, fn.DEFAULT_RATE)
        origin = F.when(F.col("machine") == "VR9", LAYOUTS["VR9"].origin).otherwise(LAYOUTS["VR5"].origin).cast("long")
        key = fn.song_key(F.col("partition"), F.col("ordinal"))
        return songs.select("*", key.alias("key"), rate.alias("rate"), F.coalesce(known, F.lit(True)).alias("rate_known"), origin.alias("origin"))

    @cached_property
    def files(self) -> DataFrame:
        return self.listing.file_table(self.spark)

    @cached_property
    def _parsed(self) -> DataFrame:
        """Event lists are read and parsed where their rows are, a song's in one task."""
        machines = {s["song_seq"]: s["machine"] for s in self.listing.songs}
        lists = self.listing.file_table(self.spark, self.listing.event_lists)
        schema = pa.schema(
            [("song_seq", pa.int64()), ("group_seq", pa.int32()), ("track", pa.int32()), ("vtrack", pa.int32()), ("name", pa.string()), ("ordinal", pa.int32()),
             ("start", pa.int64()), ("end", pa.int64()), ("trimmed", pa.int64()), ("file_id", pa.int32()), ("cluster_count", pa.int32()), ("stamp", pa.timestamp("us")),
             ("severity", pa.int32()), ("message", pa.string())]
        )

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    events, found = PARSERS[machines[row["song_seq"]]](read_content(row["extents"], 0, row["size"], row["swapped"]))
                    rows = [{"song_seq": row["song_seq"], **e} for e in events]
                    rows += [{"song_seq": row["song_seq"], "ordinal": k, "severity": s, "message": m} for k, (s, m) in enumerate(found)]
                    yield pa.RecordBatch.from_pylist(rows, schema)

        return lists.repartition(max(1, min(len(self.listing.event_lists), 64)), "song_seq").mapInArrow(parse, _PARSED)

    @cached_property
    def events(self) -> DataFrame:
        return self._parsed.filter("message IS NULL").select("song_seq", *_EVENT_FIELDS)

    def select(self, keys: list[tuple[int, int]]) -> Media:
        """The songs of these (partition, ordinal) keys; all without a key. Keys that no song has become deviations."""
        if not keys:
            return self
        own = {(s["partition"], s["ordinal"]): s["song_seq"] for s in self.listing.songs}
        chosen = {own[k] for k in keys if k in own}
        rest = [d for d in self.listing.deviations if d.song_seq < 0 or d.song_seq in chosen]
        for p, o in dict.fromkeys(k for k in keys if k not in own):
            rest.append(Deviation("song selection", "", 1, f"requested song {o if p == 0 else f'{p}.{o}'} not found", -1, 9))
        pick = lambda rows: [r for r in rows if r["song_seq"] in chosen]
        return Media(self.spark, Listing(pick(self.listing.songs), pick(self.listing.files), pick(self.listing.event_lists), rest, self.listing.raw_paths))

    # catalog and detail

    @cached_property
    def track_stats(self) -> DataFrame:
        events = self.events.join(F.broadcast(self.songs.select("song_seq", "origin")), "song_seq")
        return grouping.track_stats(events, GROUP, F.col("file_id") != 0, "end", F.col("origin"))

    def catalog(self) -> DataFrame:
        """(song_key, number, machine, n_tracks, seconds, length, created, saved, modified, name) for each song."""
        summary = grouping.song_summary(self.track_stats, ["song_seq"])
        latest = self.events.groupBy("song_seq").agg(F.max("stamp").alias("modified"))
        joined = self.songs.join(summary, "song_seq", "left").join(latest, "song_seq", "left")
        whole = fn.seconds(F.coalesce("frames", F.lit(0)), F.col("rate"))
        return joined.select(
            F.col("key").alias("song_key"), "number", "machine", F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"), whole.alias("seconds"), fn.mmss(whole).alias("length"),
            fn.stamp_text(F.col("created")).alias("created"), fn.stamp_text(F.col("saved")).alias("saved"), fn.stamp_text(F.col("modified")).alias("modified"), "name",
        )

    def detail(self) -> DataFrame:
        """(song_key, track, vtrack, n_events, seconds, first_stamp, last_stamp, name) for each v-track with audio."""
        span = grouping.stamp_span(self.events, ["song_seq", "group_seq"], "stamp")
        rows = self.track_stats.filter("has_audio").join(span, ["song_seq", "group_seq"]).join(self.songs.select("song_seq", "key", "rate"), "song_seq")
        whole = fn.seconds(F.col("end_frames"), F.col("rate"))
        return rows.select(F.col("key").alias("song_key"), "track", "vtrack", "n_events", whole.alias("seconds"), fn.stamp_text(F.col("first_stamp")).alias("first_stamp"), fn.stamp_text(F.col("last_stamp")).alias("last_stamp"), "name")

    # extraction

    @cached_property
    def takes(self) -> DataFrame:
        """Referenced takes: the last file of an id wins. n_samples is null where the format cannot be decoded."""
        ids = grouping.distinct_references(self.events, ["song_seq"], "file_id", "ordinal", "cluster_count")
        takes = self.files.filter(F.col("name").startswith("TAKE")).groupBy("song_seq", "file_id").agg(F.max_by(F.struct("size", "claimed", "swapped", "clusters", "extents"), "seq").alias("f"))
        joined = ids.join(takes, ["song_seq", "file_id"], "left").join(F.broadcast(self.songs.select("song_seq", "format", "number", "cluster_size")), "song_seq")
        size, page = F.col("f.size"), F.floor(F.col("cluster_size") / 12)
        rest = F.least(page, F.floor(size % F.col("cluster_size") / 12))
        whole = (
            F.when((F.col("format") == 3) & (size % 2 == 0), size / 2)
            .when((F.col("format") == 8) & (size % 3 == 0), size / 3)
            .when((F.col("format") == 5) & (size % 16 == 0), size)
            .when(F.col("format") == 0, F.floor(size / 16) * 16)
            .when(F.col("format") == 1, (F.floor(size / F.col("cluster_size")) * page + rest) * 16)
        )
        return joined.select("song_seq", "file_id", "most", "format", "number", "cluster_size", "f.*", F.col("f").isNotNull().alias("found"), whole.cast("long").alias("n_samples"))

    @cached_property
    def _placed(self) -> DataFrame:
        takes = self.takes.select("song_seq", "file_id", F.coalesce("n_samples", F.lit(0).cast("long")).alias("n_samples"), "found", F.col("n_samples").isNotNull().alias("decoded"))
        events = self.events.join(takes, ["song_seq", "file_id"], "left").fillna(0, ["n_samples"]).fillna(False, ["found", "decoded"])
        audible = self.track_stats.filter("has_audio").select("song_seq", "group_seq")
        return events.join(audible, ["song_seq", "group_seq"]).join(F.broadcast(self.songs.select("song_seq", "origin", "number")), "song_seq")

    def segments(self) -> DataFrame:
        """Pieces of each track's timeline with the event that is heard there, also where it is silent."""
        return overlay.later_wins(self._placed, GROUP, "ordinal", "start", "end", ["file_id", "trimmed", "n_samples", "origin"])

    def pieces(self) -> DataFrame:
        """Which samples of which take go where: (track columns, file_id, dst_from, dst_to, src_from)."""
        starts = self._placed.select(*GROUP[:2], "ordinal", F.col("start").alias("ev_start"))
        rows = self.segments().join(starts, ["song_seq", "group_seq", "ordinal"])
        placed = overlay.place_takes(rows.filter("file_id <> 0"), "origin", "ev_start", "trimmed", "n_samples")
        return placed.select(*GROUP, "ordinal", "file_id", "dst_from", "dst_to", "src_from")

    def _chunked(self, rows: DataFrame, carry: list[str]) -> DataFrame:
        """Parts of takes, `rows`(song_seq, file_id, src_from, src_to, carry...), cut to what a task decodes at once: a and b are its samples."""
        takes = self.takes.filter("n_samples IS NOT NULL").select("song_seq", "file_id", "format", "cluster_size", "swapped", "extents")
        per = F.when(F.col("format") == 3, CHUNK // 2).when(F.col("format") == 8, CHUNK // 3).when(F.col("format") == 1, F.floor(F.col("cluster_size") / 12) * 16).otherwise(CHUNK).cast("long")
        rows = rows.join(takes, ["song_seq", "file_id"])
        rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("src_from") / per), F.floor((F.col("src_to") - 1) / per))))
        a, b = F.greatest(F.col("src_from"), F.col("chunk") * per), F.least(F.col("src_to"), (F.col("chunk") + 1) * per)
        return rows.select("song_seq", *carry, F.col("src_from"), a.alias("a"), b.alias("b"), "format", "cluster_size", "swapped", "extents")

    def samples(self) -> DataFrame:
        """(track columns, dst_from, pcm: little-endian 32-bit samples) in pieces of bounded size, each decoded from its take."""
        pieces = self.pieces().withColumn("src_to", F.col("src_from") + F.col("dst_to") - F.col("dst_from"))
        rows = self._chunked(pieces, [*GROUP[1:], "dst_from"])
        schema = pa.schema([("song_seq", pa.int64()), ("group_seq", pa.int32()), ("track", pa.int32()), ("vtrack", pa.int32()), ("name", pa.string()), ("dst_from", pa.int64()), ("pcm", pa.binary())])

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    pcm, _ = take_samples(row["extents"], row["swapped"], row["format"], row["cluster_size"], row["a"], row["b"])
                    at = row["dst_from"] + row["a"] - row["src_from"]
                    yield pa.RecordBatch.from_pylist([{k: row[k] for k in GROUP} | {"dst_from": at, "pcm": pcm.tobytes()}], schema)

        return rows.mapInArrow(decode, "song_seq long, group_seq int, track int, vtrack int, name string, dst_from long, pcm binary")

    def unknown_blocks(self) -> DataFrame:
        """(song_seq, group_seq, ordinal, n) of unknown blocks that an event copies, whether or not a later one covers them."""
        live = self._copied().filter("copied > 0")
        rows = self._chunked(live.select("song_seq", "file_id", "group_seq", "ordinal", "src_from", (F.col("src_from") + F.col("copied")).alias("src_to")), ["group_seq", "ordinal"])
        schema = pa.schema([("song_seq", pa.int64()), ("group_seq", pa.int32()), ("ordinal", pa.int32()), ("n", pa.int64())])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for row in batch.to_pylist():
                    _, unknown = take_samples(row["extents"], row["swapped"], row["format"], row["cluster_size"], row["a"], row["b"])
                    found.append({k: row[k] for k in ("song_seq", "group_seq", "ordinal")} | {"n": int((unknown * 16 >= row["a"]).sum())})
                yield pa.RecordBatch.from_pylist(found, schema)

        counted = rows.filter(F.col("format").isin(0, 1)).mapInArrow(count, "song_seq long, group_seq int, ordinal int, n long")
        return counted.groupBy("song_seq", "group_seq", "ordinal").agg(F.sum("n").alias("n")).filter("n > 0")

    def _copied(self) -> DataFrame:
        """Audible events with a decoded take: where their copy starts in it, and how many samples it has."""
        live = self._placed.filter("end > start AND file_id <> 0 AND decoded")
        first = F.greatest(F.col("start"), F.col("origin"))
        skip = (first - F.col("start") + F.col("trimmed")) * 16
        room = F.greatest(F.lit(0), F.col("n_samples") - skip)
        return live.withColumn("src_from", skip).withColumn("copied", F.greatest(F.lit(0), F.least((F.col("end") - first) * 16, room))).withColumn("span", (F.col("end") - F.col("start")) * 16)

    def tracks(self, stereo: bool = False) -> DataFrame:
        """(song_key, track columns, rate, bits, n_samples, pair_track, pair_group, file): each v-track with audio and the path of its file.

        With stereo, a pair is one row: that of its left track, with the right one's track and group.
        """
        songs = self.songs.select("song_seq", "key", "partition", "ordinal", "number", F.col("name").alias("song_name"), "rate", "format")
        rows = self.track_stats.filter("has_audio")
        pairs = self.pairs() if stereo else self.spark.createDataFrame([], "song_seq long, left int, right int")
        groups = rows.select("song_seq", F.col("track").alias("pair_track"), F.col("group_seq").alias("pair_group"))
        right = pairs.select("song_seq", F.col("left").alias("track"), F.col("right").alias("pair_track")).join(groups, ["song_seq", "pair_track"])
        rows = rows.join(pairs.select("song_seq", F.col("right").alias("track")), ["song_seq", "track"], "left_anti").join(right, ["song_seq", "track"], "left").join(songs, "song_seq")
        folder = F.concat(fn.folder_name(F.col("partition"), F.col("ordinal")), F.lit(" - "), fn.file_name(F.col("song_name")))
        label = F.concat(F.lit("T"), "track", F.when(F.col("pair_track").isNotNull(), F.concat(F.lit("+"), "pair_track")).otherwise(""), F.lit("-V"), "vtrack")
        own = fn.file_name(F.col("name"))
        file = F.concat(folder, F.lit("/"), label, F.when(own != "", F.concat(F.lit(" "), own)).otherwise(""), F.lit(".wav"))
        return rows.select(
            F.col("key").alias("song_key"), *GROUP, "number", "rate", fn.bit_depth(F.col("format")).alias("bits"), (F.col("end_frames") * fn.FRAME_SAMPLES).alias("n_samples"),
            "pair_track", "pair_group", file.alias("file"),
        )

    def pairs(self) -> DataFrame:
        """(song_seq, left, right) of neighbouring tracks that make a stereo pair: one v-track with audio each, and equal events."""
        events = self._placed.groupBy("song_seq", "track", "group_seq").agg(F.array_sort(F.collect_list(F.struct("ordinal", "start", "end"))).alias("e"))
        geometry = F.transform("e", lambda x: F.struct(x["start"].alias("s"), x["end"].alias("t"))).cast("string")
        single = events.withColumn("geometry", geometry).groupBy("song_seq", "track").agg(F.count(F.lit(1)).alias("n"), F.first("geometry").alias("geometry")).filter("n = 1")
        return ordering.adjacent_pairs(single, ["song_seq"], "track", "geometry")

    # deviations

    def _disc_name(self) -> Column:
        """`disc`, or of a set the name of the disc's file."""
        return F.lit("disc") if len(self.listing.raw_paths) < 2 else F.element_at(F.split("path", "/"), -1)

    def deviations(self, scan: bool = False) -> DataFrame:
        """(stage, song_seq, sub_seq, location, reference, severity, message) of all checks; with scan, of damaged frames too."""
        song = F.concat(F.lit("song "), "number")
        place = F.concat(song, F.lit(" T"), "track", F.lit("/V"), "vtrack")
        found = [self.listing.deviation_table(self.spark)]

        def add(rows: DataFrame, stage: int, sub: object, location: object, reference: object, severity: int | object, message: object) -> None:
            level = F.lit(severity) if isinstance(severity, int) else severity
            found.append(rows.select(F.lit(stage).alias("stage"), F.col("song_seq"), F.col(sub).cast("long").alias("sub_seq") if isinstance(sub, str) else F.lit(sub).cast("long").alias("sub_seq"), location.alias("location"), (F.lit(reference) if isinstance(reference, str) else reference).alias("reference"), level.cast("int").alias("severity"), message.alias("message")))

        songs = self.songs
        add(songs.filter("NOT rate_known"), 3, 0, song, "§3", 1, F.format_string("unknown sample-rate byte 0x%02x; assuming 44.1 kHz", "rate_byte"))
        parsed = self._parsed.filter("message IS NOT NULL").join(songs.select("song_seq", "number", "list_reference"), "song_seq")
        add(parsed, 2, "ordinal", F.lit("event list"), F.col("list_reference"), F.col("severity"), F.col("message"))
        takes = self.takes
        add(takes.filter("found AND size < claimed AND NOT swapped"), 4, "file_id", song, "§5.6", 2, F.format_string("take 0x%04x runs past the end of the disc's data", "file_id"))
        add(takes.filter("found AND swapped AND most > 0 AND clusters < most"), 4, "file_id", song, "§8.3", 1, F.format_string("take TAKE%04X FAT chain yields %d cluster(s) but the event claims %d; take is truncated/corrupt", "file_id", "clusters", "most"))
        add(takes.filter("found AND n_samples IS NULL"), 4, "file_id", song, "§2", 2, F.format_string("decoding take 0x%04x: format %d or length unsupported", "file_id", "format"))
        placed = self._placed
        add(placed.filter("end <= start"), 5, "ordinal", place, "§8", 1, F.format_string("degenerate event %d: end %d <= start %d; skipped", "ordinal", "end", "start"))
        live = placed.filter("end > start AND file_id <> 0")
        add(live.filter("NOT decoded"), 5, "ordinal", place, "§10", 2, F.format_string("event references take 0x%04x, which is missing", "file_id"))
        short = self._copied().filter("copied < span")
        add(short, 5, "ordinal", place, "§10", 1, F.format_string("take 0x%04x is shorter than its event: %d of %d samples", "file_id", "copied", "span"))
        if scan and any(x["format"] in (0, 1) for x in self.listing.songs):
            heard = self._copied().join(self.unknown_blocks(), ["song_seq", "group_seq", "ordinal"])
            add(heard, 5, "ordinal", place, "§2", 1, F.format_string("take 0x%04x: %d block(s) of unknown pattern are silent", "file_id", "n"))
        if scan and self.listing.raw_paths:
            runs = grouping.runs(corrupt_frames(self.spark, self.listing.raw_paths), "frame", ["path", "unreadable"]).withColumn("song_seq", F.lit(-1).cast("long"))
            what = F.when(F.col("unreadable"), "unreadable").otherwise("corrupt")
            add(runs, 0, "low", self._disc_name(), "§10", 2, F.format_string("%s frames %d-%d (%d)", what, F.col("low"), F.col("high"), F.col("n")))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def take_samples(extents: list, swapped: bool, code: int, cluster: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(samples a to b of a take, numbers of the unknown blocks among them). With pages, a and b are in one page."""
    if width := SAMPLE_BYTES.get(code):
        return decode_pcm(read_content(extents, a * width, (b - a) * width, swapped), width), np.zeros(0, np.int64)
    size, first, last = codec.BLOCK_BYTES[code], a // codec.SAMPLES, -(-b // codec.SAMPLES)
    page = cluster // size
    at = lambda k: k * size if code != 1 else k // page * cluster + k % page * size
    before = read_content(extents, at(first - 1), size, swapped) if first else b""
    samples, unknown = codec.decode(read_content(extents, at(first), (last - first) * size, swapped), code, before)
    return samples[a - first * codec.SAMPLES : b - first * codec.SAMPLES], unknown + first


def decode_pcm(raw: bytes, width: int) -> np.ndarray:
    """Little-endian samples of two or three bytes as 32-bit numbers."""
    if width == 2:
        return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype("<i4")
    b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
    return ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype("<i4")
