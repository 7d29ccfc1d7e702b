"""Runs over media: extraction that does what it can or all or nothing, and listings as text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..sources.wav import write_tracks
from .media import Media

#: What a run ends with.
CLEAN, DEVIATIONS, USAGE, FATAL = 0, 1, 2, 3


@dataclass
class Run:
    status: int
    manifest: list[str] = field(default_factory=list)
    n_songs: int = 0
    lines: list[str] = field(default_factory=list)


def in_order(found: DataFrame) -> DataFrame:
    """Deviations in their order: by stage of the run and song, then by place, with their lines."""
    line = fn.deviation_text(F.col("severity"), F.col("reference"), F.col("location"), F.col("message"))
    return found.withColumn("line", line).orderBy("stage", "song_seq", "sub_seq", "line")


def extract(media: Media, folder: str, stereo: bool = False, strict: bool = False, scan: bool = True) -> Run:
    """Write all tracks below a folder. strict: with any deviation write nothing, and report the first alone.

    The manifest has a path a file; songs are counted by their stored number.
    """
    found = in_order(media.deviations(scan))
    if strict and (first := found.select("line").limit(1).collect()):
        return Run(DEVIATIONS, lines=[first[0]["line"]])
    tracks = media.tracks(stereo)
    done = write_tracks(tracks, media.samples(), folder)
    numbers = tracks.agg(F.countDistinct("number").alias("n")).first()["n"]
    manifest = sorted(f"{folder.rstrip('/')}/{r['file']}" for r in done.select("file").collect())
    lines = [r["line"] for r in found.select("line").collect()]
    return Run(DEVIATIONS if lines else CLEAN, manifest, numbers, lines)


def catalog_lines(media: Media) -> Iterator[str]:
    """The catalog as lines of nine fields, in the order of the source."""
    rows = media.catalog().join(media.songs.select(F.col("key").alias("song_key"), "song_seq", F.col("number").alias("n")), "song_key")
    for r in rows.filter("n = number").dropDuplicates(["song_seq"]).orderBy("song_seq").toLocalIterator():
        yield "\t".join(str(r[c]) for c in ("song_key", "number", "machine", "n_tracks", "length", "created", "saved", "modified", "name"))


def detail_lines(media: Media, keys: list[str]) -> tuple[list[str], list[str]]:
    """(lines of eight fields for the wanted songs' v-tracks, notes on keys that no song has)."""
    wanted = media.spark.createDataFrame([(k,) for k in keys], "song_key string").distinct()
    rows = media.detail().join(wanted, "song_key", "left_semi").orderBy("song_key", "track", "vtrack")
    lines = [
        "\t".join(str(x) for x in (r["song_key"], r["track"], r["vtrack"], r["n_events"], f"{r['seconds'] // 60}:{r['seconds'] % 60:02d}", r["first_stamp"], r["last_stamp"], r["name"]))
        for r in rows.toLocalIterator()
    ]
    gone = wanted.join(media.songs.select(F.col("key").alias("song_key")), "song_key", "left_anti").orderBy("song_key")
    return lines, [f"no song {r['song_key']} on this source" for r in gone.collect()]


def parse_keys(texts: list[str]) -> list[tuple[int, int]]:
    """(partition, ordinal) of keys in comma-separated lists; blanks are passed over. ValueError for what is no key."""
    found = []
    for text in (part.strip() for t in texts for part in t.split(",")):
        if not text:
            continue
        parts = text.split(".")
        numbers = [int(p) for p in parts if p.isascii() and p.removeprefix("+").isdigit()]
        if len(numbers) != len(parts) or len(parts) > 2 or len(parts) == 2 and numbers[0] < 1:
            raise ValueError(f"invalid song key {text!r}")
        found.append((0, numbers[0]) if len(parts) == 1 else (numbers[0], numbers[1]))
    return found
