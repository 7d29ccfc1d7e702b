"""What a source holds, in one form for archives and disks: songs, files with their extents, deviations.

These are directory data, one small row for each song and file; contents stay where they are until a task reads them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .bytes import read_user
from .layouts import big, stamp, text


@dataclass
class Deviation:
    location: str
    reference: str
    severity: int
    message: str
    song_seq: int = -1
    stage: int = 0


EXTENTS = "array<struct<path:string,kind:string,offset:bigint,length:bigint>>"
SONGS = (
    "song_seq long, partition int, ordinal int, number int, name string, machine string, created timestamp_ntz, saved timestamp_ntz,"
    " rate_byte int, format int, cluster_size int, list_reference string"
)
FILES = f"song_seq long, seq long, name string, file_id int, claimed long, size long, swapped boolean, cluster_size int, clusters long, extents {EXTENTS}"
DEVIATIONS = "stage int, song_seq long, sub_seq long, location string, reference string, severity int, message string"


def read_content(extents: list, offset: int, length: int, swapped: bool) -> bytes:
    """Bytes of a file from its extents; with swapped pairs, whole pairs are read."""
    a, b = (offset // 2 * 2, (offset + length + 1) // 2 * 2) if swapped else (offset, offset + length)
    parts, at = [], 0
    for e in extents:
        path, kind, begin, size = (e["path"], e["kind"], e["offset"], e["length"]) if isinstance(e, dict) else tuple(e)
        lo, hi = max(a, at), min(b, at + size)
        if lo < hi:
            parts.append(read_user(path, kind, begin + lo - at, hi - lo))
        at += size
    data = b"".join(parts)
    if swapped:
        pairs = bytearray(data)
        even = len(pairs) // 2 * 2
        pairs[0:even:2], pairs[1:even:2] = data[1:even:2], data[0:even:2]
        data = bytes(pairs)
    return data[offset - a : offset - a + length]


@dataclass
class Listing:
    songs: list[dict] = field(default_factory=list)
    files: list[dict] = field(default_factory=list)
    event_lists: list[dict] = field(default_factory=list)
    deviations: list[Deviation] = field(default_factory=list)
    raw_paths: list[str] = field(default_factory=list)

    def add_song(self, seq: int, partition: int, ordinal: int, number: int, name: str, machine: str, cluster_size: int = 0x8000) -> dict:
        song = {
            "song_seq": seq, "partition": partition, "ordinal": ordinal, "number": number, "name": name, "machine": machine, "created": None, "saved": None,
            "rate_byte": None, "format": None, "cluster_size": cluster_size, "list_reference": "",
        }
        self.songs.append(song)
        return song

    def add_file(
        self, song: int, seq: int, name: str, file_id: int, claimed: int, size: int, swapped: bool, cluster_size: int, clusters: int, rate: int, code: int, extents: list
    ) -> dict:
        file = {
            "song_seq": song, "seq": seq, "name": name, "file_id": file_id, "claimed": claimed, "size": size, "swapped": swapped, "cluster_size": cluster_size,
            "clusters": clusters, "rate_byte": rate, "format": code, "extents": extents,
        }
        self.files.append(file)
        return file

    def content(self, file: dict, length: int) -> bytes:
        return read_content(file["extents"], 0, min(length, file["size"]), file["swapped"])

    def read_song_file(self, song: dict, file: dict) -> bool:
        """Number and stamps from a SONG file; on disks its name, rate and format too."""
        head = self.content(file, 38)
        if len(head) < 6:
            return False
        song["number"] = big(head, 4)
        song["created"] = stamp(head[0x14:0x1C]) if len(head) >= 0x1C else None
        song["saved"] = stamp(head[0x1C:0x24]) if len(head) >= 0x24 else None
        if len(head) >= 0x14:
            song["head"] = {"name": text(head[6:0x12]), "rate_byte": head[0x12], "format": head[0x13]}
        return True

    def set_event_list(self, song: dict, file: dict | None, reference: str, none: str) -> None:
        song["list_reference"] = reference
        if file is None:
            self.deviations.append(Deviation(f"song {song['number']}", none, 2, "no EVENTLST file for song; nothing to extract", song["song_seq"], 2))
            return
        if song["rate_byte"] is None:
            song["rate_byte"], song["format"] = file["rate_byte"], file["format"]
        self.event_lists.append(file)

    # as tables

    def _table(self, spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
        names = [f.split(" ")[0] for f in _fields(schema)]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)

    def song_table(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, self.songs, SONGS)

    def file_table(self, spark: SparkSession, files: list[dict] | None = None) -> DataFrame:
        return self._table(spark, self.files if files is None else files, FILES)

    def deviation_table(self, spark: SparkSession) -> DataFrame:
        rows = [(d.stage, d.song_seq, k, d.location, d.reference, d.severity, d.message) for k, d in enumerate(self.deviations)]
        return spark.createDataFrame(rows, DEVIATIONS)


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:k].strip())
            start = k + 1
    return out
