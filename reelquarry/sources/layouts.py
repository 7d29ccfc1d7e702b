"""Where the fields of media stand. Fixed values of the two machines' formats."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

BLOCK = 0x8000
#: Where an archive's first file header stands; the blocks before it are two copies of the archive's own header.
FIRST_FILE = 0x10000
#: A frame of filler: this, then zeros. It marks the end of burned data.
FILLER = bytes.fromhex("5444490150010101 0180FFFFFF".replace(" ", ""))
#: What stands before a V-track table.
LIST_MAGIC = b"TAKE EVENT LIST "
TABLE_ENTRIES, VTRACKS = 288, 16
FRAME_SAMPLES = 16
FORMATS = {0: "MT1", 1: "MT2", 3: "M16", 5: "MTP", 8: "M24"}
SAMPLE_BYTES = {3: 2, 8: 3}

NAME = re.compile(rb"[A-Z0-9][A-Z0-9 ]{7}VR[59]")


@dataclass(frozen=True)
class Layout:
    """A machine's archive header block and event list."""

    machine: str
    signature: bytes
    span: int
    song_name: int
    rate: int
    file_name: int
    file_id: int
    size: int
    origin: int
    list_reference: str
    song_number: int | None = None
    block_count: int | None = None
    marker: int | None = None
    magic: tuple[int, bytes] | None = None

    @property
    def identity(self) -> list[tuple[int, int]]:
        """What a continuation disc repeats of a file's header."""
        return [(self.file_name, self.file_name + 11), (self.file_id, self.file_id + 2), (self.size, self.size + 4)]

    def accepts(self, header: bytes) -> bool:
        """Whether a block looks like a file's header, but for the block after it."""
        if len(header) < self.span or header[:32] != self.signature or not NAME.fullmatch(header[self.file_name : self.file_name + 11]):
            return False
        if self.magic:
            return header[self.magic[0] : self.magic[0] + 4] == self.magic[1]
        return header[self.marker : self.marker + 2] == b"\0\0"

    def fields(self, header: bytes) -> dict:
        size = int.from_bytes(header[self.size : self.size + 4], "little")
        count = big(header, self.block_count) if self.block_count is not None else max(1, -(-size // BLOCK))
        return {
            "song_number": big(header, self.song_number) if self.song_number is not None else 0,
            "song_name": text(header[self.song_name : self.song_name + 12]),
            "rate_byte": header[self.rate],
            "format": header[self.rate + 1],
            "name": text(header[self.file_name : self.file_name + 11]),
            "file_id": big(header, self.file_id),
            "size": size,
            "blocks": count,
        }


VR9 = Layout(
    "VR9", b"VS-8EXECR02 Song Copy Archives  ", 0x1656, song_name=0x160E, rate=0x161A, file_name=0x1624, file_id=0x1634, size=0x1652,
    origin=12, list_reference="§6.2", song_number=0x160C, block_count=0x1630, marker=0x1632,
)
VR5 = Layout(
    "VR5", b"VS1880EXR06 Song Copy Archives  ", 0x2466, song_name=0x241E, rate=0x242A, file_name=0x2434, file_id=0x2444, size=0x2462,
    origin=0, list_reference="§6.1", magic=(0x245C, bytes.fromhex("60BF5128")),
)
LAYOUTS = {x.machine: x for x in (VR9, VR5)}


def big(data: bytes, at: int, size: int = 2) -> int:
    return int.from_bytes(data[at : at + size], "big")


def little(data: bytes, at: int, size: int = 2) -> int:
    return int.from_bytes(data[at : at + size], "little")


def text(raw: bytes) -> str:
    return raw.decode("latin-1").rstrip(" \0")


def stamp(raw: bytes) -> datetime | None:
    """Second, minute, hour, weekday, day, month, year; none without a year, and fields out of range carry over."""
    if len(raw) < 8 or not (year := big(raw, 6)):
        return None
    months = year * 12 + raw[5] - 1
    try:
        return datetime(months // 12, months % 12 + 1, 1) + timedelta(days=raw[4] - 1, hours=raw[2], minutes=raw[1], seconds=raw[0])
    except (ValueError, OverflowError):
        return None


def parse_log(data: bytes) -> tuple[list[dict], list[tuple[int, str]]]:
    """(events, deviations) of a counted list of 48-byte records; groups are numbered as they first appear."""
    if len(data) < 2:
        return [], [(2, "event list shorter than its 2-byte header")]
    count, events, group = big(data, 0), [], {}
    for k in range(count):
        r = data[2 + 48 * k : 50 + 48 * k]
        if len(r) < 48:
            return events, [(2, f"event list declares {count} records but holds only {k}")]
        code = r[0x20]
        events.append(
            {"group_seq": group.setdefault(code, len(group)), "track": code // 8 + 1, "vtrack": code % 8 + 1, "name": "", "ordinal": k, **_placement(r), "stamp": None}
        )
    return events, []


def parse_table(data: bytes) -> tuple[list[dict], list[tuple[int, str]]]:
    """(events, deviations) of a V-track table: after a registry that is skipped, 288 entries by place with 64-byte records."""
    if len(data) < 18:
        return [], [(2, "event list shorter than its 18-byte header")]
    found = [] if data[:16] == LIST_MAGIC else [(1, 'event list missing the "TAKE EVENT LIST " magic; parsing positionally anyway')]
    at, events = 18 + 64 * big(data, 16), []
    for k in range(TABLE_ENTRIES):
        if at + 18 > len(data):
            return events, [*found, (2, f"V-track table truncated: only {k} of {TABLE_ENTRIES} entries present")]
        name, count = text(data[at : at + 16]).strip(), big(data, at + 16)
        at += 18
        own = "" if re.match(r"V\.T($|[ 0-9])", name) else name
        for j in range(count):
            r = data[at : at + 64]
            if len(r) < 64:
                found.append((2, f"track {k // VTRACKS + 1}/v-track {k % VTRACKS + 1} declares {count} records but the table ends after {j}"))
                break
            events.append(
                {"group_seq": k, "track": k // VTRACKS + 1, "vtrack": k % VTRACKS + 1, "name": own, "ordinal": j, **_placement(r), "stamp": stamp(r[0x28:0x30])}
            )
            at += 64
    return events, found


def _placement(r: bytes) -> dict:
    return {
        "start": big(r, 0, 4), "end": big(r, 4, 4), "trimmed": big(r, 8, 4), "file_id": big(r, 0x14), "cluster_count": big(r, 0x18),
    }


PARSERS = {"VR9": parse_log, "VR5": parse_table}
