"""Recorder disks: FAT16 partitions in a table of twelve, song folders with pair-swapped contents."""

from __future__ import annotations

from dataclasses import dataclass

from .bytes import file_size, read_user
from .layouts import LAYOUTS, little, text
from .listing import Deviation, Listing

SECTOR = 512
#: Where the table's entries stand, in the order in which they count. Fixed values.
ENTRIES = (446, 462, 478, 494, 382, 398, 414, 430, 286, 302, 318, 334)
OEM = b"Roland  "
FOLDER, LABEL = 0x10, 0x08


@dataclass
class Partition:
    path: str
    number: int
    start: int
    cluster: int
    root: int
    root_entries: int
    data: int
    fat: bytes

    def chain(self, first: int) -> list[int]:
        """Clusters of a chain; it ends at a free, bad or last link, outside the table, or when it has run too long."""
        found, now, last = [], first, len(self.fat) // 2 - 1
        while 2 <= now <= last and len(found) <= last:
            found.append(now)
            now = little(self.fat, 2 * now)
            if now == 0 or now >= 0xFFF7:
                break
        return found

    def extents(self, clusters: list[int]) -> list[tuple[str, str, int, int]]:
        """Neighbouring clusters as one extent."""
        found: list[list[int]] = []
        for c in clusters:
            at = self.data + (c - 2) * self.cluster
            if found and found[-1][0] + found[-1][1] == at:
                found[-1][1] += self.cluster
            else:
                found.append([at, self.cluster])
        return [(self.path, "plain", a, n) for a, n in found]


def partitions(path: str) -> list[Partition]:
    """Valid partitions, the first of each start; none if this is no such disk."""
    size = file_size(path)
    table = read_user(path, "plain", 0, SECTOR)
    found, seen = [], set()
    if len(table) < SECTOR:
        return found
    for entry in ENTRIES:
        start, sectors = little(table, entry + 8, 4) * SECTOR, little(table, entry + 12, 4)
        if not start or not sectors or start in seen or start + SECTOR > size:
            continue
        boot = read_user(path, "plain", start, SECTOR)
        per, reserved, fats, entries, length = boot[0x0D], little(boot, 0x0E), boot[0x10], little(boot, 0x11), little(boot, 0x16)
        if boot[3:11] != OEM or little(boot, 0x0B) != SECTOR or not per or per & (per - 1) or not (reserved and fats and length):
            continue
        fat = read_user(path, "plain", start + reserved * SECTOR, length * SECTOR)
        if len(fat) < length * SECTOR:
            continue
        seen.add(start)
        root = start + (reserved + fats * length) * SECTOR
        found.append(Partition(path, len(found) + 1, start, per * SECTOR, root, entries, root + -(-entries * 32 // SECTOR) * SECTOR, fat))
    return found


def entries(data: bytes) -> list[dict]:
    """A folder's entries: a zero ends them, a deleted one is passed over."""
    found = []
    for at in range(0, len(data) - 31, 32):
        e = data[at : at + 32]
        if e[0] == 0:
            break
        if e[0] != 0xE5:
            found.append({"name": text(e[:8]), "ext": text(e[8:11]), "kind": e[11], "first": little(e, 26), "size": little(e, 28, 4)})
    return found


def open_disk(path: str) -> Listing | None:
    """Songs and files of a disk, or None if it is none. Tables and folders are read here, contents are not."""
    parts = partitions(path)
    if not parts:
        return None
    out = Listing()
    for part in parts:
        root = read_user(path, "plain", part.root, part.root_entries * 32)
        number = 0
        for folder in entries(root):
            if not folder["kind"] & FOLDER or folder["ext"] not in LAYOUTS:
                continue
            _add_song(out, part, folder, number)
            number += 1
    return out


def _add_song(out: Listing, part: Partition, folder: dict, ordinal: int) -> None:
    from .listing import read_content

    seq = len(out.songs)
    song = out.add_song(seq, part.number, ordinal, 0, "", folder["ext"], part.cluster)
    clusters = part.chain(folder["first"])
    listing = read_content(part.extents(clusters), 0, len(clusters) * part.cluster, True)
    own: dict[str, dict] = {}
    for k, e in enumerate(x for x in entries(listing) if not x["kind"] & (FOLDER | LABEL)):
        chain = part.chain(e["first"])
        take = int(e["name"][4:], 16) if e["name"].startswith("TAKE") and len(e["name"]) == 8 and all(c in "0123456789ABCDEF" for c in e["name"][4:]) else -1
        size = min(e["size"], len(chain) * part.cluster)
        file = out.add_file(seq, k, e["name"], take, e["size"], size, True, part.cluster, len(chain), 0, 0, part.extents(chain))
        own.setdefault(e["name"], file)
    fail = lambda what: out.deviations.append(Deviation(folder["name"], "§4.4", 2, what, seq, 1))
    if "SONG" not in own:
        return fail("no SONG file in directory; cannot determine format or rate")
    if own["SONG"]["size"] < 20 or not out.read_song_file(song, own["SONG"]):
        return fail("SONG file shorter than its 20-byte header; cannot determine format or rate")
    song |= song.pop("head")
    out.set_event_list(song, own.get("EVENTLST"), LAYOUTS[folder["ext"]].list_reference, "§4.3")
