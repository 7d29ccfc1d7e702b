"""CD archives: discs of a backup set, stitched into one stream, and the files on it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes import BLOCK, PAYLOAD, blocks, file_size, geometry, list_files, read_ranges, read_user, user_length
from .layouts import FILLER, FIRST_FILE, LAYOUTS, Layout, big
from .listing import Deviation, Listing

WARNING, ERROR = 1, 2


@dataclass
class Segment:
    """Part of a disc in the stitched stream."""

    path: str
    kind: str
    log_start: int
    phys_start: int
    length: int


@dataclass
class Disc:
    path: str
    name: str
    kind: str
    length: int
    machine: str
    set_id: bytes = b""
    index: int = 0
    total: int = 0
    end: int = 0
    filled: bool = True


@dataclass
class Stream:
    """Segments end to end. There are as many as discs, so this travels with the code that reads it."""

    segments: list[Segment] = field(default_factory=list)

    @property
    def length(self) -> int:
        return sum(s.length for s in self.segments)

    def extents(self, offset: int, length: int) -> list[tuple[str, str, int, int]]:
        """(path, kind, offset, length) of the pieces that hold a part of the stream."""
        found = []
        for s in self.segments:
            a, b = max(offset, s.log_start), min(offset + length, s.log_start + s.length)
            if a < b:
                found.append((s.path, s.kind, s.phys_start + a - s.log_start, b - a))
        return found


def _frames(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, names)


def classify(spark: SparkSession, paths: list[str], machine: str | None = None) -> tuple[list[Disc], list[Deviation]]:
    """Archive discs among the paths; what is none becomes a deviation."""
    discs, found = [], []
    for path in paths:
        name = path.rsplit("/", 1)[-1]
        try:
            size = file_size(path)
        except OSError as error:
            found.append(Deviation(name, "§5", WARNING, f"cannot open: {error}"))
            continue
        if (kind := geometry(size)) is None:
            found.append(Deviation(name, "§5.1", WARNING, "not a CD image; skipped"))
            continue
        head = read_user(path, kind, 0, 0x2A)
        known = next((x.machine for x in LAYOUTS.values() if x.signature == head[:32]), machine)
        if known is None or len(head) < 0x2A:
            found.append(Deviation(name, "§5.2", WARNING, "not a song archive; skipped"))
            continue
        discs.append(Disc(path, name, kind, user_length(size, kind), known, head[0x20:0x24], big(head, 0x26), big(head, 0x28)))
    return discs, found


def elect(discs: list[Disc]) -> tuple[list[Disc], list[Deviation]]:
    """The discs of one set: that with a first disc, then the larger, then the lower id."""
    sets: dict[bytes, list[Disc]] = {}
    for d in discs:
        sets.setdefault(d.set_id, []).append(d)
    chosen = min(sets, key=lambda i: (all(d.index for d in sets[i]), -len(sets[i]), i))
    other = [
        Deviation(d.name, "§5.2", WARNING, f"disc belongs to a different backup set (set {d.set_id.hex()}, not the chosen set {chosen.hex()}); skipped")
        for d in discs
        if d.set_id != chosen
    ]
    return sets[chosen], other


def arrange(discs: list[Disc]) -> tuple[list[Disc], list[Deviation]]:
    """The run of discs from index 0 on; duplicates, stranded and missing discs become deviations."""
    kept, found, wanted = [], [], 0
    missing = lambda k: Deviation("backup set", "§5.6", ERROR, f"disc index {k} is missing")
    seen: set[int] = set()
    for d in sorted(discs, key=lambda d: d.index):
        if d.index in seen:
            found.append(Deviation(d.name, "§5.2", WARNING, f"duplicate disc index {d.index}; skipped"))
        elif d.index == wanted:
            kept.append(d)
            wanted += 1
        else:
            found += [missing(k) for k in range(wanted, d.index)]
            found.append(Deviation(d.name, "§5.6", ERROR, f"disc index {d.index} is stranded beyond a gap; skipped"))
        seen.add(d.index)
    first = next((d.total for d in discs if d.index == 0 and d.total > 0), 0)
    total = max([first, *(d.total for d in discs), *(d.index + 1 for d in discs)])
    return kept, found + [missing(k) for k in range(wanted, total)]


def data_ends(spark: SparkSession, discs: list[Disc]) -> None:
    """Find where each disc's filler begins: the first block on the grid whose first payload is filler."""
    files = _frames(spark, [(d.path, d.kind, d.length) for d in discs], "path string, kind string, user_length long")
    filler = FILLER + bytes(PAYLOAD - len(FILLER))
    first = blocks(spark, files, span=PAYLOAD).filter(F.col("data") == F.lit(filler)).groupBy("path").agg(F.min("offset").alias("end"))
    ends = {r["path"]: r["end"] for r in first.collect()}
    for d in discs:
        d.filled = d.path in ends
        d.end = ends.get(d.path, d.length)


def stitch(discs: list[Disc]) -> Stream:
    """Disc 0 from its start, later ones from their second block, each to its data's end; estimated ends keep to the grid."""
    stream, at = Stream(), 0
    for k, d in enumerate(discs):
        start = BLOCK if k else 0
        end = d.end if d.filled or k == len(discs) - 1 else d.end // BLOCK * BLOCK
        stream.segments.append(Segment(d.path, d.kind, at, start, max(0, end - start)))
        at += stream.segments[-1].length
    return stream


def headers(spark: SparkSession, stream: Stream, layout: Layout, start: int = FIRST_FILE) -> DataFrame:
    """(log, header) of all blocks that may be a file's header; the stream's end bounds them, and no header follows at once.

    Every block of the stream is looked at by itself, in all tasks at once.
    """
    end = stream.length
    rows = [(s.path, s.kind, s.phys_start + s.length, s.log_start, s.phys_start) for s in stream.segments]
    found = None
    for path, kind, length, log, phys in rows:
        files = _frames(spark, [(path, kind, length, log, phys)], "path string, kind string, user_length long, log_start long, phys_start long")
        part = blocks(spark, files, span=layout.span, first=phys).select((F.col("offset") - phys + log).alias("log"), "data")
        found = part if found is None else found.union(part)
    signed = found.filter(F.substring("data", 1, 32) == F.lit(layout.signature))
    name = F.decode(F.substring("data", layout.file_name + 1, 11), "ISO-8859-1")
    gate = (
        F.substring("data", layout.magic[0] + 1, 4) == F.lit(layout.magic[1])
        if layout.magic
        else F.substring("data", layout.marker + 1, 2) == F.lit(b"\0\0")
    )
    likely = signed.filter((F.col("log") >= start) & (F.col("log") + BLOCK < end) & name.rlike("^[A-Z0-9][A-Z0-9 ]{7}VR[59]$") & gate)
    after = signed.select((F.col("log") - BLOCK).alias("log"))
    return likely.join(after, "log", "left_anti").select("log", F.col("data").alias("header"))


def walk(found: list[tuple[int, bytes]], layout: Layout, end: int, start: int = FIRST_FILE) -> list[dict]:
    """The files that a walk along the blocks meets; a header inside another file's data is stepped over.

    Headers are one small row a file, so the walk itself is done in one place.
    """
    by_place, at, files = dict(found), start, []
    while at + BLOCK <= end:
        header = by_place.get(at)
        if header is None:
            later = [k for k in by_place if k > at and (k - at) % BLOCK == 0]
            if not later:
                break
            at = min(later)
            continue
        fields = layout.fields(bytes(header))
        files.append({**fields, "header_at": at, "data_at": at + BLOCK, "header": bytes(header)})
        at += (1 + fields["blocks"]) * BLOCK
    return files


def _reseam(spark: SparkSession, discs: list[Disc], layout: Layout) -> set[int]:
    """Recover the data's end of discs without filler from the first header on the next disc."""
    done = set()
    for k, d in enumerate(discs[:-1]):
        if d.filled:
            continue
        own = walk(_collect(headers(spark, stitch_one(d), layout)), layout, d.end)
        follower = discs[k + 1]
        head = read_user(follower.path, follower.kind, 0, layout.span)
        if not own or any(own[-1]["header"][a:b] != head[a:b] for a, b in layout.identity):
            continue
        places = [log for log, _ in _collect(headers(spark, stitch_one(follower), layout, BLOCK))]
        if not places:
            continue
        rest, size = min(places) - BLOCK, own[-1]["blocks"] * BLOCK
        end = own[-1]["data_at"] + size - rest
        if 0 < rest < size and end % BLOCK == 0 and end <= d.length:
            d.end, d.filled = end, True
            done.add(k)
    return done


def stitch_one(d: Disc) -> Stream:
    return Stream([Segment(d.path, d.kind, 0, 0, d.end)])


def _collect(found: DataFrame) -> list[tuple[int, bytes]]:
    return [(r["log"], r["header"]) for r in found.collect()]


def open_archive(spark: SparkSession, paths: list[str], machine: str | None = None) -> Listing:
    """The songs and files of a disc, of several, or of a folder of discs."""
    single = len(paths) == 1 and list_files(paths[0]) == paths
    discs, found = classify(spark, [p for path in paths for p in (list_files(path) if not single else [path])], machine)
    if not discs:
        raise ValueError("no archive discs found")
    if single:
        data_ends(spark, discs)
        stream = stitch_one(discs[0])
        if not discs[0].filled:
            found.append(Deviation("disc", "§10", WARNING, "no trailing TDI filler run; dump is likely a truncated/incomplete rip"))
        read_end = Stream([Segment(discs[0].path, discs[0].kind, 0, 0, discs[0].length)])
    else:
        discs, other = elect(discs)
        discs, order = arrange(discs)
        found += other + order
        if not discs:
            raise ValueError("the backup set has no disc index 0")
        data_ends(spark, discs)
        bare = [k for k, d in enumerate(discs) if not d.filled]
        mended = _reseam(spark, discs, LAYOUTS[discs[0].machine])
        for k in bare:
            what = "reconstructed from the continuation disc's junction" if k in mended else "estimated"
            found.append(Deviation(discs[k].name, "§10", WARNING if k in mended else ERROR, f"disc index {discs[k].index} lacks a trailing TDI filler run; its data end was {what}"))
        stream = read_end = stitch(discs)
    if any(d.kind == "cooked" for d in discs):
        found.append(Deviation("disc", "§5", WARNING, "cooked (2048-byte-sector) rip; damage cannot be detected"))
    layout = LAYOUTS[discs[0].machine]
    files = walk(_collect(headers(spark, stream, layout)), layout, stream.length)
    found += _junctions(stream, discs, files, layout)
    return _listing(files, layout, read_end, found, [d.path for d in discs if d.kind == "raw"])


def _junctions(stream: Stream, discs: list[Disc], files: list[dict], layout: Layout) -> list[Deviation]:
    """Files that run over a junction must find their header repeated on the next disc."""
    found = []
    for f in files:
        for k, s in enumerate(stream.segments[1:], 1):
            if f["data_at"] < s.log_start < f["data_at"] + f["size"]:
                head = read_user(discs[k].path, discs[k].kind, 0, layout.span)
                if len(head) < layout.span:
                    found.append(Deviation(f"file {f['name']}", "§5.6", ERROR, "continuation header is unreadable"))
                elif any(f["header"][a:b] != head[a:b] for a, b in layout.identity):
                    found.append(Deviation(f"file {f['name']}", "§5.6", ERROR, "continuation header differs from the file's own"))
    return found


def _listing(files: list[dict], layout: Layout, stream: Stream, found: list[Deviation], raw: list[str]) -> Listing:
    """Files grouped to songs in the order in which songs first appear."""
    out = Listing(deviations=list(found), raw_paths=raw)
    songs: dict[object, int] = {}
    for seq, f in enumerate(files):
        key = f["song_number"] if layout.song_number is not None else f["song_name"]
        if key not in songs:
            songs[key] = len(songs)
            out.add_song(songs[key], 0, 0, f["song_number"], f["song_name"], layout.machine)
        end = stream.length
        size = max(0, min(f["size"], end - f["data_at"]))
        out.add_file(songs[key], seq, f["name"], f["file_id"], f["size"], size, False, BLOCK, 0, f["rate_byte"], f["format"], stream.extents(f["data_at"], size))
    for song in out.songs:
        _identify(out, song, layout)
    return out


def _identify(out: Listing, song: dict, layout: Layout) -> None:
    """Number, stamps, rate and format of a song, from the first of its SONG files and event lists."""
    own = [f for f in out.files if f["song_seq"] == song["song_seq"]]
    if layout.song_number is None:
        if content := next((f for f in own if f["name"].startswith("SONG")), None):
            out.read_song_file(song, content)
        else:
            song["number"] = song["song_seq"] + 1
            out.deviations.append(
                Deviation(f"song #{song['song_seq'] + 1}", "§4.4", WARNING, "no SONG file for this song; catalog number inferred from disc order", song["song_seq"])
            )
    song["ordinal"] = song["number"]
    events = next((f for f in own if f["name"].startswith("EVENTLST")), None)
    out.set_event_list(song, events, layout.list_reference, "§5.4")


def corrupt_frames(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, frame, unreadable) of raw frames whose error-detection code doesn't fit, or that cannot be read."""
    from .edc import bad_frames

    rows = [(p, file_size(p)) for p in paths]
    step = 2352 * 512
    files = _frames(spark, rows, "path string, size long")
    ranges = files.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long")))).select(
        "path", F.lit("plain").alias("kind"), "offset", F.least(F.lit(step).cast("long"), F.col("size") - F.col("offset")).alias("length")
    )
    return bad_frames(read_ranges(ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "offset")))
