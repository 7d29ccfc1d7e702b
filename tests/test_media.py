"""Media built in memory and read back, against a plain replay in Python."""

import hashlib
import random
import wave

import numpy as np
import pytest

from reelquarry.plans import media_queries
from reelquarry.plans.media import open_media
from reelquarry.sources import builder, codec
from reelquarry.sources.archive import corrupt_frames
from reelquarry.sources.builder import Event, Song, stamp
from reelquarry.sources.wav import write_tracks
from tests.compare import assert_same
from tests.conftest import SF

ORIGIN = {"VR9": 12, "VR5": 0}


def pcm(n, seed, width=2):
    return np.random.default_rng(seed).integers(0, 256, n * width).astype(np.uint8).tobytes()


def samples(data, width):
    raw = np.frombuffer(data, np.uint8).reshape(-1, width).astype(np.int64)
    value = sum(raw[:, k] << 8 * k for k in range(width))
    return np.where(value >= 1 << 8 * width - 1, value - (1 << 8 * width), value).astype("<i4")


def decoded(song, data, cluster):
    """All samples of a take, by the formats' plain rules."""
    if song.format in (3, 8):
        return samples(data, {3: 2, 8: 3}[song.format])
    if song.format == 1:
        data = b"".join(data[k : k + cluster][: min(cluster // 12, len(data[k : k + cluster]) // 12) * 12] for k in range(0, len(data), cluster))
    return codec.decode(data, song.format)[0]


def replay(song, machine, place, cluster=0x8000):
    """What a v-track sounds like: each event clears its span, then lays down its take."""
    origin = ORIGIN[machine]
    events = [e for e in song.events if (e.track, e.vtrack) == place]
    out = np.zeros(max(0, max(e.end - origin for e in events)) * 16, "<i4")
    for e in events:
        if e.end <= e.start:
            continue
        lo, hi = max(0, e.start - origin) * 16, max(0, e.end - origin) * 16
        out[lo:hi] = 0
        if e.take in song.takes and e.take:
            take = decoded(song, song.takes[e.take], cluster)
            part = take[e.trimmed * 16 + lo - (e.start - origin) * 16 :][: hi - lo]
            out[lo : lo + len(part)] = part
    return out


def make(number, name, machine, form=3, seed=0):
    r = random.Random(seed)
    width = {3: 2, 8: 3}.get(form, 1)
    takes = {0x100 + k: pcm(r.randint(20, 3000) * 16, seed * 10 + k, width) for k in range(4)}
    takes[0x1FF] = pcm(120_000, seed, width)
    events = []
    for k in range(40):
        a = r.randint(0, 4000)
        take = r.choice([*takes, 0, 0x999])
        events.append(Event(a, a + r.randint(-3, 2500), take, track=r.randint(1, 3), vtrack=r.randint(1, 2), trimmed=r.randint(0, 30), stamp=stamp(2001, 1 + k % 14, 5, k % 30)))
    events.append(Event(ORIGIN[machine], ORIGIN[machine] + 100, 0x100, track=5))
    return Song(number, name, events, takes, format=form, created=stamp(1999, 13, 1, 10, 0, 61), saved=stamp(2000, 2, 29), names={(5, 1): "Bass/2"})


def check_tracks(spark, media, songs, tmp_path):
    """songs: (machine, song) by song_seq."""
    tracks = media.tracks()
    done = write_tracks(tracks, media.samples(), str(tmp_path / "out")).collect()
    keys = {r["song_key"]: r["song_seq"] for r in media.songs.selectExpr("key AS song_key", "song_seq").collect()}
    seen = set()
    for r in done:
        machine, song = songs[keys[r["song_key"]]]
        want = replay(song, machine, (r["track"], r["vtrack"]))
        assert r["n_samples"] == len(want)
        assert r["pcm_sha256"] == hashlib.sha256(want.tobytes()).hexdigest(), r
        with wave.open(str(tmp_path / "out" / r["file"])) as w:
            width = codec.BITS[song.format] // 8
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()) == (1, width, 44100, len(want))
            assert (samples(w.readframes(len(want)), width) == want).all()
        seen.add((keys[r["song_key"]], r["track"], r["vtrack"]))
    assert seen == {(k, e.track, e.vtrack) for k, (_, s) in enumerate(songs) for e in s.events if e.take}


@pytest.mark.parametrize(("machine", "form", "kind"), [("VR9", 3, "raw"), ("VR5", 8, "cooked")])
def test_single_disc(spark, tmp_path, machine, form, kind):
    songs = [make(2, "SONG TWO", machine, form, 1), make(7, "OTHER/ONE", machine, form, 2)]
    stream = builder.archive_stream(songs, machine)
    path = tmp_path / "disc.bin"
    path.write_bytes(builder.raw(stream) if kind == "raw" else stream)
    media = open_media(spark, [str(path)])
    catalog = sorted(media.catalog().collect(), key=lambda r: r["number"])
    assert [(r["song_key"], r["number"], r["machine"], r["name"]) for r in catalog] == [("2", 2, machine, "SONG TWO"), ("7", 7, machine, "OTHER/ONE")]
    for r, song in zip(catalog, songs, strict=True):
        places = {(e.track, e.vtrack) for e in song.events if e.take}
        ends = [max(max(0, e.end - ORIGIN[machine]) for e in song.events if (e.track, e.vtrack) == p) for p in places]
        assert (r["n_tracks"], r["seconds"]) == (len(places), max(ends) * 16 // 44100)
        assert (r["created"], r["saved"]) == (("2000-01-01 10:01:01", "2000-02-29 00:00:00") if machine == "VR5" else ("-", "-"))
        assert (r["modified"] != "-") == (machine == "VR5")
    detail = media.detail().filter("track = 5").collect()
    assert [(r["n_events"], r["name"]) for r in detail] == [(1, "Bass/2" if machine == "VR5" else "")] * 2
    check_tracks(spark, media, [(machine, s) for s in songs], tmp_path)
    found = media.deviations(scan=True)
    degenerate = sum(e.end <= e.start and any(x.take for x in s.events if (x.track, x.vtrack) == (e.track, e.vtrack)) for s in songs for e in s.events)
    missing = sum(e.end > e.start and e.take == 0x999 for s in songs for e in s.events)
    assert found.filter("message LIKE 'degenerate%'").count() == degenerate
    assert found.filter("message LIKE '%is missing'").count() == missing
    assert found.filter("message LIKE 'corrupt%'").count() == 0
    assert found.filter("message LIKE 'cooked%'").count() == (kind == "cooked")
    one = media.select([(0, 7), (0, 9)])
    assert one.catalog().count() == 1 and one.deviations().filter("message = 'requested song 9 not found'").count() == 1


def test_damaged_frames_and_missing_filler(spark, tmp_path):
    stream = builder.archive_stream([make(1, "A", "VR9")], filler=False)
    data = bytearray(builder.raw(stream))
    for frame in (3, 90, 91, 92):
        data[frame * 2352 + 40] ^= 1
    path = tmp_path / "d.bin"
    path.write_bytes(data)
    assert sorted(r["frame"] for r in corrupt_frames(spark, [str(path)]).collect()) == [3, 90, 91, 92]
    media = open_media(spark, [str(path)])
    lines = [r["message"] for r in media.deviations(scan=True).collect()]
    assert "corrupt frames 90-92 (3)" in lines and any(m.startswith("no trailing") for m in lines)
    assert media.catalog().count() == 1


def test_frames_that_cannot_be_read_are_reported(spark):
    from reelquarry.sources.edc import bad_frames

    good = builder.raw(bytes(4 * 2048))
    rows = [("a", 0, len(good), good), ("a", 4 * 2352, 3 * 2352, None), ("b", 0, 2 * 2352, good[:2000] + b"!" + good[2001 : 2 * 2352])]
    got = bad_frames(spark.createDataFrame(rows, "path string, offset long, length long, data binary")).collect()
    assert sorted(tuple(r) for r in got) == [("a", 4, True), ("a", 5, True), ("a", 6, True), ("b", 0, False)]


def test_set_of_two_discs(spark, tmp_path):
    songs = [make(1, "SPAN", "VR9", 3, 4), make(2, "SOLO", "VR9", 3, 5)]
    stream = builder.archive_stream(songs)
    first = len(builder._pad(songs[0].event_list("VR9")))
    sizes = [len(builder._pad(d)) for d in songs[0].takes.values()]
    header = 0x10000 + 0x8000 + first + sum(n + 0x8000 for n in sizes[:-1])
    for k, data in enumerate(builder.split_set(stream, header + 2 * 0x8000, header)):
        (tmp_path / f"{'ba'[k]}.bin").write_bytes(builder.raw(data))
    (tmp_path / "c.txt").write_bytes(b"not an image")
    other = builder.archive_stream([make(9, "X", "VR9")], set_id=b"\0\0\0\1", index=3, total=4)
    (tmp_path / "d.bin").write_bytes(other)
    media = open_media(spark, [str(tmp_path)])
    check_tracks(spark, media, [("VR9", s) for s in songs], tmp_path)
    lines = [r["message"] for r in media.deviations().collect()]
    assert any("not a CD image" in m for m in lines) and any("different backup set" in m for m in lines)
    assert not any("continuation" in m or "missing" in m and "disc index" in m for m in lines)


def test_truncated_first_disc_is_mended(spark, tmp_path):
    songs = [make(1, "SPAN", "VR9", 3, 4), make(2, "SOLO", "VR9", 3, 5)]
    songs[0].takes = {0x1FF: songs[0].takes.pop(0x1FF), **songs[0].takes}  # a header follows the file that is cut
    header = 0x10000 + 0x8000 + len(builder._pad(songs[0].event_list("VR9")))
    one, two = builder.split_set(builder.archive_stream(songs), header + 2 * 0x8000, header)
    (tmp_path / "1.bin").write_bytes(one[: -32 * 2048] + b"\xda" * (2 * 0x8000 + 10 * 2048))
    (tmp_path / "2.bin").write_bytes(two)
    media = open_media(spark, [str(tmp_path / "1.bin"), str(tmp_path / "2.bin")])
    check_tracks(spark, media, [("VR9", s) for s in songs], tmp_path)
    assert media.deviations().filter("message LIKE '%reconstructed%'").count() == 1


def test_disk(spark, tmp_path):
    a, b, c = make(0, "INIT", "VR5", 3, 6), make(0, "INIT", "VR9", 8, 7), make(3, "THIRD", "VR9", 3, 8)
    cut = make(4, "CUT", "VR9", 3, 9)
    cut.events, cut.takes = [Event(12, 4012, 0x1FF, clusters=8)], {0x1FF: pcm(120_000, 9)}
    path = tmp_path / "disk.img"
    path.write_bytes(builder.disk([[("VR5", a), ("VR9", b)], [("VR9", c)]]))
    media = open_media(spark, [str(path)])
    assert sorted(r["song_key"] for r in media.catalog().collect()) == ["1.0", "1.1", "2.0"]
    check_tracks(spark, media, [("VR5", a), ("VR9", b), ("VR9", c)], tmp_path)
    path.write_bytes(builder.disk([[("VR9", cut)]], short={"TAKE01FF": 2}))
    media = open_media(spark, [str(path)], "hdd")
    assert media.deviations().filter("message LIKE '%FAT chain yields 2 cluster(s) but the event claims 8%'").count() == 1
    assert media.pieces().first()["dst_to"] == 2 * 0x8000 // 2


def test_stereo_pairs(spark, tmp_path):
    takes = {1: pcm(1600, 1), 2: pcm(1600, 2)}
    place = lambda t, e: [Event(12, 50, 1 + t % 2, track=t), Event(60, e, 2, track=t)]
    song = Song(1, "S", [e for t, end in ((1, 90), (2, 90), (3, 90), (5, 80), (6, 81)) for e in place(t, end)], takes)
    path = tmp_path / "s.bin"
    path.write_bytes(builder.archive_stream([song]))
    got = [(r["left"], r["right"]) for r in open_media(spark, [str(path)], "cd").pairs().collect()]
    assert got == [(1, 2)]


@pytest.mark.parametrize(("machine", "form"), [("VR9", 1), ("VR5", 5), ("VR9", 0)])
def test_coded_takes(spark, tmp_path, machine, form):
    song = make(1, "CODED", machine, form, 20 + form)
    path = tmp_path / "c.bin"
    path.write_bytes(builder.archive_stream([song], machine))
    media = open_media(spark, [str(path)])
    check_tracks(spark, media, [(machine, song)], tmp_path)
    want = 0
    for e in song.events:
        if e.take in song.takes and e.end > e.start and any(x.take for x in song.events if (x.track, x.vtrack) == (e.track, e.vtrack)):
            data = song.takes[e.take]
            if form == 1:
                data = b"".join(data[k : k + 0x8000][: min(2730, len(data[k : k + 0x8000]) // 12) * 12] for k in range(0, len(data), 0x8000))
            total, unknown = codec.decode(data, form)
            lo = (max(e.start, ORIGIN[machine]) - e.start + e.trimmed) * 16
            hi = min(len(total), lo + (e.end - max(e.start, ORIGIN[machine])) * 16)
            want += sum(lo <= k * 16 < hi for k in unknown)
    assert (media.unknown_blocks().selectExpr("sum(n)").first()[0] or 0) == want
    assert media.deviations(scan=True).filter("message LIKE '%unknown pattern%'").count() == media.unknown_blocks().count()


def test_what_is_no_source(spark, tmp_path):
    path = tmp_path / "x"
    path.write_bytes(bytes(4096))
    for kind in ("", "hdd", "cd", "tape"):
        with pytest.raises(ValueError):
            open_media(spark, [str(path)], kind)


def test_truncated_lists():
    from reelquarry.sources.layouts import parse_log, parse_table

    assert parse_log(b"\0") == ([], [(2, "event list shorter than its 2-byte header")])
    events, found = parse_log(b"\0\5" + bytes(48) + b"xx")
    assert len(events) == 1 and found == [(2, "event list declares 5 records but holds only 1")]
    events, found = parse_table(b"?" * 16 + b"\0\0" + b"name".ljust(16) + b"\0\2" + bytes(64) + bytes(8))
    assert len(events) == 1 and [s for s, _ in found] == [1, 2, 2]


@pytest.mark.parametrize("name", ["media_catalog_vr9", "media_catalog_vr5", "media_catalog_disk", "media_catalog_set", "media_detail_vr5", "media_events", "media_tracks"])
def test_queries_take_all_nations_and_suppliers(spark, tmp_path, name):
    """Against the query's SQL, where one nation has hundreds of suppliers."""
    import duckdb

    spark.read.parquet(f"{SF}/nation.parquet").write.parquet(str(tmp_path / "nation.parquet"))
    keys = [(k % 25 if k < 100 else 20, k) for k in range(1, 900)]
    spark.createDataFrame(keys, "s_nationkey int, s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    oracle = duckdb.connect()
    for table in ("nation", "supplier"):
        oracle.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert_same(media_queries.QUERIES[name](spark, str(tmp_path)), media_queries.SQL[name], oracle)
