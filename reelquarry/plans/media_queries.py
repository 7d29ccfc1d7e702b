"""The whole media path over tables: images are made from the tables' rows, written to the shared folder, and read back.

So SQL over the same tables says what the catalog, the detail and the tracks must be.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import builder
from ..sources.bytes import _file_system
from ..sources.wav import write_tracks
from .media import Media, open_media

#: Samples of a take.
TAKE = 960


def _shared(spark: SparkSession) -> str:
    """A new folder in the one that all executors share; a machine's own temporary one only if Spark runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="reelquarry-")
    return f"{folder.rstrip('/')}/media-{uuid.uuid4().hex}"


def _put(path: str, data: bytes) -> str:
    system, name = _file_system(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(name) as out:
        out.write(data)
    return path


def _songs(spark: SparkSession, folder: str, machine: str) -> list[builder.Song]:
    """All nations as songs, all their suppliers as events, in key order: an event's place, take and length come from the supplier's key."""
    origin = 12 if machine == "VR9" else 0
    nations = spark.read.parquet(f"{folder}/nation.parquet").orderBy("n_nationkey").collect()
    suppliers = spark.read.parquet(f"{folder}/supplier.parquet").select("s_nationkey", "s_suppkey").orderBy("s_nationkey", "s_suppkey")
    keys: dict[int, list[int]] = defaultdict(list)
    for nation, s in suppliers.collect():
        keys[nation].append(s)
    songs = []
    for n in nations:
        events = []
        for s in keys[n["n_nationkey"]]:
            take = 0 if s % 7 == 0 else 0x100 + s % 3
            events.append(builder.Event(origin + s % 40, origin + s % 40 + 30 + s % 25, take, 1 + s % 4, 1 + s % 2, stamp=builder.stamp(2000 + s % 5, 1 + s % 12, 1 + s % 28, s % 24)))
        takes = {0x100 + t: bytes((t * 31 + k) % 251 for k in range(2 * TAKE)) for t in range(3)}
        songs.append(builder.Song(n["n_nationkey"] + 1, n["n_name"][:12].strip(), events, takes))
    return songs


def _disc(spark: SparkSession, folder: str, machine: str, raw: bool) -> Media:
    stream = builder.archive_stream(_songs(spark, folder, machine), machine)
    return open_media(spark, [_put(f"{_shared(spark)}/disc.bin", builder.raw(stream) if raw else stream)], "cd")


def _disk(spark: SparkSession, folder: str) -> Media:
    songs = _songs(spark, folder, "VR5")
    image = builder.disk([[("VR5", s) for s in songs[::2]], [("VR5", s) for s in songs[1::2]]])
    return open_media(spark, [_put(f"{_shared(spark)}/disk.img", image)], "hdd")


def media_catalog_vr9(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog of a raw disc of the older machine."""
    return _disc(spark, folder, "VR9", True).catalog()


def media_catalog_vr5(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog of a cooked disc of the newer machine."""
    return _disc(spark, folder, "VR5", False).catalog()


def media_catalog_disk(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog of a disk with two partitions."""
    return _disk(spark, folder).catalog()


def media_catalog_set(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog of a set of two discs whose first file after the first event list runs over the junction."""
    songs = _songs(spark, folder, "VR9")
    songs[0].takes = {0x1F0: bytes(5 * 0x8000), **songs[0].takes}
    header = 0x10000 + 0x8000 + len(builder._pad(songs[0].event_list("VR9")))
    where = _shared(spark)
    for k, data in enumerate(builder.split_set(builder.archive_stream(songs), header + 3 * 0x8000, header)):
        _put(f"{where}/disc{k}.bin", data)
    return open_media(spark, [where]).catalog()


def media_detail_vr5(spark: SparkSession, folder: str) -> DataFrame:
    """V-tracks with audio of a disc of the newer machine."""
    return _disc(spark, folder, "VR5", False).detail()


def media_events(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed events of a disk."""
    media = _disk(spark, folder)
    events = media.events.join(media.songs.select("song_seq", "number"), "song_seq")
    return events.select("number", "track", "vtrack", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "file_id")


def media_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """WAV files of a disc's tracks: paths, lengths, and digests of all samples as 32-bit numbers."""
    media = _disc(spark, folder, "VR9", True)
    return write_tracks(media.tracks(), media.samples(), f"{_shared(spark)}/out").select("song_key", "track", "vtrack", "file", "n_samples", "pcm_sha256")


def media_deviations(spark: SparkSession, folder: str) -> DataFrame:
    """Deviations of a disc without filler, with a missing take and an empty event: how many of each kind."""
    songs = _songs(spark, folder, "VR9")[:1]
    songs[0].events = [builder.Event(12, 40, 0x100), builder.Event(50, 60, 0x999), builder.Event(70, 70, 0x101)]
    path = _put(f"{_shared(spark)}/disc.bin", builder.raw(builder.archive_stream(songs, filler=False)))
    found = open_media(spark, [path]).deviations(scan=True)
    return found.groupBy("reference", "severity").agg(F.count(F.lit(1)).alias("n"))


def media_stereo_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Of three neighbouring tracks with equal events, the first two make a stereo pair."""
    songs = _songs(spark, folder, "VR5")[:1]
    songs[0].events = [builder.Event(a, a + 20, 0x100 + t % 3, t) for t in (1, 2, 3, 5) for a in (0, 30)]
    path = _put(f"{_shared(spark)}/disc.bin", builder.archive_stream(songs, "VR5"))
    return open_media(spark, [path]).pairs()


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("media_")}


def _events(origin: int) -> str:
    return f"""
    e AS (SELECT n_nationkey + 1 AS number, trim(n_name[:12]) AS name, k, {origin} + s % 40 AS a, {origin} + s % 40 + 30 + s % 25 AS b,
        CASE WHEN s % 7 = 0 THEN 0 ELSE 256 + s % 3 END AS take, 1 + s % 4 AS track, 1 + s % 2 AS vtrack,
        make_timestamp(2000 + s % 5, 1 + s % 12, 1 + s % 28, s % 24, 0, 0) AS stamp
        FROM nation LEFT JOIN (SELECT s_nationkey, s_suppkey::INT AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) ON s_nationkey = n_nationkey),
    t AS (SELECT number, name, track, vtrack, count(*) AS n, bool_or(take <> 0) AS audio, greatest(0, max(b - {origin})) AS frames, min(stamp) AS lo, max(stamp) AS hi
        FROM e WHERE k IS NOT NULL GROUP BY ALL),
    s AS (SELECT number, any_value(name) AS name, count(*) FILTER (audio) AS n_tracks, coalesce(max(frames) FILTER (audio), 0) AS frames, max(hi) AS hi
        FROM (SELECT DISTINCT number, name FROM e) LEFT JOIN t USING (number, name) GROUP BY number)"""


def _mmss(seconds: str) -> str:
    return f"({seconds} // 60) || ':' || lpad(({seconds} % 60)::VARCHAR, 2, '0')"


def _catalog(origin: int, machine: str, stamped: bool, key: str) -> str:
    modified = "coalesce(strftime(hi, '%Y-%m-%d %H:%M:%S'), '-')" if stamped else "'-'"
    seconds = "(frames * 16 // 44100)"
    return f"""WITH {_events(origin)} SELECT {key} AS song_key, number, '{machine}' AS machine, n_tracks, {seconds}::BIGINT AS seconds, {_mmss(seconds)} AS length,
        '-' AS created, '-' AS saved, {modified} AS modified, name FROM s"""


_DISK_KEY = "(1 + (number - 1) % 2) || '.' || ((number - 1) // 2)"
SQL = {
    "media_catalog_vr9": _catalog(12, "VR9", False, "number::VARCHAR"),
    "media_catalog_vr5": _catalog(0, "VR5", True, "number::VARCHAR"),
    "media_catalog_disk": _catalog(0, "VR5", True, _DISK_KEY),
    "media_catalog_set": _catalog(12, "VR9", False, "number::VARCHAR"),
    "media_detail_vr5": f"""WITH {_events(0)} SELECT number::VARCHAR AS song_key, track, vtrack, n AS n_events, (frames * 16 // 44100)::BIGINT AS seconds,
        strftime(lo, '%Y-%m-%d %H:%M:%S') AS first_stamp, strftime(hi, '%Y-%m-%d %H:%M:%S') AS last_stamp, '' AS name FROM t WHERE audio""",
    "media_events": f"WITH {_events(0)} SELECT number, track, vtrack, a::BIGINT AS start, b::BIGINT AS \"end\", take AS file_id FROM e WHERE k IS NOT NULL",
    # a frame of 16 samples sounds as the last event over it says; sample j of take t has the bytes (31 t + 2 j) % 251 and (31 t + 2 j + 1) % 251
    "media_tracks": f"""WITH {_events(12)},
    frame AS (SELECT number, track, vtrack, unnest(range(frames)) AS f FROM t WHERE audio),
    heard AS (SELECT frame.number, frame.track, frame.vtrack, f, arg_max(take, k) AS take, arg_max(a, k) AS a
        FROM frame LEFT JOIN e ON e.number = frame.number AND e.track = frame.track AND e.vtrack = frame.vtrack AND f >= a - 12 AND f < b - 12 GROUP BY ALL),
    sample AS (SELECT number, track, vtrack, f * 16 + i AS pos, CASE WHEN coalesce(take, 0) = 0 OR (f - a + 12) * 16 + i >= {TAKE} THEN 0 ELSE
            (31 * (take - 256) + 2 * ((f - a + 12) * 16 + i)) % 251 + 256 * ((31 * (take - 256) + 2 * ((f - a + 12) * 16 + i) + 1) % 251) END AS v
        FROM heard, (SELECT unnest(range(16)) AS i)),
    pcm AS (SELECT number, track, vtrack, sha256(unhex(string_agg(printf('%02X%02X', v % 256, v // 256) || CASE WHEN v >= 32768 THEN 'FFFF' ELSE '0000' END, '' ORDER BY pos))) AS pcm_sha256
        FROM sample GROUP BY ALL)
    SELECT number::VARCHAR AS song_key, track, vtrack, lpad(number::VARCHAR, 2, '0') || ' - ' || name || '/T' || track || '-V' || vtrack || '.wav' AS file,
        (frames * 16)::BIGINT AS n_samples, pcm_sha256 FROM t JOIN pcm USING (number, track, vtrack) WHERE audio""",
    "media_deviations": "SELECT reference, severity, n::BIGINT AS n FROM (VALUES ('§10', 1, 1), ('§10', 2, 1), ('§8', 1, 1)) v(reference, severity, n)",
    "media_stereo_pairs": 'SELECT song_seq::BIGINT AS song_seq, "left", "right" FROM (VALUES (0, 1, 2)) v(song_seq, "left", "right")',
}
