"""Tracks as WAV files: pieces of samples come in order and are written through, with silence where there is none."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes import _file_system

#: Samples of silence written at once.
_STEP = 1 << 16


def header(n_samples: int, rate: int, bits: int, channels: int = 1) -> bytes:
    """RIFF, format and data heads. An odd length of data is padded, which the outer size counts and the inner does not."""
    if rate <= 0 or channels not in (1, 2) or bits not in (16, 24):
        raise ValueError("WAV takes a positive rate, one or two channels, 16 or 24 bits")
    width = bits // 8 * channels
    size = n_samples * width
    return b"RIFF" + struct.pack("<I", 36 + size + size % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * width, width, bits) + b"data" + struct.pack("<I", size)


def encode(samples: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return samples.astype("<i2").tobytes()
    return samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


class _Channels:
    """Samples of one or two channels that come in pieces, by place: what all channels have is written, silence fills gaps.

    A piece that starts at a place says that no channel has anything more before it, so at most a piece is held back.
    """

    def __init__(self, out, count: int, bits: int) -> None:
        self.out, self.bits, self.digest, self.done = out, bits, hashlib.sha256(), 0
        self.held: list[list[np.ndarray]] = [[] for _ in range(count)]
        self.ends = [0] * count

    def put(self, channel: int, at: int, part: np.ndarray, most: int) -> None:
        self.fill(at)
        part = part[: max(0, most - self.ends[channel])]
        self.held[channel].append(part)
        self.ends[channel] += len(part)

    def fill(self, until: int) -> None:
        """Silence in every channel up to a place; then all up to there is whole."""
        while min(self.ends) < until:
            upto = min(until, min(self.ends) + _STEP)
            for k, end in enumerate(self.ends):
                if end < upto:
                    self.held[k].append(np.zeros(upto - end, "<i4"))
                    self.ends[k] = upto
            self._flush()
        self._flush()

    def _flush(self) -> None:
        count = min(self.ends) - self.done
        if count <= 0:
            return
        columns = []
        for k, parts in enumerate(self.held):
            whole = np.concatenate(parts)
            columns.append(whole[:count])
            self.held[k] = [whole[count:]]
        frames = np.stack(columns, axis=1).astype("<i4").reshape(-1)
        self.out.write(encode(frames, self.bits))
        self.digest.update(frames.tobytes())
        self.done += count


def write_tracks(tracks: DataFrame, samples: DataFrame, folder: str) -> DataFrame:
    """(song_key, track, vtrack, file, n_samples, pcm_sha256) of the files written below `folder`, a path or URI that all share.

    `tracks` has a row a file; its pair_group, if not null, is the group that is the right channel. A file's pieces meet in
    one task, sorted, and pass through it; it is overwritten whole, so a task may run again.
    """
    keys, names = ["song_seq", "group_seq"], ["song_key", "track", "vtrack", "file", "n_samples", "pcm_sha256"]
    parts = samples.select("song_seq", F.col("group_seq").alias("part"), "dst_from", "pcm")
    channels = F.array(F.col("group_seq"), F.col("pair_group"))
    heads = tracks.select(*keys, "song_key", "track", "vtrack", "file", "rate", "bits", "n_samples", F.col("pair_group").isNotNull().alias("stereo"), F.posexplode(channels).alias("channel", "part"))
    rows = heads.filter("part IS NOT NULL").join(parts, ["song_seq", "part"], "left")
    schema = pa.schema([("song_key", pa.string()), ("track", pa.int32()), ("vtrack", pa.int32()), ("file", pa.string()), ("n_samples", pa.int64()), ("pcm_sha256", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, made = None, None, None

        def close() -> Iterator[pa.RecordBatch]:
            if now is not None:
                made.fill(now["n_samples"])
                if now["n_samples"] * len(made.ends) * now["bits"] // 8 % 2:
                    out.write(b"\0")
                out.close()
                yield pa.RecordBatch.from_pylist([{k: now[k] for k in names[:5]} | {"pcm_sha256": made.digest.hexdigest()}], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or (row["song_seq"], row["group_seq"]) != (now["song_seq"], now["group_seq"]):
                    yield from close()
                    now = row
                    system, base = _file_system(folder.rstrip("/") + "/" + row["file"])
                    system.create_dir(base.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(base)
                    out.write(header(row["n_samples"], row["rate"], row["bits"], 1 + row["stereo"]))
                    made = _Channels(out, 1 + row["stereo"], row["bits"])
                if row["pcm"] is not None:
                    made.put(row["channel"], row["dst_from"], np.frombuffer(row["pcm"], "<i4"), now["n_samples"])
        yield from close()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("dst_from").asc_nulls_first(), "channel")
    return dealt.mapInArrow(write, "song_key string, track int, vtrack int, file string, n_samples long, pcm_sha256 string")
