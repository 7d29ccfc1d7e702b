"""The error-detection code of raw CD frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytes import FRAME

#: The code's generator, reflected; bytes that it covers; where it stands. Fixed values.
GENERATOR, COVERED = 0xD8018001, 2064


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(GENERATOR), c >> 1)
    return c


_TABLE = _table()


def code_of(frames: np.ndarray) -> np.ndarray:
    """The code of each row of bytes: all rows advance together, byte by byte."""
    crc = np.zeros(len(frames), np.uint32)
    for column in frames.T:
        crc = crc >> 8 ^ _TABLE[(crc & 0xFF).astype(np.uint8) ^ column]
    return crc


def bad_frames(ranges: DataFrame) -> DataFrame:
    """(path, frame, unreadable) from `ranges`(path, offset, length, data) that start and end at frames: frames whose code doesn't fit, and all of a range whose data is null."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, numbers, lost = [], [], []
            for path, offset, length, data in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("path", "offset", "length", "data")), strict=True):
                if data is None:
                    bad = range(offset // FRAME, (offset + length) // FRAME)
                    paths += [path] * len(bad)
                    numbers += bad
                    lost += [True] * len(bad)
                    continue
                frames = np.frombuffer(data[: len(data) // FRAME * FRAME], np.uint8).reshape(-1, FRAME)
                stored = frames[:, COVERED : COVERED + 4].copy().view("<u4")[:, 0]
                bad = np.nonzero(code_of(frames[:, :COVERED]) != stored)[0] + offset // FRAME
                paths += [path] * len(bad)
                numbers += bad.tolist()
                lost += [False] * len(bad)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(numbers, pa.int64()), pa.array(lost, pa.bool_())], ["path", "frame", "unreadable"])

    return ranges.mapInArrow(check, "path string, frame long, unreadable boolean")
