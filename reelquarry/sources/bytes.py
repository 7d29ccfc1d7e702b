"""Random access to image files from executors: a table of byte ranges goes in, their bytes come out."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a block: the unit of archives, and of what a task reads at once.
BLOCK = 0x8000

#: CD frames: bytes of one, of what stands before its payload, of the payload.
FRAME, FRAME_HEAD, PAYLOAD = 2352, 16, 2048


@lru_cache(64)
def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@lru_cache(16)
def open_input(path: str) -> pa.NativeFile:
    """A path or URI opened for random access."""
    system, name = _file_system(path)
    return system.open_input_file(name)


def file_size(path: str) -> int:
    system, name = _file_system(path)
    info = system.get_file_info(name)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def list_files(path: str) -> list[str]:
    """A file itself; of a folder its files in lexical order, not those of folders in it."""
    system, name = _file_system(path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(name))
    names = sorted(x.path for x in found if x.type == fs.FileType.File)
    return [path.rstrip("/") + "/" + n.rsplit("/", 1)[-1] for n in names]


def geometry(size: int) -> str | None:
    """raw for whole frames (which wins ties), cooked for whole payloads, else none."""
    return None if size <= 0 else "raw" if size % FRAME == 0 else "cooked" if size % PAYLOAD == 0 else None


def user_length(size: int, kind: str) -> int:
    """Length of the stream of payloads."""
    return size if kind == "cooked" else size // FRAME * PAYLOAD


def read_user(path: str, kind: str, offset: int, length: int) -> bytes:
    """Bytes of the stream of payloads; fewer where the stream ends."""
    source = open_input(path)
    if kind != "raw":
        source.seek(offset)
        return source.read(length)
    first = offset // PAYLOAD
    frames = -(-(offset % PAYLOAD + length) // PAYLOAD)
    source.seek(first * FRAME)
    raw = source.read(frames * FRAME)
    data = b"".join(raw[k + FRAME_HEAD : k + FRAME_HEAD + PAYLOAD] for k in range(0, len(raw) - FRAME + 1, FRAME))
    start = offset % PAYLOAD
    return data[start : start + length]


def read_ranges(ranges: DataFrame, name: str = "data") -> DataFrame:
    """`ranges`(path, kind: raw, cooked or plain, offset, length, ...) with the bytes of each range.

    Ranges are read where their rows are, so the table's partitioning is that of the read. An unreadable range is null.
    """
    schema = T.StructType([*ranges.schema.fields, T.StructField(name, T.BinaryType())])
    places = [ranges.columns.index(c) for c in ("path", "kind", "offset", "length")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = []
                for path, kind, offset, length in zip(*(part.column(k).to_pylist() for k in places), strict=True):
                    try:
                        found.append(read_user(path, kind, offset, length))
                    except OSError:
                        found.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, name])

    return ranges.mapInArrow(read, schema)


def blocks(spark: SparkSession, files: DataFrame, span: int = BLOCK, first: int = 0) -> DataFrame:
    """(files' columns, offset, length, data) for each block of the stream: `files`(path, kind, user_length, ...).

    Only `span` bytes of each block are read. Blocks are dealt over tasks by their own number, so one large image is
    read by all of them.
    """
    count = F.ceil((F.col("user_length") - first) / BLOCK).cast("long")
    numbered = files.filter(count > 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    ranges = numbered.select(
        *files.columns,
        (F.col("block") * BLOCK + first).alias("offset"),
        F.least(F.lit(span).cast("long"), F.col("user_length") - (F.col("block") * BLOCK + first)).alias("length"),
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_ranges(ranges.repartition(tasks, "path", F.floor(F.col("offset") / (64 * BLOCK))))
