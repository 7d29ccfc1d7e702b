"""What the operators of this subpackage share: column access, Arrow batches, tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Batches hold whole texts, so this bounds what a Python worker holds at a time.
BATCH_ROWS = 256
#: Bytes in an Arrow batch, where the Spark version can bound them.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Set the size of Arrow batches for text columns."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(name: str) -> Column:
    """The text column as bytes: workers then need not decode what they only split or hash."""
    return column(name).cast("string").cast("binary")


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a temporary one if unset and Spark runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="reelquarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends there, and the optimizer knows the table's true size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._reelquarry_path = path
    return again


def discard(df: DataFrame) -> None:
    """Delete a table that written() made and that nothing reads any more."""
    path = getattr(df, "_reelquarry_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Bits of a filter of keys, at most, as a power of two: what the driver collects for it is bounded.
MOST_FILTER_BITS = 22


def may_hold(keys: DataFrame, name: str = "key") -> Callable[[Column], Column]:
    """A test of a long column that is true for all `keys`(name: long, spread over all bits as hashes are), and false for most others.

    Rows that fail it need no join with what has these keys, so they need not be shuffled. A table with very many keys fills
    the filter, and then more rows are joined in vain.
    """
    count = keys.agg(F.approx_count_distinct(name)).first()[0]
    bits = min(MOST_FILTER_BITS, max(10, (16 * count).bit_length()))
    place = lambda key: F.shiftrightunsigned(key, 64 - bits)
    low = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(`{name}`, {64 - bits}) % 32 AS INT))")
    words = keys.select(F.shiftright(place(F.col(name)), 5).cast("int").alias("k"), low.alias("b")).groupBy("k").agg(F.bit_or("b").alias("b"))
    found = bytearray(1 << bits - 3)
    for k, b in words.collect():
        found[4 * k : 4 * k + 4] = b.to_bytes(4, "little")
    held = F.lit(bytes(found))

    def test(key: Column) -> Column:
        byte = F.conv(F.hex(F.substring(held, (F.shiftright(place(key), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        return F.getbit(byte, (place(key) % 8).cast("int")) == 1

    return test


def without(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose key, a long and no null, is not in `keys`(key). Only rows that may have one of the keys are shuffled."""
    test, marked = may_hold(keys), rows.withColumn("__key", key)
    rest = marked.filter(test(F.col("__key"))).join(keys.select(F.col("key").alias("__key")), "__key", "left_anti")
    return marked.filter(~test(F.col("__key"))).union(rest.select(*[column(c) for c in marked.columns])).drop("__key")
