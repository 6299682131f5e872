"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that separate words: U+0020 and U+0009 to U+000D.
SPACES = bytes([32, *range(9, 14)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or one in the warehouse where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/pagelens-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a small or middling table; its files go when the result is no longer referenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def written(df: DataFrame) -> DataFrame:
    """Writes a large table, compressed, into the shared folder and reads it again. The files go by forget() or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pagelens-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    store, target = _filesystem(spark, path)
    store.deleteOnExit(target)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_path = path
    return found


def forget(*tables: DataFrame) -> None:
    """Removes the files of written() tables that nothing reads any more."""
    for df in tables:
        store, target = _filesystem(df.sparkSession, df._written_path)
        store.delete(target, True)


def few(df: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A table of some numbers for the small side of a join: marked for broadcast if it has at most `most` rows, else left to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text):
    """Lower-cases A to Z and nothing else (Column to Column)."""
    return F.translate(text, UPPER, UPPER.lower())


def fold_of(doc_id, modulus: int):
    """crc32 of the id as text, modulo `modulus`; a null id is in fold -1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)), F.lit(-1))


def words(text: str | None) -> list[bytes]:
    """The lower-cased (A to Z) words of a text as UTF-8; bytes.split() knows exactly the six separators of SPACES."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches, a few hundred at a time as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
