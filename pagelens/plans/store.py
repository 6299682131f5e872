"""Tables written once where several parts of a plan read them: a node table that ten rules join with itself would otherwise be parsed ten times, and plans would double with each join."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table of files that Spark may broadcast by its own estimate.
MOST_ROWS = 20_000
#: Whether a statement's shuffle files go as soon as it has ended, not only when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def by_rows(df: DataFrame) -> DataFrame:
    """df, a table of files, marked for sort-merge joins if it has more than MOST_ROWS rows.

    Spark's estimate is the size of the compressed files, less the share of columns that aren't read: repetitive markup and keys in order take a tenth of their size or less there, and what looks small is gathered and hashed in the driver as a whole. Rows are counted from
    the files' footers. A side marked by F.broadcast still is broadcast.
    """
    return df.hint("merge") if df.count() > MOST_ROWS else df


def stored(df: DataFrame) -> DataFrame:
    """The rows of df from a Parquet table in the folder that all executors share (spark.checkpoint.dir, or the warehouse where that is unset). It goes when the driver ends; what was shuffled to make it goes at once."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/nodes-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    found = by_rows(spark.read.schema(df.schema).parquet(path))
    found._stored_at = target
    return found


def released(*tables: DataFrame) -> None:
    """Removes the files of stored() tables that nothing will read any more: what was made of them is stored itself."""
    for df in tables:
        df._stored_at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(df._stored_at, True)


def beside(df: DataFrame, sides: Sequence[DataFrame], keys: Sequence[str] = ("page_id", "pre")) -> DataFrame:
    """df with the other columns of all `sides`, null where a side has no row of the keys. A side has one row of each key at most.

    The sides are written as one table and joined once. A join for each of them would make one plan of them all, which Spark plans anew after each of its
    stages: it takes more of the driver's memory than the rows do.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    one = stored(rows.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in rows.columns if c not in keys)))
    return df.join(one, [*keys], "left")
