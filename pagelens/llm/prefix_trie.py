"""A trie of conversation prefixes, with a count-min screen before the exact grouping.

Every conversation is a sequence of turns; each distinct sequence of first d turns is a node. A prefix has a 127-bit digest, a
polynomial in the digests of its turns, so a digest can be carried on from any turn: a conversation may be cut by
a range partition anywhere, and a conversation that takes over the first turns of another is the other's digest and its own turns.

A count-min sketch of all prefix digests, of bounded size, goes to every task. It never counts too few, so an estimate of one proves
that no other conversation has the prefix: such nodes are given out where they are found. Only the other prefixes are shuffled
and grouped exactly. In what the screen lets through, a node belongs to the smallest conversation that has it; so the nodes of one
conversation are a chain from some depth to its end, and sums over subtrees are sums over members of what their chains hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, written

PRIME, BASE = (1 << 127) - 1, 0x5DEECE66D1234567890ABCDEF0F1E2D3
INVERSE = pow(BASE, -1, PRIME)
NOTHING = bytes(16)
#: Cells of a block of the sketch, two bits each; rows of the sketch.
BLOCK_CELLS, ROWS = 1 << 16, 4
#: Bytes of the sketch at most: that much is held by the driver and by every Python worker.
SKETCH_BYTES = 1 << 24
#: Characters of a piece of a list of members.
PIECE_CHARS = 1 << 16
#: Into how many parts a key is spread that holds more than one row in a thousand.
WAYS = 64


@lru_cache(1 << 16)
def power(k: int) -> int:
    return pow(BASE, k, PRIME)


def number(digest: bytes | None) -> int:
    return int.from_bytes(digest, "little") % PRIME if digest else 0


def digest(value: int) -> bytes:
    return value.to_bytes(16, "little")


def turns_of(conversations: DataFrame) -> DataFrame:
    """part, conv_id, i, value, own, n_bytes: the turns in order, numbered from 1 in each part of a conversation that one task holds.

    `value` is a digest of role and text, `own` that of the part's turns up to this one. Order: turn (null first), then value.
    Turns are dealt by range, so a conversation of any length is spread over tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    values = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(F.sha2(told.cast("binary"), 256), 1, 32)).alias("value"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("_row")
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "value", "_row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, i, h = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            place, own = [], []
            for conv, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if conv != last:
                    last, i, h = conv, 0, 0
                i += 1
                h = (h * BASE + number(value)) % PRIME
                place.append(i)
                own.append(digest(h))
            yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int32()), batch.column(0), pa.array(place, pa.int64()), batch.column(1), pa.array(own, pa.binary()), batch.column(2)], ["part", "conv_id", "i", "value", "own", "n_bytes"])

    sorted_rows = values.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "value", "n_bytes")
    return written(sorted_rows.mapInArrow(run, "part int, conv_id long, i long, value binary, own binary, n_bytes long"))


def ranked(turns: DataFrame) -> DataFrame:
    """conv_id, rank, value, own, n_bytes: turns numbered through their conversation, `own` the digest of all turns up to this one.

    What goes to the driver is two rows for each task that a conversation was cut between.
    """
    edges = sorted(tuple(r) for r in turns.groupBy("part").agg(F.min("conv_id"), F.max("conv_id")).collect())
    cut = sorted({b for (_, _, b), (_, a, _) in zip(edges, edges[1:], strict=False) if a == b})
    plain = turns.select("conv_id", F.col("i").alias("rank"), "value", "own", "n_bytes")
    if not cut:
        return plain
    spark = turns.sparkSession
    pieces = turns.join(F.broadcast(spark.createDataFrame([(c,) for c in cut], "conv_id long")), "conv_id").groupBy("conv_id", "part").agg(F.max("i").alias("n"), F.max_by("own", "i").alias("own"))
    before: dict[tuple[int, int], tuple[int, int]] = {}
    last, n, h = None, 0, 0
    for conv, part, count, own in sorted(tuple(r) for r in pieces.collect()):
        if conv != last:
            last, n, h = conv, 0, 0
        before[part, conv] = (n, h)
        n, h = n + count, (h * power(count) + number(own)) % PRIME

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, hashes = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key in before and before[key][0]:
                    n, h = before[key]
                    hashes[k] = digest((h * power(place[k]) + number(hashes[k])) % PRIME)
                    place[k] += n
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(place, pa.int64()), batch.column(3), pa.array(hashes, pa.binary()), batch.column(5)], ["conv_id", "rank", "value", "own", "n_bytes"])

    return turns.mapInArrow(run, "conv_id long, rank long, value binary, own binary, n_bytes long")


def spread(rows: DataFrame, unique: DataFrame, key: str, hot: DataFrame, by: str, how: str = "left") -> DataFrame:
    """rows joined with unique (one row for each key). The keys in `hot`, a thousand at most, are spread over tasks by the column `by`."""
    flag = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    left = rows.join(flag, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(WAYS))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    right = unique.join(flag, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(WAYS - 1)).cast("array<long>")).otherwise(F.array(F.lit(0).cast("long"))))).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def prefixes(conversations: DataFrame, head=None, family=None) -> DataFrame:
    """conv_id, depth, node, parent, n_bytes, is_end: every prefix of every conversation, the empty one included.

    `family` (Column to Column) names the conversation whose first `head` (0 to 8) turns a conversation takes in place of its own; without
    it, conversations are as they are. One that isn't there gives no turns.
    """
    turns = turns_of(conversations)
    whole = ranked(turns)
    convs = whole.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    if family is not None:
        convs = convs.withColumns({"family": family(F.col("conv_id")), "h": head(F.col("conv_id")).cast("long")}).withColumn("h", F.when(F.col("family") == F.col("conv_id"), F.lit(0).cast("long")).otherwise(F.col("h")))
    else:
        convs = convs.withColumns({"family": F.col("conv_id"), "h": F.lit(0).cast("long")})
    # A conversation's first turns, at most eight.
    first = whole.filter("rank <= 8").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("rank", "own", "n_bytes"))).alias("first"))
    records = convs.join(first, "conv_id").join(first.select(F.col("conv_id").alias("family"), F.col("first").alias("base")), "family", "left")
    records = records.withColumn("m", F.when(F.col("h") == 0, F.lit(0)).otherwise(F.least(F.col("h"), F.coalesce(F.size("base"), F.lit(0)))).cast("long")).withColumn("m", F.greatest(F.col("m"), F.lit(0)))
    nothing = F.lit(NOTHING)
    records = records.select(
        "conv_id", "n", "h", "m", F.when(F.col("m") > 0, F.get("base", (F.col("m") - 1).cast("int"))["own"]).otherwise(nothing).alias("taken"), F.when((F.col("h") > 0) & (F.col("n") > F.col("h")), F.get("first", (F.col("h") - 1).cast("int"))["own"]).otherwise(nothing).alias("left_out"), F.slice(F.coalesce("base", F.array().cast("array<struct<rank: bigint, own: binary, n_bytes: bigint>>")), 1, F.col("m").cast("int")).alias("base")
    )
    records = written(records)

    total = turns.count()
    hot = records.filter(F.col("n") > max(64, total // 1000)).select("conv_id")
    own = spread(whole, records.drop("base"), "conv_id", hot, "rank", "inner").filter("rank > h")
    names = ["conv_id", "depth", "node", "parent", "n_bytes", "is_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, parents = [], []
            for rank, value, own, h, taken, out in rows_of([batch], "rank", "value", "own", "h", "taken", "left_out"):
                node = (number(own) + (number(taken) - number(out)) * power(rank - h)) % PRIME
                nodes.append(digest(node))
                parents.append(digest((node - number(value)) * INVERSE % PRIME))
            at = [batch.schema.get_field_index(c) for c in ("conv_id", "depth", "n_bytes", "is_end")]
            yield pa.RecordBatch.from_arrays([batch.column(at[0]), batch.column(at[1]), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), batch.column(at[2]), batch.column(at[3])], names)

    schema = "conv_id long, depth long, node binary, parent binary, n_bytes long, is_end boolean"
    later = own.select("conv_id", (F.col("m") + F.col("rank") - F.col("h")).alias("depth"), "n_bytes", (F.col("rank") == F.col("n")).alias("is_end"), "rank", "value", "own", "h", "taken", "left_out").mapInArrow(run, schema)
    short = F.col("n") <= F.col("h")
    early = records.select("conv_id", "m", short.alias("short"), "base", F.explode("base").alias("x")).select("conv_id", F.col("x.rank").alias("depth"), F.col("x.own").alias("node"), F.when(F.col("x.rank") > 1, F.get("base", (F.col("x.rank") - 2).cast("int"))["own"]).otherwise(nothing).alias("parent"), F.col("x.n_bytes").alias("n_bytes"), (F.col("short") & (F.col("x.rank") == F.col("m"))).alias("is_end"))
    root = records.select("conv_id", F.lit(0).cast("long").alias("depth"), nothing.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_bytes"), (short & (F.col("m") == 0)).alias("is_end"))
    return written(later.unionByName(early).unionByName(root))


def cells(nodes: list[bytes] | pd.Series, width: int) -> np.ndarray:
    """For each digest its cell in each row of the sketch, counted through all rows."""
    found = np.frombuffer(b"".join(nodes), "<u4").reshape(-1, ROWS).astype(np.int64) & (width - 1)
    return found + np.arange(ROWS) * width


def sketch_width(prefixes: int, sketch_bytes: int) -> int:
    """Cells in a row: twice the prefixes as a power of two, as far as the bound allows."""
    most = max(BLOCK_CELLS, sketch_bytes * 4 // ROWS)
    return min(1 << (most.bit_length() - 1), max(BLOCK_CELLS, 1 << (2 * prefixes).bit_length()))


def sketch_of(rows: DataFrame, width: int) -> np.ndarray:
    """Counters 0, 1 and 2 (two or more), one byte each, of the digests in `node`.

    Each task counts its own rows; blocks of cells are added up by block. The driver gets one row a block, 2 bits a cell.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(ROWS * width, np.uint8)
        for batch in batches:
            if batch.num_rows:
                at, times = np.unique(cells(batch.column(0).to_pylist(), width), return_counts=True)
                held[at] = np.minimum(held[at] + np.minimum(times, 2), 2)
        for k, block in enumerate(held.reshape(-1, BLOCK_CELLS)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.compress(block.tobytes(), 1)], pa.binary())], ["block", "cells"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(BLOCK_CELLS, np.uint8)
        for data in pdf["cells"]:
            held = np.minimum(held + np.frombuffer(zstandard.decompress(data), np.uint8), 2)
        quarters = held.reshape(-1, 4)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "cells": [zstandard.compress((quarters << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes())]})

    schema = "block int, cells binary"
    found = np.zeros((ROWS * width // BLOCK_CELLS, BLOCK_CELLS), np.uint8)
    for block, data in rows.select("node").mapInArrow(count, schema).groupBy("block").applyInPandas(add, schema).collect():
        packed = np.frombuffer(zstandard.decompress(bytes(data)), np.uint8)
        found[block] = ((packed[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()
    return found.ravel()


def singleton(spark: SparkSession, sketch: np.ndarray):
    """Column to Column: whether the sketch proves that one row only has this digest."""
    shared = spark.sparkContext.broadcast(zstandard.compress(sketch.tobytes()))
    width = len(sketch) // ROWS
    held: list[np.ndarray] = []

    @F.pandas_udf("boolean")
    def single(nodes: pd.Series) -> pd.Series:
        if not held:
            held.append(np.frombuffer(zstandard.decompress(shared.value), np.uint8))
        known = nodes.notna().to_numpy()
        found = np.zeros(len(nodes), bool)
        if known.any():
            found[known] = held[0][cells(nodes[known].tolist(), width)].min(axis=1) == 1
        return pd.Series(found)

    return single


def member_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of (node, conv_id): the digest of the ids, ascending, comma-joined.

    Ids are joined to pieces where ranges of (node, id) put them; the pieces of a node are then hashed in order, one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size = None, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["node", "first", "ids"])

        for own, conv in rows_of(batches, "node", "conv_id"):
            if ids and (own != node or size > PIECE_CHARS):
                yield piece()
                ids, size = [], 0
            node = own
            ids.append(conv)
            size += 12
        if ids:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for own, ids in rows_of(batches, "node", "ids"):
            if own != node:
                if state:
                    yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])
                node, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    dealt = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, "node binary, first long, ids string")
    return dealt.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, head=None, family=None, sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    n_leaves counts the childless nodes below and at the node; saved_tokens adds up, for the same nodes, the members beyond the first
    times the bytes of the node's last text (what a cache of the prefix saves, in byte tokens). ends_sha256 is of the conversations that end at the node.
    Turns are ordered by turn, null first, then by a digest of role and text; null role and text are empty. Rows without a conv_id belong to no conversation
    and give nothing; repeated rows are turns each for itself. Only conv_id, turn, role and text are read. No rows give no rows, not even a root.
    `sketch_bytes` bounds the sketch: with more prefixes than it can part, more of them are grouped exactly, and the result is the same.
    """
    spark = conversations.sparkSession
    rows = prefixes(conversations, head, family)
    below = rows.filter("depth > 0")
    single = singleton(spark, sketch_of(below, sketch_width(below.count(), sketch_bytes)))
    rows = written(rows.withColumn("single", (F.col("depth") > 0) & single("node")).withColumn("tail", (F.col("depth") > 1) & single("parent")))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    tails, open_rows = rows.filter("single"), rows.filter("not single")

    nodes = open_rows.groupBy("node", "parent", "depth", "tail").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"))
    nodes = written(nodes)
    begins = tails.filter("not tail")
    children = nodes.filter("parent is not null").select("parent").unionAll(begins.select("parent")).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    total = rows.count()
    nodes = written(nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").fillna(0, ["n_children"]).withColumn("worth", (F.col("n_convs") - 1) * F.col("n_bytes")))

    # What each conversation's chain holds.
    chains = nodes.select("conv_id", "worth", (F.col("n_children") == 0).cast("long").alias("leaf")).filter("worth > 0 or leaf > 0").unionByName(tails.filter("is_end").select("conv_id", F.lit(0).cast("long").alias("worth"), F.lit(1).cast("long").alias("leaf")))
    chains = chains.groupBy("conv_id").agg(F.sum("worth").alias("worth"), F.sum("leaf").alias("leaf"))
    long_ones = rows.groupBy("conv_id").count().filter(F.col("count") > max(64, total // 1000)).select("conv_id")
    sums = spread(open_rows.select("conv_id", "node", "depth"), chains, "conv_id", long_ones, "depth", "inner").groupBy("node").agg(F.sum("worth").alias("all_worth"), F.sum("leaf").alias("n_leaves"))
    above = F.sum("worth").over(_chain_before())
    nodes = nodes.withColumn("above", F.coalesce(above, F.lit(0)))

    # The parent's smallest member, of nodes and of tails that begin below a node.
    hot = nodes.filter(F.col("n_children") > max(64, total // 1000)).select(F.col("node").alias("parent"))
    owners = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    known = nodes.join(sums, "node", "left").join(member_digests(open_rows.filter("is_end")), "node", "left")
    known = known.select("conv_id", "depth", "parent", "tail", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), (F.coalesce("all_worth", F.lit(0)) - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    one, nil = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = tails.select("conv_id", "depth", "parent", "tail", one.alias("n_convs"), F.when(F.col("is_end"), nil).otherwise(one).alias("n_children"), one.alias("n_leaves"), nil.alias("saved_tokens"), F.when(F.col("is_end"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(empty).alias("ends_sha256"))
    placed = spread(known.unionByName(alone.filter("not tail")).filter("not tail"), owners, "parent", hot, "conv_id")
    within = known.filter("tail").unionByName(alone.filter("tail")).withColumn("parent_conv_id", F.col("conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return placed.select(out).unionByName(within.select(out))


def _chain_before():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
