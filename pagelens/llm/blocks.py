"""Counting of keys over a corpus without a row for each occurrence.

Documents are gathered, where they lie, into blocks of a few megabytes. A block sends the sorted distinct 64-bit keys of
its content, cut into shards of the key range, and each shard answers every block for its own keys: one shuffle of
packed keys, one of packed answers. Keys that are frequent everywhere come at most once from each block, so no shard is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 8_000_000
#: Blocks whose keys one shard holds, on average.
BLOCKS_PER_SHARD = 2


def planes(values: np.ndarray) -> bytes:
    """64-bit values byte by byte, all lowest bytes first: what compresses well."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def gather(docs: DataFrame, by: str | None = None) -> DataFrame:
    """block, part, payload: the rows of docs, whose `text` isn't null, in blocks; rows with different values of the boolean `by` (as `part`) are in different blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq = TaskContext.get().partitionId() << 24, 0
        waiting: dict[bool, tuple[list[pa.Table], int]] = {False: ([], 0), True: ([], 0)}

        def block(part: bool) -> pa.RecordBatch:
            nonlocal seq
            tables, _ = waiting[part]
            waiting[part] = ([], 0)
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([first + seq]), pa.array([part]), pa.array([pack(pa.concat_tables(tables))], pa.binary())], ["block", "part", "payload"])

        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for part in (False, True) if by else (False,):
                rows = whole.filter(pc.equal(whole[by], part)) if by else whole
                sizes = np.cumsum(pc.binary_length(rows["text"]).to_numpy()) if rows.num_rows else np.zeros(0)
                begin = 0
                while begin < rows.num_rows:
                    tables, held = waiting[part]
                    before = sizes[begin - 1] if begin else 0
                    end = min(rows.num_rows, max(begin + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES - held, "right"))))
                    tables.append(rows.slice(begin, end - begin))
                    waiting[part] = (tables, held + int(sizes[end - 1] - before))
                    begin = end
                    if waiting[part][1] >= BLOCK_BYTES or begin < rows.num_rows:
                        yield block(part)
        for part, (tables, _) in list(waiting.items()):
            if tables:
                yield block(part)

    return written(docs.mapInArrow(run, "block long, part boolean, payload binary"))


def shards(keys: np.ndarray, count: int) -> np.ndarray:
    """Where each shard of the sorted keys begins, and the end."""
    edges = [(s << 64) // count for s in range(1, count)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)])).astype(np.int64)


def exchange(blocks: DataFrame, ask: Callable[[pa.Table, bool], list[tuple[int, np.ndarray, list[np.ndarray]]]], answer: Callable[[int, np.ndarray, list[list[np.ndarray]], np.ndarray], list[list[np.ndarray]]], count: int) -> DataFrame:
    """block, level, shard, data: what the shards answer.

    ask(rows, part) gives for each level (sorted distinct keys, arrays of values). answer(level, keys, values, parts) gets a shard's
    distinct sorted keys, for each block (its keys' places among them, its values), and returns for each block its arrays. Rows with
    block -1 hold what answer returns beyond the blocks.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, part = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for level, keys, values in ask(unpack(batch.column(2)[i].as_py()), part):
                    cuts = shards(keys, count)
                    held = np.flatnonzero(np.diff(cuts))
                    cols = [[], *([] for _ in range(2))]
                    for s in held.tolist():
                        a, b = cuts[s], cuts[s + 1]
                        cols[0].append(s)
                        cols[1].append(planes(keys[a:b]))
                        cols[2].append([planes(v[a:b]) for v in values])
                    n = len(held)
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array([block] * n), pa.array([part] * n), pa.array([level] * n, pa.int32()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.list_(pa.binary()))], ["block", "part", "level", "shard", "keys", "values"])

    def reply(pdf: pd.DataFrame) -> pd.DataFrame:
        level, shard = int(pdf["level"].iloc[0]), int(pdf["shard"].iloc[0])
        parts = [unplanes(k) for k in pdf["keys"]]
        sizes = [len(p) for p in parts]
        distinct, places = np.unique(np.concatenate(parts), return_inverse=True)
        places = np.split(places, np.cumsum(sizes)[:-1])
        values = [[p, *(unplanes(v) for v in vs)] for p, vs in zip(places, pdf["values"], strict=True)]
        out = answer(level, distinct, values, pdf["part"].to_numpy())
        ids = [*pdf["block"].tolist(), *[-1] * (len(out) - len(parts))]
        return pd.DataFrame({"block": ids, "level": level, "shard": shard, "data": [[planes(np.asarray(a)) for a in arrays] for arrays in out]})

    sent = blocks.mapInArrow(send, "block long, part boolean, level int, shard int, keys binary, values array<binary>")
    return sent.groupBy("level", "shard").applyInPandas(reply, "block long, level int, shard int, data array<binary>")


def answers(pdf: pd.DataFrame, level: int) -> list[np.ndarray]:
    """A block's answers for all its keys of a level, in the keys' order."""
    rows = pdf[pdf["level"] == level].sort_values("shard")["data"].tolist()
    return [np.concatenate([unplanes(r[k]) for r in rows]) for k in range(len(rows[0]))] if rows else []


def shard_count(blocks: DataFrame) -> int:
    return max(8, blocks.count() // BLOCKS_PER_SHARD)


def each(blocks: DataFrame, replies: DataFrame, use: Callable[[pa.Table, bool, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """use(rows, part, answers) for every block."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = [use(unpack(row.payload), bool(row.part), right) for row in left.itertuples()]
        return made[0] if made else pd.DataFrame()

    return blocks.groupBy("block").cogroup(replies.filter(F.col("block") >= 0).groupBy("block")).applyInPandas(run, schema)
