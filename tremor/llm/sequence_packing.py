"""Best-fit packing into sequences of several permitted lengths.

Every document is cut into pieces of at most the largest permitted length. Pieces go to
shards at random by their hash, about SHARD_ROWS to a shard. A shard takes its pieces from
long to short. A piece goes into the open bin that it leaves least room in; where none has
room, a bin opens in the size that costs least per word: the room it would leave, less what
the shorter pieces still to come could fill, plus a fixed cost. Bins close with a shard,
and each is at last downsized to the least permitted length that holds its contents, so
rooms that stayed empty cost nothing.

Null and empty texts have no words and get no piece. Repeated rows are separate documents
with pieces of their own, which a number among equal rows tells apart, so the result does
not depend on how the rows lie in files; null ids are allowed; other columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_files, stage, table, words

SIZES = (512, 1024, 2048, 4096)
SHARD_ROWS = 20_000
#: Fixed cost of a bin, in words: it favours few, large sequences.
BIN_COST = 8


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES, bin_cost: float = BIN_COST) -> tuple[list[int], list[int], list[int]]:
    """For lengths from long to short: (bin, offset) of each piece, and each bin's final size.

    Open bins are kept by their room, so a piece finds its best fit by bisection.
    """
    rest, open_room = sum(lengths), 0
    rooms: list[tuple[int, int]] = []  # (room, bin)
    used: list[int] = []
    where, offset = [], []
    for n in lengths:
        rest -= n
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
            open_room -= room
        else:
            free = max(0, rest - open_room)  # words to come that no open bin can take
            size = min((s for s in sizes if s >= n), key=lambda s: ((s - n) - min(s - n, free) + bin_cost) / s)
            b, room = len(used), size
            used.append(0)
        where.append(b)
        offset.append(used[b])
        used[b] += n
        if room > n:
            insort(rooms, (room - n, b))
            open_room += room - n
    return where, offset, [sizes[bisect_left(sizes, u)] for u in used]


def _pack_shards(sizes: tuple[int, ...]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            where, offset, final = pack(t.column("length").to_pylist(), sizes)
            shard = t.column("shard")[0].as_py()
            fill = np.bincount(where, weights=t.column("length").to_numpy(), minlength=len(final)).astype(np.int64)
            w = np.array(where)
            return pa.RecordBatch.from_pydict(
                {
                    "bin_id": pa.array(w.astype(np.int64) + (shard << 32)),
                    "bin_size": pa.array(np.array(final, np.int32)[w]),
                    "bin_used": pa.array(fill[w]),
                    "doc_id": t.column("doc_id").combine_chunks(),
                    "piece": t.column("piece").combine_chunks(),
                    "start": t.column("start").combine_chunks(),
                    "length": t.column("length").combine_chunks(),
                    "offset": pa.array(offset, pa.int32()),
                }
            )

        for part in parts:
            shards = part.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), part.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j:
                    if held and held[-1].column(0)[0].as_py() != int(shards[i]):
                        yield done()
                        held.clear()
                    held.append(part.slice(i, j - i))
        if held:
            yield done()

    return run


def pack_documents(docs: DataFrame, sizes: tuple[int, ...] = SIZES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: bin_id, bin_size, bin_used, doc_id, piece, start, length, offset (in words)."""
    most = sizes[-1]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("n"), F.xxhash64("text").alias("t")).where("n > 0")
    # equal rows are one row with a count up to here; numbered, their copies don't share a shard
    rows = rows.groupBy("doc_id", "n", "t").agg(F.count(F.lit(1)).alias("copies"))
    pieces = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / most) - 1).cast("int"))))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * most).withColumn("length", F.least(F.col("n") - F.col("start"), F.lit(most)).cast("int"))
    pieces = stage(pieces.withColumn("spread", F.xxhash64("doc_id", "t", "piece", "copy")).drop("copies"), "pack-pieces")
    shards = max(1, math.ceil(pieces.count() / shard_rows))
    dealt = pieces.select(F.pmod("spread", F.lit(shards)).alias("shard"), F.col("length").alias("length"), "doc_id", "piece", "start", "spread")
    dealt = dealt.repartition(min(shards, 1 << 16), "shard").sortWithinPartitions("shard", F.col("length").desc(), "doc_id", "piece", "spread").drop("spread")
    return dealt.mapInArrow(_pack_shards(sizes), "bin_id long, bin_size int, bin_used long, doc_id long, piece int, start long, length int, offset int")


def op8_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(pack_documents(table(spark, sf_dir, "documents")))


QUERIES = {"op8_sequence_packing": op8_sequence_packing}
