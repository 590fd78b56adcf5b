"""Exact top-k by inner product over a bit-sliced index.

Every component x becomes floor(scale * x). The rows are cut into blocks; a block's index
holds, per dimension, the bits of (value - least value) as bitmaps over its rows. For a
query, the score is a sum of these slices with integer weights: a slice counts once at
each bit of the query's component, complemented where the component is negative. A
carry-save adder over the bitmaps turns all of them into the bit slices of the score.
The best k rows are then selected from the most significant slice downward: rows that
are ahead are in, rows that tie go on, and what still ties at the last slice is resolved
by the smaller id. Blocks are independent; their best k are merged per query.

Index blocks stay where they are built; only the queries travel, to every block, as an exact
search over all rows needs. Where there are fewer blocks than partitions, a block is copied
so that each copy answers a part of the queries.

Rows whose vector is null, or holds a null or non-finite component, take no part. Shorter
vectors count as padded with zeros. Repeated ids are separate rows: a query skips every row
with its own id, each query row has a ranking of its own, and equal (score, id) pairs are
equal results. Fewer than k candidates
give fewer ranks; an empty table gives no rows. Other columns are not read. Scores must
fit in 62 bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few_files, partitions, stage, table, unstage

#: Rows of an index block, which bound a task's memory, and queries that a copy of one answers.
BLOCK_ROWS = 16384
BLOCK_QUERIES = 1 << 16
# Fixed values of the query.
SCALE = 64.0
TOP = 20
EVERY = 20


def _rows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a dense matrix, zero-padded."""
    lists = part.column(1)
    values, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    dense = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths)
    dense[at, np.arange(len(values)) - offsets[:-1][at]] = values
    return part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), dense


def build_slices(matrix: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(slices as packed words, bits per dimension, least value per dimension) of a block."""
    n = len(matrix)
    least = matrix.min(axis=0) if n else np.zeros(matrix.shape[1], np.int64)
    rest = matrix - least
    bits = [int(x).bit_length() for x in (rest.max(axis=0) if n else least)]
    size = -(-n // 64) * 8
    slices = np.zeros((sum(bits), size), np.uint8)
    k = 0
    for d, b in enumerate(bits):
        for i in range(b):
            packed = np.packbits((rest[:, d] >> i) & 1 == 1, bitorder="little")
            slices[k, : len(packed)] = packed
            k += 1
    return slices.view(np.uint64), bits, least


def score_slices(slices: np.ndarray, bits: list[int], least: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Bit slices of each row's score less a constant, and that constant."""
    weights: dict[int, list[np.ndarray]] = defaultdict(list)
    base, at = 0, 0
    for d, b in enumerate(bits):
        q = int(query[d])
        base += q * int(least[d])
        if q and b:
            own = slices[at : at + b]
            if q < 0:  # q * v = |q| * (2**b - 1 - v) - |q| * (2**b - 1)
                base += q * ((1 << b) - 1)
                own = ~own
            size = abs(q)
            for j in range(size.bit_length()):
                if size >> j & 1:
                    for i in range(b):
                        weights[i + j].append(own[i])
        at += b
    out: list[np.ndarray] = []
    w = 0
    while w <= max(weights, default=-1):
        todo = weights.get(w, [])
        if not todo:
            out.append(np.zeros(slices.shape[1], np.uint64))
            w += 1
            continue
        stack = np.stack(todo)
        carries = []
        while len(stack) > 2:  # full adders: three bitmaps of a weight give a sum and a carry
            third = len(stack) // 3
            a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
            ab = a ^ b
            carries.append((a & b) | (ab & c))
            stack = np.concatenate([ab ^ c, stack[3 * third :]])
        if len(stack) == 2:
            carries.append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        out.append(stack[0])
        for c in carries:
            weights[w + 1].extend(c)
        w += 1
    return out, base


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def select_top(score: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows; of ties at the boundary those that stand first."""
    sure, tied = np.zeros_like(valid), valid.copy()
    for s in reversed(score):
        ahead = tied & s
        if (n := _count(sure) + _count(ahead)) > k:
            tied = ahead
        elif n == k:
            sure, tied = sure | ahead, np.zeros_like(tied)
            break
        else:
            sure, tied = sure | ahead, tied & ~s
    first = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    rest = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))[: k - len(first)]
    return np.concatenate([first, rest])


def _value(score: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    for w, s in enumerate(score):
        out += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
    return out


def _pack(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a group as one index block: ids in order, slices, bits and least values."""
    for key, part in _by_key(groups):
        ids, m = _rows(part)
        order = np.argsort(ids, kind="stable")
        slices, bits, least = build_slices(m[order])
        yield pa.RecordBatch.from_pydict(
            {
                "k": pa.array([key], pa.int64()),
                "ids": pa.array([ids[order].tobytes()], pa.binary()),
                "bits": pa.array([bits], pa.list_(pa.int32())),
                "least": pa.array([least.tolist()], pa.list_(pa.int64())),
                "data": pa.array([slices.tobytes()], pa.binary()),
            }
        )


def _by_key(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches sorted by their first column, a key at a time; a key's rows are bounded."""
    held: list[pa.Table] = []
    now = None
    for part in parts:
        keys = part.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i < j:
                if held and keys[i] != now:
                    yield now, _one(held)
                    held = []
                now = int(keys[i])
                held.append(pa.Table.from_batches([part.slice(i, j - i)]))
    if held:
        yield now, _one(held)


def _one(held: list[pa.Table]) -> pa.RecordBatch:
    return pa.concat_tables(held).select([1, 2]).combine_chunks().to_batches()[0]


class Block:
    """An index block, to be searched by one query after the other."""

    def __init__(self, ids: bytes, bits: list[int], least: list[int], data: bytes):
        self.ids, self.bits, self.least = np.frombuffer(ids, np.int64), bits, np.array(least, np.int64)
        words = -(-len(self.ids) // 64)
        self.slices = np.frombuffer(data, np.uint64).reshape(sum(bits), words) if sum(bits) else np.zeros((0, words), np.uint64)
        self.every = np.packbits(np.arange(words * 64) < len(self.ids), bitorder="little").view(np.uint64)

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than those with the query's own id."""
        width = max(len(self.bits), len(query))
        query, least = np.pad(query, (0, width - len(query))), np.pad(self.least, (0, width - len(self.least)))
        score, base = score_slices(self.slices, self.bits + [0] * (width - len(self.bits)), least, query)
        valid = self.every.copy()
        for p in range(np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, side="right")):
            valid[p >> 6] &= ~np.uint64(1 << (p & 63))
        best = select_top(score, valid, k)
        return self.ids[best], _value(score, best) + base


def _search(k: int):
    """Rows by block: the index block first, its ``q`` is null, then the queries that it answers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block | None = None
        for part in parts:
            out = []
            qs, ids = part.column(0), part.column(1).to_pylist()
            values = part.column(2)
            for r in range(part.num_rows):
                if not qs[r].is_valid:
                    block = Block(*(part.column(i)[r].as_py() for i in range(3, 7)))
                elif block is not None:
                    found, score = block.top(ids[r], values[r].values.to_numpy(), k)
                    out.append((np.full(len(found), qs[r].as_py()), np.full(len(found), ids[r]), found, score))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
            yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("q", "query_id", "vec_id", "score"), cols, strict=True)})

    return run


def quantise(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of every component, null where the vector takes no part."""
    usable = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Both sides have (id long, v array<long>). One row per query and rank: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    vectors = stage(vectors, "topk-vectors")
    asked = stage(queries.withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    n_blocks, n_queries = max(1, -(-vectors.count() // block_rows)), asked.count()
    copies = max(1, min(n_queries, max(-(-partitions(spark) // n_blocks), -(-n_queries // block_queries))))

    def upto(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    keyed = vectors.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("k"), "id", "v")
    index = keyed.repartition(min(n_blocks, 4096), "k").sortWithinPartitions("k").mapInArrow(_pack, "k long, ids binary, bits array<int>, least array<long>, data binary")
    index = stage(index, "topk-index")
    none = F.lit(None)
    blocks = index.select("k", upto(copies).alias("copy"), none.cast("long").alias("q"), none.cast("long").alias("id"), none.cast("array<long>").alias("v"), "ids", "bits", "least", "data")
    sent = asked.select(upto(n_blocks).alias("k"), F.pmod(F.xxhash64("q"), F.lit(copies)).alias("copy"), "q", "id", "v", *(none.cast(t).alias(c) for c, t in (("ids", "binary"), ("bits", "array<int>"), ("least", "array<long>"), ("data", "binary"))))
    dealt = blocks.unionByName(sent).repartition(min(n_blocks * copies, 1 << 16), "k", "copy").sortWithinPartitions("k", "copy", F.col("q").asc_nulls_first())
    found = dealt.select("q", "id", "v", "ids", "bits", "least", "data").mapInArrow(_search(k), "q long, query_id long, vec_id long, score long")
    found = stage(found, "topk-found")
    unstage(vectors, asked, index)
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantise(F.col("embedding")).alias("v")).where("v is not null and id is not null")
    return few_files(top_k(rows, rows.where(F.col("id") % EVERY == 0)))


ORACLE_SQL = {
    "op9_top_k": """
WITH r AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r q JOIN r c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
""",
}
QUERIES = {"op9_top_k": op9_top_k}
