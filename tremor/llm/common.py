"""What the operators of this package share: tables, staging and text buffers."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: White space of any kind beyond ASCII's six: such texts are split with WORD, all others by str.split.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_WORD, _SPACE = re.compile(WORD), re.compile(r"[\x20\x09-\x0D]")
#: The shared folder of a session in local mode that names none; a cluster must name its own.
LOCAL_SHARED = "/tmp/checkpoints"
#: Text bytes that a numpy kernel takes at once; one longer text is taken alone.
CHUNK_BYTES = 1 << 18
#: Texts that a Python kernel takes out of a record batch at once.
CHUNK_ROWS = 512
#: Code points of a very long text that are split into words at once.
PIECE = 1 << 20
#: While a table is staged: bytes of a record batch that goes to a Python worker, and shuffle
#: files go once the table is written, as nothing reads them again.
STAGING = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: Rows of a small table to a file, where their number is known before it is staged.
FILE_ROWS = 1 << 16
#: Tasks of a writing stage: so many a core, and one for so many bytes of its input, are enough.
WAVES, TASK_BYTES = 4, 1 << 23
#: A sieve has 2**SIEVE words of 64 bits at most, whatever the number of keys.
SIEVE = 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session gets one here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_SHARED)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def few_files(df: DataFrame) -> DataFrame:
    """df in no more tasks than its input's bytes and the cores ask for, so that partitions of next to nothing don't become as many files.

    A task computes its partitions one after the other, so none gets larger, and tasks grow in
    number with the input. Left alone where the number of cores may grow.
    """
    sc = df.sparkSession.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return df
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.coalesce(min(1 << 30, max(WAVES * sc.defaultParallelism, -(-size // TASK_BYTES))))


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df below the shared folder and read it back: a later loss of executors costs no recomputation.

    ``rows`` is about the most rows that df can have, where computing them is light: its last
    step then runs in as few tasks as there are files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tremor-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df = few_files(df) if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    with settings(spark, STAGING):
        df.write.parquet(path)
    found = spark.read.schema(schema).parquet(path)
    found.staged_at = path
    return found


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _sieve_place(key: str) -> tuple[Column, Column]:
    h = F.xxhash64(key, F.lit(77))
    return F.shiftrightunsigned(h, 64 - SIEVE), F.pmod(h, F.lit(64)).cast("int")


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """A Bloom filter with one hash: (word, bits), at most 2**SIEVE rows."""
    word, bit = _sieve_place(key)
    return keys.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def sift(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows whose key may be among the sieve's; a later join decides. 2**SIEVE rows are the broadcast's bound."""
    word, bit = _sieve_place(key)
    hit = df.withColumns({"sieve_word": word, "sieve_bit": bit}).join(F.broadcast(bits), F.col("sieve_word") == F.col("word"))
    return hit.where(F.call_function("shiftright", F.col("bits"), F.col("sieve_bit")).bitwiseAND(F.lit(1)) == 1).select(*df.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    col = col.cast(pa.large_binary())
    raw = col.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return data[first : offsets[-1] if len(offsets) else 0], offsets - first


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes and ``rows`` rows, a longer row alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n, i + rows)
        yield i, j
        i = j


def slices(part: pa.RecordBatch, rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """A record batch in smaller ones, so that Python objects of a few texts exist at a time."""
    for i in range(0, part.num_rows, rows):
        yield part.slice(i, rows)


def texts(col: pa.Array) -> list[str | None]:
    """A string column as Python values; bytes that are no UTF-8 become U+FFFD."""
    try:
        return col.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in col.cast(pa.binary()).to_pylist()]


def once(name: str, make: Callable[[], object]) -> object:
    """What a worker process makes once for all of its tasks.

    Functions come by value with the globals they use, made anew for each task; this store is a
    module of the process, so it stays.
    """
    store = sys.modules.setdefault("_made_once", ModuleType("_made_once")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """A text in pieces of about ``most`` code points; only ASCII white space parts them, so no word is cut."""
    i = 0
    while len(text) - i > most:
        cut = _SPACE.search(text, i + most)
        if cut is None:
            break
        yield text[i : cut.start()]
        i = cut.start()
    yield text[i:] if i else text


def split_words(text: str) -> list[str]:
    """The words of a text in order."""
    return _WORD.findall(text) if ODD_SPACE.search(text) else text.split()


def batches(tables: Iterable[dict[str, np.ndarray | pa.Array]]) -> Iterator[pa.RecordBatch]:
    """Record batches from dicts of equally long arrays; empty ones are left out."""
    for t in tables:
        cols = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in t.items()}
        if len(next(iter(cols.values()))):
            yield pa.RecordBatch.from_pydict(cols)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a byte buffer, eight bytes at a time.

    Each step is bijective in the state and in the eight bytes, so no two spans of up to eight
    bytes and one length collide, and longer ones do with the probability of random values.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    out = mix64(length.astype(np.uint64) + np.uint64(0x51_7C_C1_B7_27_22_0A_95))
    live, at = np.arange(len(starts)), starts.astype(np.int64)
    while len(live):
        left = ends[live] - at
        cut = (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)) % np.uint64(64)
        lane = lanes[at] << cut  # bytes beyond the end go
        out[live] = mix64(out[live] * np.uint64(0x9E3779B97F4A7C15) + lane)
        on = left > 8
        live, at = live[on], at[on] + 8
    return out
