"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every start of a WIDTH-byte string is a suffix to be ordered through WIDTH bytes; those
that end in groups of two or more are repeated. The most significant digits come first and
only suffixes in groups that are still shared go on:

1. The first digit is content-defined: of the GRAM-byte strings in a suffix's WIDTH bytes,
   the one with the least hash (the leftmost of equal ones). Equal suffixes have equal
   digits at equal distances. Consecutive suffixes with one digit form a run, so the sort
   carries one row per run, about one per (WIDTH - GRAM) / 2 bytes, instead of one per byte.
   A digit that occurs in one run only ends there: its suffixes are unique.
2. The second digit is the run's whole content. Runs of a digit that all agree are
   repeated as a whole, and need no further order.
3. Of what is left, one run of each content is ordered by the remaining bytes, PASS_BYTES
   at a time, suffix by suffix; groups of one drop out after each pass. A digit with up to
   FEW contents is sorted inside a task; a more frequent one is sorted across tasks, in
   blocks of neighbouring suffixes that get finer where they stay undecided.

Contents, cores and wholes are compared by BLAKE2b digests of 64 bits within one digit, the
suffixes of a task by their bytes. The bytes to remove are those of the repeated suffixes'
windows; matches never cross documents.

Null is the empty text; texts below WIDTH bytes keep all bytes. Repeated rows are separate
documents, so their texts are removed in full if long enough; they share an internal key
of id and text, under which equal rows have equal results. Null ids are allowed. Other
columns are not read. A text's own arrays are built CHUNK_BYTES at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, batches, buffers, chunks, few_files, mix64, slices, stage, table, unstage

# Fixed value of the query: bytes of a repeated string.
WIDTH = 200
GRAM = 32
PASS_BYTES = 50
#: Contents of one digit that a task sorts by itself.
FEW = 256
#: Suffixes to a block, from coarse to fine, where a digit's contents are sorted across tasks.
STEPS = (16, 4, 1)
#: Suffixes that a task sorts at once.
BATCH_SUFFIXES = 100_000
#: Bits of a place in a buffer: the others of a 64-bit word order the digits, alike in every buffer.
PLACE_BITS = np.uint64(int(2 * CHUNK_BYTES).bit_length())


class Rolling:
    """Hashes of any span of a byte buffer from prefix sums of a random polynomial modulo 2**64.

    The base is odd, hence invertible, so a span's sum can be shifted to a common origin. There
    are fixed pairs of different strings with equal sums under this modulus, so these hashes
    only sort suffixes into groups that are split further: by ``digests`` or by their bytes.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(2**60, 2**63, dtype=np.int64)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, b, np.uint64)]), dtype=np.uint64) for b in (self.base, self.inverse))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((prefix[ends] - prefix[starts]) * self.down[starts])


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """BLAKE2b digests of spans of a byte buffer as 64-bit integers; they tell contents of one digit apart."""
    view, size = memoryview(np.ascontiguousarray(data)), {"digest_size": 8}
    found = b"".join([hashlib.blake2b(view[a:b], **size).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(found, np.int64)


def _windows(data: np.ndarray, offsets: np.ndarray, width: int, gram: int, roll: Rolling) -> dict[str, np.ndarray]:
    """Runs of suffixes with one digit: owner row, first start, number, digit and content."""
    starts_ok = np.repeat(offsets[1:] - width, np.maximum(np.diff(offsets), 0))
    n = len(data) - width + 1
    empty = {k: np.empty(0, np.int64) for k in ("row", "start", "count", "digit", "content")}
    if n <= 0:
        return empty
    prefix = roll.prefix(data)
    at = np.arange(len(data) - gram + 1)
    grams = roll.spans(prefix, at, at + gram)
    keyed = (grams >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64)
    w = width - gram + 1
    pad = -len(keyed) % w
    blocks = np.concatenate([keyed, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    good = np.flatnonzero(np.arange(n) <= starts_ok[:n])
    if not len(good):
        return empty
    anchor = least[good]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(good) != 1)])
    first = good[new]
    count = np.diff(np.concatenate([np.flatnonzero(new), [len(good)]]))
    row = np.searchsorted(offsets, first, side="right") - 1
    content = digests(data, first, first + count + width - 1)
    return {"row": row, "start": first - offsets[row], "count": count, "digit": grams[anchor[new]].view(np.int64), "content": content}


def _runs(width: int, gram: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling(1)
        for part in parts:
            data, offsets = buffers(part.column(2))
            keys = [part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]

            def rows(found: dict, base: int, shift: int, keys: list = keys) -> dict:
                own = found["row"] + base
                return {"k": keys[0][own], "t": keys[1][own], "start": found["start"] + shift, "count": found["count"].astype(np.int32), "digit": found["digit"], "content": found["content"]}

            for i, j in chunks(offsets):
                a, b = offsets[i], offsets[j]
                if b - a <= 2 * CHUNK_BYTES:
                    yield from batches([rows(_windows(data[a:b], offsets[i : j + 1] - a, width, gram, roll), i, 0)])
                    continue
                for s in range(a, b, CHUNK_BYTES):  # a very long text; a cut run is two runs of one digit
                    e = min(b, s + CHUNK_BYTES + width - 1)
                    yield from batches([rows(_windows(data[s:e], np.array([0, e - s]), width, gram, roll), i, s - a)])

    return run


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the true stretches."""
    d = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def repeated_suffixes(group: np.ndarray, data: np.ndarray, at: np.ndarray, width: int, roll: Rolling) -> np.ndarray:
    """Which of the suffixes that start at ``at`` agree through ``width`` bytes with another of their group.

    Most-significant-digit passes over what is left; a pass refines the groups and drops
    those of one. The last one compares bytes, a slice of the groups at a time.
    """
    prefix = roll.prefix(data)
    alive = np.arange(len(at))
    for depth in range(0, width, PASS_BYTES):
        if not len(alive):
            break
        end = min(width, depth + PASS_BYTES)
        digit = roll.spans(prefix, at[alive] + depth, at[alive] + end)
        order = np.lexsort((digit, group))
        g, d = group[order], digit[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
        name = np.cumsum(new) - 1
        shared = np.bincount(name)[name] > 1
        alive, group = alive[order][shared], name[shared]
    out = np.zeros(len(at), bool)
    for s in range(0, len(alive), BATCH_SUFFIXES):
        # a slice starts with the member before it, so that neighbours of one group are compared
        own = alive[max(0, s - 1) : s + BATCH_SUFFIXES + 1]
        name = group[max(0, s - 1) : s + BATCH_SUFFIXES + 1]
        bytes_ = np.lib.stride_tricks.sliding_window_view(data, width)[at[own]]
        same = (name[1:] == name[:-1]) & (bytes_[1:] == bytes_[:-1]).all(axis=1)
        out[own[1:][same]] = out[own[:-1][same]] = True
        odd = np.unique(name[1:][(name[1:] == name[:-1]) & ~same])
        for g in odd:  # equal hashes of different bytes: practically never
            members = alive[group == g]
            _, back, times = np.unique(np.lib.stride_tricks.sliding_window_view(data, width)[at[members]], axis=0, return_inverse=True, return_counts=True)
            out[members] = times[back] > 1
    return out


def _sort_few(width: int):
    """Contents sorted by digit; each digit's suffixes are ordered among themselves."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling(2)
        held: list[pa.Table] = []
        size = 0

        def done(t: pa.Table) -> dict:
            digit, content, times, counts = (t.column(i).to_numpy() for i in range(4))
            data, offsets = buffers(t.column(4))
            own = np.repeat(np.arange(len(counts)), counts)
            step = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            same = repeated_suffixes(digit[own], data, offsets[own] + step, width, roll) | (times[own] > 1)
            # a stretch must not run over into the next content
            s, e = _ranges(np.insert(same, np.cumsum(counts)[:-1], False))
            shift = np.arange(len(counts))
            row = np.searchsorted(np.cumsum(counts) + shift, s, side="right")
            low = s - shift[row] - (np.cumsum(counts) - counts)[row]
            return {"digit": digit[row], "content": content[row], "low": low.astype(np.int32), "high": (low + e - s).astype(np.int32)}

        for part in parts:
            if not part.num_rows:
                continue
            t = pa.Table.from_batches([part])
            digits = part.column(0).to_numpy()
            if held and size >= BATCH_SUFFIXES:
                # cut at a change of digit
                last = held[-1].column(0)[-1].as_py()
                cut = int(np.argmax(digits != last)) if (digits != last).any() else len(digits)
                held.append(t.slice(0, cut))
                t = t.slice(cut)
                if not t.num_rows:
                    continue
                yield from batches([done(pa.concat_tables(held).combine_chunks())])
                held, size = [], 0
            held.append(t)
            size += int(t.column(3).to_numpy().sum())
        if held:
            yield from batches([done(pa.concat_tables(held).combine_chunks())])

    return run


def _cut_blocks(width: int, gram: int, step: int):
    """Stretches of suffixes cut where their distance to the digit is a multiple of ``step``.

    A block's core is what all suffixes at its distances have in common; whoever shares a
    suffix of the block shares the core. Its whole is what its own suffixes cover.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling(1)
        for part in parts:
            digit, content = (part.column(i).to_numpy() for i in range(2))
            data, offsets = buffers(part.column(2))
            at = np.arange(max(0, len(data) - gram + 1))
            same = roll.spans(roll.prefix(data), at, at + gram)
            lead = np.array([np.argmax(same[o : o + width] == d) for o, d in zip(offsets[:-1], digit.view(np.uint64), strict=True)], np.int64)
            shift = width - gram - lead  # of a suffix's number to its distance
            ranges = part.column(3)
            per = np.diff(ranges.offsets.to_numpy())
            flat = ranges.flatten()
            low, high = (flat.field(i).to_numpy().astype(np.int64) for i in range(2))
            row = np.repeat(np.arange(part.num_rows), per)
            first, last = (low + shift[row]) // step, (high - 1 + shift[row]) // step
            times = last - first + 1
            of = np.repeat(np.arange(len(row)), times)
            block = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            r = row[of]
            begin = np.maximum(low[of], block * step - shift[r])
            end = np.minimum(high[of], (block + 1) * step - shift[r])
            core_from = np.minimum((block + 1) * step - 1, width - gram) - shift[r]
            core_to = block * step - shift[r] + width
            yield from batches(
                [
                    {
                        "digit": digit[r],
                        "content": content[r],
                        "block": block.astype(np.int32),
                        "core": digests(data, offsets[r] + core_from, offsets[r] + core_to),
                        "whole": digests(data, offsets[r] + begin, offsets[r] + end - 1 + width),
                        "place": (begin + shift[r]).astype(np.int32),
                        "low": begin.astype(np.int32),
                        "high": end.astype(np.int32),
                    }
                ]
            )

    return run


def _sort_many(often: DataFrame, width: int, gram: int) -> DataFrame:
    """Repeated stretches (digit, content, low, high) of digits with very many contents.

    Their suffixes are ordered across tasks in blocks that get finer: a block whose whole
    recurs is repeated, one whose core doesn't is unique, and only the others go on, one of
    each whole. Rows are a few per content, not one per suffix.
    """
    ranges = often.select("digit", "content", F.array(F.struct(F.lit(0).alias("low"), F.col("count").alias("high"))).alias("ranges"))
    bodies = often.select("digit", "content", "body")
    found = often.where("times > 1").select("digit", "content", F.lit(0).alias("low"), F.col("count").alias("high"))
    for step in STEPS:
        kinds = "digit long, content long, block int, core long, whole long, place int, low int, high int"
        rows = bodies.join(ranges, ["digit", "content"]).select("digit", "content", "body", "ranges").mapInArrow(_cut_blocks(width, gram, step), kinds)
        rows = stage(rows, "repeat-blocks")
        same = ["digit", "block", "core", "whole", "place", "length"]
        rows = rows.withColumn("length", F.col("high") - F.col("low"))
        wholes = stage(rows.groupBy(same).agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("content", "low", "high"))), "repeat-wholes")
        twice = wholes.where("n > 1").select(same)
        found = found.unionByName(rows.join(twice, same).select("digit", "content", "low", "high"))
        if step > 1:
            open_ = wholes.groupBy("digit", "block", "core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
            ranges = wholes.join(open_, ["digit", "block", "core"]).groupBy("digit", "content").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    return found


def _remove(with_kept: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for whole in parts for x in slices(whole)):
            data, offsets = buffers(part.column(1))
            lists = part.column(2)
            removed, spans, digests, kept = [], [], [], []
            for i in range(part.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(0, bool)
                if lists[i].is_valid:
                    values = lists[i].values
                    edge = np.zeros(len(own) + 1, np.int32)
                    np.add.at(edge, values.field(0).to_numpy(), 1)
                    np.add.at(edge, values.field(1).to_numpy(), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    own = own[~gone]
                removed.append(int(gone.sum()))
                spans.append(len(_ranges(gone)[0]))
                digests.append(hashlib.sha256(own).hexdigest())
                if with_kept:
                    kept.append(own.tobytes())
            cols = {
                "doc_id": part.column(0),
                "n_bytes": pa.array(np.diff(offsets)),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
            }
            yield pa.RecordBatch.from_pydict(cols | ({"kept": pa.array(kept, pa.binary())} if with_kept else {}))

    return run


def repeated_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, few: int = FEW) -> DataFrame:
    """(k, t, gone): byte ranges [low, high) of documents that repeated strings cover; docs has k, t, text."""
    docs_text = docs.select("k", "t", "text")
    runs = docs_text.mapInArrow(_runs(width, gram), "k long, t long, start long, count int, digit long, content long")
    shared = runs.groupBy("digit").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("c1"), F.max("content").alias("c2")).where("n > 1")
    shared = stage(shared.select("digit", (F.col("c1") != F.col("c2")).alias("mixed")), "repeat-digits")
    hits = stage(runs.join(shared, "digit"), "repeat-runs")

    mixed = hits.where("mixed").groupBy("digit", "content").agg(F.count(F.lit(1)).alias("times"), *(F.first(c).alias(c) for c in ("k", "t", "start", "count")))
    mixed = stage(mixed, "repeat-contents")
    sizes = mixed.groupBy("digit").agg((F.count(F.lit(1)) > few).alias("many"))
    many = stage(sizes.where("many"), "repeat-many", mixed.count() // few + 1)
    body = F.substring(F.col("text").cast("binary"), (F.col("start") + 1).cast("int"), (F.col("count") + width - 1).cast("int"))
    picked = mixed.join(docs_text, ["k", "t"]).select("digit", "content", "times", "count", body.alias("body"))
    picked = stage(picked.dropDuplicates(["digit", "content"]), "repeat-bodies")
    rare = picked.join(many, "digit", "left_anti")
    found = rare.repartition("digit").sortWithinPartitions("digit").select("digit", "content", "times", "count", "body").mapInArrow(_sort_few(width), "digit long, content long, low int, high int")
    if not many.isEmpty():
        often = picked.join(many.select("digit"), "digit", "left_semi").select("digit", "content", "times", "count", "body")
        found = found.unionByName(_sort_many(stage(often, "repeat-often"), width, gram))
    found = stage(found, "repeat-found")
    unstage(picked, mixed, shared)

    start = F.col("start").cast("long")
    whole = hits.where("not mixed").select("k", "t", start.alias("low"), (start + F.col("count") + width - 1).alias("high"))
    part = hits.where("mixed").join(found, ["digit", "content"]).select("k", "t", (start + F.col("low")).alias("low"), (start + F.col("high") + width - 1).alias("high"))
    per_doc = whole.unionByName(part).distinct().groupBy("k", "t").agg(F.collect_list(F.struct("low", "high")).alias("gone"))
    per_doc = stage(per_doc, "repeat-ranges")
    unstage(hits, found)
    return per_doc


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, few: int = FEW, with_kept: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, where wanted, the kept bytes."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("k"), F.xxhash64("text").alias("t"), "text")
    joined = keyed.join(repeated_ranges(keyed, width, gram, few), ["k", "t"], "left").select("doc_id", "text", "gone")
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(_remove(with_kept), kinds + (", kept binary" if with_kept else ""))


def op1_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(remove_repeats(table(spark, sf_dir, "documents"), with_kept=False))


QUERIES = {"op1_repeat_spans": op1_repeat_spans}
