"""Document fingerprints from prefix polynomial hashes.

The code points of a text are the coefficients of a polynomial modulo two primes; with the
prefix arrays of its partial sums, any two spans are compared in constant time and the
longest common extension of two positions is found by binary search (``Prefixes``). A
fingerprint keeps the length, the hash of the whole text, and the hashes of content-defined
spans that cover the text end to end (cut where a hash of the last WINDOW code points says
so). The spans of two fingerprints are sequences themselves: their longest common beginning
and ending are found by binary search over prefix hashes of these, which locates the common
ends of the texts to within one span. Prefix and suffix hashes at GRID lengths do so for
short ends, of which a span is a large part. Likeness is the share of the longer text that
both ends and the common spans between them cover: 1 for equal texts, 0 where nothing agrees.
The ends never overlap: together they are no longer than the shorter text.

Null is the empty text; two empty texts have likeness 1, an empty and another 0. Ids that
repeat are ordered by text; null ids stand before all others. A single document is its own
next one. Texts of any length are taken whole; a text's arrays need about 40 bytes a code
point, one text at a time. Bytes that are no UTF-8
count as U+FFFD. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_files, partitions, slices, table, texts

# Fixed values of the fingerprint: two primes below 2**31, the bases and the grid's growth.
PRIMES = (2147483629, 2147483587)
BASES = (1000003, 69069069)
GROWTH = 1.125
#: Cuts between blocks that are looked through at once.
STEP = 64
# Content-defined spans: code points that decide on a cut, one cut in EVERY, and the longest span.
WINDOW, EVERY, LONGEST = 8, 32, 255
# Hashes at grid lengths have three letters of six bits.
LETTERS = np.frombuffer((string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/").encode(), np.uint8)
PLACES = np.array([12, 6, 0], np.uint64)


def _grid(most: int) -> list[int]:
    out, g = [], 1
    while g <= most:
        out.append(g)
        g = max(g + 1, int(g * GROWTH))
    return out


GRID = _grid(1 << 40)
GRID_ARRAY = np.array(GRID)


class Powers:
    """Powers of the bases and of their inverses, kept and grown as longer texts come."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def upto(self, n: int) -> None:
        for k, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
            while len(self.up[k]) < n:
                m = len(self.up[k])
                self.up[k] = np.concatenate([self.up[k], self.up[k] * np.uint64(pow(b, m, p)) % np.uint64(p)])
                self.down[k] = np.concatenate([self.down[k], self.down[k] * np.uint64(pow(b, -m, p)) % np.uint64(p)])


POWERS = Powers()


class Prefixes:
    """Prefix hashes of one text, or of numbers below 2**32: h[i] = sum of c[j] * base**j for j < i, modulo each prime."""

    def __init__(self, text: str | np.ndarray, powers: Powers = POWERS):
        self.n = len(text)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) if isinstance(text, str) else text
        points = points.astype(np.uint64) + np.uint64(1)
        powers.upto(self.n + 1)
        self.powers, self.down = powers.up, powers.down
        self.h = []
        for p, w in zip(PRIMES, self.powers, strict=True):
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(points * w[: self.n] % np.uint64(p), out=sums[1:])
            self.h.append(sums % np.uint64(p))

    def prefix(self, n: int) -> int:
        return int(self.h[0][n]) << 31 | int(self.h[1][n])

    def span(self, i: int, j: int) -> int:
        """Hash of text[i:j] brought to the origin: equal for equal spans."""
        out = 0
        for p, b, h in zip(PRIMES, BASES, self.h, strict=True):
            out = out << 31 | (int(h[j]) - int(h[i])) * pow(b, -i, p) % p
        return out

    def spans(self, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
        """The part of span() modulo the k-th prime, for many spans at once."""
        p = np.uint64(PRIMES[k])
        return (self.h[k][ends] + p - self.h[k][starts]) % p * self.down[k][starts] % p

    def windows(self, width: int) -> np.ndarray:
        """spans() modulo the first prime of all windows of a width, by their starts."""
        p, h = np.uint64(PRIMES[0]), self.h[0]
        return (h[width:] + p - h[:-width]) % p * self.down[0][: max(0, self.n + 1 - width)] % p

    def same(self, i: int, other: Prefixes, j: int, n: int) -> bool:
        """Whether text[i:i+n] equals other's [j:j+n]; the later start is the common origin."""
        for p, w, a, b in zip(PRIMES, self.powers if self.n >= other.n else other.powers, self.h, other.h, strict=True):
            x, y = (int(a[i + n]) - int(a[i])) % p, (int(b[j + n]) - int(b[j])) % p
            if i < j:
                x = x * int(w[j - i]) % p
            else:
                y = y * int(w[i - j]) % p
            if x != y:
                return False
        return True

    def common(self, i: int, other: Prefixes, j: int) -> int:
        """Longest n with text[i:i+n] equal to other's [j:j+n], by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(i, other, j, mid) else (low, mid - 1)
        return low

    def common_before(self, i: int, other: Prefixes, j: int) -> int:
        """Longest n with text[i-n:i] equal to other's [j-n:j], by binary search."""
        low, high = 0, min(i, j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(i - mid, other, j - mid, mid) else (low, mid - 1)
        return low


def _hashes(x: Prefixes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First part of span() for many spans at once."""
    return x.spans(starts, ends, 0)


def _cuts(x: Prefixes) -> np.ndarray:
    """Starts of the content-defined spans, and the text's end."""
    cuts = np.flatnonzero(x.windows(WINDOW)[:-1] & np.uint64(EVERY - 1) == 0) + WINDOW if x.n > WINDOW else np.empty(0, np.int64)
    cuts = np.concatenate([[0], cuts, [x.n]]).astype(np.int64)
    if (more := (np.diff(cuts) - 1) // LONGEST).any():  # long spans in pieces
        first = np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        cuts = np.append(np.repeat(cuts[:-1], more + 1) + (np.arange(len(first)) - first) * LONGEST, x.n)
    return cuts


def _letters(values: np.ndarray) -> str:
    """The low 18 bits of each value as three letters."""
    return LETTERS[(values[:, None] >> PLACES & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    """``n:whole:prefixes:suffixes:spans``.

    Prefixes and suffixes are three letters for each grid length up to n; spans are, in base64,
    four bytes for each content-defined span in order: three of its hash, one of its length.
    """
    x = Prefixes(text)
    lengths = GRID_ARRAY[: bisect_right(GRID, x.n)]
    heads = _letters(x.h[1][lengths])
    tails = _letters(x.spans(x.n - lengths, np.full(len(lengths), x.n), 1))
    cuts = _cuts(x)
    starts, ends = (cuts[:-1], cuts[1:]) if x.n else (cuts[:0], cuts[:0])
    cut = np.uint64((1 << 24) - 1)
    spans = ((_hashes(x, starts, ends) & cut) << np.uint64(8) | (ends - starts).astype(np.uint64)).astype(">u4").tobytes()
    return f"{x.n}:{x.prefix(x.n):016x}:{heads}:{tails}:{base64.b64encode(spans).decode()}"


def _agree(a: str, b: str) -> int:
    """Largest grid length at which both hash lists agree; agreement is monotone."""
    low, high = 0, min(len(a), len(b)) // 3
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[3 * mid - 3 : 3 * mid] == b[3 * mid - 3 : 3 * mid] else (low, mid - 1)
    return GRID[low - 1] if low else 0


def likeness(a: str, b: str) -> float:
    """0 to 1 from two fingerprints."""
    n, whole, heads, tails, spans = a.split(":")
    m, other, heads2, tails2, spans2 = b.split(":")
    if n == m and whole == other:
        return 1.0
    longest, shortest = max(int(n), int(m)), min(int(n), int(m))
    x, y = _spans(spans), _spans(spans2)
    first, last = _ends(x, y)
    head = max(_agree(heads, heads2), int((x[:first] & 255).sum()))
    tail = min(max(_agree(tails, tails2), int((x[len(x) - last :] & 255).sum())), shortest - head)
    between = _between(x, head, int(n) - tail) & _between(y, head, int(m) - tail)
    return min(head + tail + sum((k & 255) * times for k, times in between.items()), longest) / longest


def _spans(text: str) -> np.ndarray:
    """Hash and length of each span, as one number."""
    return np.frombuffer(base64.b64decode(text), ">u4").astype(np.int64)


def _ends(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """How many spans two texts begin with alike, and how many of the others they end with alike."""
    a, b = Prefixes(x), Prefixes(y)
    first = a.common(0, b, 0)
    return first, min(a.common_before(a.n, b, b.n), min(a.n, b.n) - first)


def _between(spans: np.ndarray, start: int, end: int) -> Counter[int]:
    """How often each span lies between two places of the text."""
    ends = np.cumsum(spans & 255)
    return Counter(spans[(ends - (spans & 255) >= start) & (ends <= end)].tolist())


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block, then order; a block ends with the first row of the next one, tail = 1."""
    held = None  # (block, doc_id, text, fingerprint)
    for part in (x for whole in parts for x in slices(whole)):
        rows: list[tuple] = []
        blocks, tails, ids = (part.column(i).to_pylist() for i in range(3))
        for block, tail, doc_id, text in zip(blocks, tails, ids, texts(part.column(3)), strict=True):
            if tail and (held is None or held[0] != block):
                continue  # one of several equal first rows: the next row is known already
            text = text or ""
            own = fingerprint(text)
            if held is not None and held[0] == block:
                before, mark = held[2], held[3]
                edited = edit(before, text)
                new = mark if edited == before else fingerprint(edited)
                rows.append((held[1], len(before), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, new, likeness(mark, new), likeness(mark, own)))
            held = None if tail else (block, doc_id, text, own)
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(NAMES, map(pa.array, zip(*rows, strict=True), TYPES), strict=True)))


NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, its edited text and the next document by id.

    Documents are dealt into blocks of consecutive ids between quantiles of the ids; the
    first document of each block goes to the block before as well, so one shuffle of the
    texts gives every document its successor.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    # the cuts in rows of STEP: a row is found by its first cut, the place in it by counting
    coarse, rows_of = [*cuts[::STEP]], [cuts[i : i + STEP] for i in range(0, len(cuts), STEP)]
    block = F.lit(0)
    if cuts:
        row = F.size(F.filter(F.lit(coarse), lambda c: c <= F.col("doc_id")))
        place = F.size(F.filter(F.element_at(F.lit(rows_of), row), lambda c: c <= F.col("doc_id")))
        block = F.when(row > 0, (row - 1) * STEP + place).otherwise(0)
    block = F.when(F.col("doc_id").isNull(), 0).otherwise(block)
    named = _labels(spark, n, len(cuts) + 1)
    starts = ids.withColumn("block", block).groupBy("block").agg(F.when(F.count("doc_id") == F.count(F.lit(1)), F.min("doc_id")).alias("first"))
    starts = sorted((r[0], r[1]) for r in starts.collect())  # one row a block
    first, previous = [None] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for i, (b, least) in enumerate(starts):
        first[b], previous[b] = least, named[starts[i - 1][0]]  # the first block follows the last one
    at = F.col("block") + 1
    literal = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("block", block)
    own = F.struct(F.element_at(literal(named), at).alias("block"), F.lit(0).alias("tail"))
    copy = F.struct(F.element_at(literal(previous), at).alias("block"), F.lit(1).alias("tail"))
    places = F.when(F.col("doc_id").eqNullSafe(F.element_at(literal(first), at)), F.array(own, copy)).otherwise(F.array(own))
    dealt = rows.withColumn("place", F.explode(places)).select("place.block", "place.tail", "doc_id", "text")
    dealt = dealt.repartition(n, "block").sortWithinPartitions("block", "tail", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _labels(spark: SparkSession, n: int, blocks: int) -> list[int]:
    """Names for blocks that hash to different ones of n partitions, as far as there are enough."""
    found = spark.range(32 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).select("id").collect()
    names = sorted(r[0] for r in found)
    return [names[i] if i < len(names) else 32 * n + i for i in range(blocks)]


def op6_prefix_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(compare_with_next(table(spark, sf_dir, "documents")))


QUERIES = {"op6_prefix_fingerprint": op6_prefix_fingerprint}
