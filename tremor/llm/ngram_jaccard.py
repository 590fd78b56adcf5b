"""N-gram Jaccard join by partition-and-enumerate signatures.

A document's set is its distinct runs of ``n`` words, or its whole words where they are
fewer; two documents link when den * |intersection| >= num * |union|. With sizes a <= b,
linked sets differ in at most K(a) = floor(a * (den - num) / num) elements, and b is at
most a * den / num.

Signatures: sizes are cut into bands; a set takes part in each band in which it can be the
smaller or the larger one of a pair. A band splits the domain of elements at random into
blocks; as at most K elements differ, in some block the two sets differ little, and some
subset of the block's parts is equal in both. A signature is the hash of a set's elements
in such a subset. For small K, blocks have three parts of which two are taken; for large K
each block is one part. More blocks are used than K needs; the rest are spare. A subset that holds no element gives no signature; a set with more
such hollow blocks than the band has spare ones adds the signatures of another random split, where its
partner, hollow in the same blocks, does so too. So no linked pair is lost.

Pairs: equal sets are one class first. The classes of a signature are first compared with
the least of them only, then, where several components are left, with the least of each in
HEADS random orders, each time only where STAR signatures have the same head: that settles
groups of near copies with few comparisons, and need not find every link. Classes already
connected need no more. What stays undecided is narrowed by counts: of its blocks, a set with h hollow ones shares at least
``left`` = 1 + spare - h signatures with any set it links to. Signatures of more than HOT rows
are passed over where the rest must still show some of these; only two sets that both lack
enough others meet under them too, mostly once, under the least one that they share. A pair
that shares fewer others than it would have to, or whose sizes or 256-bit parity sketches forbid a link, goes. Each comparison that
remains is exact on the sets of 64-bit element hashes. Signatures are counted once by the
shuffle; only those that several classes share are dealt again, as far as a sieve of bounded
size tells (what it lets through in vain is dropped by the join).

Null and empty texts and texts without words have the empty set and link with nothing.
Rows with equal texts are one class, so repeated rows are linked; null ids are allowed and
an id that repeats with other texts stands for all of them. Other columns are not read.
Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, buffers, chunks, few_files, mix64, sieve, sift, stage, table, unstage, word_hashes
from .graph import connected_components

#: Growth of the bands, largest K with blocks of three parts, spare blocks, splits.
BAND = 1.5
SMALL_K = 9
SPARE, SPARE_EVERY = 3, 7
SPLITS = 5
SKETCH = 256
#: Signatures with one head that a class has to share with it to be compared at once; heads of the second turn.
STAR, HEADS = 4, 8
#: Rows of a signature that is passed over where others suffice.
HOT = 32
#: Least hot signatures of a class and slot, by which its pairs are kept from meeting twice.
LOWEST = 16
#: The low bits of a signature name its slot: band modulo 8, then split.
SLOT_BITS = 6
LARGEST = 1 << 34


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of each text's distinct word n-grams, by row, then element."""
    low = np.where((data >= 65) & (data <= 90), data | 32, data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first[:-1] | np.concatenate([[True], ~inside[:-1]])))
    ends = np.flatnonzero(inside & (first[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    word = word_hashes(low, starts, ends)
    row = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(row, minlength=len(offsets) - 1)
    begin = np.cumsum(counts) - counts
    length = np.minimum(counts, n)
    runs = np.where(counts > 0, counts - length + 1, 0)
    owner = np.repeat(np.arange(len(counts)), runs)
    at = np.repeat(begin, runs) + np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    h = length[owner].astype(np.uint64)
    for k in range(n):
        on = k < length[owner]
        h = np.where(on, mix64(h * np.uint64(0x9E3779B97F4A7C15) + word[np.where(on, at + k, 0)] if len(word) else h), h)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, owner, values)
    return out


def set_hashes(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_sums(owner, mix64(h ^ np.uint64(c)), n).view(np.int64) for c in (0x1234567, 0x89ABCDE))


def bands(num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and largest smaller size of each band, and the largest size of a partner."""
    at, low, high = 1, [], []
    while at <= LARGEST:
        k = at * (den - num) // num
        to = max(at, int(at * BAND))
        if k == 0:  # up to the last size at which only equal sets link
            to = -(-num // (den - num)) - 1
        low.append(at)
        high.append(max(at, to))
        at = high[-1] + 1
    high_a = np.array(high)
    return np.array(low), high_a, high_a * den // num


def signatures(owner: np.ndarray, h: np.ndarray, n: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) for the sets of n rows."""
    return sign(owner, h, n, num, den)[:2]


def sign(owner: np.ndarray, h: np.ndarray, n: int, num: int, den: int, cut: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """(row, signature) and (row, left * 64 + slot) for the sets of n rows; cut is bands(num, den), where it is known."""
    low, high, reach = cut or bands(num, den)
    size = np.bincount(owner, minlength=n)
    start = np.cumsum(size) - size
    rows_out, sigs_out, left_rows, lefts = [], [], [], []

    def emit_(rows: np.ndarray, sigs: np.ndarray, slot: np.ndarray) -> None:
        rows_out.append(rows)
        sigs_out.append(sigs << np.uint64(SLOT_BITS) | slot.astype(np.uint64))

    lowest = np.searchsorted(reach, size, side="left")  # bands from there to the one of its own size
    own = np.searchsorted(low, size, side="right") - 1
    for step in range(int((own - lowest).max(initial=0)) + 1):
        band = lowest + step
        k_band = high[np.minimum(band, len(high) - 1)] * (den - num) // num
        rows = np.flatnonzero((size > 0) & (band <= own) & (k_band > 0))
        for split in range(SPLITS + 1):
            if not len(rows):
                break
            b = band[rows]
            slot = b % 8 * 8 + split
            smaller = np.minimum(size[rows], high[b])
            k, k_band_rows = smaller * (den - num) // num, high[b] * (den - num) // num
            if split == SPLITS:  # hollow in all splits: these few meet under one signature a band
                emit_(rows, mix64(b.astype(np.uint64) * np.uint64(1009) + np.uint64(7)), slot)
                left_rows.append(rows)
                lefts.append(1 << SLOT_BITS | slot)
                break
            three = k_band_rows <= SMALL_K
            spare = np.where(three, 0, SPARE + k_band_rows // SPARE_EVERY)
            blocks = np.where(three, k_band_rows // 2 + 1, k_band_rows + 1) + spare
            emit = np.where(three, k // 2 + 1, k + 1) + spare
            parts = np.where(three, 3, 1)
            # elements of these rows, each to its block and part
            times = size[rows]
            who = np.repeat(np.arange(len(rows)), times)
            el = h[np.repeat(start[rows], times) + np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)]
            salt = mix64(b.astype(np.uint64) * np.uint64(64) + np.uint64(split) + np.uint64(1))
            cell = (mix64(el ^ salt[who]) >> np.uint64(11)) % (blocks * parts).astype(np.uint64)[who]
            cell = cell.astype(np.int64)
            used = emit * parts
            on = cell < used[who]
            base = np.cumsum(used) - used
            total = int(used.sum())
            flat = base[who[on]] + cell[on]
            cells = _sums(flat, mix64(el[on] + np.uint64(0x5BD1E995)), total)
            filled = np.bincount(flat, minlength=total) > 0
            cell_row = np.repeat(np.arange(len(rows)), used)
            place = (np.arange(total) - np.repeat(base, used)).astype(np.uint64)
            hollow = np.zeros(len(rows), np.int64)
            one = ~three[cell_row]
            name = mix64(cells + salt[cell_row] + place * np.uint64(0x2545F4914F6CDD1D))
            emit_(rows[cell_row[one & filled]], name[one & filled], slot[cell_row[one & filled]])
            np.add.at(hollow, cell_row[one & ~filled], 1)
            heads = np.flatnonzero(~one & (place % np.uint64(3) == 0))
            bad = np.zeros(len(heads), bool)
            for x, y in ((0, 1), (0, 2), (1, 2)):
                some = filled[heads + x] | filled[heads + y] if len(heads) else bad
                pair = mix64(cells[heads + x] * np.uint64(3) + cells[heads + y] * np.uint64(5) + salt[cell_row[heads]] + (place[heads] * np.uint64(3) + np.uint64(x + y)) * np.uint64(0x2545F4914F6CDD1D))
                emit_(rows[cell_row[heads[some]]], pair[some], slot[cell_row[heads[some]]])
                bad = bad | ~some
            np.add.at(hollow, cell_row[heads[bad]], 1)
            sure = hollow <= spare
            left_rows.append(rows[sure])
            lefts.append((1 + spare - hollow)[sure] << SLOT_BITS | slot[sure])
            rows = rows[~sure]
    if not rows_out:
        return (np.empty(0, np.int64),) * 4
    return np.concatenate(rows_out), np.concatenate(sigs_out).view(np.int64), np.concatenate(left_rows), np.concatenate(lefts).astype(np.int64)


def sketches(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Parity of the elements in each of SKETCH cells: two sets differ at least where their parities do."""
    cell = (mix64(h ^ np.uint64(0xC2B2AE35)) % np.uint64(SKETCH)).astype(np.int64)
    odd = np.bincount(owner * SKETCH + cell, minlength=n * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, SKETCH), axis=1).view(np.int64)


def _each(n: int, make):
    """Sets of the texts in the last column, chunk by chunk; make(part, first row, sets) gives columns."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = buffers(part.column(part.num_columns - 1))
            for i, j in chunks(offsets):
                owner, h = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                yield from batches([make(part.slice(i, j - i), owner, h)])

    return run


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Values by owner, which is in order, as one list per row."""
    ends = np.cumsum(np.bincount(owner, minlength=n))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values.view(np.int64)))


def _describe(num: int, den: int):
    cut = bands(num, den)

    def make(part: pa.RecordBatch, owner: np.ndarray, h: np.ndarray) -> dict:
        rows = part.num_rows
        h1, h2 = set_hashes(owner, h, rows)
        sk = sketches(owner, h, rows)
        once = np.zeros(rows, bool)  # copies in one chunk sign once
        once[np.unique(np.stack([h1, h2]), axis=1, return_index=True)[1]] = True
        kept = once[owner]
        who, sigs, sure, left = sign(owner[kept], h[kept], rows, num, den, cut)
        order, by = np.argsort(who, kind="stable"), np.argsort(sure, kind="stable")
        return {"doc_id": part.column(0), "k": part.column(1), "t": part.column(2), "n": np.bincount(owner, minlength=rows), "h1": h1, "h2": h2, **{f"s{x}": np.ascontiguousarray(sk[:, x]) for x in range(4)}, "sigs": _lists(who[order], sigs[order], rows), "lefts": _lists(sure[by], left[by], rows)}

    return make


def _sets(part: pa.RecordBatch, owner: np.ndarray, h: np.ndarray) -> dict:
    return {"node": part.column(0), "items": _lists(owner, h, part.num_rows)}


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that link, by their sets; pairs is a staged table."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    most = pairs.count()
    wanted = stage(classes.join(nodes, "node", "left_semi").select("node", "k", "t"), "jaccard-wanted", 2 * most)
    bits = stage(sieve(wanted, "t"), "jaccard-sieve", 1)
    text = sift(texts, "t", bits).join(wanted, ["k", "t"]).select("node", "text").dropDuplicates(["node"])
    sets = stage(text.mapInArrow(_each(n, _sets), "node long, items array<long>"), "jaccard-sets")
    x, y = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    linked = pairs.join(x, "a").join(y, "b").where(den * both >= num * (F.size("x") + F.size("y") - both)).select("a", "b")
    linked = stage(linked, "jaccard-links")
    unstage(sets, wanted, bits)
    return linked


def _allowed(num: int, den: int):
    """Condition on the sizes and sketches of two classes, prefixed a_ and b_."""
    a, b = F.col("a_n"), F.col("b_n")
    apart = sum((F.bit_count(F.col(f"a_s{x}").bitwiseXOR(F.col(f"b_s{x}"))) for x in range(4)), F.lit(0))
    return (F.least(a, b) * den >= F.greatest(a, b) * num) & (apart * (den + num) <= (a + b) * (den - num))


def _prefixed(classes: DataFrame, p: str) -> DataFrame:
    return classes.select(F.col("node").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("n", "s0", "s1", "s2", "s3")))


def _row_key() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(-1)).cast("long").alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")]


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id; also root, which names the component, and k and t, which name the row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_row_key(), F.coalesce("text", F.lit("")).alias("text"))
    kinds = "doc_id long, k long, t long, n long, h1 long, h2 long, s0 long, s1 long, s2 long, s3 long, sigs array<long>, lefts array<long>"
    base = stage(texts.mapInArrow(_each(n, _describe(num, den)), kinds), "jaccard-base")
    rows = base.count()
    keep = [F.first(c).alias(c) for c in ("k", "t", "n", "s0", "s1", "s2", "s3")]
    # a class is named by h1; of those rare ones that share it, all but the first get another name
    place = F.row_number().over(Window.partitionBy("h1").orderBy("h2"))
    classes = base.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), *keep).withColumn("place", place)
    classes = classes.withColumn("node", F.when(F.col("place") == 1, F.col("h1")).otherwise(F.xxhash64("h1", "h2", "place")))
    classes = stage(classes, "jaccard-classes", rows)

    signed = base.select(F.explode("sigs").alias("sig"), F.col("h1").alias("node"))
    shared = signed.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high"), (F.count(F.lit(1)) > HOT).alias("hot"))
    shared = shared.where("low <> high").select("sig", "low", "hot")
    shared = stage(shared, "jaccard-shared")
    bits = stage(sieve(shared, "sig"), "jaccard-sieve", 1)
    met = sift(signed, "sig", bits).join(shared, "sig").select("sig", "node", "low", "hot").distinct()
    clash = classes.where("place > 1").select(F.col("h1").alias("node"), F.col("node").alias("other"))
    members = stage(met.union(met.join(clash, "node").select("sig", "other", "low", "hot")), "jaccard-members")

    pair = [F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")]

    def compare(stars: DataFrame) -> DataFrame:
        """Links of the pairs (a, b) that stand in enough rows of stars."""
        often = stars.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= STAR)
        likely = often.join(_prefixed(classes, "a"), "a").join(_prefixed(classes, "b"), "b").where(_allowed(num, den)).select("a", "b")
        return _links(stage(likely, "jaccard-stars"), classes, texts, n, num, den)

    def place_(roots: DataFrame) -> DataFrame:
        """Members of signatures with several components left, with their roots."""
        placed = members.join(roots, "node", "left").select("sig", "node", "hot", F.coalesce("root", "node").alias("root"))
        several = placed.groupBy("sig").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("sig")
        return placed.join(several, "sig")

    links = compare(members.withColumnRenamed("low", "head").where("node <> head").select(*pair))
    compared = [links]
    roots = stage(connected_components(links), "jaccard-roots", rows)
    unstage(shared, bits)
    open_ = stage(place_(roots), "jaccard-placed")
    orders = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("u"), F.col("node").alias("head"), F.col("root").alias("head_root"))).alias(f"h{k}") for k in range(HEADS)]
    heads = open_.groupBy("sig").agg(*orders).select("sig", F.explode(F.array_distinct(F.array(*(F.struct(f"h{k}.head", f"h{k}.head_root") for k in range(HEADS))))).alias("h")).select("sig", "h.*")
    # a pair is counted once a signature, also where both are heads
    stars = open_.join(heads, "sig").where("root <> head_root").select("sig", *pair).distinct()
    more = compare(stars)
    compared.append(more)
    unstage(open_)
    if not more.isEmpty():
        links = links.union(more)
        roots = stage(connected_components(links), "jaccard-roots", rows)
    slot = F.col("sig").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).alias("slot")
    undecided = stage(place_(roots).select("*", slot), "jaccard-undecided")
    left = base.select(F.col("h1").alias("node"), F.explode("lefts").alias("v")).select("node", F.col("v").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).alias("slot"), F.shiftright("v", SLOT_BITS).alias("left"))
    left = left.union(left.join(clash, "node").select("other", "slot", "left")).groupBy("node", "slot").agg(F.max("left").alias("left"))
    cold = undecided.groupBy("node", "slot").agg(F.sum(F.col("hot").cast("long")).alias("hots")).join(left, ["node", "slot"], "left")
    cold = cold.select("node", "slot", F.coalesce("left", F.lit(0)).alias("left"), (F.coalesce("left", F.lit(0)) - F.col("hots")).alias("cold"))
    open_ = undecided.join(cold, ["node", "slot"]).where("not hot or cold <= 0")
    lowest = open_.where("hot").groupBy("node", "slot").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, LOWEST).alias("low"))
    open_ = open_.join(lowest, ["node", "slot"], "left").withColumn("low", F.when(F.col("hot"), F.col("low"))).join(classes.select("node", "n", "s0", "s1", "s2", "s3"), "node")
    open_ = stage(open_, "jaccard-open")
    side = lambda p: open_.select("sig", "slot", "hot", F.col("node").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("root", "left", "cold", "low", "n", "s0", "s1", "s2", "s3")))
    common = F.array_intersect("a_low", "b_low")  # where that is empty, the pair meets under each
    once = ~F.col("hot") | (F.size(common) == 0) | (F.col("sig") == F.array_min(common))
    met = side("a").join(side("b").drop("slot", "hot"), "sig").where((F.col("a_root") > F.col("b_root")) & _allowed(num, den) & once)
    met = met.groupBy("a", "b", "slot", F.greatest("a_left", "b_left").alias("left"), F.greatest("a_cold", "b_cold").alias("cold"))
    met = met.agg(F.sum((~F.col("hot")).cast("long")).alias("colds"))
    enough = F.when(F.col("cold") > 0, F.col("colds") >= F.col("cold")).otherwise(F.col("left") > 0)
    rest = stage(met.where(enough).select("a", "b").distinct(), "jaccard-rest")
    unstage(members, undecided)
    more = _links(rest, classes, texts, n, num, den)
    compared.append(more)
    unstage(open_, rest)
    if not more.isEmpty():
        roots = stage(connected_components(links.union(more)), "jaccard-roots", rows)

    rooted = classes.select("h1", "h2", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(rooted.join(least, "root").select("h1", "h2", "root", "component_id"), "jaccard-named", rows)
    unstage(classes, *compared)
    found = base.where("n > 0").join(named, ["h1", "h2"])
    alone = base.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("root", F.lit(None).cast("long"))
    cols = [F.col("doc_id"), F.col("n").alias("n_shingles"), "component_id", "root", "k", "t"]
    return found.select(*cols).unionByName(alone.select(*cols))


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, the one with the least id, with all its columns; rows without words all stay."""
    found = jaccard_components(docs, n, num, den)
    heads = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "k", "t")).alias("m"))
    kept = heads.select("m.k", "m.t", F.lit(False).alias("alone")).union(found.where("root is null").select("k", "t", F.lit(True).alias("alone")).distinct())
    keyed = docs.select("*", *(c.alias(f"near_{x}") for c, x in zip(_row_key(), "kt", strict=True)))
    kept = stage(kept.toDF("near_k", "near_t", "near_alone"), "jaccard-kept")
    place = F.row_number().over(Window.partitionBy("near_k", "near_t").orderBy("near_alone"))
    return keyed.join(kept, ["near_k", "near_t"]).withColumn("near_place", place).where("near_alone or near_place = 1").select(*docs.columns)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)
    return few_files(found.select("doc_id", "n_shingles", "component_id"))


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}

ORACLE_SQL = {
    "op2_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE
    WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')]
    ELSE [] END) AS sh
  FROM w
), e AS MATERIALIZED (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s
), links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM e x JOIN e y ON x.h = y.h AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM s LEFT JOIN reach r ON r.a = s.doc_id
GROUP BY s.doc_id, len(s.sh)
""",
}
