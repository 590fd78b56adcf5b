"""How text filters interact: counts of kept, removed and lost documents in every order of filters.

A document fails any of five filters: A has too few words, B too few distinct ones, C too many
capitals, D a sign of markup, E is identical to a document of a smaller id. All that an order
of filters does to a source follows from the number of its documents in each of the 32 sets of
failed filters, so the corpus is counted once by (source, set) and the orders are worked out
on those counts.

Duplicates come from partition refinement. Documents are split by their length in code points,
then by the hash of one block of text after the other (BLOCKS); after each split, groups of
one are dropped. The full texts of those that are left are compared, by grouping on the text
itself, and every id but the smallest of a text is marked. Where two texts share all hashes,
marks are made by text instead of by hashes, so no hash decides.

Null texts are empty; null sources and the empty source are one part, ''. A row without id is
never marked and marks none. Rows of one id and text don't mark one another. A document has
quality or toxicity 1 if any row of labels says so; labels without id count for none. Empty
tables give no rows. Other columns are not read. A text's distinct words are held at once.
"""

from __future__ import annotations

import itertools
import math
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_files, pieces, sieve, sift, slices, split_words, stage, table, texts, unstage

# Fixed values of the filters.
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_CAPITALS_PERCENT = 5
MARKUP = re.compile("[#$%&*|]")
FILTERS = "ABCDE"

#: Code points of the blocks that split groups further: from, number (the last one: all the rest).
BLOCKS = ((1, 64), (65, 448), (513, None))
KEYS = ["n_points", *(f"block{i}" for i in range(1, len(BLOCKS) + 1))]


def block_hash(part: Column) -> Column:
    return F.xxhash64(part)


def failing(text: str) -> int:
    """Bits 0 to 3 for the filters A to D."""
    n, distinct = 0, set()
    for piece in pieces(text):
        words = split_words(piece)
        n += len(words)
        distinct.update(words)
    capitals = sum(map(text.count, string.ascii_uppercase))
    return (
        (n < LEAST_WORDS)
        + 2 * (100 * len(distinct) < LEAST_DISTINCT_PERCENT * n)
        + 4 * (100 * capitals > MOST_CAPITALS_PERCENT * len(text))
        + 8 * bool(MARKUP.search(text))
    )


def _fail(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mask of A to D in place of the last column, the text."""
    for part in (x for whole in parts for x in slices(whole)):
        mask = pa.array([failing(t) for t in texts(part.column(part.num_columns - 1))], pa.int32())
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], mask], names=[*part.schema.names[:-1], "mask"])


def _masked(rows: DataFrame) -> DataFrame:
    """Rows with mask in place of text."""
    rows = rows.select(*(c for c in rows.columns if c != "text"), "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_fail, f"{kinds}, mask int")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, part, text and the keys of the refinement."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = [F.substring("text", at, n if n else 2**31 - 1) for at, n in BLOCKS]
    return rows.select("*", F.length("text").alias(KEYS[0]), *(block_hash(b).alias(k) for b, k in zip(blocks, KEYS[1:], strict=True)))


def _survivors(facts: DataFrame) -> DataFrame:
    """The keys that more than one row has, by one split after the other."""
    left, groups = facts.select(KEYS), None
    for i in range(len(KEYS)):
        keys = KEYS[: i + 1]
        groups = stage(left.groupBy(keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(keys), "audit-groups")
        if i + 1 == len(KEYS):
            break
        fewer = stage(left.join(groups, keys, "left_semi"), "audit-left")
        unstage(groups, *([left] if i else []))
        left = fewer
    unstage(left)
    return groups


def mark_copies(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, part, mask; bit 4 of mask says that a smaller id has the same text, bits 0 to 3 are filters A to D."""
    facts = stage(_masked(_keyed(docs)), "audit-facts")
    named = facts.where("doc_id is not null")
    groups = _survivors(named)

    # full texts of what is left: rows of one text meet as one per task before they are shuffled
    key = F.xxhash64(*KEYS).alias("key")
    bits = stage(sieve(groups.select(key), "key"), "audit-sieve")
    same = sift(_keyed(docs).where("doc_id is not null").withColumn("key", key), "key", bits)
    same = stage(same.groupBy(*KEYS, "text").agg(F.min("doc_id").alias("first")), "audit-texts")
    firsts = same.groupBy(KEYS).agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"))
    firsts = stage(firsts, "audit-firsts")
    unstage(groups, bits)

    clashes = firsts.where("texts > 1").select(KEYS)
    copy = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    plain = named.join(firsts.where("texts = 1").select(*KEYS, "first"), KEYS, "left")
    out = ["doc_id", "part", (F.col("mask") + copy).alias("mask")]
    if clashes.isEmpty():
        marked = plain.select(out)
    else:
        by_text = stage(same.join(clashes, KEYS, "left_semi"), "audit-clashes")
        again = _keyed(docs).where("doc_id is not null").join(by_text, [*KEYS, "text"])
        marked = plain.join(clashes, KEYS, "left_anti").select(out).unionByName(_masked(again).select(out))
    marked = stage(marked.unionByName(facts.where("doc_id is null").select("doc_id", "part", "mask")), "audit-marked")
    unstage(facts, same, firsts)
    return marked


def count_masks(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part one array of (mask, n, good, toxic), of 32 masks at most."""
    says = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    says = says.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = marked.where("doc_id is not null").join(says, "doc_id", "left").select("part", "mask", "good", "toxic")
    none = F.lit(None).cast("int")
    rows = known.unionByName(marked.where("doc_id is null").select("part", "mask", none.alias("good"), none.alias("toxic")))
    counts = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))


def _every_step(parts: DataFrame) -> DataFrame:
    """Every step of every order for each part: the filters before it as bits, and its own bit."""
    orders = " ".join(map("".join, itertools.permutations(FILTERS)))
    rows = parts.select("part", "masks", F.explode(F.split(F.lit(orders), " ")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bit(place: Column) -> Column:
        letter = F.substr(F.col("filter_order"), place, F.lit(1))
        return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)

    until = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda acc, i: acc.bitwiseOR(bit(i)))
    return rows.withColumns({"own": bit(F.col("step")), "until": until}).withColumn("before", F.col("until") - F.col("own"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of filters and step, with what the step keeps, removes and loses."""
    marked = mark_copies(docs)
    parts = stage(count_masks(marked, labels), "audit-counts")
    unstage(marked)
    rows = _every_step(parts)
    before, own = F.col("before"), F.col("own")

    def total(which, what: str = "n") -> Column:
        return F.aggregate(F.filter("masks", which), F.lit(0).cast("long"), lambda acc, x: acc + x[what])

    def first_here(x: Column) -> Column:
        return (x["mask"].bitwiseAND(own) != 0) & (x["mask"].bitwiseAND(before) == 0)

    # a document is removed by a filter in as many orders as that filter comes first of those it fails
    shares = F.aggregate(
        F.filter("masks", lambda x: x["mask"].bitwiseAND(own) != 0),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x["n"] * F.floor(F.lit(math.factorial(len(FILTERS))) / F.bit_count(x["mask"])),
    )
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda x: x["mask"].bitwiseAND(F.col("until")) == 0).alias("kept"),
        total(first_here).alias("removed"),
        total(lambda x: (x["mask"].bitwiseAND(own) != 0) & (x["mask"].bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda x: x["mask"] == own).alias("unique_fails"),
        total(first_here, "good").alias("good_lost"),
        total(first_here, "toxic").alias("toxic_lost"),
        shares.alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {"op13_filter_audit": op13_filter_audit}

ORACLE_SQL = {
    "op13_filter_audit": r"""
WITH l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT d.part,
    {'A': len(w) < 50,
     'B': 100 * len(list_distinct(w)) < 65 * len(w),
     'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'),
     'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS f,
    coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM d LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, f.A AS a, f.B AS b, f.C AS c, f.D AS d, f.E AS e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL
), s AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails, n, good, toxic FROM c
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), k AS (
  SELECT filter_order, step, filter_order[step] AS own, list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: position(y IN filter_order) < step) AS before
  FROM o, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step)
), g AS (
  SELECT part, filter_order, step, own,
    CAST(sum(n) FILTER (NOT list_contains(fails, own) AND NOT list_has_any(fails, before)) AS BIGINT) AS kept,
    CAST(sum(n) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)) AS BIGINT) AS removed,
    CAST(sum(n) FILTER (list_contains(fails, own) AND list_has_any(fails, before)) AS BIGINT) AS redundant,
    CAST(sum(n) FILTER (fails = [own]) AS BIGINT) AS unique_fails,
    CAST(sum(good) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)) AS BIGINT) AS good_lost,
    CAST(sum(toxic) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)) AS BIGINT) AS toxic_lost
  FROM s, k GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
  coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""
}
