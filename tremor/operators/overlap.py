"""Best partners by shared words, without pairs of all rows that share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_sets(rows: DataFrame, group: list[str], words: Column) -> DataFrame:
    """Distinct (group, words, rows): rows of equal word sets are one, so a folder of many files is compared once."""
    return rows.select(*group, F.array_sort(F.array_distinct(words)).alias("words")).groupBy(*group, "words").agg(F.count(F.lit(1)).alias("rows"))


def best_overlap(asks: DataFrame, offers: DataFrame, group: list[str], same: bool = False) -> DataFrame:
    """(group, asked, offered, rows, near): for each word set asked, those of its group that share most words, all ties.

    Both sides come from ``word_sets``; sets that share nothing, and null groups, give no row.
    ``same`` tells that both are one table: a set is then its own partner only if several rows
    have it. A set first meets others by its rarest word. A partner as good as the best of these
    shares one of the words that a set would have left after losing all but so many: only those,
    rare ones first, are looked up then, so frequent words form pairs only where these may tie.
    """
    on, asked = [*group, "word"], [*group, "asked"]
    held = offers.select(*group, F.col("words").alias("offered"), "rows", F.explode("words").alias("word"))
    seen = held.groupBy(*on).agg(F.sum("rows").alias("seen")).where(F.col("seen") > int(same))
    a = asks.select(*group, F.col("words").alias("asked"), F.explode("words").alias("word")).join(seen, on)
    a = a.groupBy(*asked).agg(F.array_sort(F.collect_list(F.struct("seen", "word"))).alias("w")).select(*asked, F.transform("w", lambda x: x["word"]).alias("rare"))

    def meet(rows: DataFrame, words: Column) -> DataFrame:
        near = F.size(F.array_intersect("asked", "offered")).cast("long")
        found = rows.select(*asked, F.explode(words).alias("word")).join(held, on)
        found = found.where((F.col("asked") != F.col("offered")) | (F.col("rows") > 1)) if same else found
        return found.select(*asked, "offered", "rows", near.alias("near"))

    first = meet(a, F.slice("rare", 1, 1))
    least = first.groupBy(*asked).agg(F.max("near").alias("least"))
    rest = a.join(least, asked, "left").withColumn("least", F.coalesce("least", F.lit(0)))
    left = F.greatest(F.size("rare") - F.col("least").cast("int"), F.lit(0))
    pairs = first.union(meet(rest, F.slice(F.col("rare"), F.lit(2), left))).distinct()
    return pairs.join(pairs.groupBy(*asked).agg(F.max("near").alias("near")), [*asked, "near"])


def best_partners(rows: DataFrame, key: str, group: list[str], words: Column) -> DataFrame:
    """(key, ties, near, least): how many other rows of the group share most words with a row, how many words, the least such key.

    Rows without a word in common with another of their group have no row. Keys are unique.
    """
    r = rows.select(key, *group, F.array_sort(F.array_distinct(words)).alias("words"))
    on = [*group, "words"]
    sets = r.groupBy(*on).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"))
    pairs = best_overlap(sets, sets, group, same=True)
    firsts = sets.select(*group, F.col("words").alias("offered"), "first")
    own = F.col("asked") == F.col("offered")
    best = pairs.join(firsts, [*group, "offered"]).groupBy(*group, F.col("asked").alias("words")).agg(F.sum("rows").alias("all"), F.max("near").alias("near"), F.max(own).alias("own"), F.min(F.when(~own, F.col("first"))).alias("other"))
    second = r.join(sets.where("rows > 1").select(*on, "first"), on).where(F.col(key) != F.col("first")).groupBy(*on).agg(F.min(key).alias("second"))
    known = best.join(sets.select(*on, "first"), on).join(second, on, "left")
    mine = F.when(F.col("own"), F.when(F.col(key) == F.col("first"), F.col("second")).otherwise(F.col("first")))
    return r.join(known, on).select(key, (F.col("all") - F.col("own").cast("int")).alias("ties"), "near", F.least("other", mine).alias("least"))
