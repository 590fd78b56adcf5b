"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target divided by its size is the number of copies that each of its documents
should get on average. The whole part is given to all; the fractional parts are rounded
by pairing: of two documents, words move at random from one to the other until one
fraction is 0 or 1, which keeps the source's words and each document's expectation. Blocks
of about BLOCK documents are folded side by side; every block leaves one fraction, and
these are folded again, BLOCK to one, up to a single one per source, which is rounded as its
fraction says. What a source then lacks or has too much, less than its largest document, is
made up by turning the rounding of a few of its documents, from large to small, chosen by
hash among CHOICE of each order of size; so it ends near its smallest ones.

Null texts have size 0; null sources are one source, the last in order; sizes of 0 take
nothing. Rows that agree in id, size and source are one item with a count while rounding,
so a row repeated a million times is one row of a block, and its copies are spread evenly.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few_files, stage, table, words

# Weights in turn, the share of all sizes and the most copies of a source.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0

BLOCK = 64
#: Documents of a source, an order of size and a direction whose rounding may be turned.
CHOICE = 8
#: Classes by text hash that rows of one id, size and source are numbered in.
SPLITS = 256
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: src (its place), source, source_size, n, target.

    With caps c = most * size and a common level x, target = min(c, x * weight). In order
    of c / weight the capped sources come first; x is the level at the first source that
    it does not fill. The windows run over sources, not documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("src") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        per_source.withColumn("src", F.row_number().over(order))
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "src").rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        ranked.withColumn("level", level)
        .withColumn("x", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(everything)["level"])
        .select("src", "source", "source_size", F.least("cap", F.coalesce(F.col("x") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def _pivot(acc: Column, x: Column, seed: int) -> Column:
    """Move words between the open item of acc and x until one of them is decided."""
    cur = acc["cur"]
    up = F.least((1 - cur["p"]) * cur["size"], x["p"] * x["size"])  # words to cur
    down = F.least(cur["p"] * cur["size"], (1 - x["p"]) * x["size"])  # words to x
    u = F.xxhash64(cur["doc_id"], cur["size"], x["doc_id"], x["size"], F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    moved = F.when(u * (up + down) < down, up).otherwise(-down)
    p1, p2 = cur["p"] + moved / cur["size"], x["p"] - moved / x["size"]

    def settled(p: Column) -> Column:
        return (p < EPS) | (p > 1 - EPS)

    def out(item: Column, p: Column) -> Column:
        return F.array(F.struct(item["doc_id"].alias("doc_id"), item["size"].alias("size"), item["rows"].alias("rows"), (item["base"] + F.when(p > 0.5, 1).otherwise(0)).alias("copies"), item["base"].alias("base")))

    def left(item: Column, p: Column) -> Column:
        return item.withField("p", p)

    none = F.lit(None).cast("struct<doc_id:bigint,size:bigint,rows:bigint,base:bigint,p:double>")
    done = F.when(settled(p1) & settled(p2), F.concat(out(cur, p1), out(x, p2))).when(settled(p1), out(cur, p1)).otherwise(out(x, p2))
    open_item = F.when(settled(p1) & settled(p2), none).when(settled(p1), left(x, p2)).otherwise(left(cur, p1))
    return F.when(cur.isNull(), acc.withField("cur", x)).otherwise(F.struct(F.concat(acc["done"], done).alias("done"), open_item.alias("cur")))


def _fold(items: DataFrame, seed: int) -> DataFrame:
    """Per (src, block): the decided items and the one that stays open."""
    item = F.struct(F.xxhash64("doc_id", "size", F.lit(seed)).alias("u"), *(F.col(c) for c in ("doc_id", "size", "rows", "base", "p")))
    start = F.expr("named_struct('done', cast(array() as array<struct<doc_id:bigint,size:bigint,rows:bigint,copies:bigint,base:bigint>>), 'cur', cast(null as struct<doc_id:bigint,size:bigint,rows:bigint,base:bigint,p:double>))")
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("u"))
    return (
        items.groupBy("src", "block")
        .agg(ordered.alias("items"), F.first("blocks").alias("blocks"))
        .select("src", "block", "blocks", F.aggregate("items", start, lambda acc, x: _pivot(acc, x, seed)).alias("r"))
        .select("src", "block", "blocks", "r.done", "r.cur")
    )


def mix_items(sizes: DataFrame, seed: int = 0, **how) -> DataFrame:
    """From (doc_id, size, source) rows: one row per distinct triple, with rows, copies, source_size and target."""
    targets = stage(source_targets(sizes, **how), "mix-targets")
    per_row = targets.select(F.col("source").alias("s"), "src", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("share"))
    wanted = F.col("share") * F.col("rows")
    base = F.floor(wanted + EPS)
    items = (
        sizes.groupBy("doc_id", "size", "source")
        .agg(F.count(F.lit(1)).alias("rows"))
        .join(per_row, F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("doc_id").cast("long"), F.col("size").cast("long"), "src", "rows", base.alias("base"), F.greatest(wanted - base, F.lit(0.0)).alias("p"))
    )
    items = stage(items.withColumn("p", F.when((F.col("size") > 0) & (F.col("p") >= EPS), F.col("p")).otherwise(0.0)), "mix-items")
    counts = stage(items.where("p > 0").groupBy("src").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "mix-blocks")
    most = items.where("p > 0").groupBy("src").count().agg(F.max("count")).first()[0] or 0

    fixed = items.where("p = 0").select("src", "doc_id", "size", "rows", F.col("base").alias("copies"), F.lit(None).cast("long").alias("base"))
    parts = [fixed]
    level = (
        items.where("p > 0")
        .join(counts, "src")
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("blocks")))
    )
    depth = max(1, 1 + math.ceil(math.log(max(1, math.ceil(most / BLOCK)), BLOCK) + EPS))
    for k in range(depth):
        folded = stage(_fold(level, seed + k), "mix-level")
        parts.append(folded.select("src", F.explode("done").alias("d")).select("src", "d.*"))
        open_items = folded.where("cur is not null").select("src", "block", "blocks", "cur.*")
        level = open_items.withColumn("blocks", F.ceil(F.col("blocks") / BLOCK)).withColumn("block", F.floor(F.col("block") / BLOCK))
    u = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + depth)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    parts.append(open_items.select("src", "doc_id", "size", "rows", (F.col("base") + F.when(u < F.col("p"), 1).otherwise(0)).alias("copies"), "base"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    turned = stage(_turned(out, targets, seed), "mix-turned")
    return _apply(out, turned).join(targets, "src").drop("src", "base")


def _turned(out: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """(src, key, by): items of single rows whose copies change by one so that a source comes nearer its target."""
    taken = out.groupBy("src").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    gap = targets.join(taken, "src").select("src", (F.col("target") - F.col("taken")).alias("gap"))
    open_ = out.where("base is not null and rows = 1 and size > 0").select("src", _item_key().alias("key"), "size", (F.col("base") + 1 - F.col("copies")).alias("up"))
    near = Window.partitionBy("src", "up", F.floor(F.log2("size"))).orderBy(F.xxhash64("key", F.lit(seed + 991)), "key")
    few = open_.withColumn("place", F.row_number().over(near)).where(F.col("place") <= CHOICE)
    choices = F.sort_array(F.collect_list(F.struct("size", "key")), asc=False)
    few = few.join(gap, "src").where((F.col("up") == (F.col("gap") > 0).cast("long")) & (F.col("size") < F.abs("gap") + 0.5))
    few = few.groupBy("src").agg(choices.alias("choices"), F.first("gap").alias("gap"))  # CHOICE for each order of size at most
    start = F.struct(F.abs("gap").alias("left"), F.expr("cast(array() as array<bigint>)").alias("keys"))

    def take(acc: Column, x: Column) -> Column:
        return F.when(x["size"] < acc["left"] + 0.5, F.struct((acc["left"] - x["size"]).alias("left"), F.concat(acc["keys"], F.array(x["key"])).alias("keys"))).otherwise(acc)

    picked = few.select("src", F.signum("gap").cast("long").alias("by"), F.aggregate("choices", start, take)["keys"].alias("keys"))
    return picked.select("src", F.explode("keys").alias("key"), "by")


def _item_key() -> Column:
    return F.xxhash64("doc_id", "size")


def _apply(out: DataFrame, turned: DataFrame) -> DataFrame:
    """The items with the turned ones' copies changed."""
    keyed = out.withColumn("key", _item_key()).join(turned, ["src", "key"], "left")
    mine = F.when(F.col("by").isNotNull() & F.col("base").isNotNull() & (F.col("rows") == 1), F.col("by")).otherwise(F.lit(0))
    fits = (F.col("copies") + mine).between(F.col("base"), F.col("base") + 1)
    return keyed.withColumn("copies", F.col("copies") + F.when(fits, mine).otherwise(F.lit(0))).drop("key", "by")


def _copies(place: Column, copies: str = "copies", rows: str = "rows") -> Column:
    """Copies of the place-th (from 1) of an item's equal rows."""
    return F.floor((F.col(copies) + F.col(rows) - place) / F.col(rows))


def _sizes(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("size"), "source", *more)


def mix_documents(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """The documents of the mix: each as often as it was given copies, none for 0.

    Rows of one id, size and source (null ids, say) are numbered by SPLITS classes of their text's
    hash, then by text, so no task holds all of them; equal texts are alike, whichever goes first.
    """
    split = F.pmod(F.xxhash64("text"), F.lit(SPLITS)).cast("int")
    sizes = stage(_sizes(docs, split.alias("mix_split")), "mix-sizes")
    items = mix_items(sizes, seed, **how)

    def key(d: DataFrame, size: Column) -> Column:
        return F.concat_ws("|", F.coalesce(d["doc_id"].cast("string"), F.lit("~")), size.cast("string"), F.coalesce(F.concat(F.lit("="), d["source"]), F.lit("~")))

    given = items.select(key(items, items["size"]).alias("mix_key"), F.col("rows").alias("mix_rows"), F.col("copies").alias("mix_total"))
    # rows in the classes before each: SPLITS numbers a key at most
    before = Window.partitionBy("mix_key").orderBy("mix_split").rowsBetween(Window.unboundedPreceding, -1)
    classes = sizes.select(key(sizes, sizes["size"]).alias("mix_key"), "mix_split").groupBy("mix_key", "mix_split").count()
    classes = classes.withColumn("mix_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    given = stage(classes.join(given, "mix_key"), "mix-given")
    place = F.col("mix_before") + F.row_number().over(Window.partitionBy("mix_key", "mix_split").orderBy("text"))
    return (
        docs.withColumn("mix_key", key(docs, words(docs["text"])))
        .withColumn("mix_split", split)
        .join(given, ["mix_key", "mix_split"])
        .withColumn("mix_place", place)
        .withColumn("mix_copies", _copies(F.col("mix_place"), "mix_total", "mix_rows"))
        .where("mix_copies > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies")))
        .select(*docs.columns)
    )


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = mix_items(stage(_sizes(table(spark, sf_dir, "documents")), "mix-sizes"))
    rows = items.withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return few_files(rows.select("doc_id", "size", "source_size", "target", (_copies(F.col("place")) * F.col("size")).alias("taken")))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of the mix: sizes and targets, the latter in thousandths of a word."""
    sizes = _sizes(table(spark, sf_dir, "documents"))
    targets = source_targets(sizes).withColumnRenamed("source", "s").drop("src")
    found = sizes.join(targets, F.col("source").eqNullSafe(F.col("s")))
    return found.select("doc_id", "size", "source_size", F.floor(F.col("target") * 1000 + 0.5).cast("long").alias("target_e3"))


QUERIES = {"op5_mix_sources": op5_mix_sources, "mix_targets": mix_targets}

ORACLE_SQL = {
    "mix_targets": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS MATERIALIZED (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM d GROUP BY source
), fill AS (
  SELECT 0 AS step, 1.5::DOUBLE * sum(source_size) / sum(weight) AS level FROM s
  UNION ALL
  SELECT step + 1, (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(2.0::DOUBLE * source_size) FILTER (fill.level * weight > 2.0::DOUBLE * source_size), 0)) / sum(weight) FILTER (fill.level * weight <= 2.0::DOUBLE * source_size) FROM s)
  FROM fill WHERE step < 100 AND level IS NOT NULL
), level AS (SELECT max(level) AS level FROM fill)
SELECT d.doc_id, d.size, s.source_size, CAST(floor(least(2.0::DOUBLE * s.source_size, (SELECT level FROM level) * s.weight) * 1000 + 0.5::DOUBLE) AS BIGINT) AS target_e3
FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source
"""
}
