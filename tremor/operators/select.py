"""Sampling, selection and ranking of rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import paths_in_text

#: Ranges into which a key is cut for a global rank.
RANGES = 256
# Fixed value: seed files of a problem.
MOST_SEEDS = 8


def spread_sample(rows: DataFrame, key: str, k: int) -> DataFrame:
    """k rows at even steps of the sorted distinct keys, all where there are no more.

    Ranks are global without a single task (``with_rank``). The i-th pick is row floor(i * n / k).
    """
    ordered = with_rank(rows.select(key).distinct(), key)
    n = ordered.agg(F.count(F.lit(1)).alias("n"))
    step = F.col("n") / F.lit(float(k))
    # the place is picked when some i in 0..k-1 has floor(i * step) = place
    i = F.ceil(F.col("place") / step)
    picked = (F.col("n") <= k) | ((i < k) & (F.floor(i * step) == F.col("place")))
    return ordered.join(F.broadcast(n)).where(picked).select(key)  # n is one row


def with_rank(rows: DataFrame, key: str, ranges: int = RANGES) -> DataFrame:
    """place: 0-based rank of each row by key, over all partitions.

    The key's domain is cut at about ``ranges`` keys, those with the least hashes, so a
    row's range depends on its key alone, however often and wherever the plan runs.
    """
    cuts = sorted(r[0] for r in rows.where(F.col(key).isNotNull()).select(key, F.xxhash64(key).alias("_u")).distinct().orderBy("_u", key).limit(ranges).collect())
    cut = F.lit(cuts) if cuts else F.array().cast(f"array<{rows.schema[key].dataType.simpleString()}>")
    # nulls sort first
    parts = rows.withColumn("_part", F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(cut, lambda c: c <= F.col(key)))))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))  # at most ranges + 2 rows
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_part").orderBy(key)
    return parts.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("place", F.col("_before") + F.col("_in") - 1).drop("_part", "_in", "_before")


#: Bits that a pass of the selection decides: so many counts come to the driver, whatever the rows.
DIGIT = 12


def values_at(rows: DataFrame, value: str, places: list[int]) -> list[int]:
    """The whole numbers of 0 and more at these places (from 0) of the order of all, by counts of digits from the top down.

    A pass counts the next DIGIT bits of the values that agree with what is decided: the counts
    of 2**DIGIT digits are partial sums of every task, and no task holds or sorts the values.
    Nulls are left out. Places outside raise.
    """
    v = F.col(value).cast("long")
    rows = rows.where(v.isNotNull())
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(v).alias("most"), F.min(v).alias("least")).first()
    if any(not 0 <= p < total["n"] for p in places) or total["n"] and total["least"] < 0:
        raise ValueError("places must lie within the rows, values must be 0 or more")
    top = DIGIT * max(1, -(-int(total["most"] or 0).bit_length() // DIGIT))
    found = {p: (0, p) for p in places}  # decided bits, and the place among the values that begin with them
    for low in range(top - DIGIT, -1, -DIGIT):
        prefix = F.call_function("shiftright", v, F.lit(low + DIGIT)) if low + DIGIT < 63 else F.lit(0).cast("long")
        digit = F.call_function("shiftright", v, F.lit(low)).bitwiseAND(F.lit((1 << DIGIT) - 1))
        counts: dict[int, dict[int, int]] = {}
        for r in rows.where(prefix.isin(sorted({b for b, _ in found.values()}))).groupBy(prefix.alias("b"), digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(r["b"], {})[r["d"]] = r["n"]
        for p, (bits, place) in found.items():
            for d in sorted(counts[bits]):
                if place < counts[bits][d]:
                    found[p] = (bits << DIGIT | d, place)
                    break
                place -= counts[bits][d]
    return [found[p][0] for p in places]


def median_of(rows: DataFrame, value: str) -> float | None:
    """The exact median of whole numbers of 0 and more, the mean of the middle two of an even number; null without values."""
    n = rows.where(F.col(value).isNotNull()).count()
    if not n:
        return None
    low, high = values_at(rows, value, [(n - 1) // 2, n // 2])
    return (low + high) / 2


def head_sample(rows: DataFrame, key: str, k: int) -> DataFrame:
    return rows.select(key).distinct().orderBy(key).limit(k)


def cap_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts each partition's groups before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)


def last_rows(rows: DataFrame, order: str, k: int) -> DataFrame:
    return rows.orderBy(F.col(order).desc()).limit(k)


def parse_selection(text: str) -> list[int]:
    """``1,3,5-7`` as numbers, in order, each once."""
    out: list[int] = []
    for part in filter(None, re.split(r"\s*,\s*", text.strip())):
        low, _, high = part.partition("-")
        out += range(int(low), int(high or low) + 1)
    return list(dict.fromkeys(out))


def select_places(rows: DataFrame, place: str, text: str) -> DataFrame:
    return rows.where(F.col(place).isin(parse_selection(text)))


def focus_files(files: DataFrame, pinned: list[str]) -> DataFrame:
    """Files (path, pos) by pinned, class (source, other, test, setup or documentation), depth, place."""
    p = F.col("path")
    depth = F.size(F.split(p, "/"))
    name = F.element_at(F.split(p, "/"), -1)
    kind = F.when(F.rlike(p, F.lit(r"(^|/)(docs?|examples?)/")) | name.isin("setup.py", "conftest.py"), 3).when(F.rlike(p, F.lit(r"(^|/)tests?/|(^|/)test_|_test\.py$")), 2).when(name == "__init__.py", 1).otherwise(0)
    return files.select("path", p.isin(*pinned).alias("pinned") if pinned else F.lit(False).alias("pinned"), kind.alias("kind"), depth.alias("depth"), "pos").orderBy(F.col("pinned").desc(), "kind", "depth", "pos")


def between_dates(rows: DataFrame, at: str, first: str, last: str) -> DataFrame:
    """Rows whose date lies in the closed range; both as YYYY-MM-DD."""
    return rows.where(F.to_date(at).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def source_candidates(test_file: Column) -> Column:
    """Files that a test file's path is likely about: beside the tests folder, then beside itself."""
    name = F.element_at(F.split(test_file, "/"), -1)
    parent = F.regexp_extract(test_file, r"^(.*)/[^/]*$", 1)
    above = F.when(F.contains(test_file, F.lit("/tests/")), F.element_at(F.split(test_file, "/tests/"), 1))

    def beside(folder: Column) -> list[Column]:
        return [
            F.when(name.startswith("test_") & (F.length(folder) > 0), F.concat(folder, F.lit("/"), F.substr(name, F.lit(6)))),
            F.when(name.endswith("_test.py") & (F.length(folder) > 0), F.concat(folder, F.lit("/"), F.regexp_replace(name, r"_test\.py$", ".py"))),
        ]

    return F.array_distinct(F.filter(F.array(*beside(above), *beside(parent)), lambda x: x.isNotNull()))


def seed_files(problems: DataFrame, files: DataFrame, imports: DataFrame | None = None, most: int = MOST_SEEDS) -> DataFrame:
    """(instance_id, path, pos): the first ``most`` existing files that a problem names or that its tests are about.

    problems: (instance_id, text, tests array of node ids); files: (path); imports: (test_file,
    path), what a test file imports, if known. Order: paths in the text, then for each test
    its source candidates, its imports and the test file.
    """
    strip = lambda c: F.regexp_replace(F.trim(c), r"^[./]+", "")
    named = problems.select("instance_id", F.posexplode(paths_in_text(F.coalesce("text", F.lit("")))).alias("a", "path")).select("instance_id", F.lit(-1).alias("test"), F.lit(0).alias("kind"), "a", "path")
    tests = problems.select("instance_id", F.posexplode("tests").alias("test", "node")).select("instance_id", "test", F.trim(F.element_at(F.split("node", "::"), 1)).alias("file")).where(F.col("file").endswith(".py"))
    about = tests.select("instance_id", "test", F.posexplode(source_candidates(F.col("file"))).alias("a", "path")).select("instance_id", "test", F.lit(0).alias("kind"), "a", "path")
    own = tests.select("instance_id", "test", F.lit(2).alias("kind"), F.lit(0).alias("a"), F.col("file").alias("path"))
    rows = named.union(about).union(own)
    if imports is not None:
        got = tests.join(imports.select(F.col("test_file").alias("file"), F.col("path")), "file")
        rows = rows.union(got.select("instance_id", "test", F.lit(1).alias("kind"), F.lit(0).alias("a"), "path"))
    found = rows.withColumn("path", strip("path")).join(files.select("path").distinct(), "path", "left_semi")
    first = found.groupBy("instance_id", "path").agg(F.min(F.struct("test", "kind", "a", "path")).alias("at"))
    w = Window.partitionBy("instance_id").orderBy("at")
    return first.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("instance_id", "path", "pos")
