"""Best partners by shared words, and coverage links of chosen tests, against plain loops."""

import random

from pyspark.sql import functions as F

from tremor.operators import link, overlap
from tremor.plans import build
from tremor.sources.store import GraphStore


def best(rows):
    """(key, ties, near, least) by comparing all pairs of a group."""
    out = []
    for k, g, ws in rows:
        near = {q: len(set(ws or ()) & set(vs or ())) for q, h, vs in rows if q != k and g is not None and h == g}
        top = max(near.values(), default=0)
        if top:
            ties = [q for q, n in near.items() if n == top]
            out.append((k, len(ties), top, min(ties)))
    return sorted(out)


def test_best_partners_match_all_pairs(spark):
    for seed in range(4):
        rng = random.Random(seed)
        words = ["docs"] * 6 + ["api"] * 3 + [f"w{i}" for i in range(rng.choice([4, 12, 60]))]
        rows = [(i, rng.choice(["h1", "h1", "h2", None]), None if rng.random() < 0.05 else rng.choices(words, k=rng.randrange(0, 6))) for i in range(150)]
        df = spark.createDataFrame(rows, "k long, g string, ws array<string>")
        got = overlap.best_partners(df, "k", ["g"], F.col("ws"))
        assert sorted(map(tuple, got.collect())) == best(rows), seed
    assert overlap.best_partners(df.limit(0), "k", ["g"], F.col("ws")).count() == 0


def test_a_shared_folder_forms_few_pairs(spark):
    """20,000 files below one folder, each with one neighbour of its own: the folder's name pairs nothing."""
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("k"), F.lit("h").alias("g"), F.array(F.lit("docs"), F.concat(F.lit("a"), F.expr("id div 2")), F.concat(F.lit("b"), F.expr("id div 2")), F.concat(F.lit("c"), F.col("id"))).alias("ws"))
    sets = overlap.word_sets(rows, ["g"], F.col("ws"))
    assert overlap.best_overlap(sets, sets, ["g"], same=True).count() == n
    got = overlap.best_partners(rows, "k", ["g"], F.col("ws"))
    assert got.where("ties = 1 and near = 3 and least = k + 1 - 2 * (k % 2)").count() == n


def test_tests_modules_are_linked_by_folders(spark):
    rng = random.Random(5)
    folders = ["/".join(rng.choices("abcdef", k=rng.randrange(1, 4))) for _ in range(30)]
    paths = sorted({f"{rng.choice(folders)}/m{i}.py" for i in range(60)} | {f"{f}/tests/tests.py" for f in folders} | {"tests.py", "top.py"})
    dirs = lambda p: set(p.split("/")[:-1])
    want = set()
    for t in (p for p in paths if p.endswith("tests.py")):
        near = {s: len(dirs(s) & (dirs(t) - {"test", "tests"})) for s in paths if not s.endswith("tests.py")}
        want |= {(s, t) for s, n in near.items() if n and n == max(near.values())}
    got = link.link_by_file_name(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_chosen_tests_take_files_classes_and_ids(spark):
    refs = [" ./t/a.py ", "t\\b.py::C", "t/c.py::test_x", "t/a.py", "", "  ", "t/none.py"]
    asked = spark.createDataFrame(list(enumerate(refs)), "place int, ref string")
    chosen = link.chosen_tests(asked)
    assert [(r.place, r.ref) for r in chosen.collect()] == [(0, "t/a.py"), (1, "t/b.py::C"), (2, "t/c.py::test_x"), (6, "t/none.py")]
    assert link.chosen_tests(asked, 2).count() == 2
    cover = [("t/a.py::test_1", "x.py", 0.5), ("t/a.py::test_1", "y.py", 0.05), ("t/b.py::C::test_2", "x.py", 1.0), ("t/b.py::CC::test_3", "x.py", 1.0), ("t/c.py::test_x", "z.py", 0.1), ("t/c.py::test_xy", "z.py", 0.9)]
    rows = spark.createDataFrame(cover, "test string, file_path string, ratio double")
    got = [(r.src, r.dst, r.link_source, round(r.link_confidence, 6)) for r in link.chosen_coverage(chosen, rows).collect()]
    assert sorted(got) == [("t/a.py::test_1", "x.py", "targeted_coverage", 0.85), ("t/b.py::C::test_2", "x.py", "targeted_coverage", 1.0), ("t/c.py::test_x", "z.py", "targeted_coverage", 0.73)]
    few = link.chosen_coverage(chosen, rows, most=1)
    assert [r.src for r in few.collect()] == ["t/a.py::test_1"]
    report = link.chosen_report(asked, chosen, few, 1).first()
    assert tuple(report) == (1, 4, 1, False, True)  # "./t/a.py" is "t/a.py" again, not one too many
    assert link.chosen_report(asked, link.chosen_tests(asked, 2), few).first().tests_capped


def test_chosen_links_reach_the_store(spark, tmp_path):
    kept = GraphStore(spark, f"file://{tmp_path}/g", 4)
    old = [("t/a.py::test_1", "x.py", "coverage", 0.9, 0.7), ("t/z.py::test_9", "x.py", "coverage", 0.8, 0.4)]
    kinds = "src string, dst string, link_source string, link_confidence double, coverage_pct double"
    kept.save({}, {"depends_on": spark.createDataFrame(old, kinds)}, {"commit": "a"})
    rows = spark.createDataFrame([("t/a.py::test_1", "x.py", 0.5), ("t/a.py::test_1", "y.py", 1.0)], "test string, file_path string, ratio double")
    build.refresh_coverage(spark, kept.path, ["t/a.py"], rows)
    got = sorted((r.src, r.dst, r.link_source, round(r.link_confidence, 6), r.coverage_pct) for r in kept.table("edges", "depends_on").collect())
    assert got == [(*old[0],), ("t/a.py::test_1", "y.py", "targeted_coverage", 1.0, 1.0), (*old[1],)]
    assert kept.manifest()["metadata"] == {"commit": "a"}
