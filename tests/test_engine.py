import random

import pytest
from pyspark.sql import functions as F

from tremor.functions import scalars as S
from tremor.operators import agent, evaluate, impact, link, merge, resolve, select, traverse
from tremor.plans import build
from tremor.sources import code, coverage, logs, tables
from tremor.streaming import incremental

TREE = {
    "src/shapes.py": "from src import checks\n\nclass Shape:\n    def area(self):\n        return self.side() ** 2\n\n    def side(self):\n        return 1\n\nclass Square(Shape):\n    pass\n\ndef scale(x: int, by=2) -> int:\n    return checks.positive(x) * by\n",
    "src/checks.py": "def positive(x):\n    if x < 0:\n        raise ValueError(x)\n    return x\n",
    "src/broken.py": "def broken(:\n",
    "tests/test_shapes.py": "from src.shapes import scale, Shape\n\ndef test_scale():\n    assert scale(2) == 4\n\nclass TestShape:\n    def test_area(self):\n        assert Shape().area() == 1\n",
    "tests/test_checks.py": "from src.checks import positive\n\ndef test_positive():\n    assert positive(1) == 1\n",
    "node_modules/x/skip.py": "x = 1\n",
    ".hidden/skip.py": "x = 1\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("build") / "dist"
    for name, text in TREE.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


@pytest.fixture(scope="module")
def graph(spark, tree):
    return build.build_graph(spark, str(tree))


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, "string" if not isinstance(v, (int, float)) else "double") for k, v in values.items())))
    return row.select(column.alias("x")).first().x


def test_scan_skips_and_parses(spark, graph):
    nodes, edges = graph
    assert {r.path for r in nodes["file"].collect()} == {k for k in TREE if k.startswith(("src/", "tests/"))}
    f = {r.id: r for r in nodes["function"].collect()}
    assert "src/shapes.py::Shape.area:4" in f and f["src/shapes.py::scale:13"].signature == "scale(x: int, by) -> int"
    assert f["src/shapes.py::Shape.area:4"].calls == ["Shape.side"]
    assert {r.name for r in nodes["test"].collect()} == {"test_scale", "TestShape.test_area", "test_positive"}
    assert not [k for k in f if "broken" in k]


def test_edges_of_the_tree(graph):
    nodes, edges = graph
    calls = {(r.src, r.dst): r.resolution_method for r in edges["calls"].collect()}
    assert ("src/shapes.py::scale:13", "src/checks.py::positive:1") in calls
    assert ("src/shapes.py::Shape.area:4", "src/shapes.py::Shape.side:7") in calls
    assert ("tests/test_shapes.py", "src/shapes.py") in {(r.src, r.dst) for r in edges["imports"].collect()}
    assert [(r.src, r.dst) for r in edges["inherits"].collect()] == [("src/shapes.py::Square:10", "src/shapes.py::Shape:3")]
    links = {(r.src, r.dst): r.link_confidence for r in edges["tests"].collect()}
    assert links["test::tests/test_shapes.py::test_scale:3", "src/shapes.py::scale:13"] == 0.8


def test_impact_of_a_change(graph):
    rows = {r.test_id: r for r in build.impacted_tests(graph, ["./src/checks.py"]).collect()}
    assert rows["test::tests/test_checks.py::test_positive:3"].source == "direct"
    assert round(rows["test::tests/test_checks.py::test_positive:3"].score, 3) == 0.905
    assert rows["test::tests/test_shapes.py::test_scale:3"].source == "transitive"


def test_update_reparses_only_what_changed(spark, graph, tree, tmp_path):
    tables.save_graph(str(tmp_path / "g"), *graph)
    saved = tables.load_graph(spark, str(tmp_path / "g"))
    (tree / "src/extra.py").write_text("def more():\n    return 1\n")
    try:
        files = code.scan_tree(spark, str(tree))
        nodes, edges = build.update_graph(saved, files)
        assert "src/extra.py::more:1" in {r.id for r in nodes["function"].collect()}
        assert edges["calls"].count() == graph[1]["calls"].count()
    finally:
        (tree / "src/extra.py").unlink()


def test_save_and_load(spark, graph, tmp_path):
    tables.save_graph(str(tmp_path / "g"), {"file": graph[0]["file"]}, {"calls": graph[1]["calls"]})
    nodes, edges = tables.load_graph(spark, str(tmp_path / "g"))
    assert nodes["file"].count() == 5 and edges["calls"].count() == graph[1]["calls"].count()
    assert nodes["test"].count() == 0 and edges["tests"].columns[0] == "src"
    assert tables.find_nodes(nodes["file"], name=["checks.py"]).count() == 1


def test_paths(spark):
    rows = [("/r/pkg/a.py",), ("pkg/b.py",), ("./pkg/c.py",), ("/other/d.py",), ("pkg/e.txt",), (None,)]
    got = spark.createDataFrame(rows, "p string").select(S.normalise_paths(F.col("p"), "/r").alias("x")).collect()
    assert [r.x for r in got] == ["pkg/a.py", "pkg/b.py", "pkg/c.py", None, None, None]
    assert one(spark, S.module_name(F.col("p")), p="a/b/c.py") == "a.b.c"
    assert one(spark, F.array_join(S.dotted_suffixes(F.col("p")), ","), p="a.b.c") == "b.c,c"
    assert one(spark, S.normalise_node_id(F.col("p")), p="tests\\t.py::test_a[1-2]|run") == "tests/t.py::test_a"
    assert one(spark, S.pytest_node_id(F.lit(None), F.lit(None), F.lit(None), F.col("p")), p="test::tests/test_mod.py::test_alpha:42") == "tests/test_mod.py::test_alpha"
    assert one(spark, S.repo_slug(F.col("p")), p="git@host.example:own/name.git") == "own/name"
    assert one(spark, S.repo_slug(F.col("p")), p="https://host.example/x/own/name") == "own/name"


@pytest.mark.parametrize(("pattern", "name", "hit"), [("test_*.py", "test_a.py", True), ("test_*.py", "a_test.py", False), ("[!a]?", "bc", True), ("*_test.py", "x_test.py", True)])
def test_globs(spark, pattern, name, hit):
    assert one(spark, S.matches_any(F.col("p"), [pattern]), p=name) is hit


def test_target_names(spark):
    assert one(spark, F.array_join(S.target_names(F.col("p")), ","), p="test_query_at_x") == "query_at_x,at_x"
    assert one(spark, F.array_join(S.target_names(F.col("p")), ","), p="TestFoo.test_bar") == "bar"


def test_scores_and_tiers(spark):
    assert round(one(spark, S.impact_score(0.95, F.lit(0.8), 0.3, 4), p="x"), 4) == 0.905
    assert one(spark, S.boosted_score(0.95, F.lit(0.6), 0.3, F.lit(50), 0.2), p="x") == 1.0
    df = spark.createDataFrame([("a", 0.9), ("b", 0.6), ("c", 0.3), ("d", 0.85)], "test_id string, score double")
    assert [r.test_id for r in impact.tiered_top(df, 2).collect()] == ["a", "d"]


def test_hybrid_bonus(spark):
    g = spark.createDataFrame([("t1", "n", "f.py", 0.8, 0.9, 3, ["a"])], "test_id string, test_name string, test_file string, score double, confidence double, line_count int, path array<string>")
    c = spark.createDataFrame([("t1", "n", "f.py", 0.7, 2, ["x.py"]), ("t2", "m", "g.py", 0.65, 1, ["y.py"])], "test_id string, test_name string, test_file string, score double, coverage_hits int, matched_files array<string>")
    rows = {r.test_id: r for r in impact.hybrid_merge(g, c).collect()}
    assert rows["t1"].source == "graph+coverage" and round(rows["t1"].score, 6) == 0.85 and rows["t2"].source == "coverage"


def test_best_paths_against_search(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(14), rng.randrange(14)): rng.choice([0.98, 0.9, 0.7]) for _ in range(40)}
    edges = {k: v for k, v in edges.items() if k[0] != k[1]}
    calls = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "src int, dst int, resolution_confidence double")
    seeds = spark.createDataFrame([(0,), (3,)], "id int")
    want = {}
    for s in (0, 3):
        layer = {s: 1.0}
        for d in (1, 2, 3):
            grown = {}
            for (a, b), c in edges.items():
                if b in layer and (a, s) not in want:
                    grown[a] = max(grown.get(a, 0), layer[b] * c)
            want |= {(a, s): (d, round(v, 9)) for a, v in grown.items()}
            layer = grown
    got = {(r.start, r.seed): (r.depth, round(r.confidence, 9)) for r in traverse.best_paths(calls, seeds).collect()}
    assert got == want
    assert {r.node for r in traverse.reachable_callers(calls, seeds).collect()} == {a for a, _ in want}


def test_upserts(spark):
    old = spark.createDataFrame([("a", "b", "x", 0.5, 0.1), ("a", "c", "x", 0.9, None)], "src string, dst string, link_source string, link_confidence double, coverage double")
    new = spark.createDataFrame([("a", "b", "y", 0.5, 0.0), ("a", "c", "y", 0.4, 0.7)], old.schema)
    got = {r.dst: (r.link_source, r.link_confidence, r.coverage) for r in merge.upsert_edges(old, new, maxima=("coverage",)).collect()}
    assert got == {"b": ("y", 0.5, 0.1), "c": ("x", 0.9, 0.7)}


def test_ranked_resolution_caps_ambiguity(spark):
    f = spark.createDataFrame([("1", "go", None, "m"), ("2", "go", None, "n"), ("3", "run", "K", "m")], "id string, name string, class_name string, module_name string")
    calls = spark.createDataFrame([("3", "go", 0, "x", None), ("3", "n.go", 1, "x", None), ("1", "self.run", 2, "m", "K"), ("1", "", 3, "m", None)], "caller string, called string, seq int, caller_module string, caller_class string")
    got = {(r.src, r.dst): (r.resolution_method, r.resolution_confidence) for r in resolve.resolve_calls_ranked(calls, f).collect()}
    assert got == {("3", "1"): ("simple_name", 0.55), ("3", "2"): ("qualified_name", 0.9), ("1", "3"): ("self_symbol_key", 0.98)}


def test_import_by_stem_takes_the_rightmost_part(spark):
    files = spark.createDataFrame([("a/util.py",), ("b/util.py",), ("b/core.py",)], "path string")
    imports = spark.createDataFrame([("b/core.py", "b.util"), ("a/util.py", "pkg.core.x")], "path string, module string")
    got = {(r.src, r.dst) for r in resolve.resolve_imports_by_stem(imports, files).collect()}
    assert got == {("b/core.py", "b/util.py"), ("a/util.py", "b/core.py")}


def test_file_name_links(spark):
    files = spark.createDataFrame([(p,) for p in ("src/query.py", "src/_forest.py", "tests/test_query_sum.py", "tests/test_forest.py", "app/auth/login.py", "tests/auth/tests.py")], "path string")
    got = {(r.source, r.test) for r in link.link_by_file_name(files).collect()}
    assert got == {("src/query.py", "tests/test_query_sum.py"), ("src/_forest.py", "tests/test_forest.py"), ("app/auth/login.py", "tests/auth/tests.py")}


def test_unified_diff(spark):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -3 +3,2 @@\n-a\n+b\n+c\n@@ -9,2 +10,0 @@\n-d\n-e\ndiff --git a/y.py b/y.py\n--- /dev/null\n+++ b/y.py\n@@ -0,0 +1 @@\n+z\n"
    got = {(r.file_path, r.line) for r in logs.unified_diff(spark.createDataFrame([(diff,)], "diff string")).collect()}
    assert got == {("x.py", 3), ("x.py", 4), ("x.py", 9), ("x.py", 10), ("y.py", 1)}


def test_run_log_last_match_wins(spark):
    text = "Result for a__b-1: resolved: False\n'patch_exists': True\nResult for a__b-1: resolved: True\n"
    r = logs.run_log(spark.createDataFrame([(text,), ("",)], "text string")).collect()
    assert (r[0].instance_id, r[0].resolved, r[0].patch_exists, r[0].patch_applied) == ("a__b-1", True, True, None) and r[1].resolved is None


def test_pytest_output(spark):
    df = spark.createDataFrame([(1, "tests/a.py::test_x PASSED\ntests/a.py::test_y[1] FAILED [50%]\n3 passed, 1 failed, 1 error in 0.5s")], "id int, text string")
    assert [(r.node_id, r.status) for r in logs.pytest_results(df).collect()] == [("tests/a.py::test_x", "PASSED"), ("tests/a.py::test_y[1]", "FAILED")]
    r = logs.pytest_summary(df).first()
    assert (r.passed, r.failed, r.errors) == (3, 1, 1)


def test_selection(spark):
    assert select.parse_selection("1,3,5-7, 3") == [1, 3, 5, 6, 7]
    rows = spark.range(10).select(F.format_string("f%02d", "id").alias("k"))
    assert sorted(r.k for r in select.spread_sample(rows, "k", 4).collect()) == ["f00", "f02", "f05", "f07"]
    assert select.spread_sample(rows, "k", 20).count() == 10


def test_precision_floor_and_guard(spark):
    df = spark.createDataFrame([("a", 0.9, None, True)] + [("a", 0.9, None, False)] * 3, "g string, confidence double, score double, runnable boolean")
    assert agent.precision_floor(df, "g").first().reason == "low_runnable_ratio"
    assert one(spark, agent.graph_guard("both", F.lit(True), F.lit(False)), p="x") == "graph_guard_both_failed:unit_test_change_missing"
    assert one(spark, agent.graph_guard("either", F.lit(True), F.lit(False)), p="x") == ""


def test_trend_needs_three(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(5)] + [("b", 0, 1.0)], "g string, o int, evaluation_score double")
    assert [(r.g, r.first_avg, r.second_avg) for r in evaluate.score_trend(df, "g", ["o"]).collect()] == [("a", 0.5, 3.0)]


def test_streamed_snapshots(spark, tmp_path):
    src, state, changes, ck = (str(tmp_path / x) for x in ("in", "state", "changes", "ck"))
    first = spark.createDataFrame([("a", "1", None, False), ("b", "1", None, False)], "path string, content_hash string, seen_at string, deleted boolean")
    stamp = lambda df, t: df.withColumn("seen_at", F.to_timestamp(F.lit(t)))
    stamp(first, "2024-01-01 00:00:00").write.mode("append").parquet(src)
    incremental.follow_snapshots(spark, src, state, changes, ck).awaitTermination()
    second = spark.createDataFrame([("a", "2", None, False), ("b", None, None, True), ("c", "1", None, False)], first.schema)
    stamp(second, "2024-01-02 00:00:00").write.mode("append").parquet(src)
    incremental.follow_snapshots(spark, src, state, changes, ck).awaitTermination()
    assert {(r.path, r.content_hash) for r in spark.read.parquet(state).collect()} == {("a", "2"), ("c", "1")}
    assert {(r.path, r.status) for r in spark.read.parquet(changes).where("batch = 1").collect()} == {("a", "changed"), ("b", "deleted"), ("c", "new")}


def test_streamed_links_survive_a_replay(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "links")
    spark.createDataFrame([("a", "b", "x", 0.5, 0.1), ("a", "b", "y", 0.7, None)], incremental.LINKS).write.parquet(src)
    for k in range(2):  # another checkpoint: the same batch number again
        incremental.follow_links(spark, src, table, str(tmp_path / f"ck{k}")).awaitTermination()
    assert [tuple(r) for r in incremental.read_state(spark, table, incremental.LINKS).collect()] == [("a", "b", "y", 0.7, 0.1)]


def test_windowed_outcomes(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "ok"), ("2024-01-01 00:09:00", "ok"), ("2024-01-01 00:11:00", "bad")], "t string, status string").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.status, r.n) for r in incremental.windowed_outcomes(rows).collect()) == [("bad", 1), ("ok", 2)]


def test_unknown_strategies_raise():
    assert S.profile(None) == S.profile(" Balanced ")
    with pytest.raises(ValueError, match="unknown strategy"):
        S.profile("fast")


def test_upserts_have_one_winner(spark):
    old = spark.createDataFrame([(1, "o")], "id long, v string")
    new = [spark.createDataFrame(rows, "id long, v string") for rows in ([(1, "x"), (1, "y")], [(1, "y"), (1, "x")])]
    assert merge.upsert_nodes(old, new[0]).collect() == merge.upsert_nodes(old, new[1]).collect()


def test_ranks_over_partitions(spark):
    df = spark.createDataFrame([(f"k{i:03}",) for i in range(300)] + [(None,)], "key string").repartition(7)
    got = {r.key: r.place for r in select.with_rank(df, "key", ranges=9).collect()}
    assert got == {None: 0} | {f"k{i:03}": i + 1 for i in range(300)}


def test_sinks_and_catalogues(spark, tmp_path):
    empty = spark.createDataFrame([], "source string, tests string")
    tables.write_test_map(empty, str(tmp_path / "map"))
    assert [r.value for r in spark.read.text(str(tmp_path / "map")).collect()] == ["# no tests mapped"]
    rows = spark.createDataFrame([(1, "a|b"), (2, None), (3, "c")], "id int, v string").orderBy("id")
    assert tables.markdown(rows, 2) == "| id | v |\n|---|---|\n| 1 | a\\|b |\n| 2 |  |\n\n1 more"
    for name, text in (("predictions_20240102_030405.jsonl", "{}\n\n{}\n"), ("predictions_eval.jsonl", "{}\n"), ("old.jsonl", "{}\n")):
        (tmp_path / "runs").mkdir(exist_ok=True)
        (tmp_path / "runs" / name).write_text(text)
    found = [(r.name, r.n, str(r.stamp)) for r in logs.prediction_catalogue(spark, str(tmp_path / "runs")).collect()]
    assert found == [("predictions_20240102_030405.jsonl", 2, "2024-01-02 03:04:05"), ("old.jsonl", 1, "None")]
    tables.clear_graph(spark, str(tmp_path / "graph"))
    nodes, edges = tables.load_graph(spark, str(tmp_path / "graph"))
    assert all(df.isEmpty() for df in [*nodes.values(), *edges.values()])


def test_seed_files_keep_their_order(spark):
    files = spark.createDataFrame([("pkg/a.py",), ("pkg/b.py",), ("lib/c.py",), ("lib/tests/test_c.py",)], "path string")
    problems = spark.createDataFrame([(1, "see pkg/b.py, no/such.py and ./pkg/a.py or pkg/b.py", ["lib/tests/test_c.py::t"]), (2, None, [])], "instance_id long, text string, tests array<string>")
    imports = spark.createDataFrame([("lib/tests/test_c.py", "pkg/a.py")], "test_file string, path string")
    got = [(r.pos, r.path) for r in select.seed_files(problems, files, imports).orderBy("pos").collect()]
    assert got == [(1, "pkg/b.py"), (2, "pkg/a.py"), (3, "lib/c.py"), (4, "lib/tests/test_c.py")]
    assert select.seed_files(problems, files, most=1).count() == 1


def test_coverage_files(spark, tmp_path):
    import sqlite3

    db = sqlite3.connect(tmp_path / "coverage.data")
    db.executescript("create table file (id integer, path text); create table context (id integer, context text); create table line_bits (file_id integer, context_id integer, numbits blob);")
    db.executemany("insert into file values (?, ?)", [(1, "/repo/src/a.py"), (2, "/repo/tests/test_a.py"), (3, "/other/b.py")])
    db.executemany("insert into context values (?, ?)", [(1, ""), (2, "tests/test_a.py::test_x|run")])
    db.executemany("insert into line_bits values (?, ?, ?)", [(1, 2, bytes([0b1010, 1])), (1, 1, bytes([0b10])), (2, 2, bytes([255])), (3, 2, bytes([255]))])
    db.commit()
    db.close()
    (tmp_path / "broken").write_text("no database")
    found = coverage.read_coverage(spark, str(tmp_path), "/repo")
    assert sorted((r.context or "", r.file_path, r.line) for r in found.collect()) == [("", "src/a.py", 1)] + [("tests/test_a.py::test_x|run", "src/a.py", k) for k in (1, 3, 8)]
    ratios = link.coverage_by_test(found.where("context is not null"), found.select("file_path", "line").distinct())
    assert [tuple(r) for r in ratios.collect()] == [("tests/test_a.py::test_x", "src/a.py", 1.0)]


def test_graph_is_refreshed_when_stale(spark, tmp_path):
    root, path = tmp_path / "dist" / "tree", str(tmp_path / "saved")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    states = []
    for change in (None, None, "def positive(x):\n    return abs(x)\n\ndef negative(x):\n    return -abs(x)\n"):
        if change:
            (root / "src/checks.py").write_text(change)
        (nodes, edges), state = build.open_graph(spark, str(root), path)
        states.append((state, nodes["function"].where("name = 'negative'").count(), edges["tests"].where("src like '%test_positive%'").count() > 0))
    assert states == [("missing", 0, True), ("fresh", 0, True), ("stale", 1, True)]


def test_scans_of_both_engines_and_text_hashes(spark, tmp_path):
    root = tmp_path / "dist" / "t"
    for name in ("a.py", "env/b.py", "build/c.py", ".hidden/d.py", ".git/e.py", "__init__.py", "_in/_f.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x = 1\r\n" if name == "a.py" else b"x = 1\n")
    paths = lambda **how: sorted(r.path for r in code.scan_tree(spark, str(root), **how).collect())
    assert paths(hidden=False, skipped=code.SKIPPED_BY_NAME) == [".hidden/d.py", "__init__.py", "_in/_f.py", "a.py", "env/b.py"]
    assert paths(skipped=code.SKIPPED_IF_HIDDEN) == ["__init__.py", "_in/_f.py", "a.py", "build/c.py"] and paths() == ["__init__.py", "_in/_f.py", "a.py"]
    assert {r.text for r in code.scan_tree(spark, str(root)).where("path like '%\\_%'").collect()} == {"x = 1\n"}
    by = {by_text: {r.path: r.content_hash for r in code.scan_tree(spark, str(root), skipped=(), by_text=by_text).collect()} for by_text in (True, False)}
    assert by[True]["a.py"] == by[True]["build/c.py"] == by[False]["build/c.py"] != by[False]["a.py"]
