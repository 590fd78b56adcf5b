"""Steps over pairs: what they form before the result, and the result against plain loops."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tremor.operators import impact, link, resolve

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def graph(spark):
    """Tests, links, calls, imports; confidences that tie, and links of confidence 0."""
    rng = random.Random(3)
    tests = spark.createDataFrame([(i, f"t{i % 3}.py") for i in range(30)], "id long, file_path string")
    functions = spark.createDataFrame([(i, f"f{i % 9}.py") for i in range(60)], "id long, file_path string")
    links = spark.createDataFrame([(rng.randrange(30), i, rng.choice([0.0, 0.5, 0.9, 1.0, None])) for i in range(60) for _ in range(2)], "src long, dst long, link_confidence double").dropDuplicates(["src", "dst"])
    calls = spark.createDataFrame([(rng.randrange(60), rng.randrange(60), rng.choice([0.7, 0.9, 0.98])) for _ in range(200)], "src long, dst long, resolution_confidence double")
    imports = spark.createDataFrame([(f"t{rng.randrange(3)}.py", f"f{rng.randrange(9)}.py") for _ in range(25)], "src string, dst string")
    changed = spark.createDataFrame([("f1.py",), ("f4.py",), ("f7.py",), ("f8.py",)], "path string")
    seeds = functions.join(changed.withColumnRenamed("path", "file_path"), "file_path").select("id", "file_path")
    return tests, functions, links.orderBy("src", "dst"), calls, imports, changed, seeds


@pytest.mark.parametrize("strategy", ["conservative", "balanced", "aggressive"])
def test_best_of_all_equals_best_of_every_candidate(spark, graph, strategy):
    tests, functions, links, calls, imports, changed, seeds = graph
    direct = impact.direct_tests(links, functions, changed)
    every = {"direct": direct, "transitive": impact.transitive_candidates(calls, links, functions, seeds), "imports": impact.import_tests(tests, imports, changed)}
    few = {"direct": direct, "transitive": impact.transitive_best(calls, links, functions, seeds), "imports": impact.import_files(imports, changed)}
    for names in (["direct", "transitive", "imports"], ["transitive"], ["imports"]):
        want = impact.best_per_test(impact.score_candidates({n: every[n] for n in names}, strategy), 0.1)
        got = impact.best_of_all({n: few[n] for n in names}, tests, strategy, threshold=0.1)
        assert rows_of(got.select(*want.columns)) == rows_of(want)
    lines = spark.createDataFrame([("f1.py", 30), ("f8.py", 3), ("f4.py", 90)], "target_file string, lines long")
    want = impact.best_per_test(impact.score_candidates({"imports": every["imports"]}, strategy, lines))
    got = impact.best_of_all({"imports": few["imports"]}, tests, strategy, lines)
    assert rows_of(got.select(*want.columns)) == rows_of(want)


def test_candidates_are_not_tests_times_files(spark):
    """400 tests of a file that imports 300 changed files: 300 rows, not 120,000; a start of 200 seeds in as many files hands on few."""
    from tremor.plans import impact_queries

    class View:
        tests = spark.range(400).select("id", F.lit("t.py").alias("file_path"))
        files = spark.range(300).select(F.concat(F.lit("f"), "id", F.lit(".py")).alias("path"))
        changed = files
        functions = spark.range(300).select("id", F.concat(F.lit("f"), "id", F.lit(".py")).alias("file_path"))
        seeds = functions.where("id >= 100")
        test_imports = files.select(F.lit("t.py").alias("src"), F.col("path").alias("dst"))
        calls = spark.range(100, 300).select(F.lit(1).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(0.9).alias("resolution_confidence"))
        test_links = spark.range(400).select(F.col("id").alias("src"), F.lit(1).cast("long").alias("dst"), F.lit(0.5).alias("link_confidence"))
        depends = spark.createDataFrame([], "src long, dst string, coverage_pct double, link_confidence double")

    found = impact_queries.candidates(View)
    assert found["imports"].count() == 300
    assert found["transitive"].count() == 400
    best = impact_queries._union(View, "balanced")
    assert best.count() == 400


def above_the_join(df):
    """What the plan does with the pairs after the join that makes them."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(lines) if "Join " in x)
    return [x for x in lines[:at] if "Aggregate" in x or "Window" in x or "Repartition" in x]


def suffixes(name):
    p = name.split(".")
    return {".".join(p[i:]) for i in range(1, len(p))}


def test_pairs_by_name_stand_once_without_a_shuffle(spark):
    """calls_resolve_suffix, inherits_by_name: several shared keys, repeated rows, nulls."""
    rng = random.Random(4)
    functions = [(i, rng.choice("abc"), ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))) for i in range(40)] + [(40, "a", None), (3, "b", "c.b")]
    calls = [(rng.randrange(15), rng.choice(["a", "b.c", "c", "a.b.c", "b", "zz", None])) for _ in range(80)]
    f = spark.createDataFrame(functions, "id long, name string, qualified_name string")
    c = spark.createDataFrame(calls, "caller long, called string")
    got = resolve.resolve_calls_by_suffix(c, f)
    want = {(s, i) for s, k in calls for i, n, q in functions if k is not None and (k == n or (q and k in suffixes(q)))}
    assert rows_of(got) == sorted(want)
    assert above_the_join(got) == []
    bases = spark.createDataFrame([(s, k) for s, k in calls], "child long, base string")
    got = resolve.resolve_bases_by_name(bases, f)
    assert rows_of(got) == sorted({(s, i) for s, k in calls for i, n, _ in functions if k == n and s != i})
    assert above_the_join(got) == []


def test_ranked_lookups_match_loops_without_a_shuffle_of_pairs(spark):
    """calls_resolve_ranked, inherits_resolve: the first rule of a lookup, the best lookup of a pair."""
    rng = random.Random(5)
    keys = sorted({(rng.choice(["simple", "symbol"]), rng.choice("abcd"), rng.randrange(12)) for _ in range(50)})
    lookups = [(rng.randrange(8), seq, [(rng.choice(["simple", "symbol"]), rng.choice(["a", "b", "c", "d", "e", None]), f"m{seq}{j}", rng.choice([0.4, 0.7, 0.9])) for j in range(rng.randrange(1, 5))]) for seq in range(40)]
    k = spark.createDataFrame(keys, "kind string, key string, id long")
    rows = spark.createDataFrame(lookups, "src long, seq long, rules array<struct<kind:string,key:string,method:string,confidence:double>>")
    best = {}
    for src, seq, rules in lookups:
        seen = set()
        for kind, key, method, confidence in rules:
            ids = {i for x, y, i in keys if (x, y) == (kind, key)}
            c = min(confidence, 0.5) if len(ids) > 1 else confidence
            for i in ids - seen - {src}:
                best[src, i] = max(best.get((src, i), (-1.0, -1, "")), (c, seq, method))
            seen |= ids
    got = resolve._ranked(rows, k, 0.5)
    assert rows_of(got) == sorted((s, d, m, c) for (s, d), (c, _, m) in best.items())
    assert above_the_join(got) == []


def test_links_by_name_are_not_grouped_after_the_join(spark):
    """link_naming, link_naming_dotted: an exact name before a dotted one, repeated rows, methods of Test classes."""
    tests = spark.createDataFrame([(1, "test_x", "t.py"), (2, "TestC.test_x", "t.py"), (3, "TestC.test_y", "f.py"), (2, "TestC.test_x", "t.py"), (4, "other", "t.py")], "id long, name string, file_path string")
    functions = spark.createDataFrame([(10, "x", "m.x", "f.py"), (11, "C.x", "m.C.x", "f.py"), (12, "x", None, "t.py"), (13, "C.y", "y", "g.py"), (14, "x", "m.z", "g.py"), (10, "x", "m.x", "f.py")], "id long, name string, qualified_name string, file_path string")
    classes = spark.createDataFrame([(20, "C", "f.py"), (21, "C", "g.py"), (21, "C", "g.py")], "id long, name string, file_path string")
    got = link.link_by_name(tests, functions, classes)
    named = [(s, d, "Function", c) for s in (1, 2) for d, c in ((10, 0.7), (11, 0.65), (14, 0.7))]
    want = sorted([*named, (2, 20, "Class", 0.7), (2, 21, "Class", 0.7), (3, 21, "Class", 0.7)])
    assert rows_of(got.select("src", "dst", "dst_label", "link_confidence")) == want
    assert above_the_join(got) == []


def test_direct_tests_choose_links_before_orders_come_in(spark, tmp_path, monkeypatch):
    """impact_direct, impact_line_boost, nodeid_normalise: no walk is run, and lines of other parts meet no order."""
    from tremor.plans import impact_queries

    spark.range(20).selectExpr("id s_suppkey", "concat('s', id) s_name", "int(id % 3) s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(40).selectExpr("id p_partkey", "'a b' p_name", "int(id % 5 + 1) p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(30).selectExpr("id o_orderkey", "id % 4 o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(120).selectExpr("id % 30 l_orderkey", "id % 40 l_partkey", "double(id % 10) / 100 l_discount").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(6).selectExpr("id event_id", "id user_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(4).selectExpr("id c_custkey", "int(0) c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")

    def walked(*args, **more):
        raise AssertionError("a walk was run")

    monkeypatch.setattr(impact, "best_paths", walked)
    found = {n: impact_queries.QUERIES[n](spark, str(tmp_path)) for n in ("impact_direct", "impact_line_boost", "nodeid_normalise")}
    links = {}
    for i in range(120):
        if i % 40 % 20 % 10 == 0:
            key = i % 30 % 4, f"src/n{i % 20 % 3}/s{i % 20}.py"
            links[key] = max(links.get(key, 0), 1 - i % 10 / 100)
    best = {t: max((c, f) for (u, f), c in links.items() if u == t) for t, _ in links}
    assert rows_of(found["impact_direct"].select("test_id", "target_file")) == sorted((t, f) for t, (_, f) in best.items())
    assert found["nodeid_normalise"].count() == len(best) == found["impact_line_boost"].count()
    for df in found.values():
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        semi = next(i for i, x in enumerate(lines) if "LeftSemi" in x)
        assert any("o_orderkey" in x or "l_orderkey" in x for x in lines[:semi] if "Join Inner" in x)


def test_ranges_that_many_tests_ran_meet_functions_once(spark, monkeypatch):
    """link_overlap: what is joined by lines is the distinct ranges of files, whatever the keys of files and contexts are."""
    rng = random.Random(6)
    contexts = [(c, c % 40) for c in range(60)]
    functions = [(i, i % 3, low, low + rng.choice([-1, 0, 7, 30])) for i in range(40) for low in [rng.randrange(100)]] + [(90, None, 1, 5)]
    ranges = [(c, c % 3, 40, 55) for c in range(70)] + [(rng.randrange(60), rng.randrange(4), low, low + 15) for low in (10, 80) for _ in range(30)]
    linked = [(1, 4), (2, 5), (7, 1)]
    met, pairs = [], link.overlapping_pairs

    def counted(left, *rest):
        met.append(left.count())
        return pairs(left, *rest)

    monkeypatch.setattr(link, "overlapping_pairs", counted)
    got = link.link_coverage_overlap(
        spark.createDataFrame(contexts, "context long, test_id long"),
        spark.createDataFrame(functions, "id long, file_path long, start_line int, end_line int"),
        spark.createDataFrame(ranges, "context long, file_path long, low int, high int"),
        spark.createDataFrame(linked, "src long, dst long"),
    )
    tests = dict(contexts)
    want = {(tests[c], i) for c, f, a, b in ranges if c in tests for i, g, x, y in functions if f == g and x <= y and x <= b and y >= a}
    assert rows_of(got.select("src", "dst")) == sorted(want - set(linked))
    assert met == [len({r[1:] for r in ranges})]


def test_links_by_tokens_are_scored_once_for_tests_that_ask_alike(spark):
    """link_naming_tokens: tests come in after the scores, and pairs are not grouped then; repeated ids, names and files."""
    functions = spark.createDataFrame([(i, f"{'ab'[i % 2]}lpha_{i}", f"m.x{i}", f"tests/n{i % 2}/f.py") for i in range(10)], "id long, name string, qualified_name string, file_path string")
    rows = [(i, "test_alpha_4", f"tests/n{i % 2}/t{i}.py") for i in range(50)] + [(50, "test_blpha_3", "src/t.py"), (51, None, "src/t.py"), (1, "test_blpha_3", "tests/n1/t.py"), (52, "test_alpha_4", None), (3, "test_alpha_4", "tests/n1/t3.py")]
    tests = spark.createDataFrame(rows, "id long, name string, file_path string")
    alone = {}
    for _, name, path in rows:
        key = name, path and path.rsplit("/", 1)[0]
        if key not in alone:
            one = spark.createDataFrame([(0, name, path)], "id long, name string, file_path string")
            alone[key] = [(r.dst, r.link_confidence) for r in link.link_by_tokens(one, functions).collect()]
    best = {}
    for src, name, path in rows:
        for dst, c in alone[name, path and path.rsplit("/", 1)[0]]:
            best[src, dst] = max(best.get((src, dst), 0.0), c)
    got = link.link_by_tokens(tests, functions)
    assert len(best) > 200 and rows_of(got) == sorted((s, d, c) for (s, d), c in best.items())
    assert above_the_join(got) == []


def test_best_paths_of_tests_without_the_path(spark, graph, monkeypatch):
    """impact_transitive_bestpath: the same rows, and the query's walk keeps no path, which it does not return."""
    from tremor.operators import traverse
    from tremor.plans import impact_queries

    _, _, links, calls, _, _, seeds = graph
    kept = traverse.best_path_tests(calls, links, seeds)
    assert rows_of(traverse.best_path_tests(calls, links, seeds, with_path=False)) == rows_of(kept.drop("path"))
    asked, walk = [], traverse.best_paths
    monkeypatch.setattr(traverse, "best_paths", lambda *a, **k: asked.append(k.get("with_path", True)) or walk(*a, **k))

    class View:
        pass

    View.calls, View.test_links, View.seeds = calls, links, seeds
    assert impact_queries.impact_transitive_bestpath(View).count() == kept.count()
    assert asked == [False]


def test_functions_are_not_dealt_out_by_the_test_files_that_import_them(spark):
    """link_static: what is shuffled are files, imports and tests, not functions times test files; repeated rows, nulls, ids in two files."""
    rng = random.Random(8)
    tests = [(i, f"t{i % 40}.py") for i in range(120)] + [(3, "t3.py"), (4, "t9.py"), (121, None)]
    functions = [(i, f"n{i % 7}", f"f{i % 2}.py") for i in range(200)] + [(5, "n5", "f1.py"), (5, "n6", "f1.py"), (6, None, "f0.py"), (7, "n1", None), (8, "n1", "f9.py")]
    imports = [(f"t{i % 40}.py", f"f{i % 2 if i < 40 else rng.randrange(3)}.py") for i in range(80)] + [("t1.py", None), (None, "f1.py")]
    calls = [(rng.randrange(120), f"{rng.choice(['', 'm.', 'self.'])}n{rng.randrange(9)}") for _ in range(150)] + [(1, None)]
    names = {t: {c.split(".")[-1] for x, c in calls if x == t and c} for t, _ in tests}
    pairs = {(t, p, d, n, f) for t, p in tests for d, n, f in functions if p and f and (p, f) in imports}
    want = sorted((t, d, 0.8 if n in names[t] else 0.5) for t, _, d, n, _ in pairs)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((tests, "id long, file_path string"), (imports, "src string, dst string"), (functions, "id long, name string, file_path string"), (calls, "test long, called string"))]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = link.link_by_imports(*frames)
        assert rows_of(got.select("src", "dst", "link_confidence")) == want
        assert rows_of(link.link_by_imports(*frames, every=True).select("src", "dst", "link_confidence")) == [(t, d, 0.8) for t, d, _ in want]

        def dealt(plan):
            own = plan.metrics().get("shuffleRecordsWritten").get().value() if plan.nodeName() == "Exchange" else 0
            return own + sum(dealt(plan.children().apply(i)) for i in range(plan.children().size()))

        run = got._jdf.queryExecution()
        run.toRdd().count()
        rows = dealt(run.executedPlan())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(want) > 10000 and 0 < rows < 1500


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_coverage_of_chosen_files_is_worked_out_once(spark, monkeypatch):
    """strategy_hybrid: what the changed files cover, and the starts that reach them, are written once and read again."""
    from tremor.plans import binding, rule_queries
    from tremor.sources import scratch

    written, write = {}, scratch.staged

    def kept(df, name):
        written.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(scratch, "staged", kept)
    rule_queries.strategy_hybrid(binding.Tables(spark, DATA))
    assert len(written["covered"]) == len(written["best"]) == 1
