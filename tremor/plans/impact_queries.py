"""Impact queries over the graph views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import PROFILES, scaled
from ..operators import impact, traverse
from .binding import Tables, ctes

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = ctes(sql)
        return f

    return add


S = "CAST(floor({} * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def score_sql(weight: float, cw: float, boost: str = "") -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {1.0 - cw!r}::DOUBLE * {weight!r}::DOUBLE + {cw!r}::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, confidence)){boost}))"


def union_sql(profile: str) -> str:
    w = PROFILES[profile]
    parts = (("direct", "direct"), ("transitive", "transitive"), ("coverage", "coverage_hits"), ("imports", "import_hits"))
    rows = "\nUNION ALL ".join(f"SELECT test_id, target_file, least(1.0::DOUBLE, greatest(0.0::DOUBLE, confidence)) AS confidence, {score_sql(w[s], w['confidence_weight'])} AS score, '{s}' AS source, {i} AS source_rank FROM {v}" for i, (s, v) in enumerate(parts))
    return f"""WITH scored AS ({rows}),
best AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY score DESC, confidence DESC, source_rank, target_file DESC) AS rn FROM scored WHERE score >= 0.1)
"""


def candidates(t: Tables, *sources: str) -> dict[str, DataFrame]:
    """Candidates by strategy, of all or of the named ones; only what is asked for is planned, as a walk runs at once."""
    found = {
        # the maxima come out alike from ungrouped links, which changed symbols cut down before orders come in
        "direct": lambda: impact.direct_tests(getattr(t, "line_links", t.test_links), t.functions, t.changed),
        "transitive": lambda: impact.transitive_best(t.calls, t.test_links, t.functions, t.seeds),
        "coverage": lambda: impact.coverage_tests(t.depends, t.changed),
        "imports": lambda: impact.import_files(t.test_imports, t.changed),
    }
    return {s: found[s]() for s in sources or found}


def _union(t: Tables, profile: str) -> DataFrame:
    return impact.best_of_all(candidates(t), t.tests, profile, threshold=0.1)


def _one(t: Tables, source: str) -> DataFrame:
    best = impact.best_of_all(candidates(t, source), t.tests)
    return best.select("test_id", "target_file", scaled(F.col("confidence")).alias("confidence_e6"), scaled(F.col("score")).alias("score_e6"))


def _one_sql(source: str, view: str) -> str:
    w = PROFILES["balanced"]
    return f"""WITH scored AS (SELECT test_id, target_file, confidence, {score_sql(w[source], w['confidence_weight'])} AS score FROM {view}),
r AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY score DESC, confidence DESC, target_file DESC) AS rn FROM scored)
SELECT test_id, target_file, {S.format('confidence')} AS confidence_e6, {S.format('score')} AS score_e6 FROM r WHERE rn = 1"""


@query(_one_sql("direct", "direct"))
def impact_direct(t: Tables) -> DataFrame:
    return _one(t, "direct")


@query(_one_sql("coverage", "coverage_hits"))
def impact_coverage(t: Tables) -> DataFrame:
    return _one(t, "coverage")


@query(_one_sql("imports", "import_hits"))
def impact_imports(t: Tables) -> DataFrame:
    return _one(t, "imports")


@query(f"""SELECT l.src AS test_id, min(depth) AS depth, {S.format('max(l.link_confidence * 0.7::DOUBLE)')} AS confidence_e6
FROM test_links l JOIN reached r ON r.node = l.dst GROUP BY l.src""")
def impact_transitive_flat(t: Tables) -> DataFrame:
    out = traverse.transitive_tests(t.calls, t.test_links, t.seeds)
    return out.select("test_id", "depth", scaled(F.col("confidence")).alias("confidence_e6"))


@query(f"""SELECT l.src AS test_id, p.start, p.seed, p.depth, {S.format('l.link_confidence * p.confidence / p.depth')} AS confidence_e6
FROM test_links l JOIN paths p ON p.start = l.dst""")
def impact_transitive_bestpath(t: Tables) -> DataFrame:
    out = traverse.best_path_tests(t.calls, t.test_links, t.seeds, with_path=False)
    return out.select("test_id", "start", "seed", "depth", scaled(F.col("confidence")).alias("confidence_e6"))


@query("SELECT node, depth FROM reached")
def reachable_callers_3hop(t: Tables) -> DataFrame:
    return traverse.reachable_callers(t.calls, t.seeds)


UNION_COLUMNS = f"SELECT test_id, source, target_file, {S.format('confidence')} AS confidence_e6, {S.format('score')} AS score_e6 FROM best WHERE rn = 1"


def _union_out(t: Tables, profile: str) -> DataFrame:
    return _union(t, profile).select("test_id", "source", "target_file", scaled(F.col("confidence")).alias("confidence_e6"), scaled(F.col("score")).alias("score_e6"))


@query(union_sql("conservative") + UNION_COLUMNS)
def impact_union_conservative(t: Tables) -> DataFrame:
    return _union_out(t, "conservative")


@query(union_sql("balanced") + UNION_COLUMNS)
def impact_union_balanced(t: Tables) -> DataFrame:
    return _union_out(t, "balanced")


@query(union_sql("aggressive") + UNION_COLUMNS)
def impact_union_aggressive(t: Tables) -> DataFrame:
    return _union_out(t, "aggressive")


@query(union_sql("balanced") + f"""SELECT test_id, {S.format('score')} AS score_e6, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS tier
FROM best WHERE rn = 1 ORDER BY CASE WHEN score >= 0.8 THEN 0 WHEN score >= 0.5 THEN 1 ELSE 2 END, score DESC, test_id LIMIT 50""")
def impact_tiered_topk(t: Tables) -> DataFrame:
    top = impact.tiered_top(_union(t, "balanced").drop("line_count"), 50)
    return top.select("test_id", scaled(F.col("score")).alias("score_e6"), "tier")


@query(union_sql("balanced") + """SELECT count(*) AS total, count(*) FILTER (score >= 0.8) AS high, count(*) FILTER (score >= 0.5 AND score < 0.8) AS medium, count(*) FILTER (score < 0.5) AS low FROM best WHERE rn = 1""")
def impact_tier_counts(t: Tables) -> DataFrame:
    return impact.tier_counts(_union(t, "balanced")).drop("average")


@query("""SELECT DISTINCT f.id, f.file_path FROM functions f JOIN changed_lines c ON c.file_path = f.file_path AND c.line BETWEEN f.start_line AND f.end_line
WHERE f.file_path IN (SELECT path FROM changed)""")
def changed_symbols(t: Tables) -> DataFrame:
    lines = t.changed_lines.join(t.changed.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return impact.changed_symbols(t.functions, lines)


_W = PROFILES["balanced"]
_BOOST = f" + CASE WHEN lines > 0 THEN least({_W['line_boost_max']!r}::DOUBLE, lines / 100.0::DOUBLE) ELSE 0.0::DOUBLE END"


@query(f"""WITH d AS (SELECT d.*, coalesce(lines, 0) AS lines FROM direct d LEFT JOIN line_counts c ON c.target_file = d.target_file),
s AS (SELECT *, {score_sql(_W['direct'], _W['confidence_weight'], _BOOST)} AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY score DESC, confidence DESC, target_file DESC) AS rn FROM s)
SELECT test_id, target_file, lines AS line_count, {S.format('score')} AS score_e6 FROM r WHERE rn = 1""")
def impact_line_boost(t: Tables) -> DataFrame:
    counts = t.changed_lines.groupBy(F.col("file_path").alias("target_file")).agg(F.count_distinct("line").alias("lines"))
    best = impact.best_per_test(impact.score_candidates(candidates(t, "direct"), "balanced", counts))
    return best.select("test_id", "target_file", "line_count", scaled(F.col("score")).alias("score_e6"))


_DIFF = """cov AS (SELECT test AS test_id, max(ratio) AS score, count(*) AS hits, array_to_string(list(file_path ORDER BY ratio DESC, file_path)[1:5], ',') AS files
FROM coverage WHERE file_path IN (SELECT path FROM changed) GROUP BY test HAVING max(ratio) >= 0.05)"""


@query(f"WITH {_DIFF} SELECT test_id, {S.format('score')} AS score_e6, hits AS coverage_hits, files AS matched_files FROM cov")
def impact_coverage_diff(t: Tables) -> DataFrame:
    out = impact.coverage_diff(t.coverage, t.changed)
    return out.select("test_id", scaled(F.col("score")).alias("score_e6"), "coverage_hits", F.array_join("matched_files", ",").alias("matched_files"))


@query(union_sql("balanced").rstrip() + f""",
{_DIFF},
m AS (SELECT coalesce(g.test_id, c.test_id) AS test_id, coalesce(g.score, 0.0::DOUBLE) AS gs, coalesce(c.score, 0.0::DOUBLE) AS cs, coalesce(c.hits, 0) AS coverage_hits
  FROM (SELECT * FROM best WHERE rn = 1) g FULL JOIN cov c ON c.test_id = g.test_id),
o AS (SELECT test_id, gs, cs, coverage_hits, least(1.0::DOUBLE, greatest(gs, cs) + CASE WHEN gs > 0 AND cs > 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END) AS score,
  CASE WHEN gs > 0 AND cs > 0 THEN 'graph+coverage' WHEN cs > 0 THEN 'coverage' ELSE 'graph' END AS source FROM m)
SELECT CAST(test_id AS VARCHAR) AS test_id, source, coverage_hits, {S.format('score')} AS score_e6, {S.format('gs')} AS graph_e6, {S.format('cs')} AS coverage_e6
FROM o ORDER BY score DESC, gs DESC, cs DESC, CAST(test_id AS VARCHAR) LIMIT 300""")
def impact_hybrid_merge(t: Tables) -> DataFrame:
    names = t.tests.select(F.col("id").alias("test_id"), F.col("name").alias("test_name"), F.col("file_path").alias("test_file"))
    g = _union(t, "balanced").join(names, "test_id").withColumn("path", F.array("source"))
    c = impact.coverage_diff(t.coverage, t.changed).join(names, "test_id")
    text = F.col("test_id").cast("string")
    top = impact.hybrid_top(impact.hybrid_merge(g.withColumn("test_id", text), c.withColumn("test_id", text)))
    return top.select("test_id", "source", "coverage_hits", scaled(F.col("score")).alias("score_e6"), scaled(F.col("graph_score")).alias("graph_e6"), scaled(F.col("coverage_score")).alias("coverage_e6"))


@query("""SELECT 'node' AS kind, 'file' AS label, (SELECT count(*) FROM files) AS n UNION ALL SELECT 'node', 'function', (SELECT count(*) FROM functions)
UNION ALL SELECT 'node', 'test', (SELECT count(*) FROM tests) UNION ALL SELECT 'edge', 'tests', (SELECT count(*) FROM test_links)
UNION ALL SELECT 'edge', 'calls', (SELECT count(*) FROM calls) UNION ALL SELECT 'edge', 'imports', (SELECT count(*) FROM imports)
UNION ALL SELECT 'edge', 'depends_on', (SELECT count(*) FROM depends)""")
def graph_stats(t: Tables) -> DataFrame:
    return impact.graph_stats({"file": t.files, "function": t.functions, "test": t.tests}, {"tests": t.test_links, "calls": t.calls, "imports": t.imports, "depends_on": t.depends})


@query("""SELECT f.file_path AS source, array_to_string(list_sort(list(DISTINCT t.file_path)), ' ') AS tests
FROM test_links l JOIN functions f ON f.id = l.dst JOIN tests t ON t.id = l.src GROUP BY f.file_path""")
def test_map(t: Tables) -> DataFrame:
    return impact.test_map(t.test_links, t.functions, t.tests)


@query("""WITH f AS (SELECT test_id, 'tests/x.py::' || test_id || CASE WHEN test_id % 2 = 0 THEN '[p]' ELSE '|run' END AS node_id FROM direct GROUP BY test_id)
SELECT node_id, regexp_replace(split_part(node_id, '|', 1), '\\[.*\\]', '') AS plain FROM f""")
def nodeid_normalise(t: Tables) -> DataFrame:
    from ..functions.scalars import normalise_node_id

    ids = candidates(t, "direct")["direct"].select("test_id").distinct()
    node = F.concat(F.lit("tests/x.py::"), F.col("test_id"), F.when(F.col("test_id") % 2 == 0, "[p]").otherwise("|run"))
    return ids.select(node.alias("node_id")).select("node_id", normalise_node_id(F.col("node_id")).alias("plain"))
