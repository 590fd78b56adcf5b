"""Evaluation analytics, parsing and loop queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import scaled
from ..operators import agent, evaluate, select
from ..sources import logs
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


def _pct(expr: str) -> str:
    return f"CAST(floor(({expr}) * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def _tests(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Expected tests and outcomes of instances (users) from events."""
    e = t.read("events")
    test = F.concat(F.lit("t"), F.col("event_id") % 12)
    instance = F.col("user_id").alias("instance_id")
    expected = e.select(instance, F.when(F.col("event_id") % 12 < 4, "F2P").otherwise("P2P").alias("kind"), test.alias("test")).distinct()
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type").isin("view", "click"), "PASSED").otherwise("SKIPPED")
    return expected, e.select(instance, test.alias("test"), status.alias("status"))


_MEMBERSHIP = """expected AS (SELECT DISTINCT user_id AS instance_id, CASE WHEN event_id % 12 < 4 THEN 'F2P' ELSE 'P2P' END AS kind, 't' || (event_id % 12) AS test FROM events),
results AS (SELECT user_id AS instance_id, 't' || (event_id % 12) AS test, bool_or(event_type IN ('view', 'click')) AS passed, bool_or(event_type = 'error') AS failed FROM events GROUP BY ALL),
m AS (SELECT e.instance_id, count(*) FILTER (kind = 'F2P') AS f2p_total, count(*) FILTER (kind = 'F2P' AND passed) AS f2p_passed, count(*) FILTER (kind = 'F2P' AND failed) AS f2p_failed,
  count(*) FILTER (kind = 'P2P') AS p2p_total, count(*) FILTER (kind = 'P2P' AND passed) AS p2p_passed, count(*) FILTER (kind = 'P2P' AND failed) AS p2p_failed
  FROM expected e LEFT JOIN results r ON r.instance_id = e.instance_id AND r.test = e.test GROUP BY ALL),
i AS (SELECT *, f2p_total > 0 AND f2p_failed = 0 AS issue_fixed, p2p_failed > 0 AS has_regressions, f2p_total > 0 AND f2p_failed = 0 AND p2p_failed = 0 AS clean_resolution, f2p_passed + f2p_failed > 0 AS f2p_observed FROM m)"""


@query(f"WITH {_MEMBERSHIP} SELECT * FROM i")
def expected_membership(t: Tables) -> DataFrame:
    return evaluate.expected_membership(*_tests(t))


@query(f"""WITH {_MEMBERSHIP}, x AS (SELECT *, CASE WHEN instance_id % 7 = 0 THEN NULL ELSE clean_resolution END AS resolved, instance_id % 4 <> 0 AS generated FROM i)
SELECT count(*) AS instances, count(*) FILTER (resolved) AS resolved, count(*) FILTER (issue_fixed) AS issue_fixed, count(*) FILTER (has_regressions) AS has_regressions, count(*) FILTER (clean_resolution) AS clean_resolution,
count(*) FILTER (generated) AS generated, CAST(sum(p2p_failed) AS BIGINT) AS p2p_failed, CAST(sum(p2p_total) AS BIGINT) AS p2p_total,
{_pct("count(*) FILTER (resolved)::DOUBLE / count(*)")} AS resolved_e6, {_pct("count(*) FILTER (has_regressions AND generated)::DOUBLE / count(*) FILTER (generated)")} AS regressed_per_generated_e6,
{_pct("sum(p2p_failed)::DOUBLE / sum(p2p_total)::DOUBLE")} AS test_regression_e6 FROM x""")
def regression_summary(t: Tables) -> DataFrame:
    i = evaluate.expected_membership(*_tests(t))
    i = i.withColumn("resolved", F.when(F.col("instance_id") % 7 != 0, F.col("clean_resolution"))).withColumn("generated", F.col("instance_id") % 4 != 0)
    out = evaluate.regression_summary(i)
    return out.select(
        "instances", "resolved", "issue_fixed", "has_regressions", "clean_resolution", "generated", "p2p_failed", "p2p_total", scaled(F.col("resolved_per_instance")).alias("resolved_e6"),
        scaled(F.col("regressed_per_generated")).alias("regressed_per_generated_e6"), scaled(F.col("test_regression_rate")).alias("test_regression_e6"),
    )


_MODE = "SELECT user_id AS instance_id, bool_or(event_type = 'purchase' AND value > 50) AS resolved, bool_or(event_type = 'click') AS generated FROM events WHERE {} GROUP BY ALL"
# Every event belongs to one of two modes: whether its number and its user's agree in the last bit.
_A, _B = "(event_id + user_id) % 2 = 0", "(event_id + user_id) % 2 = 1"


def _mode(t: Tables, which: str) -> DataFrame:
    e = t.read("events").where(which)
    return e.groupBy(F.col("user_id").alias("instance_id")).agg(F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 50)).alias("resolved"), F.bool_or(F.col("event_type") == "click").alias("generated"))


@query(f"""WITH a AS ({_MODE.format(_A)}), b AS ({_MODE.format(_B)})
SELECT coalesce(a.instance_id, b.instance_id) AS instance_id, a.resolved AS a_resolved, b.resolved AS b_resolved, a.generated AS a_generated, b.generated AS b_generated,
CASE WHEN a.instance_id IS NULL THEN 'only_b' WHEN b.instance_id IS NULL THEN 'only_a' WHEN NOT a.resolved AND b.resolved THEN 'gained' WHEN a.resolved AND NOT b.resolved THEN 'lost' ELSE 'same' END AS change
FROM a FULL JOIN b ON b.instance_id = a.instance_id""")
def two_mode_delta(t: Tables) -> DataFrame:
    return evaluate.two_mode_delta(_mode(t, _A), _mode(t, _B))


@query(f"""WITH x AS (SELECT 'a' AS mode, * FROM ({_MODE.format(_A)}) UNION ALL SELECT 'b', * FROM ({_MODE.format(_B)}))
SELECT mode, count(*) AS n, CAST(round(100.0::DOUBLE * count(*) FILTER (generated) / count(*), 2) * 100 AS BIGINT) AS generated_x100, CAST(round(100.0::DOUBLE * count(*) FILTER (resolved) / count(*), 2) * 100 AS BIGINT) AS resolved_x100 FROM x GROUP BY mode""")
def mode_rates(t: Tables) -> DataFrame:
    both = _mode(t, _A).withColumn("mode", F.lit("a")).unionByName(_mode(t, _B).withColumn("mode", F.lit("b")))
    x = lambda c: F.round(F.col(c) * 100).cast("long").alias(c.replace("_pct", "_x100"))
    return evaluate.mode_rates(both).select("mode", "n", x("generated_pct"), x("resolved_pct"))


@query("""WITH p AS (SELECT CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE text END AS prediction FROM documents), s AS (SELECT CASE WHEN regexp_matches(prediction, '\\S') THEN length(prediction) END AS n FROM p)
SELECT count(*) AS total, count(n) AS generated, CAST(floor(avg(n)) AS BIGINT) AS mean_length, CAST(floor(median(n)) AS BIGINT) AS median_length, max(n) AS max_length FROM s""")
def generation_stats(t: Tables) -> DataFrame:
    d = t.read("documents").select(F.when(F.col("doc_id") % 6 == 0, " ").otherwise(F.col("text")).alias("prediction"))
    return evaluate.generation_stats(d)


_ERROR = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Failed to set up repository: ' || event_type WHEN 2 THEN 'Execution failed (' || event_type || ')' ELSE event_type END"


@query(f"""WITH e AS (SELECT {_ERROR} AS error FROM events)
SELECT CASE WHEN contains(error, 'Failed to set up repository') THEN 'Repository Setup' WHEN contains(error, 'Execution failed') THEN 'Execution Failed' ELSE 'Other' END AS category, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY ALL""")
def error_categories(t: Tables) -> DataFrame:
    return evaluate.error_counts(t.read("events").select(F.expr(_ERROR).alias("error")))


@query("""WITH r AS (SELECT o_orderpriority AS variant, o_totalprice > 100000 AS generated, CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS resolved, o_orderstatus = 'F' AND o_custkey % 2 = 0 AS clean,
  CAST(o_custkey % 600 AS BIGINT) AS seconds, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS patch_size FROM orders)
SELECT variant, count(*) AS n, count(*) FILTER (generated) AS generated, count(*) FILTER (resolved) AS resolved, count(*) FILTER (clean) AS clean, 100 * count(*) FILTER (generated) // count(*) AS generated_pct,
100 * count(*) FILTER (resolved) // count(*) AS resolved_pct, 100 * count(*) FILTER (clean) // count(*) AS clean_pct, CAST(floor(avg(seconds) * 1000 + 0.5) AS BIGINT) AS avg_ms, CAST(floor(avg(patch_size) * 1000 + 0.5) AS BIGINT) AS avg_patch_x1000,
CAST(sum(seconds) AS BIGINT) AS total_seconds FROM r GROUP BY variant""")
def variant_rollup(t: Tables) -> DataFrame:
    o = t.read("orders")
    status = F.col("o_orderstatus")
    r = o.select(F.col("o_orderpriority").alias("variant"), (F.col("o_totalprice") > 100000).alias("generated"), F.when(status == "F", True).when(status == "O", False).alias("resolved"), ((status == "F") & (F.col("o_custkey") % 2 == 0)).alias("clean"), (F.col("o_custkey") % 600).alias("seconds"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("patch_size"))
    out = evaluate.variant_rollup(r)
    return out.select("variant", "n", "generated", "resolved", "clean", "generated_pct", "resolved_pct", "clean_pct", scaled(F.col("avg_seconds"), 1e3).alias("avg_ms"), scaled(F.col("avg_patch_size"), 1e3).alias("avg_patch_x1000"), "total_seconds")


_LOG = """log AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'completed' WHEN event_type = 'signup' THEN NULL ELSE 'pending' END AS evaluation_status,
  CAST(floor(value * 100 + 0.5) AS BIGINT) AS generation_score, CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value * 50 + 0.5) AS BIGINT) END AS evaluation_score, event_id % 90 AS generation_time, event_id % 45 AS evaluation_time FROM events)"""


def _log(t: Tables) -> DataFrame:
    e = t.read("events")
    status = F.when(F.col("event_type").isin("view", "click"), "completed").when(F.col("event_type") == "signup", F.lit(None)).otherwise("pending")
    return e.select("event_id", "user_id", "ts", status.alias("evaluation_status"), scaled(F.col("value"), 100).alias("generation_score"), F.when(F.col("event_id") % 3 != 0, scaled(F.col("value"), 50)).alias("evaluation_score"), (F.col("event_id") % 90).alias("generation_time"), (F.col("event_id") % 45).alias("evaluation_time"))


@query(f"""WITH {_LOG}, d AS (SELECT *, evaluation_status IS NOT DISTINCT FROM 'completed' AS done FROM log),
a AS (SELECT avg(generation_score) FILTER (done) AS g, avg(evaluation_score) FILTER (done) AS e FROM d)
SELECT count(*) AS runs, count(*) FILTER (done) AS evaluated, count(*) FILTER (NOT done) AS pending, min(generation_score) FILTER (done) AS min_generation, max(generation_score) FILTER (done) AS max_generation,
min(evaluation_score) FILTER (done) AS min_evaluation, max(evaluation_score) FILTER (done) AS max_evaluation, (SELECT {_pct('g')} FROM a) AS avg_generation_e6, (SELECT {_pct('e')} FROM a) AS avg_evaluation_e6, (SELECT {_pct('e / g')} FROM a) AS success_e6,
CAST(sum(generation_time) AS BIGINT) AS generation_seconds, CAST(sum(evaluation_time) FILTER (done) AS BIGINT) AS evaluation_seconds FROM d""")
def score_stats(t: Tables) -> DataFrame:
    s = evaluate.score_stats(_log(t))
    return s.select(
        "runs", "evaluated", "pending", F.col("min_generation").cast("long").alias("min_generation"), F.col("max_generation").cast("long").alias("max_generation"), "min_evaluation", "max_evaluation",
        scaled(F.col("avg_generation")).alias("avg_generation_e6"), scaled(F.col("avg_evaluation")).alias("avg_evaluation_e6"), scaled(F.col("success_ratio")).alias("success_e6"), "generation_seconds", "evaluation_seconds",
    )


@query(f"""WITH {_LOG}, e AS (SELECT user_id, coalesce(evaluation_score, 0) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM log WHERE evaluation_status = 'completed'),
x AS (SELECT user_id, any_value(n) AS n, avg(s) FILTER (rn <= n // 2) AS f, avg(s) FILTER (rn > n // 2) AS l FROM e WHERE n >= 3 GROUP BY user_id)
SELECT user_id, n, {_pct('f')} AS first_e6, {_pct('l')} AS second_e6 FROM x""")
def score_trend(t: Tables) -> DataFrame:
    log = _log(t).where("evaluation_status = 'completed'").withColumn("evaluation_score", F.coalesce("evaluation_score", F.lit(0)))
    out = evaluate.score_trend(log, "user_id", ["ts", "event_id"])
    return out.select("user_id", "n", scaled(F.col("first_avg")).alias("first_e6"), scaled(F.col("second_avg")).alias("second_e6"))


@query("""WITH x AS (SELECT o_orderpriority || o_orderstatus AS name, count(*) FILTER (o_totalprice > 100000)::DOUBLE / count(*) AS rate, avg(o_custkey % 600) AS s, avg(o_custkey) AS z FROM orders GROUP BY ALL)
SELECT (SELECT name FROM x ORDER BY rate DESC, name DESC LIMIT 1) AS by_generation, (SELECT name FROM x ORDER BY s, name LIMIT 1) AS by_time, (SELECT name FROM x ORDER BY z, name LIMIT 1) AS by_size,
(SELECT name FROM x WHERE rate >= (SELECT max(rate) FROM x) * 0.95 ORDER BY s, name LIMIT 1) AS pick""")
def best_experiment(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    x = t.read("orders").groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("name")).agg((F.count_if(F.col("o_totalprice") > 100000) / n).alias("generation_rate"), F.avg(F.col("o_custkey") % 600).alias("avg_seconds"), F.avg("o_custkey").alias("avg_size"))
    return evaluate.best_experiments(x).drop("best_rate")


_RECON = "r AS (SELECT o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS resolved FROM orders)"


def _instances(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.read("orders").select(F.col("o_orderkey").cast("string").alias("instance_id"), F.when(s == "F", True).when(s == "O", False).alias("resolved"))


@query(f"WITH {_RECON} SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS instance_id FROM r WHERE resolved IS NULL")
def incomplete_instances(t: Tables) -> DataFrame:
    return evaluate.incomplete_instances(_instances(t))


@query(f"""WITH {_RECON} SELECT count(*) AS total, count(*) FILTER (resolved) AS resolved, count(*) FILTER (NOT resolved) AS unresolved, count(*) FILTER (resolved IS NULL) AS incomplete,
{_pct("count(*) FILTER (resolved)::DOUBLE / count(*)")} AS rate_e6 FROM r""")
def reconstruct_rollup(t: Tables) -> DataFrame:
    return evaluate.reconstruct_rollup(_instances(t)).select("total", "resolved", "unresolved", "incomplete", scaled(F.col("resolved_rate")).alias("rate_e6"))


_ATTEMPTS = """a AS (SELECT user_id, event_id, ts, event_type AS sig, event_id % 4 AS f2p, event_id % 3 AS reg, event_type = 'purchase' AND value > 100 AS clean FROM events),
l AS (SELECT *, row_number() OVER w AS rn, lag(sig) OVER w AS psig, lag(f2p) OVER w AS pf2p, lag(reg) OVER w AS preg, lag(clean) OVER w AS pclean FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CASE WHEN rn = 1 THEN 'first_attempt' WHEN f2p > pf2p THEN 'new_issue_tests_green' WHEN reg < preg THEN 'regression_failures_reduced' WHEN clean AND NOT pclean THEN 'clean_resolution_improved'
  WHEN sig IS DISTINCT FROM psig THEN 'failure_signature_changed' ELSE 'stagnant_failure_signature' END AS reason FROM l),
g AS (SELECT *, sum(CASE WHEN reason <> 'stagnant_failure_signature' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM r)"""


@query(f"""WITH {_ATTEMPTS} SELECT event_id, reason, reason <> 'stagnant_failure_signature' AS passed, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1 AS stagnation FROM g""")
def progress_gate(t: Tables) -> DataFrame:
    e = t.read("events")
    a = e.select("user_id", "event_id", "ts", F.col("event_type").alias("failure_signature"), (F.col("event_id") % 4).alias("f2p_passed"), (F.col("event_id") % 3).alias("regression_failed"), ((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("clean_resolution"))
    return agent.progress_gate(a, "user_id", ["ts", "event_id"]).select("event_id", "reason", "passed", F.col("stagnation").cast("long").alias("stagnation"))


@query(f"""WITH d AS (SELECT doc_id, list_distinct(string_split(source || ' ' || lang || ' ' || (doc_id % 3), ' ')) AS files, length(text) AS n, md5(text) AS h FROM documents),
p AS (SELECT a.doc_id, a.h = b.h AS same, len(list_intersect(a.files, b.files))::DOUBLE / len(list_distinct(list_concat(a.files, b.files)))::DOUBLE AS j, CASE WHEN a.n > 0 AND b.n > 0 THEN least(a.n, b.n)::DOUBLE / greatest(a.n, b.n)::DOUBLE ELSE 0.0::DOUBLE END AS s
  FROM d a JOIN d b ON b.doc_id = a.doc_id + 20)
SELECT doc_id, {_pct("CASE WHEN same THEN 1.0::DOUBLE ELSE 0.65::DOUBLE * j + 0.35::DOUBLE * s END")} AS similarity_e6 FROM p""")
def attempt_similarity(t: Tables) -> DataFrame:
    d = t.read("documents").select("doc_id", F.array_distinct(F.split(F.concat_ws(" ", "source", "lang", (F.col("doc_id") % 3).cast("string")), " ")).alias("files"), F.length("text").alias("n"), F.md5("text").alias("h"))
    b = d.select((F.col("doc_id") - 20).alias("doc_id"), F.col("files").alias("files2"), F.col("n").alias("n2"), F.col("h").alias("h2"))
    s = agent.attempt_similarity(F.col("files"), F.col("files2"), F.col("n"), F.col("n2"), F.col("h"), F.col("h2"))
    return d.join(b, "doc_id").select("doc_id", scaled(s).alias("similarity_e6"))


@query("""WITH c AS (SELECT user_id, event_id, event_type = 'purchase' AS valid, value > 100 AS clean, event_id % 3 = 0 AS verify, event_id % 5 = 0 AS smoke, (event_id % 11) / 10.0::DOUBLE AS f2p, event_id % 4 AS p2p, event_id % 300 AS lines, CAST(json_extract(props, '$.k') AS INTEGER) AS steps FROM events)
SELECT user_id, event_id, steps FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY valid DESC, clean DESC, verify DESC, smoke DESC, f2p DESC, p2p, CASE WHEN lines > 0 THEN lines ELSE 1000000 END, steps, event_id) AS rn FROM c) WHERE rn = 1""")
def candidate_best(t: Tables) -> DataFrame:
    e = t.read("events")
    i = F.col("event_id")
    c = e.select(
        "user_id", "event_id", i.alias("attempt"), (F.col("event_type") == "purchase").alias("patch_gate_valid"), (F.col("value") > 100).alias("clean_resolution"), (i % 3 == 0).alias("verify_pass_after_edit"), (i % 5 == 0).alias("smoke_pass_after_edit"),
        ((i % 11) / 10.0).alias("f2p_pass_rate"), (i % 4).cast("int").alias("p2p_smoke_failures"), (i % 300).cast("int").alias("changed_lines_total"), F.get_json_object("props", "$.k").cast("int").alias("steps"),
    )
    absent = {"tdd_gate_passed": "boolean", "regression_gate_passed": "boolean", "progress_gate_passed": "boolean", "patch_gate_severity": "string", "status": "string", "patch_gate_reason": "string", "graph_penalty": "int", "tdd_evidence_complete": "boolean", "tdd_fail_open_applied": "boolean", "required_test_added": "boolean", "indexed_search_attempted": "boolean", "indexed_query_success": "boolean", "loop_abort_reason": "string", "format_errors": "int", "timeouts": "int", "prediction": "string", "test_signal_confidence": "double", "test_signal_reliable": "boolean"}
    c = c.withColumns({k: F.lit(None).cast(v) for k, v in absent.items()})
    return agent.best_candidate(c, "user_id").select("user_id", "event_id", "steps")


_DIFF = """concat('diff --git a/f b/f', chr(10), '--- a/f', chr(10), '+++ b/f', chr(10), '+', event_type, chr(10), '-', event_type, '_old', chr(10), CASE WHEN event_id % 3 = 0 THEN repeat(concat('+', event_type, chr(10)), CAST(event_id % 5 AS INTEGER)) ELSE '' END,
CASE WHEN event_id % 4 = 0 THEN concat('+# TODO later', chr(10)) ELSE '' END, CASE WHEN event_id % 7 = 0 THEN concat('-def f(a):', chr(10), '+def f(a, b):', chr(10)) ELSE '' END)"""


@query(f"""WITH d AS (SELECT event_id, string_split({_DIFF}, chr(10)) AS l FROM events),
m AS (SELECT event_id, list_filter(l, lambda x: regexp_matches(x, '^\\+') AND NOT regexp_matches(x, '^\\+\\+\\+\\s')) AS a, list_filter(l, lambda x: regexp_matches(x, '^-') AND NOT regexp_matches(x, '^---\\s')) AS r FROM d),
u AS (SELECT event_id, max(c) AS dup FROM (SELECT event_id, x, count(*) AS c FROM (SELECT event_id, trim(unnest(a)[2:]) AS x FROM m) GROUP BY ALL) GROUP BY event_id)
SELECT m.event_id, len(a) AS added_lines, len(r) AS removed_lines, dup AS duplicate_line_max, event_id % 7 = 0 AS signature_change, event_id % 4 = 0 AS placeholder,
CASE WHEN dup >= 4 OR event_id % 4 = 0 THEN 'fail' WHEN event_id % 7 = 0 THEN 'warn' ELSE 'info' END AS severity FROM m JOIN u USING (event_id)""")
def patch_metrics(t: Tables) -> DataFrame:
    d = t.read("events").select("event_id", F.expr(_DIFF.replace("chr(10)", "'\\n'")).alias("diff"))
    out = agent.patch_metrics(d)
    big = lambda c: F.col(c).cast("long").alias(c)
    return out.select("event_id", big("added_lines"), big("removed_lines"), big("duplicate_line_max"), "signature_change", "placeholder", "severity")


_REMOVAL = """concat('diff --git a/', CASE event_id % 6 WHEN 0 THEN 'tests/test_m.py' WHEN 1 THEN 'notes.txt' ELSE 'src/m.py' END, ' b/x', chr(10), '-def gone', event_id % 4, '(a):', chr(10),
CASE WHEN event_id % 3 = 0 THEN concat('+def gone', event_id % 4, '(a, b):', chr(10)) ELSE concat('+x = ', event_id, chr(10)) END,
CASE WHEN event_id % 5 = 0 THEN concat('diff --git a/src/z.py b/src/z.py', chr(10), '-    def inner(self):', chr(10), '+y = 2', chr(10)) ELSE '' END)"""


@query("""WITH g AS (SELECT event_id, list_filter([CASE WHEN event_id % 6 > 1 AND event_id % 3 <> 0 THEN 'src/m.py:gone' || (event_id % 4) END, CASE WHEN event_id % 5 = 0 THEN 'src/z.py:inner' END], lambda x: x IS NOT NULL) AS gone FROM events)
SELECT event_id, CASE WHEN len(gone) > 0 THEN 'removed_function_without_replacement:' || array_to_string(gone, '|') ELSE '' END AS fail_reasons, 'potential_signature_change' AS warn_reasons,
CASE WHEN len(gone) > 0 THEN 'fail' ELSE 'warn' END AS severity FROM g""")
def patch_removals(t: Tables) -> DataFrame:
    d = t.read("events").select("event_id", F.expr(_REMOVAL.replace("chr(10)", "'\\n'")).alias("diff"))
    return agent.patch_metrics(d).select("event_id", "fail_reasons", "warn_reasons", "severity")


@query("""WITH s AS (SELECT user_id AS conv, count(*) AS selected, count(*) FILTER (event_type = 'view') AS runnable, avg(least(1.0::DOUBLE, value / 100)) AS precision, bool_or(value / 100 >= 0.8) AS sure FROM events GROUP BY ALL)
SELECT conv, selected, runnable, CASE WHEN selected >= 3 THEN CASE WHEN runnable::DOUBLE / selected < 0.35 THEN 'low_runnable_ratio' WHEN precision < 0.45 THEN 'low_confidence' ELSE '' END
ELSE CASE WHEN runnable > 0 AND sure THEN '' WHEN runnable <= 0 THEN 'no_runnable_nodeids' ELSE 'low_confidence' END END AS reason FROM s""")
def precision_floor(t: Tables) -> DataFrame:
    e = t.read("events").select(F.col("user_id").alias("conv"), (F.col("value") / 100).alias("confidence"), F.lit(None).cast("double").alias("score"), (F.col("event_type") == "view").alias("runnable"))
    return agent.precision_floor(e, "conv").select("conv", "selected", "runnable", "reason")


_PYTEST = "concat('line', chr(10), '= ', event_id % 50, ' passed, ', event_id % 7, ' failed', CASE WHEN event_id % 3 = 0 THEN concat(', ', event_id % 2 + 1, ' error') ELSE '' END, ' in 0.5s =')"


@query("""SELECT event_id, event_id % 50 AS passed, event_id % 7 AS failed, CASE WHEN event_id % 3 = 0 THEN event_id % 2 + 1 ELSE 0 END AS errors FROM events""")
def pytest_counts(t: Tables) -> DataFrame:
    d = t.read("events").select("event_id", F.expr(_PYTEST.replace("chr(10)", "'\\n'")).alias("output"))
    return logs.pytest_summary(d, "output").select("event_id", F.col("passed").cast("long").alias("passed"), F.col("failed").cast("long").alias("failed"), F.col("errors").cast("long").alias("errors"))


@query("""WITH n AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'predictions.jsonl' ELSE strftime(ts, 'predictions_%Y%m%d_%H%M%S.jsonl') END AS name, ts FROM events)
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS stamp FROM n""")
def filename_timestamp(t: Tables) -> DataFrame:
    name = F.when(F.col("event_id") % 4 == 0, "predictions.jsonl").otherwise(F.concat(F.lit("predictions_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".jsonl")))
    return t.read("events").select("event_id", F.unix_timestamp(scalars.file_stamp(name)).alias("stamp"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE event_id % 3 * 2 + 1 - event_id % 3 END AS n, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type || '|' || user_id ELSE '' END AS items FROM events""")
def json_list_coerce(t: Tables) -> DataFrame:
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.col("event_type")).when(k == 1, F.concat(F.lit('["'), "event_type", F.lit('", "'), F.col("user_id").cast("string"), F.lit('"]'))).otherwise("  ")
    items = scalars.json_list(raw)
    return t.read("events").select("event_id", F.size(items).cast("long").alias("n"), F.array_join(items, "|").alias("items"))


@query("""SELECT user_id, CAST(min(least(1.0::DOUBLE, value / 100)) * 1e6 AS BIGINT) AS confidence_e6, bool_and(event_type <> 'error' OR event_id % 2 = 0) AS reliable FROM events GROUP BY user_id""")
def reliability_flags(t: Tables) -> DataFrame:
    e = t.read("events").select("user_id", F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), ((F.col("event_type") != "error") | (F.col("event_id") % 2 == 0)).alias("reliable"))
    out = agent.reliability(e, "user_id")
    return out.select("user_id", F.round(F.col("confidence") * 1e6).cast("long").alias("confidence_e6"), "reliable")


@query("""SELECT event_type AS source, array_to_string(list_sort(list(DISTINCT CAST(user_id % 9 AS VARCHAR))), ' ') AS line FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' GROUP BY ALL""")
def date_range_map(t: Tables) -> DataFrame:
    e = select.between_dates(t.read("events"), "ts", "2024-01-05", "2024-01-09")
    return e.groupBy(F.col("event_type").alias("source")).agg(F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 9).cast("string"))), " ").alias("line"))
