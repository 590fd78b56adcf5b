"""Resolution, linking, merging and sampling queries over the graph views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import scaled
from ..operators import link, merge, overlap, resolve, select
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


def _percent(c: str) -> Column:
    """A confidence of two digits in percent; ``round`` goes through a decimal number, which takes longer than all else of a pair."""
    return (F.col(c) * 100 + 0.5).cast("long")


_SUFFIXES = "(SELECT id, array_to_string(p[i:], '.') AS key FROM (SELECT id, string_split(qualified_name, '.') AS p FROM symbols), range(2, 64) r(i) WHERE i <= len(p) UNION SELECT id, name FROM symbols)"


@query(f"SELECT DISTINCT caller AS src, k.id AS dst FROM call_refs JOIN {_SUFFIXES} k ON k.key = called")
def calls_resolve_suffix(t: Tables) -> DataFrame:
    return resolve.resolve_calls_by_suffix(t.call_refs, t.symbols)


_FKEYS = """fkeys AS (
  SELECT 'symbol' AS kind, concat_ws('::', module_name, class_name, name) AS key, id FROM symbols
  UNION SELECT 'qualified', concat_ws('.', class_name, name), id FROM symbols WHERE class_name IS NOT NULL
  UNION SELECT 'qualified', concat_ws('.', module_name, class_name, name), id FROM symbols
  UNION SELECT 'simple', name, id FROM symbols
  UNION SELECT 'simple', concat_ws('.', class_name, name), id FROM symbols),
counted AS (SELECT kind, key, count(DISTINCT id) AS ids FROM fkeys GROUP BY ALL)"""

_CALL_RULES = """refs AS (SELECT *, caller_module AS m, caller_class AS c, called LIKE 'self.%' OR called LIKE 'cls.%' AS own, contains(called, '.') AS dotted,
  regexp_replace(called, '^(self|cls)\\.', '') AS method, string_split(called, '.')[-1] AS simple, array_to_string(string_split(called, '.')[-2:], '.') AS tail2 FROM call_refs),
rules AS (
  SELECT caller, seq, 0 AS rank, 'symbol' AS kind, m || '::' || c || '::' || method AS key, 'self_symbol_key' AS method, 0.98::DOUBLE AS confidence FROM refs WHERE own
  UNION ALL SELECT caller, seq, 1, 'qualified', c || '.' || method, 'self_class_method', 0.92::DOUBLE FROM refs WHERE own
  UNION ALL SELECT caller, seq, 2, 'simple', method, 'method_simple_name', 0.72::DOUBLE FROM refs WHERE own
  UNION ALL SELECT caller, seq, 0, 'qualified', called, 'qualified_name', 0.9::DOUBLE FROM refs WHERE NOT own AND dotted
  UNION ALL SELECT caller, seq, 1, 'qualified', m || '.' || called, 'module_qualified_name', 0.95::DOUBLE FROM refs WHERE NOT own AND dotted
  UNION ALL SELECT caller, seq, 2, 'qualified', tail2, 'class_method', 0.88::DOUBLE FROM refs WHERE NOT own AND dotted
  UNION ALL SELECT caller, seq, 3, 'symbol', m || '::' || c || '::' || simple, 'caller_class_symbol_key', 0.95::DOUBLE FROM refs WHERE NOT own
  UNION ALL SELECT caller, seq, 4, 'qualified', c || '.' || simple, 'caller_class_method', 0.86::DOUBLE FROM refs WHERE NOT own
  UNION ALL SELECT caller, seq, 5, 'symbol', m || '::' || simple, 'module_symbol_key', 0.95::DOUBLE FROM refs WHERE NOT own
  UNION ALL SELECT caller, seq, 6, 'qualified', m || '.' || simple, 'module_qualified_name', 0.9::DOUBLE FROM refs WHERE NOT own
  UNION ALL SELECT caller, seq, 7, 'simple', simple, 'simple_name', 0.7::DOUBLE FROM refs WHERE NOT own
  UNION ALL SELECT caller, seq, 8, 'simple', called, 'raw_name', 0.68::DOUBLE FROM refs WHERE NOT own),
hits AS (SELECT r.caller, r.seq, k.id, r.rank, r.method, CASE WHEN n.ids > 1 THEN least(r.confidence, 0.55::DOUBLE) ELSE r.confidence END AS confidence
  FROM rules r JOIN fkeys k ON k.kind = r.kind AND k.key = r.key JOIN counted n ON n.kind = r.kind AND n.key = r.key),
first AS (SELECT *, row_number() OVER (PARTITION BY caller, seq, id ORDER BY rank) AS rn FROM hits),
best AS (SELECT *, row_number() OVER (PARTITION BY caller, id ORDER BY confidence DESC, seq DESC) AS bn FROM first WHERE rn = 1 AND caller <> id)"""


@query(f"WITH {_FKEYS},\n{_CALL_RULES}\nSELECT caller AS src, id AS dst, method AS resolution_method, CAST(round(confidence * 100) AS BIGINT) AS confidence_pct FROM best WHERE bn = 1")
def calls_resolve_ranked(t: Tables) -> DataFrame:
    out = resolve.resolve_calls_ranked(t.call_refs, t.symbols)
    return out.select("src", "dst", "resolution_method", _percent("resolution_confidence").alias("confidence_pct"))


_MODULES = "(SELECT DISTINCT a.path, replace(regexp_replace(b.path, '\\.py$', ''), '/', '.') AS full_name, i.src, i.dst FROM imports i JOIN files a ON a.path = i.src JOIN files b ON b.path = i.dst)"


@query(f"""WITH refs AS (SELECT src, CASE WHEN ascii(right(dst, 4)) % 2 = 0 THEN full_name ELSE string_split(full_name, '.')[-1] END AS module FROM {_MODULES}),
mods AS (SELECT path, string_split(replace(regexp_replace(path, '\\.py$', ''), '/', '.'), '.') AS p FROM files),
keys AS (SELECT path AS dst, array_to_string(p[i:], '.') AS module FROM mods, range(1, 64) r(i) WHERE i <= len(p))
SELECT DISTINCT src, dst FROM refs JOIN keys USING (module) WHERE src <> dst""")
def imports_resolve(t: Tables) -> DataFrame:
    full = scalars.module_name(F.col("dst"))
    module = F.when(F.ascii(F.substring("dst", -4, 4)) % 2 == 0, full).otherwise(scalars.last_part(full))
    return resolve.resolve_imports_by_suffix(t.imports.select(F.col("src").alias("path"), module.alias("module")), t.files)


@query("""WITH ck AS (SELECT 'symbol' AS kind, module_name || '::' || name AS key, id FROM classes UNION SELECT 'qualified', module_name || '.' || name, id FROM classes UNION SELECT 'simple', name, id FROM classes),
n AS (SELECT kind, key, count(DISTINCT id) AS ids FROM ck GROUP BY ALL),
refs AS (SELECT id AS child, base, module_name AS m, string_split(base, '.')[-1] AS simple, contains(base, '.') AS dotted FROM classes),
rules AS (SELECT child, 0 AS rank, 'qualified' AS kind, base AS key, 'qualified_name' AS method, 0.92::DOUBLE AS confidence FROM refs WHERE dotted
  UNION ALL SELECT child, 1, 'qualified', m || '.' || base, 'module_qualified_name', 0.9::DOUBLE FROM refs WHERE dotted
  UNION ALL SELECT child, 2, 'symbol', m || '::' || simple, 'module_symbol_key', 0.9::DOUBLE FROM refs
  UNION ALL SELECT child, 3, 'qualified', m || '.' || simple, 'module_qualified_name', 0.86::DOUBLE FROM refs
  UNION ALL SELECT child, 4, 'simple', simple, 'simple_name_fallback', 0.66::DOUBLE FROM refs),
hits AS (SELECT child, k.id, rank, method, CASE WHEN ids > 1 THEN least(confidence, 0.5::DOUBLE) ELSE confidence END AS confidence FROM rules r JOIN ck k ON k.kind = r.kind AND k.key = r.key JOIN n ON n.kind = r.kind AND n.key = r.key),
first AS (SELECT *, row_number() OVER (PARTITION BY child, id ORDER BY rank) AS rn FROM hits WHERE child <> id)
SELECT child AS src, id AS dst, method AS resolution_method, CAST(round(confidence * 100) AS BIGINT) AS confidence_pct FROM first WHERE rn = 1""")
def inherits_resolve(t: Tables) -> DataFrame:
    refs = t.classes.select(F.col("id").alias("child"), "base", F.lit(0).alias("seq"), F.col("module_name").alias("child_module"))
    out = resolve.resolve_bases_ranked(refs, t.classes)
    return out.select("src", "dst", "resolution_method", _percent("resolution_confidence").alias("confidence_pct"))


def _named_tests(t: Tables) -> DataFrame:
    """Tests named after the part that a customer's first line has."""
    first = t.first_links.select(F.col("src").alias("id"), F.col("dst").alias("part"))
    s = t.symbols.select(F.col("id").alias("part"), "name", "class_name")
    files = t.tests.select("id", "file_path")
    key = F.concat_ws("_", F.col("id").cast("string"), F.col("part").cast("string"))
    return first.join(s, "part").join(files, "id").select(key.alias("id"), F.concat(F.lit("test_"), F.col("name")).alias("name"), "file_path", "class_name")


_TESTS = "SELECT l.src || '_' || l.dst AS id, 'test_' || s.name AS name, t.file_path, s.class_name FROM first_links l JOIN symbols s ON s.id = l.dst JOIN tests t ON t.id = l.src"


@query(f"""WITH tt AS MATERIALIZED ({_TESTS})
SELECT tt.id AS src, s.id AS dst, 'Function' AS dst_label, 70 AS confidence_pct FROM tt JOIN symbols s ON s.name = tt.name[6:] WHERE s.file_path <> tt.file_path
UNION ALL SELECT DISTINCT tt.id, c.id, 'Class', 70 FROM tt JOIN symbol_classes c ON c.name = tt.class_name WHERE c.file_path <> tt.file_path""")
def link_naming(t: Tables) -> DataFrame:
    """Tests of parts in a class are methods of a Test class."""
    tests = _named_tests(t)
    in_class = F.when(F.col("class_name").isNotNull(), F.concat(F.lit("Test"), "class_name", F.lit("."), "name")).otherwise(F.col("name"))
    out = link.link_by_name(tests.withColumn("name", in_class), t.symbols, t.symbol_classes)
    return out.select("src", "dst", "dst_label", F.round(F.col("link_confidence") * 100).cast("int").alias("confidence_pct"))


@query(f"""WITH tt AS MATERIALIZED ({_TESTS})
SELECT tt.id AS src, s.id AS dst, 'Function' AS dst_label, CASE WHEN s.class_name IS NULL THEN 70 ELSE 65 END AS confidence_pct
FROM tt JOIN symbols s ON s.name = tt.name[6:] WHERE s.file_path <> tt.file_path""")
def link_naming_dotted(t: Tables) -> DataFrame:
    """Methods go by Class.method, so tests find them by the last part of their qualified names only."""
    dotted = F.concat_ws(".", "class_name", "name")
    out = link.link_by_name(_named_tests(t), t.symbols.withColumn("name", dotted), t.symbol_classes)
    return out.select("src", "dst", "dst_label", F.round(F.col("link_confidence") * 100).cast("int").alias("confidence_pct"))


@query(f"""WITH tt AS ({_TESTS}),
raw AS (SELECT id, file_path, unnest(list_distinct(list_concat([name[6:]], list_transform(range(2, len(string_split(name, '_')) + 1), lambda i: array_to_string(string_split(name, '_')[i:], '_'))))) AS target FROM tt),
tg AS (SELECT * FROM raw WHERE contains(target, '_') OR len(target) >= 3),
asked AS (SELECT DISTINCT target, kind, key, rank FROM (
  SELECT target, 'exact' AS kind, target AS key, 100 AS rank FROM tg UNION ALL SELECT target, 'tail', target, 90 FROM tg UNION ALL SELECT target, 'qualified', target, 80 FROM tg
  UNION ALL SELECT target, 'token', unnest(list_filter(string_split_regex(lower(target), '[^a-z0-9]+'), lambda x: len(x) >= 3)), 40 FROM tg)),
idx AS (SELECT DISTINCT * FROM (SELECT id AS dst, 'exact' AS kind, name AS key FROM symbols UNION ALL SELECT id, 'tail', name FROM symbols UNION ALL SELECT id, 'qualified', string_split(qualified_name, '.')[-1] FROM symbols
  UNION ALL SELECT id, 'token', unnest(list_filter(list_concat(string_split_regex(lower(name), '[^a-z0-9]+'), string_split_regex(lower(qualified_name), '[^a-z0-9]+')), lambda x: x <> '')) FROM symbols)),
ranked AS (SELECT target, dst, max(rank) AS rank FROM asked JOIN idx USING (kind, key) GROUP BY ALL),
cut AS (SELECT r.*, s.name, s.file_path AS function_file, row_number() OVER (PARTITION BY target ORDER BY rank DESC, len(s.name), s.name, dst) AS n FROM ranked r JOIN symbols s ON s.id = r.dst),
scored AS (SELECT tg.id AS src, dst, least(0.9::DOUBLE, CASE WHEN name = tg.target THEN 0.75::DOUBLE WHEN ends_with(name, '.' || tg.target) THEN 0.7::DOUBLE WHEN contains(name, tg.target) THEN 0.58::DOUBLE ELSE 0.45::DOUBLE END) AS c
  FROM tg JOIN cut ON cut.target = tg.target AND n <= 192)
SELECT src, dst, CAST(round(max(c) * 100) AS INTEGER) AS confidence_pct FROM scored GROUP BY ALL""")
def link_naming_tokens(t: Tables) -> DataFrame:
    out = link.link_by_tokens(_named_tests(t), t.symbols)
    return out.select("src", "dst", F.round(F.col("link_confidence") * 100).cast("int").alias("confidence_pct"))


@query("""WITH called AS (SELECT DISTINCT l.src AS test, f.name FROM test_links l JOIN functions f ON f.id = l.dst),
p AS (SELECT t.id AS src, f.id AS dst, f.name FROM tests t JOIN test_imports i ON i.src = t.file_path JOIN functions f ON f.file_path = i.dst)
SELECT p.src, p.dst, max(CASE WHEN c.test IS NOT NULL THEN 80 ELSE 50 END) AS confidence_pct FROM p LEFT JOIN called c ON c.test = p.src AND c.name = p.name GROUP BY ALL""")
def link_static(t: Tables) -> DataFrame:
    # names are gathered as sets, so links need not be grouped first; without nulls, as the imports
    # have them, lines meet orders once for both
    links = t.line_links.where("src is not null and dst is not null")
    calls = links.select(F.col("src").alias("test"), F.col("dst").alias("id")).join(t.functions.select("id", F.col("name").alias("called")), "id")
    out = link.link_by_imports(t.tests, t.test_imports, t.functions, calls)
    return out.select("src", "dst", F.round(F.col("link_confidence") * 100).cast("int").alias("confidence_pct"))


@query("""WITH c AS (SELECT o_custkey AS test, 'src/n' || (l_suppkey % 25) || '.py' AS file_path, l_linenumber * 10 + l_suppkey % 10 AS line FROM lines),
f AS (SELECT file_path, count(DISTINCT line) AS total FROM c GROUP BY ALL),
h AS (SELECT test, file_path, count(DISTINCT line) AS hit FROM c GROUP BY ALL),
r AS (SELECT test, h.file_path, hit::DOUBLE / total::DOUBLE AS ratio, row_number() OVER (PARTITION BY test ORDER BY hit::DOUBLE / total::DOUBLE DESC, h.file_path) AS n FROM h JOIN f ON f.file_path = h.file_path)
SELECT CAST(test AS VARCHAR) AS src, file_path AS dst, CAST(floor((0.7::DOUBLE + 0.3::DOUBLE * ratio) * 1e6 + 0.5::DOUBLE) AS BIGINT) AS confidence_e6 FROM r WHERE n <= 5 AND ratio >= 0.05""")
def link_coverage(t: Tables) -> DataFrame:
    rows = t.lines.select(F.concat(F.col("o_custkey"), F.lit("[p]|run")).alias("context"), F.concat(F.lit("src/n"), F.col("l_suppkey") % 25, F.lit(".py")).alias("file_path"), (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("line"))
    out = link.depends_on(link.coverage_by_test(rows, rows.select("file_path", "line").distinct()), per_test=5, least=0.05)
    return out.select("src", "dst", scaled(F.col("link_confidence")).alias("confidence_e6"))


@query("""WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, CASE WHEN l_linenumber <= 3 THEN 0 ELSE 1 END AS seq, CAST(l_discount * 100 AS INTEGER) AS c, l_returnflag AS s, CAST(l_tax * 100 AS INTEGER) AS v FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY c DESC, seq DESC, s DESC) AS rn FROM e)
SELECT src, dst, c AS confidence_pct, s AS link_source, (SELECT max(v) FROM e WHERE e.src = r.src AND e.dst = r.dst) AS coverage_pct FROM r WHERE rn = 1""")
def edge_upsert_max(t: Tables) -> DataFrame:
    e = t.read("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.round(F.col("l_discount") * 100).cast("int").alias("link_confidence"), F.col("l_returnflag").alias("link_source"), F.round(F.col("l_tax") * 100).cast("int").alias("coverage"), "l_linenumber")
    out = merge.upsert_edges(e.where("l_linenumber <= 3").drop("l_linenumber"), e.where("l_linenumber > 3").drop("l_linenumber"), maxima=("coverage",))
    return out.select("src", "dst", F.col("link_confidence").alias("confidence_pct"), "link_source", F.col("coverage").alias("coverage_pct"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS owner
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def node_upsert_last(t: Tables) -> DataFrame:
    o = t.read("orders")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"))
    new = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("status"), (F.col("o_custkey") + 1).alias("owner"))
    return merge.upsert_nodes(old, new)


@query("""WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(text || 'x') ELSE md5(text) END AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.doc_id IS NULL THEN 'new' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n ON n.doc_id = o.doc_id""")
def snapshot_diff(t: Tables) -> DataFrame:
    d = t.read("documents").select("doc_id", "text")
    old = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), F.md5("text").alias("content_hash"))
    new = d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("path"), F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("content_hash"))
    return merge.snapshot_diff(old, new)


@query("SELECT src, dst FROM calls WHERE src NOT IN (SELECT id FROM seeds) AND dst NOT IN (SELECT id FROM seeds)")
def subgraph_delete(t: Tables) -> DataFrame:
    nodes = {"file": t.files.select("path"), "function": t.functions.select("id", "file_path")}
    nodes["file"] = nodes["file"].withColumn("id", F.lit(None).cast("long"))
    gone = t.functions.join(t.changed.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return merge.without_nodes(t.calls, gone.select("id")).select("src", "dst")


@query("SELECT src, dst FROM calls WHERE src % 9 <> 0 AND dst % 4 <> 0")
def endpoint_checked_edges(t: Tables) -> DataFrame:
    f = t.functions
    return merge.existing_endpoints(t.calls, f.where("id % 9 <> 0"), f.where("id % 4 <> 0")).select("src", "dst")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?]*)', 1), '/+$', '') AS path FROM pages),
w AS (SELECT page_id, host, list_distinct(list_filter(string_split_regex(lower(regexp_replace(path, '/?[^/]*$', '')), '[/_-]'), lambda x: x NOT IN ('', 'test', 'tests', 'src'))) AS words FROM p),
s AS (SELECT a.page_id AS a, b.page_id AS b, len(list_intersect(a.words, b.words)) AS near FROM w a JOIN w b ON a.host = b.host AND a.page_id <> b.page_id),
r AS (SELECT *, rank() OVER (PARTITION BY a ORDER BY near DESC) AS k FROM s WHERE near > 0)
SELECT a, count(*) AS ties, max(near) AS near, min(b) AS least FROM r WHERE k = 1 GROUP BY a""")
def url_path_proximity(t: Tables) -> DataFrame:
    """Per page: the pages of its host that share most directory words, all ties counted; word sets meet, not pages."""
    url = F.col("url")
    path = F.regexp_replace(F.regexp_extract(url, r"^https?://[^/]+/([^?]*)", 1), "/+$", "")
    p = t.read("pages").select("page_id", F.regexp_extract(url, r"^https?://([^/]+)", 1).alias("host"), scalars.path_words(path).alias("words"))
    return overlap.best_partners(p, "page_id", ["host"], F.col("words")).withColumnRenamed("page_id", "a")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)/', 1) AS dir FROM pages),
s AS (SELECT dir || '/m' || page_id || '.py' AS source, list_distinct(string_split(dir, '/')) AS dirs FROM p),
t AS (SELECT DISTINCT dir || '/tests/tests.py' AS test, list_distinct(string_split(dir, '/')) AS dirs FROM p),
x AS (SELECT source, test, len(list_intersect(s.dirs, t.dirs)) AS near FROM s, t),
r AS (SELECT *, rank() OVER (PARTITION BY test ORDER BY near DESC) AS k FROM x WHERE near > 0)
SELECT source, test FROM r WHERE k = 1""")
def folder_tests_links(t: Tables) -> DataFrame:
    """A module for every page, a tests.py for every folder: linked by the folders they share, all ties."""
    folder = F.regexp_extract("url", r"^https?://([^?#]*)/", 1)
    p = t.read("pages").select(F.col("page_id"), folder.alias("dir"))
    modules = p.select(F.concat("dir", F.lit("/m"), "page_id", F.lit(".py")).alias("path"))
    tests = p.select(F.concat("dir", F.lit("/tests/tests.py")).alias("path")).distinct()
    return link.link_by_file_name(modules.union(tests))


_COVERED = """c AS (SELECT 'tests/t' || (o_custkey % 40) || '.py::test_' || o_custkey AS test, 'src/n' || (l_suppkey % 25) || '.py' AS file_path, l_linenumber * 10 + l_suppkey % 10 AS line FROM lines),
f AS (SELECT file_path, count(DISTINCT line) AS total FROM c GROUP BY ALL),
h AS (SELECT test, file_path, count(DISTINCT line) AS hit FROM c GROUP BY ALL),
v AS (SELECT test, h.file_path, hit::DOUBLE / total::DOUBLE AS ratio, row_number() OVER (PARTITION BY test ORDER BY hit::DOUBLE / total::DOUBLE DESC, h.file_path) AS n FROM h JOIN f ON f.file_path = h.file_path),
a AS (SELECT c_custkey AS place, CASE WHEN c_custkey % 2 = 0 THEN 'tests/t' || (c_custkey % 40) || '.py' ELSE 'tests/t' || (c_custkey % 40) || '.py::test_' || c_custkey END AS ref FROM customer),
s AS (SELECT ref, min(place) AS place FROM a GROUP BY ref ORDER BY place, ref LIMIT 12),
k AS (SELECT test, min(place) AS place FROM (SELECT DISTINCT test FROM c) t JOIN s ON t.test = s.ref OR starts_with(t.test, s.ref || '::') GROUP BY test),
o AS (SELECT v.test AS src, file_path AS dst, ratio FROM v JOIN k ON k.test = v.test WHERE n <= 12 AND ratio >= 0.1 ORDER BY place, src, ratio DESC, dst LIMIT 2000)"""


def _chosen(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    test = lambda key: F.concat(F.lit("tests/t"), F.col(key) % 40, F.lit(".py::test_"), F.col(key))
    rows = t.lines.select(test("o_custkey").alias("context"), F.concat(F.lit("src/n"), F.col("l_suppkey") % 25, F.lit(".py")).alias("file_path"), (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("line"))
    c = F.col("c_custkey")
    ref = F.when(c % 2 == 0, F.concat(F.lit(" ./tests/t"), c % 40, F.lit(".py "))).otherwise(F.translate(test("c_custkey"), "/", "\\"))
    asked = t.read("customer").select(c.alias("place"), ref.alias("ref"))
    chosen = link.chosen_tests(asked)
    return asked, chosen, link.chosen_coverage(chosen, link.coverage_by_test(rows, rows.select("file_path", "line").distinct()))


@query(f"WITH {_COVERED} SELECT src, dst, CAST(floor((0.7::DOUBLE + 0.3::DOUBLE * ratio) * 1e6 + 0.5::DOUBLE) AS BIGINT) AS confidence_e6 FROM o")
def targeted_coverage(t: Tables) -> DataFrame:
    """Files and node ids chosen from all customers' tests: the first twelve, twelve files each, 2,000 rows."""
    return _chosen(t)[2].select("src", "dst", scaled(F.col("link_confidence")).alias("confidence_e6"))


@query(f"WITH {_COVERED} SELECT count(*) AS links_created, (SELECT count(*) FROM s) AS tests_considered, count(DISTINCT src) AS tests_with_coverage, (SELECT count(DISTINCT ref) > 12 FROM a) AS tests_capped, count(*) >= 2000 AS rows_capped FROM o")
def targeted_coverage_report(t: Tables) -> DataFrame:
    return link.chosen_report(*_chosen(t))


@query("""WITH f AS (SELECT DISTINCT file_path FROM tests), r AS (SELECT file_path, row_number() OVER (ORDER BY file_path) - 1 AS i, count(*) OVER () AS n FROM f)
SELECT file_path FROM r WHERE n <= 20 OR i IN (SELECT CAST(floor(k * ((SELECT count(*) FROM f) / 20.0::DOUBLE)) AS BIGINT) FROM range(20) x(k))""")
def spread_sample(t: Tables) -> DataFrame:
    return select.spread_sample(t.tests, "file_path", 20)


@query("SELECT DISTINCT file_path FROM tests ORDER BY file_path LIMIT 20")
def head_sample(t: Tables) -> DataFrame:
    return select.head_sample(t.tests, "file_path", 20)


@query("""SELECT src, dst, n FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY coverage_pct DESC, dst) AS n FROM depends) WHERE n <= 8""")
def cap_per_group(t: Tables) -> DataFrame:
    return select.cap_per_group(t.depends, "src", [F.col("coverage_pct").desc(), F.col("dst")], 8).select("src", "dst", F.col("n").cast("long").alias("n"))


@query("SELECT run_id, status FROM runs ORDER BY run_id DESC LIMIT 50")
def last_n(t: Tables) -> DataFrame:
    return select.last_rows(t.runs, "run_id", 50).select("run_id", "status")


@query("SELECT file_path AS path, id, 'src/n' || (id % 25) AS dir FROM functions WHERE id IN (1, 3, 5, 6, 7, 20, 21, 22)")
def range_selection(t: Tables) -> DataFrame:
    picked = select.select_places(t.functions, "id", "1,3,5-7,20-22")
    return picked.select(F.col("file_path").alias("path"), "id", F.concat(F.lit("src/n"), F.col("id") % 25).alias("dir"))
