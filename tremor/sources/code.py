"""Source trees: files as rows, and their symbols by one pass of the standard parser.

Parsing is the one step of the graph that needs Python on executors; it runs over record
batches, one file at a time, and turns a file that doesn't parse into a row with an error.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import base_name, is_test_path, matches_any, module_name, parse_hash, qualify_self
from . import formats

# Directories that are skipped, name patterns of tests. Two engines skip different ones: the first
# these by name, the second others and whatever is hidden; the default skips what either does.
SKIPPED_BY_NAME = (".git", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".eggs", "dist", "build")
SKIPPED_IF_HIDDEN = ("__pycache__", "venv", "env", "node_modules")
SKIPPED = tuple(sorted({*SKIPPED_BY_NAME, *SKIPPED_IF_HIDDEN}))
TEST_FILES = ["test_*.py", "*_test.py"]
TEST_FUNCTIONS = ["test_*"]
TEST_CLASSES = ["Test*"]

SYMBOLS = (
    "path string, error string, imports array<string>, "
    "functions array<struct<name:string,class_name:string,start_line:int,end_line:int,signature:string,docstring:string,calls:array<string>>>, "
    "classes array<struct<name:string,start_line:int,end_line:int,docstring:string,bases:array<string>>>"
)
_ARROW_FUNCTION = pa.struct([("name", pa.string()), ("class_name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("docstring", pa.string()), ("calls", pa.list_(pa.string()))])
_ARROW_CLASS = pa.struct([("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("docstring", pa.string()), ("bases", pa.list_(pa.string()))])


def kept_path(path: Column, hidden: bool = True, skipped: tuple[str, ...] = SKIPPED) -> Column:
    """No part of the relative path is a skipped directory, nor, if asked, hidden."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    out = ~F.arrays_overlap(parts, F.array(*map(F.lit, skipped)))
    return out & ~F.exists(parts, lambda x: x.startswith(".")) if hidden else out


def scan_tree(spark: SparkSession, root: str, hidden: bool = True, skipped: tuple[str, ...] = SKIPPED, by_text: bool = False) -> DataFrame:
    """(path, content, text, content_hash, last_modified) of the Python files below root, by relative path.

    The hash is over bytes, or with ``by_text`` over the decoded text where there is one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).load(root)
    files = files.select("path", "content", "modificationTime")
    prefix = "^(?:[a-z0-9]+:/*)?/*" + "/".join(map(_quoted, root.split("://", 1)[-1].strip("/").split("/"))) + "/+"
    files = files.withColumn("path", F.regexp_replace("path", prefix, ""))
    # what Spark's readers pass over, found and read by tasks
    formats.register(spark)
    files = files.union(spark.read.format("source_tree").option("names", "passed_over").load(root))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    digest = F.coalesce(parse_hash(text), F.md5("content")) if by_text else F.md5("content")
    rows = files.select("path", "content", text.alias("text"), digest.alias("content_hash"), F.col("modificationTime").alias("last_modified"))
    return rows.where(kept_path(F.col("path"), hidden, skipped))


def _quoted(part: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c in "_-") else c for c in part)


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return None


def _signature(f: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    a = f.args
    shown = [x.arg + (f": {ast.unparse(x.annotation)}" if x.annotation else "") for x in a.posonlyargs + a.args + a.kwonlyargs]
    shown += [f"{stars}{x.arg}" for stars, x in (("*", a.vararg), ("**", a.kwarg)) if x]
    return f"{f.name}({', '.join(shown)})" + (f" -> {ast.unparse(f.returns)}" if f.returns else "")


def _function(f: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None) -> dict:
    calls = [_dotted(n.func) for n in ast.walk(f) if isinstance(n, ast.Call)]
    return {"name": f.name, "class_name": owner, "start_line": f.lineno, "end_line": f.end_lineno, "signature": _signature(f), "docstring": ast.get_docstring(f), "calls": list(dict.fromkeys(c for c in calls if c))}


def parse_source(text: str) -> dict:
    """Symbols of one module: top-level functions, classes with their methods, imports of the module's own body."""
    tree = ast.parse(text)
    found: dict = {"imports": [], "functions": [], "classes": []}
    todo = list(tree.body)
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
    while todo:
        n = todo.pop(0)
        if isinstance(n, kinds):
            found["functions"].append(_function(n, None))
        elif isinstance(n, ast.ClassDef):
            found["classes"].append({"name": n.name, "start_line": n.lineno, "end_line": n.end_lineno, "docstring": ast.get_docstring(n), "bases": [b for b in map(_dotted, n.bases) if b]})
            found["functions"] += [_function(m, n.name) for m in n.body if isinstance(m, kinds)]
        elif isinstance(n, ast.Import):
            found["imports"] += [x.name for x in n.names]
        elif isinstance(n, ast.ImportFrom):
            found["imports"] += [n.module] if n.module else []
        else:
            todo += [x for x in ast.iter_child_nodes(n) if isinstance(x, ast.stmt)]
    found["imports"] = list(dict.fromkeys(found["imports"]))
    return found


def parse_files(files: DataFrame) -> DataFrame:
    """One row per (path, text): imports, functions and classes, or the error."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, errors = [], []
            for text in part.column(1).to_pylist():
                try:
                    rows.append(parse_source(text or ""))
                    errors.append(None)
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append({"imports": [], "functions": [], "classes": []})
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_pydict(
                {
                    "path": part.column(0),
                    "error": pa.array(errors, pa.string()),
                    "imports": pa.array([r["imports"] for r in rows], pa.list_(pa.string())),
                    "functions": pa.array([r["functions"] for r in rows], pa.list_(_ARROW_FUNCTION)),
                    "classes": pa.array([r["classes"] for r in rows], pa.list_(_ARROW_CLASS)),
                }
            )

    return files.select("path", "text").mapInArrow(run, SYMBOLS)


def is_test_function(path: Column, name: Column, class_name: Column) -> Column:
    in_file = matches_any(base_name(path), TEST_FILES) | is_test_path(path)
    named = matches_any(name, TEST_FUNCTIONS)
    return in_file & named & (class_name.isNull() | matches_any(class_name, TEST_CLASSES))


def graph_tables(files: DataFrame, parsed: DataFrame, repo: str = "") -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Node tables and containment from scanned and parsed files; test functions, methods too, are both functions and tests."""
    file = files.select("path", base_name(F.col("path")).alias("name"), "content_hash", F.lit(repo).alias("repo_path"), "last_modified").join(parsed.select("path", "imports"), "path", "left")
    f = parsed.select("path", F.explode("functions").alias("f")).select(F.col("path").alias("file_path"), "f.*")
    shown = F.concat_ws(".", "class_name", "name")
    module = module_name(F.col("file_path"))
    function = f.select(
        F.concat(F.col("file_path"), F.lit("::"), shown, F.lit(":"), F.col("start_line")).alias("id"), "name", "file_path", "start_line", "end_line", "signature", "docstring",
        F.concat_ws(".", module, "class_name", "name").alias("qualified_name"), module.alias("module_name"), F.concat_ws("::", module, "class_name", "name").alias("symbol_key"), "class_name",
        F.transform("calls", lambda c: qualify_self(c, F.col("class_name"))).alias("calls"),
    )
    c = parsed.select("path", F.explode("classes").alias("c")).select(F.col("path").alias("file_path"), "c.*")
    klass = c.select(F.concat(F.col("file_path"), F.lit("::"), F.col("name"), F.lit(":"), F.col("start_line")).alias("id"), "name", "file_path", "start_line", "end_line", "docstring", F.concat_ws(".", module, "name").alias("qualified_name"), module.alias("module_name"), F.concat_ws("::", module, "name").alias("symbol_key"), "bases")
    own = function.where(is_test_function(F.col("file_path"), F.col("name"), F.col("class_name")))
    test = own.select(F.concat(F.lit("test::"), "id").alias("id"), F.concat_ws(".", "class_name", "name").alias("name"), "file_path", F.col("name").alias("function_name"), F.lit("pytest").alias("test_type"))
    parts = [d.select(F.col("file_path").alias("src"), F.col("id").alias("dst"), F.lit("File").alias("src_label"), F.lit(label).alias("dst_label")) for d, label in ((function, "Function"), (klass, "Class"), (test, "Test"))]
    methods = function.where("class_name is not null").select("file_path", "class_name", F.col("id").alias("dst")).join(klass.select(F.col("id").alias("src"), F.col("name").alias("class_name"), "file_path"), ["file_path", "class_name"])
    contains = parts[0].union(parts[1]).union(parts[2]).union(methods.select("src", "dst", F.lit("Class").alias("src_label"), F.lit("Function").alias("dst_label")))
    return {"file": file, "function": function, "class": klass, "test": test}, {"contains": contains}
