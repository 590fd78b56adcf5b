"""Edges of a graph: all of them, or those that a change of files may have made, changed or undone.

Every lookup of a reference ends in a name: a call in the last part of its text, a base in the
last part of its own, an import in the last part of the module. So what a change can touch is
found by the names that changed files gave or lost: callers, classes and importers with a
reference of such a name are resolved anew, as are those in the files themselves, and the tests
whose names, imports or calls are among them are linked anew. All other edges stay. Joins are
by name and equi; only the references of what is touched are resolved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import last_part, module_name
from ..operators import link, resolve
from ..sources import scratch

Tables = dict[str, DataFrame]


def references(nodes: Tables) -> Tables:
    """Calls, bases and imports by text, with where they stand."""
    return {
        "calls": nodes["function"].select(F.col("id").alias("caller"), F.posexplode("calls").alias("seq", "called"), F.col("module_name").alias("caller_module"), F.col("class_name").alias("caller_class")),
        "inherits": nodes["class"].select(F.col("id").alias("child"), F.posexplode("bases").alias("seq", "base"), F.col("module_name").alias("child_module")),
        "imports": nodes["file"].select("path", F.explode("imports").alias("module")),
    }


def resolve_edges(nodes: Tables, refs: Tables | None = None) -> Tables:
    """Edges of all references, or of the given ones."""
    refs = refs or references(nodes)
    return {
        "calls": resolve.resolve_calls_ranked(refs["calls"], nodes["function"]),
        "imports": resolve.resolve_imports_by_suffix(refs["imports"], nodes["file"]),
        "inherits": resolve.resolve_bases_ranked(refs["inherits"], nodes["class"]),
    }


def link_tests(nodes: Tables, edges: Tables) -> DataFrame:
    """All linkers over the tests of nodes, the greatest confidence per pair."""
    named = link.link_by_name(nodes["test"], nodes["function"], nodes["class"])
    own = nodes["function"].select(F.concat(F.lit("test::"), "id").alias("test"), F.explode("calls").alias("called"))
    static = link.link_by_imports(nodes["test"], edges["imports"], nodes["function"], own).withColumn("dst_label", F.lit("Function"))
    called = link.link_by_calls(nodes["test"], nodes["function"], edges["calls"]).withColumn("dst_label", F.lit("Function"))
    cols = ["src", "dst", "dst_label", "link_source", "link_confidence"]
    rows = named.select(cols).union(static.select(cols)).union(called.select(cols))
    best = rows.groupBy("src", "dst").agg(F.max_by(F.struct("dst_label", "link_source", "link_confidence"), F.struct("link_confidence", "link_source")).alias("b"))
    return best.select("src", "dst", "b.*").withColumn("coverage", F.lit(None).cast("double"))


class Change:
    """What a change of files touches; ``diff`` has the (path, status) of new, changed and deleted files."""

    def __init__(self, before: Tables, after: Tables, diff: DataFrame):
        self.before, self.after, self.refs = before, after, references(after)
        self.gone = diff.where("status in ('changed', 'deleted')").select("path")
        self.come = diff.where("status in ('changed', 'new')").select("path")
        self.paths = diff.select("path")
        modules = diff.where("status in ('new', 'deleted')").select(last_part(module_name(F.col("path"))).alias("name")).distinct()
        calls = self._of("function", "id", "caller").union(self._by_name("calls", "caller", "called", self._names("function")))
        self.callers = scratch.staged(calls.distinct(), "callers")
        children = self._of("class", "id", "child").union(self._by_name("inherits", "child", "base", self._names("class")))
        self.children = scratch.staged(children.distinct(), "children")
        importers = self.come.union(self._by_name("imports", "path", "module", modules))
        self.importers = scratch.staged(importers.distinct(), "importers")

    def _names(self, kind: str) -> DataFrame:
        """Names of the symbols that the files gave or lost."""
        old = self.before[kind].join(self.gone.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
        new = self.after[kind].join(self.come.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
        return old.select("name").union(new.select("name")).distinct()

    def _of(self, kind: str, key: str, name: str) -> DataFrame:
        own = self.after[kind].join(self.come.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
        return own.select(F.col(key).alias(name))

    def _by_name(self, refs: str, owner: str, text: str, names: DataFrame) -> DataFrame:
        return self.refs[refs].withColumn("name", last_part(F.trim(text))).join(names, "name", "left_semi").select(owner)

    def lost(self, kind: str) -> DataFrame:
        """Ids of the symbols of changed and deleted files."""
        return self.before[kind].join(self.gone.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("id")

    def touched(self) -> tuple[Tables, Tables]:
        """The nodes that touched references can name, and these references."""
        owners = {"calls": (self.callers, "caller"), "inherits": (self.children, "child"), "imports": (self.importers, "path")}
        refs = {k: self.refs[k].join(df, key, "left_semi") for k, (df, key) in owners.items()}
        named = {}
        for kind, edge, text, name in (("function", "calls", "called", F.col("name")), ("class", "inherits", "base", F.col("name")), ("file", "imports", "module", last_part(module_name(F.col("path"))))):
            asked = refs[edge].select(last_part(F.trim(text)).alias("_name")).distinct()
            named[kind] = self.after[kind].withColumn("_name", name).join(asked, "_name", "left_semi").drop("_name")
        return self.after | named, refs

    def tests(self, old_imports: DataFrame, new_imports: DataFrame) -> DataFrame:
        """The tests to be linked anew: by their file, name or class, by what their file imports, by what they call."""
        t = self.after["test"]
        bare = last_part(F.col("name"))
        names, classes = self._names("function"), self._names("class")
        by_name = t.where(bare.startswith("test_")).withColumn("key", F.substr(bare, F.lit(6))).join(names.withColumnRenamed("name", "key"), "key", "left_semi")
        owner = F.element_at(F.split("name", r"\."), 1)
        by_class = t.where(F.col("name").contains(".") & owner.startswith("Test")).withColumn("key", F.substr(owner, F.lit(5))).join(classes.withColumnRenamed("name", "key"), "key", "left_semi")
        imported = old_imports.union(new_imports).join(self.paths.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("src").alias("file_path"))
        files = self.paths.union(self.importers).union(imported).distinct().toDF("file_path")
        by_file = t.join(files, "file_path", "left_semi")
        runs = self.after["function"].join(self.callers.withColumnRenamed("caller", "id"), "id", "left_semi").select(F.col("name").alias("function_name"), "file_path")
        by_call = t.join(runs, ["function_name", "file_path"], "left_semi")
        return reduce(DataFrame.union, (x.select("id") for x in (by_name, by_class, by_file, by_call))).distinct()


def renew_edges(change: Change, old: Tables) -> Tables:
    """Calls, imports, inherits and tests after the change."""
    new = resolve_edges(*change.touched())
    owners = {
        "calls": change.callers.toDF("src").union(change.lost("function")),
        "inherits": change.children.toDF("src").union(change.lost("class")),
        "imports": change.importers.toDF("src").union(change.gone),
    }
    out = {k: old[k].join(own.toDF("src").distinct(), "src", "left_anti").select(new[k].columns).union(new[k]) for k, own in owners.items()}
    out = {k: scratch.staged(df, k) for k, df in out.items()}
    tests = scratch.staged(change.tests(old["imports"].select("src", "dst"), out["imports"].select("src", "dst")), "tests")
    links = link_tests(change.after | {"test": change.after["test"].join(tests, "id", "left_semi")}, out)
    stay = old["tests"].join(tests.union(change.lost("test")).distinct().toDF("src"), "src", "left_anti")
    out["tests"] = stay.select(links.columns).union(links)
    return out
