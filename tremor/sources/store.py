"""Versioned graph tables: copy-on-write buckets under manifests that are switched last.

A table is dealt into buckets by a hash of its key; each bucket is a folder of Parquet files. A
manifest names the folders of every bucket of every table, their row counts, the metadata of
the tree and the time. A change writes the buckets that it touches below a new folder and then
puts the next manifest in place by a rename that fails if the name is taken. So

* readers of a version go on reading it, and a failure before the rename leaves the version
  before it: what was half written belongs to no manifest;
* of two writers one gets the number; the other is told (``Conflict``) and starts over from
  what is there then;
* an upsert reads and writes the buckets of its own keys only, and counts only those anew.

Old versions stay until ``vacuum``. Nothing here knows how many rows a table has.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGES, NODES

#: Buckets of a new store's tables: at 100 TB choose so many that one is a few files.
BUCKETS = 16
#: Versions that vacuum leaves.
KEPT = 3
KEYS = {"file": ["path"], "function": ["id"], "class": ["id"], "test": ["id"]}
EDGE_KEY = ["src", "dst"]


class Conflict(RuntimeError):
    """Another writer has put a version in place meanwhile."""


def _key(kind: str, name: str) -> list[str]:
    return KEYS[name] if kind == "nodes" else EDGE_KEY


class GraphStore:
    """The versions of one graph below ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.new_buckets = spark, path.rstrip("/"), buckets

    # -- files ------------------------------------------------------------------

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def _read(self, name: str) -> dict:
        jvm, fs = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{name}"))
        try:
            return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> None:
        jvm, fs = self._fs()
        sc = self.spark.sparkContext
        temporary = jvm.org.apache.hadoop.fs.Path(f"{self.path}/writing/{uuid.uuid4().hex}.json")
        stream = fs.create(temporary, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{manifest['version']:012d}.json")
        fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        plain = sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(temporary), fs.makeQualified(target), plain)
        except Exception as error:
            fs.delete(temporary, False)
            if fs.exists(target):
                raise Conflict(f"version {manifest['version']} is taken") from error
            raise

    # -- versions ---------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        found = self.versions()
        if not found:
            return None
        return self._read(f"{found[-1] if version is None else version:012d}.json")

    def _next(self, old: dict | None, tables: dict, metadata: dict) -> dict:
        made = {
            "version": old["version"] + 1 if old else 1,
            "buckets": old["buckets"] if old else self.new_buckets,
            "tables": (old["tables"] if old else {}) | tables,
            "metadata": metadata if metadata else (old or {}).get("metadata", {}),
            "at": time.time(),
        }
        self._put(made)
        return made

    def _bucket(self, key: list[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")

    def _write(self, rows: DataFrame, kind: str, name: str, n: int, asked: list[int]) -> dict:
        """Write rows below a new folder; the entries of the asked buckets, of which some may be empty now."""
        folder = f"data/{uuid.uuid4().hex}/{kind}/{name}"
        bucket = self._bucket(_key(kind, name), n)
        # one file a bucket, unless it is large: a bucket is spread over tasks by AQE, as rebalancing asks for
        rows.withColumn("bucket", bucket).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        written = {int(x.split("=")[1]) for x in self._names(folder) if x.startswith("bucket=")}
        counts: dict[int, int] = {}
        if written:  # counts come from the files' footers
            found = self.spark.read.parquet(f"{self.path}/{folder}").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
            counts = {r["bucket"]: r["n"] for r in found.collect()}  # as many rows as buckets
        return {str(b): {"folder": f"{folder}/bucket={b}", "rows": counts[b]} if b in written else None for b in asked}

    # -- reading ----------------------------------------------------------------

    def table(self, kind: str, name: str, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """One table of a version, or some of its buckets."""
        manifest = manifest or self.manifest()
        entry = (manifest or {"tables": {}})["tables"].get(f"{kind}/{name}")
        default = (NODES if kind == "nodes" else EDGES)[name]
        if entry is None:
            return self.spark.createDataFrame([], default)
        own = [e["folder"] for b, e in entry["files"].items() if e and (buckets is None or int(b) in buckets)]
        if not own:
            return self.spark.createDataFrame([], entry["schema"])
        return self.spark.read.schema(entry["schema"]).parquet(*(f"{self.path}/{x}" for x in own))

    def load(self, version: int | None = None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """All tables of a version, the newest by default; empty ones where there are none."""
        manifest = self.manifest(version)
        return tuple({n: self.table(kind, n, manifest) for n in schemas} for kind, schemas in (("nodes", NODES), ("edges", EDGES)))

    def statistics(self, most_age: float | None = None) -> DataFrame:
        """(kind, label, n, version, age_seconds): row counts kept with the buckets. Beyond ``most_age`` seconds the files are counted again and the new counts kept."""
        manifest = self.manifest()
        schema = "kind string, label string, n long, version long, age_seconds double"
        if manifest is None:
            return self.spark.createDataFrame([], schema)
        if most_age is not None and time.time() - manifest["at"] > most_age:
            manifest = self.recount(manifest)
        age = time.time() - manifest["at"]
        rows = []
        for name, entry in manifest["tables"].items():
            kind, label = name.split("/")
            rows.append((kind[:-1], label, sum(e["rows"] for e in entry["files"].values() if e), manifest["version"], age))
        return self.spark.createDataFrame(rows, schema)

    def recount(self, manifest: dict) -> dict:
        tables = {}
        for name, entry in manifest["tables"].items():
            kind, label = name.split("/")
            bucket = self._bucket(_key(kind, label), manifest["buckets"])
            counts = {r["b"]: r["n"] for r in self.table(kind, label, manifest).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
            tables[name] = entry | {"files": {b: e and e | {"rows": counts.get(int(b), 0)} for b, e in entry["files"].items()}}
        return self._next(manifest, tables, {})

    # -- writing ----------------------------------------------------------------

    def save(self, nodes: dict[str, DataFrame], edges: dict[str, DataFrame], metadata: dict | None = None, base: dict | None = None) -> dict:
        """A new version with these tables whole; others stay as they are. ``base``: the version it follows, the newest by default."""
        base = base or self.manifest()
        n = base["buckets"] if base else self.new_buckets
        tables = {}
        for kind, group in (("nodes", nodes), ("edges", edges)):
            for name, df in group.items():
                tables[f"{kind}/{name}"] = {"schema": _ddl(df), "files": self._write(df, kind, name, n, list(range(n)))}
        return self._next(base, tables, metadata or {})

    def set_metadata(self, metadata: dict, base: dict | None = None) -> dict:
        """A new version with the same tables."""
        return self._next(base or self.manifest(), {}, metadata)

    def change(self, kind: str, name: str, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> dict:
        """A new version in which ``merge(old, new)`` replaces the buckets that new's keys fall into.

        merge must decide every key by the rows of that key. Buckets without keys of new keep their files.
        """
        base = self.manifest()
        n = base["buckets"] if base else self.new_buckets
        bucket = self._bucket(_key(kind, name), n)
        touched = sorted(r["b"] for r in new.select(bucket.alias("b")).distinct().collect())  # as many rows as buckets
        if not touched:
            return base or self._next(None, {}, {})
        merged = merge(self.table(kind, name, base, touched), new)
        entry = (base or {"tables": {}})["tables"].get(f"{kind}/{name}", {"files": {}})
        files = entry["files"] | self._write(merged, kind, name, n, touched)
        return self._next(base, {f"{kind}/{name}": {"schema": _ddl(merged), "files": files}}, {})

    def clear(self) -> dict:
        """A new version in which every table is empty."""
        return self._next(self.manifest(), {f"{k}/{n}": {"schema": s, "files": {}} for k, g in (("nodes", NODES), ("edges", EDGES)) for n, s in g.items()}, {"cleared": True})

    def vacuum(self, keep: int = KEPT) -> list[str]:
        """Delete the manifests before the last ``keep``, and data that no manifest left names and that is older than all of them."""
        jvm, fs = self._fs()
        found = self.versions()
        for v in found[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{v:012d}.json"), False)
        left = [self.manifest(v) for v in found[-keep:]]
        used = {e["folder"].split("/")[1] for m in left for t in m["tables"].values() for e in t["files"].values() if e}
        limit = min((m["at"] for m in left), default=0) * 1000
        gone = []
        for name in self._names("data"):
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{name}")
            if name not in used and fs.getFileStatus(at).getModificationTime() < limit:
                fs.delete(at, True)
                gone.append(name)
        return gone


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
