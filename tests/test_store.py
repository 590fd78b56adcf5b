"""The versioned graph store, opening and refreshing graphs, and edges by delta against full builds."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tremor.operators import merge
from tremor.plans import build
from tremor.sources import code
from tremor.sources.store import Conflict, GraphStore

ROW = "id string, name string"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, ROW)


@pytest.fixture
def kept(spark, tmp_path):
    g = GraphStore(spark, f"file://{tmp_path}/g", 4)
    g.save({"function": rows(spark, [(str(i), "n") for i in range(40)])}, {}, {"commit": "a"})
    return g


def test_upserts_leave_other_buckets_files(spark, kept):
    before = kept.manifest()
    after = kept.change("nodes", "function", rows(spark, [("3", "z"), ("new", "y")]), merge.upsert_nodes)
    a, b = (m["tables"]["nodes/function"]["files"] for m in (before, after))
    touched = {k for k in a if a[k] != b[k]}
    assert 1 <= len(touched) <= 2 and after["metadata"] == {"commit": "a"}
    got = {r.id: r.name for r in kept.table("nodes", "function").collect()}
    assert len(got) == 41 and got["3"] == "z" and got["new"] == "y" and got["4"] == "n"
    assert {r.id: r.name for r in kept.table("nodes", "function", before).collect()}["3"] == "n"
    # an upsert by key and one over the whole table give the same rows
    whole = merge.upsert_nodes(kept.table("nodes", "function", before), rows(spark, [("3", "z"), ("new", "y")]))
    assert sorted(map(tuple, whole.select("id", "name").collect())) == sorted(got.items())
    assert kept.change("nodes", "function", rows(spark, []), merge.upsert_nodes)["version"] == after["version"]


def test_edges_by_confidence(spark, kept):
    schema = "src string, dst string, link_source string, link_confidence double"
    for link in (("a", "b", "x", 0.5), ("a", "b", "y", 0.9), ("a", "b", "z", 0.2), ("c", "d", "x", None)):
        kept.change("edges", "tests", spark.createDataFrame([link], schema), merge.upsert_edges)
    assert sorted(map(tuple, kept.table("edges", "tests").select("src", "dst", "link_source", "link_confidence").collect())) == [("a", "b", "y", 0.9), ("c", "d", "x", None)]


def test_statistics_are_kept_and_recounted(spark, kept):
    kept.change("nodes", "function", rows(spark, [("new", "y")]), merge.upsert_nodes)
    first = kept.statistics().first()
    assert (first.kind, first.label, first.n, first.version) == ("node", "function", 41, 2)
    assert kept.statistics(3600).first().version == 2 and kept.statistics(0).first().version == 3
    assert kept.statistics().first().n == 41
    assert GraphStore(spark, kept.path + "-none").statistics().collect() == []


def test_a_second_writer_is_told(spark, kept):
    base = kept.manifest()
    kept.set_metadata({"commit": "b"}, base)
    with pytest.raises(Conflict):
        kept.set_metadata({"commit": "c"}, base)
    assert kept.manifest()["metadata"] == {"commit": "b"} and kept.table("nodes", "function").count() == 40


def test_a_failure_between_tables_leaves_the_version_before(spark, kept, monkeypatch):
    real, calls = GraphStore._write, []

    def broken(self, *a):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("lost")
        return real(self, *a)

    monkeypatch.setattr(GraphStore, "_write", broken)
    with pytest.raises(OSError, match="lost"):
        kept.save({"function": rows(spark, []), "class": rows(spark, [])}, {})
    assert kept.versions() == [1] and kept.load()[0]["function"].count() == 40
    monkeypatch.setattr(GraphStore, "_write", real)
    kept.save({"function": rows(spark, [("1", "n")])}, {})
    assert kept.vacuum(1) and kept.load()[0]["function"].count() == 1
    kept.clear()
    assert kept.load()[0]["function"].count() == 0 and kept.load(2)[0]["function"].count() == 1


# -- opening ------------------------------------------------------------------------


def write(root, tree):
    for name, text in tree.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def counts(graph):
    return {k: df.count() for side in graph for k, df in side.items()}


def test_a_new_commit_alone_keeps_the_graph(spark, tmp_path):
    root, path = tmp_path / "tree", f"file://{tmp_path}/kept"
    write(root, {"src/a.py": "def go():\n    return 1\n", "tests/test_a.py": "from src.a import go\n\ndef test_go():\n    assert go() == 1\n"})
    found = [build.open_graph(spark, str(root), path, c) for c in ("one", "two", "two")]
    assert [s for _, s in found] == ["missing", "stale", "fresh"]
    assert counts(found[0][0]) == counts(found[1][0]) == counts(found[2][0])
    stats = {(r.kind, r.label): (r.n, r.last_indexed_commit) for r in build.graph_statistics(spark, path).collect()}
    assert stats["node", "test"] == (1, "two") and stats["edge", "calls"][0] == 1
    # files under the saved tables are the first version's still
    g = GraphStore(spark, path)
    assert g.manifest(1)["tables"] == g.manifest(2)["tables"]


def test_two_openers_at_once(spark, tmp_path):
    root, path = tmp_path / "tree", f"file://{tmp_path}/kept"
    write(root, {f"src/m{i}.py": f"def f{i}():\n    return f{i - 1}()\n" for i in range(4)})
    states, graphs = [], []

    def run():
        graph, state = build.open_graph(spark, str(root), path, "one")
        states.append(state)
        graphs.append(counts(graph))

    both = [threading.Thread(target=run) for _ in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert len(graphs) == 2 and graphs[0] == graphs[1] and "missing" in states
    assert build.open_graph(spark, str(root), path, "one")[1] == "fresh"


# -- edges by delta -----------------------------------------------------------------


def random_file(rng, name):
    lines = [f"from pkg.{rng.choice('abcd')} import x" for _ in range(rng.randrange(3))] + [f"import pkg.{rng.choice('abcd')}" for _ in range(rng.randrange(2))]
    for k in range(rng.randrange(1, 4)):
        body = "; ".join(rng.choice(["go()", "run()", "K.go()", "a.run()", "stop()", "K2()"]) for _ in range(rng.randrange(1, 3)))
        pick = rng.randrange(3)
        test = name.startswith("tests/")
        if pick == 0:
            lines += [f"class {'Test' if test else ''}{rng.choice(['K', 'K2'])}({rng.choice(['', 'K', 'b.K2'])}):", f"    def {'test_' if test else ''}{rng.choice(['go', 'run'])}(self):", f"        self.go(); {body}"]
        else:
            lines += [f"def {'test_' if test else ''}{rng.choice(['go', 'run', 'stop'])}{k if pick == 2 else ''}():", f"    {body}"]
    return "\n".join(lines) + "\n"


def at_rest(spark, folder, graph):
    """The graph as kept: what is built reads the tree itself."""
    g = GraphStore(spark, f"file://{folder}", 2)
    return g.load(g.save(*graph)["version"])


def shown(df):
    cols = sorted(df.columns)
    return sorted(str([r[c] for c in cols]) for r in df.select(*cols).collect())


@pytest.mark.parametrize("seed", [1])
def test_updates_equal_full_builds(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = [f"pkg/{x}.py" for x in "abcd"] + ["pkg/sub/a.py", "tests/test_a.py", "tests/test_b.py"]
    root = tmp_path / "tree"
    write(root, {n: random_file(rng, n) for n in rng.sample(names, 5)})
    graph = at_rest(spark, tmp_path / "k", build.build_graph(spark, str(root)))
    for n in rng.sample(names, 3):
        if (root / n).exists() and rng.random() < 0.4:
            (root / n).unlink()
        else:
            write(root, {n: random_file(rng, n)})
    graph = at_rest(spark, tmp_path / "k", build.update_graph(graph, code.scan_tree(spark, str(root))))
    whole = build.build_graph(spark, str(root))
    for side in (0, 1):
        for k in whole[side]:
            drop = ["repo_path", "last_modified", "updated_at"]
            assert shown(graph[side][k].drop(*drop)) == shown(whole[side][k].drop(*drop)), (seed, k)


def test_only_what_a_change_names_is_resolved_again(spark, tmp_path):
    from tremor.plans import delta

    root = tmp_path / "tree"
    write(root, {f"src/m{i}.py": f"from src import m{i + 1}\n\ndef f{i}():\n    return f{i + 1}()\n" for i in range(30)})
    before = at_rest(spark, tmp_path / "k", build.build_graph(spark, str(root)))[0]
    write(root, {"src/m7.py": "def f7():\n    return 7\n"})
    after = build.build_graph(spark, str(root))[0]
    diff = merge.snapshot_diff(before["file"], after["file"]).where("status <> 'unchanged'")
    change = delta.Change(before, after, diff)
    assert sorted(r.caller for r in change.callers.collect()) == ["src/m6.py::f6:3", "src/m7.py::f7:1"]
    assert [r.path for r in change.importers.collect()] == ["src/m7.py"]
    nodes, refs = change.touched()
    assert nodes["function"].count() == 1 and refs["calls"].agg(F.count(F.lit(1))).first()[0] == 1
