"""Formats of source trees and coverage databases, and attempts judged as a stream."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tremor.operators import agent
from tremor.sources import formats
from tremor.streaming import attempts


def test_trees_of_many_files(spark, tmp_path, monkeypatch):
    want = {}
    for i in range(120):
        name = f"{'._x'[i % 3]}d{i % 7}/e{i % 3}/f{i}.py" if i % 2 else f"top{i}.py"
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x = %d\n" % i)
        want[name] = b"x = %d\n" % i
    (tmp_path / "note.txt").write_text("no")
    formats.register(spark)
    for folders in (1, 5, 64):
        rows = spark.read.format("source_tree").option("folders", str(folders)).load(str(tmp_path))
        assert rows.columns == ["path", "content", "last_modified"]
        assert {r.path: bytes(r.content) for r in rows.collect()} == want and rows.where("last_modified is null").count() == 0
    odd = spark.read.format("source_tree").option("names", "passed_over").load(f"file://{tmp_path}")
    assert {r.path for r in odd.collect()} == {n for n in want if n[0] in "._"}
    reader = formats.SourceTreeReader({"path": str(tmp_path), "folders": "9"})
    assert len(reader.partitions()) >= 9
    monkeypatch.setattr(formats, "BATCH_BYTES", 20)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 120 and max(b.num_rows for p in reader.partitions() for b in reader.read(p)) < 10


def database(path, rows):
    db = sqlite3.connect(path)
    db.executescript("create table file (id integer, path text); create table context (id integer, context text); create table line_bits (file_id integer, context_id integer, numbits blob)")
    for i, (file, context, lines) in enumerate(rows):
        bits = bytearray(max(lines) // 8 + 1)
        for n in lines:
            bits[n // 8] |= 1 << n % 8
        db.execute("insert into file values (?, ?)", (i, file))
        db.execute("insert into context values (?, ?)", (i, context))
        db.execute("insert into line_bits values (?, ?, ?)", (i, i, bytes(bits)))
    db.commit()
    db.close()


def test_coverage_databases_are_streamed(spark, tmp_path, monkeypatch):
    want = set()
    for k in range(6):
        rows = [(f"/r/src/m{i}.py", f"t{k}" if i else "", [1, 7, 8, 300 + k]) for i in range(3)]
        folder = tmp_path / f"run{k % 2}"
        folder.mkdir(exist_ok=True)
        database(folder / (".coverage" if k < 2 else f"data{k}"), rows)
        want |= {(c or None, f, n) for f, c, ls in rows for n in ls}
    (tmp_path / "other").write_bytes(b"no database")
    (tmp_path / "broken").write_bytes(b"SQLite format 3\x00 and no more")
    empty = sqlite3.connect(tmp_path / "other.db")
    empty.execute("create table x (y)")
    empty.commit()
    formats.register(spark)
    got = spark.read.format("coverage_lines").load(str(tmp_path)).collect()
    assert {(r.context, r.file, r.line) for r in got} == want
    monkeypatch.setattr(formats, "BATCH_ROWS", 5)
    reader = formats.CoverageReader({"path": str(tmp_path / "run0")})
    assert max(b.num_rows for p in reader.partitions() for b in reader.read(p)) < 12


@pytest.mark.parametrize("seed", [1, 2])
def test_judged_streams_equal_the_batch(spark, tmp_path, seed):
    """Attempts arrive up to 20 minutes late; a last one of another conversation moves the watermark on."""
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        at = 1_700_000_000 + i * 60
        rows.append((f"c{rng.randrange(4)}", i, at, rng.choice(["x", "y", None]), rng.choice([0, 1, 2, None]), rng.choice([0, 1, None]), rng.choice([True, False, None])))
    arrival = sorted(rows, key=lambda r: r[2] + rng.randrange(1200))
    schema = attempts.ATTEMPTS.replace("ts timestamp", "ts long")

    def frame(part):
        return spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("ts"))

    source = str(tmp_path / "in")
    parts = [arrival[i : i + 30] for i in range(0, 120, 30)] + [[("end", 999, 1_700_000_000 + 10**6, None, None, None, None)], [("end", 1000, 1_700_000_000 + 10**6 + 1, None, None, None, None), (None, 1, 5, None, None, None, None)]]
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for part in parts:
        frame(part).coalesce(1).write.mode("append").parquet(source)
        judged = attempts.judge_attempts(spark.readStream.schema(attempts.ATTEMPTS).parquet(source))
        judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = agent.progress_gate(frame(rows), "conv", ["ts", "attempt"]).select("conv", "attempt", "reason", "passed", F.col("stagnation").cast("long"), "relocalize")
    got = spark.read.parquet(out).where("conv <> 'end'").select("conv", "attempt", "reason", "passed", "stagnation", "relocalize")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
