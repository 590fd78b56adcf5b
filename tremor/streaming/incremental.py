"""File snapshots and coverage as streams that keep tables current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import snapshot_diff, upsert_edges

SNAPSHOT = "path string, content_hash string, seen_at timestamp, deleted boolean"
LINKS = "src string, dst string, link_source string, link_confidence double, coverage double"


#: Folder of a table after a batch; a version is whole once its _SUCCESS file is there.
VERSION = "batch="


def _versions(spark: SparkSession, table: str) -> dict[int, str]:
    """The whole versions of a table, by batch."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{table}/{VERSION}*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    folders = [str(f.getPath().getParent().toString()) for f in found]
    return {int(f.rsplit(VERSION, 1)[1]): f for f in folders}


def read_state(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The newest whole version of a table."""
    found = _versions(spark, table)
    return spark.read.schema(schema).parquet(found[max(found)]) if found else spark.createDataFrame([], schema)


def _write_version(df: DataFrame, table: str, number: int) -> None:
    """A batch's version in a folder of its own; the one before goes once this is whole, so a failure leaves either."""
    df.write.mode("overwrite").parquet(f"{table}/{VERSION}{number}")
    spark = df.sparkSession
    for k, folder in _versions(spark, table).items():
        if k < number:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def follow_snapshots(spark: SparkSession, source: str, state: str, changes: str, checkpoint: str) -> StreamingQuery:
    """Parquet files of (path, content_hash, seen_at, deleted) as they arrive: ``state`` holds the latest of each path, ``changes`` every batch's differences.

    Both are written by batch number, and a batch whose state is whole is not merged again. Of equal times the
    greatest hash counts.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if number in _versions(session, state):
            return
        latest = batch.groupBy("path").agg(F.max_by(F.struct("content_hash", "deleted"), F.struct("seen_at", "content_hash")).alias("r")).select("path", "r.*")
        old = read_state(session, state, "path string, content_hash string")
        kept = old.join(latest, "path", "left_anti").unionByName(latest.where("not coalesce(deleted, false)").select("path", "content_hash"))
        kept = kept.persist()
        diff = snapshot_diff(old, kept).where("status <> 'unchanged'")
        diff.write.mode("overwrite").parquet(f"{changes}/{VERSION}{number}")
        _write_version(kept, state, number)
        kept.unpersist()

    stream = spark.readStream.schema(SNAPSHOT).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_links(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """Links as they arrive, merged by greatest confidence; replaying a batch changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        if number in _versions(batch.sparkSession, table):
            return
        old = read_state(batch.sparkSession, table, LINKS)
        _write_version(upsert_edges(old, batch, maxima=("coverage",)), table, number)

    stream = spark.readStream.schema(LINKS).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_outcomes(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts of outcomes (ts, status) per window, with a watermark: works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "status").agg(F.count(F.lit(1)).alias("n"))
