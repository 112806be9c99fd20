"""Queries that run a stream over the files there are and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark import constants as C
from ctxspark.functions import text as T
from ctxspark.plans.q_pack import PACKED
from ctxspark.plans.registry import Tables, query
from ctxspark.plans.stage import written
from ctxspark.sources.files import scratch
from ctxspark.streaming import jobs as J


def source(t: Tables, name: str) -> DataFrame:
    return J.stream_scan(t.spark, f"{t.path}/{name}.parquet", getattr(t, name).schema)


@query("SELECT file_path, count(*) AS n FROM raw_rows GROUP BY file_path")
def stream_scan(t: Tables) -> DataFrame:
    out, place = scratch(t.spark, "stream"), scratch(t.spark, "place")
    J.run_to_file(source(t, "raw_rows").select("row_id", "file_path"), out, place)
    return t.spark.read.schema("row_id bigint, file_path string").parquet(out).groupBy("file_path").agg(F.count("*").alias("n"))


@query("SELECT run_name, count(*) AS n, count(DISTINCT step) AS n_steps FROM step_log GROUP BY run_name")
def stream_checkpoint(t: Tables) -> DataFrame:
    """The same stream started twice with one checkpoint: the second start reads nothing again."""
    out, place = scratch(t.spark, "stream"), scratch(t.spark, "place")
    for _ in range(2):
        J.run_to_file(source(t, "step_log").select("run_name", "step"), out, place)
    s = t.spark.read.schema("run_name string, step bigint").parquet(out)
    return s.groupBy("run_name").agg(F.count("*").alias("n"), F.count_distinct("step").alias("n_steps"))


@query("SELECT run_name, time_bucket(INTERVAL '10 minutes', logged_at) AS window_start, count(*) AS n, sum(decoder_tokens)::BIGINT AS decoder_tokens FROM step_log WHERE logged_at IS NOT NULL GROUP BY ALL")
def stream_metrics(t: Tables) -> DataFrame:
    """Windows as they change. The watermark is as wide as the log, so that no row is late whatever the order of files; the greatest count of a window is its last state."""
    out, place = scratch(t.spark, "stream"), scratch(t.spark, "place")
    log = t.step_log.agg(F.min("logged_at").alias("a"), F.max("logged_at").alias("b")).select(F.expr("timestampdiff(DAY, a, b) + 2").alias("d")).collect()[0]["d"]  # one row
    J.run_windows(J.step_windows(source(t, "step_log"), late=f"{log or 2} days"), out, place)
    s = t.spark.read.schema("run_name string, window_start timestamp, n bigint, decoder_tokens bigint").parquet(out)
    last = s.groupBy("run_name", "window_start").agg(F.max_by(F.struct("n", "decoder_tokens"), "n").alias("x")).select("run_name", "window_start", "x.*")
    return last.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def sized(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("source").alias("shard"), F.md5(F.concat_ws("-", F.lit(str(C.SEED)), F.col("doc_id").cast("string"))).alias("ord"), F.col("doc_id").alias("id"), T.n_tokens("text").alias("n"))


@query(f"{PACKED} SELECT shard, id, n, pack_id, pack_offset FROM p")
def stream_pack(t: Tables) -> DataFrame:
    """The documents in read order, cut into files of a quarter of the keys each: a file is a batch, and the open packs are carried on."""
    out, place, files = scratch(t.spark, "stream"), scratch(t.spark, "place"), scratch(t.spark, "items")
    items = sized(t.documents.where("text is not null"))
    # next-fit depends on the order of all items, so the stream's files have to follow it
    quarter = F.conv(F.substring("ord", 1, 1), 16, 10).cast("int")
    parts = written(items.withColumn("quarter", F.floor(quarter / 4).cast("int")), "stream-items")
    for i in range(4):
        parts.where(F.col("quarter") == i).drop("quarter").coalesce(1).write.mode("append").parquet(files)
    J.run_to_file(J.stream_pack(J.stream_scan(t.spark, files, items.schema)), out, place)
    return t.spark.read.schema(J.PACKED).parquet(out)
