"""Structured Streaming: resumable scans, windowed metrics, packing with an open pack as state.

Every job reads files as they come, keeps its place in a checkpoint folder and can be stopped after any batch; started
again with the same folder it goes on where it was, without reading a row twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark import constants as C
from ctxspark.operators.packing import place


def stream_scan(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, some each batch, in the order they were written; or of one file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    return reader.parquet(path)


def run_to_file(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends what is there now to Parquet, exactly once, and ends."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", stop: Callable[[], bool] | None = None) -> int:
    """Hands every batch to ``each`` with its number, and says how many there were.

    ``stop`` is asked after each batch. Batches after one at which it was true are not begun: the query ends there, and another start with the same
    checkpoint goes on behind the last whole batch.
    """
    ended: list[bool] = []
    done = [0]

    def handle(df: DataFrame, number: int) -> None:
        if ended:
            raise _Stopped
        each(df, number)
        done[0] += 1
        if stop is not None and stop():
            ended.append(True)

    q = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except Exception:
        if not ended:
            raise
    return done[0]


class _Stopped(Exception):
    """A batch that is not begun."""


def run_windows(windows: DataFrame, out: str, checkpoint: str) -> None:
    """Writes each batch's changed windows behind one another; the greatest count of a window is its last state."""
    run_batches(windows, lambda df, i: df.write.mode("append").parquet(out), checkpoint, "update")


def step_windows(log: DataFrame, width: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """(run_name, window_start, n, decoder_tokens): tumbling windows over logged_at; rows later than the watermark are left out."""
    w = log.withColumn("at", F.col("logged_at").cast("timestamp")).withWatermark("at", late).groupBy("run_name", F.window("at", width))
    return w.agg(F.count("*").alias("n"), F.sum("decoder_tokens").alias("decoder_tokens")).select("run_name", F.col("window.start").alias("window_start"), "n", "decoder_tokens")


PACKED = "shard string, id bigint, n bigint, pack_id bigint, pack_offset bigint"
STATE = "fill bigint, pack bigint"


def stream_pack(items: DataFrame, limit: int = C.PACK) -> DataFrame:
    """Next-fit packing of a stream of (shard, ord, id, n): the open pack of each shard is the state.

    Within a batch items go by ``ord`` and ``id``; batches follow each other. The result equals the batch operator's on that order; a null shard is a shard of its
    own. A batch's items of a shard are sorted in one task: they are three numbers and a key each, and what a trigger reads (files or bytes a batch) bounds them.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fill, pack = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["ord", "id"], kind="stable")
        sizes = rows["n"].to_numpy()
        packs, offsets = place(sizes, limit, fill, pack)
        if len(sizes):
            fill, pack = int(offsets[-1] + sizes[-1]), int(packs[-1])
        state.update((fill, pack))
        yield pd.DataFrame({"shard": [None if key[0] else key[1]] * len(rows), "id": rows["id"].to_numpy(), "n": sizes, "pack_id": packs, "pack_offset": offsets})

    kept = items.where(F.col("n") <= limit).select(F.col("shard").isNull().alias("no_shard"), F.coalesce("shard", F.lit("")).alias("shard"), "ord", "id", "n")
    return kept.groupBy("no_shard", "shard").applyInPandasWithState(step, PACKED, STATE, "append", "NoTimeout")
