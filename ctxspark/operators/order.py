"""Deterministic order of files and rows, shards of ranks, batches and resuming.

Order is stateless: a row's place depends on the seed, the epoch and its file and index only, so a resumed read and an
uninterrupted one agree, on any number of ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxspark import constants as C
from ctxspark.plans.prefix import running


def file_shuffle(files: DataFrame, seed: int = C.SEED) -> DataFrame:
    """(file_path, file_ord): a seeded permutation of the files, the same on all ranks. One row a file, so one sort suffices."""
    w = Window.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), "file_path")), "file_path")
    return files.where("file_path is not null").select("file_path").distinct().select("file_path", (F.row_number().over(w) - 1).cast("bigint").alias("file_ord"))


def drop_last_files(ordered: DataFrame, ranks: int) -> DataFrame:
    """The first n - n % ranks files, so that each rank has as many."""
    n = F.count("*").over(Window.partitionBy())
    return ordered.withColumn("n", n).where(F.col("file_ord") < F.col("n") - F.col("n") % ranks).drop("n")


def shard_round_robin(ordered: DataFrame, ranks: int) -> DataFrame:
    """``rank`` of each file: file i belongs to rank i mod ranks."""
    return ordered.withColumn("rank", F.pmod("file_ord", F.lit(ranks)).cast("bigint"))


def row_order(rows: DataFrame, seed: int = C.SEED, epoch: int = 0, shuffle: bool = True) -> DataFrame:
    """``rows`` of (row_id, file_path, row_idx) with ``row_ord``, the place in the file: hashed, or as stored.

    A file may hold any share of the rows: its rows are numbered in ranges. Rows without a file have no place and are left out.
    """
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(str(epoch)), "file_path", F.col("row_idx").cast("string")))
    keyed = rows.where("file_path is not null").withColumn("__key", key if shuffle else F.lit(""))
    return running(keyed, ["file_path"], ["__key", "row_idx", "row_id"], {"row_ord": F.lit(1)}).drop("__key").withColumn("row_ord", F.col("row_ord").cast("bigint") - 1)


def scan_plan(rows: DataFrame, files: DataFrame, ranks: int = C.RANKS, seed: int = C.SEED, epoch: int = 0, after: tuple[int, int] | None = None) -> DataFrame:
    """(row_id, file_path, rank, file_ord, row_ord): who reads which row when. Files over an even share of the ranks are dropped.

    With ``after``, a cursor (file_ord, row_ord), only what is left to read behind it. Files that are dropped or read already leave before rows are numbered.
    """
    plan = shard_round_robin(drop_last_files(file_shuffle(files, seed), ranks), ranks)
    if after:
        plan = plan.where(F.col("file_ord") >= after[0])
    numbered = row_order(rows.join(plan, "file_path"), seed, epoch).select("row_id", "file_path", "rank", "file_ord", "row_ord")
    return resume(numbered, *after) if after else numbered


def resume(plan: DataFrame, file_ord: int, row_ord: int) -> DataFrame:
    """What is left to read after the row at the cursor."""
    return plan.where((F.col("file_ord") > file_ord) | ((F.col("file_ord") == file_ord) & (F.col("row_ord") > row_ord)))


def fingerprint(files: DataFrame, seed: int, ranks: int) -> DataFrame:
    """One row that changes with the files, the seed or the number of ranks; ``resume_warnings`` compares it."""
    listed = F.array_join(F.array_sort(F.collect_set("file_path")), "\n")
    return files.agg(F.md5(F.concat_ws("\n", F.lit(f"{seed}-{ranks}"), listed)).alias("fingerprint"), F.count_distinct("file_path").alias("n_files"))


def batches(plan: DataFrame, size: int) -> DataFrame:
    """``batch`` of each row within its file; a file's last batch may be short."""
    return plan.withColumn("batch", F.floor(F.col("row_ord") / size).cast("bigint"))


def resume_warnings(saved: DataFrame, files: DataFrame, seed: int, ranks: int) -> DataFrame:
    """(what, saved, now) of everything that differs between a saved state and the present; a resume warns and goes on.

    ``saved`` has one row (fingerprint, n_files, file_ord, current_file, ratio_ok): what ``fingerprint`` gave, the cursor's file and its path then. No rows mean
    that the state fits; a missing saved value is not compared.
    """
    ordered = file_shuffle(files, seed)
    now = fingerprint(files, seed, ranks).select(F.col("fingerprint").alias("now_fp"), F.col("n_files").alias("now_n"))
    at = saved.select("file_ord").join(ordered, "file_ord", "left").select(F.col("file_path").alias("now_file"))
    j = saved.crossJoin(now).crossJoin(at)  # one row each
    pair = lambda what, was, is_: F.struct(F.lit(what).alias("what"), was.cast("string").alias("saved"), is_.cast("string").alias("now"))
    pairs = F.array(pair("fingerprint", F.col("fingerprint"), F.col("now_fp")), pair("number of files", F.col("n_files"), F.col("now_n")), pair("current file", F.col("current_file"), F.col("now_file")))
    return j.select(F.explode(pairs).alias("p")).select("p.*").where("saved is not null and not saved <=> now")
