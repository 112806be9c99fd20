"""Reading and writing of the file formats: JSON lines with open metadata, partitioned and resumable sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ctxspark.plans.stage import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are written as null."""
    df.write.option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, messages, meta) of JSON lines whose prompt is a string or a list of messages; blank lines are skipped.

    ``meta`` is the whole record as a variant, so any other key is kept without a schema.
    """
    v = spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("meta"))
    is_list = F.schema_of_variant(F.expr("variant_get(meta, '$.prompt')")).startswith("ARRAY")
    text = F.when(~is_list, F.expr("variant_get(meta, '$.prompt', 'string')"))
    messages = F.when(is_list, F.expr("try_variant_get(meta, '$.prompt', 'array<struct<role:string,content:string>>')"))
    return v.select(text.alias("prompt"), messages.alias("messages"), "meta")


def meta_map(df: DataFrame, prompt: str) -> DataFrame:
    """(prompt, meta): the other columns as a map of strings."""
    pairs = [x for c in df.columns if c != prompt for x in (F.lit(c), F.col(c).cast("string"))]
    return df.select(F.col(prompt).alias("prompt"), F.create_map(*pairs).alias("meta"))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """One folder of JSON lines for each value; the number of files follows the data, not one a value."""
    df.write.partitionBy(by).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def append_missing(df: DataFrame, path: str, keys: list[str], summary: str | None = None) -> bool:
    """Appends the rows whose keys are not in the sink yet and says whether it did anything.

    A null key is a key like any other; given twice, a row is added once. If there is a ``summary`` of the whole task, nothing is read or added.
    """
    spark = df.sparkSession
    if summary and exists(spark, summary):
        return False
    new = df.dropDuplicates(keys)
    if exists(spark, path):
        done = spark.read.schema(df.schema).parquet(path).select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        new = new.join(done, same, "left_anti")
    new.write.mode("append").parquet(path)
    return True


def write_summary(scores: DataFrame, path: str, task: str = "task", score: str = "score") -> None:
    """One JSON file with a row for each task and one over all: (task, n, mean, is_overall). Overall, each task counts the same.

    A null task is one; the result has one row a task, so one file takes it.
    """
    tasks = scores.groupBy(task).agg(F.count("*").alias("n"), F.avg(score).alias("mean")).withColumn("is_overall", F.lit(False))
    overall = tasks.agg(F.lit(None).cast("string").alias(task), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.avg("mean").alias("mean"), F.lit(True).alias("is_overall"))
    tasks.unionByName(overall).coalesce(1).write.option("ignoreNullFields", "false").json(path)


def row_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(tbl, n): rows of Parquet tables by their footers: no column is read, and no data page."""
    counts = None
    for name, path in paths.items():
        one = spark.read.schema(StructType([])).parquet(path).agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def answers_of(nested: Column, several: Column, single: Column) -> Column:
    """The first that isn't empty of nested answers, a single answer and a list of them; a text counts as a list of one, none at all as an empty list."""
    full = lambda c: F.when(F.size(c) > 0, c)
    one = F.when(single != "", F.array(single))
    return F.coalesce(full(nested), one, full(several), F.array().cast("array<string>"))


def benchmark_split(items: DataFrame, prefix: str = "memwrap/ruler/") -> DataFrame:
    """(ctx, subtask, item_id) of the items whose category names a subtask and a context length."""
    named = items.where(F.col("category").rlike(f"^{prefix}.*_\\d+$"))
    return named.select(F.regexp_extract("category", r"_(\d+)$", 1).alias("ctx"), F.regexp_extract("category", rf"^{prefix}(.*)_\d+$", 1).alias("subtask"), "item_id")
