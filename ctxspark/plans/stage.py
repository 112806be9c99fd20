"""Stages written to the folder that all executors share.

A job of several passes cuts its lineage by writing an intermediate table; the table survives the
loss of any executor. The folder is the cluster's ``spark.checkpoint.dir`` or the context's checkpoint folder; only on a
local master, where all tasks share one disk, a folder is made if both are unset.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_PATHS: list[str] = []
#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for stages, without a trailing slash."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    set_by_code = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not at and set_by_code.isDefined():
        at = set_by_code.get()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("stages need a folder that all executors share: set spark.checkpoint.dir")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="ctxspark-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> int:
    """Deletes the stages this process has written and says how many; results that still read them must be saved before."""
    n = 0
    while _PATHS:
        at = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        n += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    return n


#: The optimizer gives inputs it knows nothing about (in-memory rows) about the largest long.
UNKNOWN = 1 << 62
#: Scans of at most this many bytes may be dealt out anew.
SPREAD_BYTES = 8 << 30


def planned_bytes(df: DataFrame) -> int:
    """Bytes that feed ``df``: the optimizer's estimate, or the sum of its inputs' bytes if that is less, as after joins.

    At least UNKNOWN if an input's size isn't known.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    inputs = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return UNKNOWN if inputs >= UNKNOWN else min(int(str(plan.stats().sizeInBytes())), inputs)


def n_partitions(df: DataFrame) -> int:
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt out evenly if it has fewer partitions than there are cores, as one of few or unsplittable files has.

    For work that costs far more than moving the rows. Scans over SPREAD_BYTES, and those with enough partitions, stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    small = planned_bytes(scan)
    return scan.repartition(2 * cores) if (small <= SPREAD_BYTES or small >= UNKNOWN) and n_partitions(scan) < cores else scan


def _parts(size: int, dfs: tuple[DataFrame, ...], each: int) -> int:
    """Parts of ``each`` bytes; an unknown size counts as one part for each partition there is."""
    return sum(map(n_partitions, dfs)) if size >= UNKNOWN else math.ceil(size / each)


#: Bytes of an input that a bucket of an exchange is for.
PART = 8 << 20


def least_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def exchange_parts(*dfs: DataFrame, each: int = PART) -> int:
    """Buckets for an exchange fed by ``dfs``: the session's partitions, more if an input is large."""
    return max(least_parts(dfs[0]), _parts(sum(map(planned_bytes, dfs)), dfs, each))


def range_parts(df: DataFrame, each: int = 4 << 20) -> int:
    """Ranges for rows that are few bytes each: by size, the session's partitions if that is unknown."""
    size = planned_bytes(df)
    return max(4, math.ceil(size / each)) if size < UNKNOWN else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
