"""Training telemetry: tokens, throughput, losses, schedules, skipped steps, checkpoints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.plans.prefix import running

KEY = ["run_name", "step", "rank"]


def once(log: DataFrame) -> DataFrame:
    """Each (run, step, rank) once; repeated rows are equal."""
    return log.dropDuplicates(KEY)


def finite(c: str) -> Column:
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))


def token_counts(log: DataFrame) -> DataFrame:
    """(run_name, step, rank, is_total, memory_tokens, decoder_tokens): per rank and, with is_total, over all ranks of a step."""
    sums = log.groupBy("run_name", "step", F.coalesce("rank", F.lit(-1)).alias("rank")).agg(F.sum("memory_tokens").alias("memory_tokens"), F.sum("decoder_tokens").alias("decoder_tokens"))
    total = sums.rollup(F.struct("run_name", "step").alias("at"), "rank").agg(F.grouping("rank").cast("boolean").alias("is_total"), F.sum("memory_tokens").alias("memory_tokens"), F.sum("decoder_tokens").alias("decoder_tokens"))
    return total.where("at is not null").select("at.run_name", "at.step", "rank", "is_total", "memory_tokens", "decoder_tokens")


def per_step(log: DataFrame) -> DataFrame:
    """One row a step: time, tokens, mean of the finite losses, whether a loss wasn't finite. Later windows run over these, not over ranks."""
    bad = F.col("loss").isNotNull() & ~finite("loss")
    return log.groupBy("run_name", "step").agg(
        F.max("t_sec").alias("t_sec"), F.sum(F.coalesce("memory_tokens", F.lit(0)) + F.coalesce("decoder_tokens", F.lit(0))).alias("tokens"),
        F.avg(F.when(finite("loss"), F.col("loss"))).alias("loss"), F.bool_or(bad).alias("is_bad"), F.count("*").alias("n_ranks"),
    )


def _numbered(steps: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``steps`` with ``__i``, their number in the run from 1, and running sums; a run may hold any share of the steps."""
    return running(steps, ["run_name"], ["step"], {"__i": F.lit(1)} | sums)


def _earlier(steps: DataFrame, by: int, columns: list[str]) -> DataFrame:
    """(run, number, columns) as they were ``by`` steps before, to be joined by run and number."""
    return steps.select(F.col("run_name").alias("__run"), (F.col("__i") + by).alias("__at"), *(F.col(c).alias(f"{c}_then") for c in columns))


def _with_earlier(steps: DataFrame, by: int, columns: list[str]) -> DataFrame:
    then = _earlier(steps, by, columns)
    return steps.join(then, F.col("run_name").eqNullSafe(F.col("__run")) & (F.col("__i") == F.col("__at")), "left").drop("__run", "__at")


def throughput(steps: DataFrame) -> DataFrame:
    """(run_name, step, dt, tokens_per_sec) from a run's second step on; null where no time passed.

    Steps meet those before them by their numbers, so a run's steps are not sorted in one task.
    """
    s = _with_earlier(_numbered(steps, {}), 1, ["t_sec"]).withColumn("dt", F.col("t_sec") - F.col("t_sec_then")).where("dt is not null")
    return s.select("run_name", "step", "dt", F.when(F.col("dt") > 0, F.col("tokens") / F.col("dt")).alias("tokens_per_sec"))


def running_loss(steps: DataFrame, last: int = 100) -> DataFrame:
    """``running``: the mean of the losses of the last ``last`` steps with one, as the difference of two running sums."""
    s = _with_earlier(_numbered(steps.where("loss is not null"), {"__sum": F.col("loss")}), last, ["__sum"])
    mean = (F.col("__sum") - F.coalesce("__sum_then", F.lit(0.0))) / F.least(F.col("__i"), F.lit(last))
    return s.withColumn("running", mean).drop("__i", "__sum", "__sum_then")


def examples_seen(steps: DataFrame, batch: int) -> DataFrame:
    """``seen``: examples up to a step, batch times ranks summed."""
    return running(steps, ["run_name"], ["step"], {"seen": F.col("n_ranks") * batch})


def skip_ranges(text: str) -> list[tuple[int, int]]:
    """Inclusive ranges of "24-26,40"."""
    out = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        a, _, b = part.partition("-")
        out.append((int(a), int(b or a)))
    return out


def skipped(steps: DataFrame, text: str, anti: bool = False) -> DataFrame:
    """Steps in any of the ranges, or those in none."""
    spark = steps.sparkSession
    ranges = spark.createDataFrame(skip_ranges(text), "first bigint, last bigint") if text.strip() else spark.createDataFrame([], "first bigint, last bigint")
    return steps.join(F.broadcast(ranges), steps["step"].between(F.col("first"), F.col("last")), "left_anti" if anti else "left_semi")


def learning_rate(step: Column, base: float, warmup: int, total: int, least: float = 0.0, fraction: float = 1.0, world: int = 1) -> Column:
    """Linear warm-up, then half a cosine down to ``least`` over ``fraction`` of the rest, then constant.

    ``warmup`` and ``total`` count optimizer steps of one process; a schedule that is stepped by ``world`` processes has as many times more.
    """
    warmup, total = warmup * world, total * world
    decay = int((total - warmup) * fraction)
    cosine = 0.5 * (1 + F.cos(math.pi * (step - warmup) / max(1, decay)))
    return F.when(step <= warmup, base * step / max(1, warmup)).when(step <= warmup + decay, least + (base - least) * cosine).otherwise(F.lit(least))


def resume_position(step: Column, batch: int, accumulated: int, file_ord: Column, row_ord: Column, rows_in_first: Column) -> Column:
    """Struct (by_steps, by_cursor, apart): examples read by the count of steps, and by the cursor if all files are as long as the first."""
    by_steps, by_cursor = step * batch * accumulated, file_ord * rows_in_first + row_ord
    return F.struct(by_steps.cast("bigint").alias("by_steps"), by_cursor.cast("bigint").alias("by_cursor"), F.abs(by_steps - by_cursor).cast("bigint").alias("apart"))


def checkpoint_step(name: Column) -> Column:
    """The step a checkpoint's name ends with, null for other names."""
    return F.nullif(F.regexp_extract(name, r"_(?:step_)?(\d+)$", 1), F.lit("")).cast("bigint")


def retain_latest(checkpoints: DataFrame, keep: int, by: str = "run_name") -> DataFrame:
    """(by, name, step, keep): whether a checkpoint is among its run's ``keep`` newest. Names without a step are left out."""
    c = checkpoints.withColumn("step", checkpoint_step(F.col("name"))).where("step is not null")
    return c.select(by, "name", "step", (F.row_number().over(Window.partitionBy(by).orderBy(F.desc("step"), "name")) <= keep).alias("keep"))


def best_branch(branches: DataFrame, preferred: list[str], by: str = "run_name") -> DataFrame:
    """(by, branch): the first preferred name a run has, else the one of its latest step."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for i, p in enumerate(preferred) for x in (F.lit(p), F.lit(i))]), F.col("name")), F.lit(len(preferred)))
    key = F.struct(rank.alias("r"), (-F.coalesce(checkpoint_step(F.col("name")), F.lit(-1))).alias("s"), F.col("name"))
    return branches.groupBy(by).agg(F.min(key).alias("k")).select(by, F.col("k.name").alias("branch"))


def param_group(name: Column) -> Column:
    """The optimizer group of a parameter: decoder, encoder or adapter by what its name holds, in this order; decoder otherwise, null for a null name."""
    group = F.when(name.contains("decoder"), "decoder").when(name.contains("encoder.embed_model"), "encoder").when(name.contains("adapter"), "adapter")
    return F.when(name.isNotNull(), F.coalesce(group, F.lit("decoder")))


def param_group_count(params: DataFrame) -> DataFrame:
    """(param_group, n_params, n_elements) of parameters (name, n)."""
    return params.groupBy(param_group(F.col("name")).alias("param_group")).agg(F.count("*").alias("n_params"), F.sum("n").alias("n_elements"))
