"""Scores of responses and their aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.functions import parsing as P
from ctxspark.plans.prefix import running
from ctxspark.plans.stage import written

#: Characters of needles in one automaton, of about 50 bytes each.
NEEDLE_CHARS = 2 << 20


def scored(completions: DataFrame) -> DataFrame:
    """Distinct completions with ``score``."""
    return completions.distinct().withColumn("score", P.score_match_all("answers", "response"))


def task_means(scores: DataFrame, task: str = "task") -> DataFrame:
    """(task, n, mean)."""
    return scores.groupBy(task).agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


def macro_mean(means: DataFrame) -> DataFrame:
    """The unweighted mean of the tasks' means, in one row."""
    return means.agg(F.count("*").alias("n_tasks"), F.avg("mean").alias("macro"))


def metric_aggregate(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., metric, n_with, mean) of rows with a map ``metrics``: the mean over rows that have the metric, nulls aside.

    NaN is a value and makes a mean NaN. The metric ``__n__`` has the number of rows as its mean, whatever they hold.
    """
    e = metrics.select(*keys, F.explode("metrics").alias("metric", "value")).where("value is not null")
    means = e.groupBy(*keys, "metric").agg(F.count("*").alias("n_with"), F.avg("value").alias("mean"))
    every = metrics.groupBy(*keys).agg(F.count("*").alias("n_with")).select(*keys, F.lit("__n__").alias("metric"), "n_with", F.col("n_with").cast("double").alias("mean"))
    return means.unionByName(every)


def running_score(scores: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``running``: the mean of the scores so far in each group; a group may hold any share of the rows."""
    r = running(scores, [by], order, {"__sum": F.col("score"), "__n": F.lit(1)})
    return r.withColumn("running", F.col("__sum") / F.col("__n")).drop("__sum", "__n")


def contained_needles(texts: DataFrame, needles: DataFrame, at_once: int = NEEDLE_CHARS) -> DataFrame:
    """(id, needle_id): every needle (needle_id, needle) that a text (id, text) contains, whatever the case.

    One pass over the texts with an automaton of all needles in place of a join of all pairs. The automaton is broadcast and holds ``at_once`` characters of
    needles, and one needle more at most; more of them take several passes. Null and empty needles and null texts match nothing.
    """
    import ahocorasick

    spark = texts.sparkSession
    real = written(needles.where("needle_id is not null and needle <> ''").select(F.col("needle_id").cast("bigint").alias("needle_id"), "needle").distinct(), "needles")
    sums = running(real.withColumn("all", F.lit(0)), ["all"], ["needle_id", "needle"], {"sum": F.length("needle")})
    turns = written(sums.select("needle_id", "needle", ((F.col("sum") - 1) / at_once).cast("bigint").alias("turn")), "needle-turns")
    n = turns.agg(F.max("turn")).collect()[0][0]
    found = spark.createDataFrame([], "id bigint, needle_id bigint") if n is None else None
    for t in range(0 if n is None else n + 1):
        a = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for r in turns.where(F.col("turn") == t).collect():
            by.setdefault(r["needle"].lower(), []).append(r["needle_id"])
        for word, ids in by.items():
            a.add_word(word, ids)
        if by:
            a.make_automaton()
        shared = spark.sparkContext.broadcast(a if by else None)
        one = texts.where("text is not null").select(F.col("id").cast("bigint").alias("id"), "text").mapInArrow(_find(shared), "id bigint, needle_id bigint")
        found = one if found is None else found.unionByName(one)
    return found


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for b in batches:
            ids, hits = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if a else ():
                mine = sorted({n for _, found in a.iter(text.lower()) for n in found})
                ids += [i] * len(mine)
                hits += mine
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, pa.int64())], names=["id", "needle_id"])

    return run
