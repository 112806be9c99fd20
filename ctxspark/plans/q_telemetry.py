"""Queries on telemetry, schedules and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.functions import parsing as P
from ctxspark.operators import telemetry as L
from ctxspark.plans.registry import Tables, query

ONCE = "l AS (SELECT run_name, step, rank, any_value(loss) AS loss, any_value(memory_tokens) AS memory_tokens, any_value(decoder_tokens) AS decoder_tokens, any_value(t_sec) AS t_sec FROM step_log GROUP BY run_name, step, rank)"
STEPS = f"""{ONCE}, st AS (SELECT run_name, step, max(t_sec) AS t_sec, sum(coalesce(memory_tokens, 0) + coalesce(decoder_tokens, 0))::BIGINT AS tokens,
avg(loss) FILTER (isfinite(loss)) AS loss, bool_or(loss IS NOT NULL AND NOT isfinite(loss)) AS is_bad, count(*) AS n_ranks FROM l GROUP BY run_name, step)"""


def log(t: Tables) -> DataFrame:
    return L.once(t.step_log)


def steps(t: Tables) -> DataFrame:
    return L.per_step(log(t))


@query(f"""WITH {ONCE} SELECT run_name, step, coalesce(rank, -1) AS rank, false AS is_total, sum(memory_tokens)::BIGINT AS memory_tokens, sum(decoder_tokens)::BIGINT AS decoder_tokens FROM l GROUP BY run_name, step, rank
UNION ALL SELECT run_name, step, NULL, true, sum(memory_tokens)::BIGINT, sum(decoder_tokens)::BIGINT FROM l GROUP BY run_name, step""")
def step_token_counts(t: Tables) -> DataFrame:
    return L.token_counts(log(t))


@query(f"WITH {STEPS}, d AS (SELECT *, t_sec - lag(t_sec) OVER (PARTITION BY run_name ORDER BY step) AS dt FROM st) SELECT run_name, step, round(dt, 4) AS dt, CASE WHEN dt > 0 THEN round(tokens / dt, 2) END AS tokens_per_sec FROM d WHERE dt IS NOT NULL")
def step_throughput(t: Tables) -> DataFrame:
    r = L.throughput(steps(t))
    return r.select("run_name", "step", F.round("dt", 4).alias("dt"), F.round("tokens_per_sec", 2).alias("tokens_per_sec"))


@query(f"WITH {STEPS} SELECT run_name, step, round(avg(loss) OVER (PARTITION BY run_name ORDER BY step ROWS 99 PRECEDING), 5) AS running FROM st WHERE loss IS NOT NULL")
def running_loss_100(t: Tables) -> DataFrame:
    return L.running_loss(steps(t)).select("run_name", "step", F.round("running", 5).alias("running"))


@query(f"WITH {STEPS} SELECT run_name, step FROM st WHERE is_bad")
def nonfinite_guard(t: Tables) -> DataFrame:
    """Steps to skip: a rank's loss isn't finite."""
    return steps(t).where("is_bad").select("run_name", "step")


@query(f"WITH {STEPS} SELECT run_name, step, n_ranks, tokens FROM st WHERE step % 10 = 0")
def batch_debug_stats(t: Tables) -> DataFrame:
    return L.per_step(log(t).where("step % 10 = 0")).select("run_name", "step", "n_ranks", "tokens")


@query(f"WITH {STEPS} SELECT run_name, step, sum(n_ranks * 4) OVER (PARTITION BY run_name ORDER BY step ROWS UNBOUNDED PRECEDING)::BIGINT AS seen FROM st")
def examples_seen(t: Tables) -> DataFrame:
    return L.examples_seen(steps(t), 4).select("run_name", "step", "seen")


@query(f"""WITH {STEPS}, f AS (SELECT count(*) AS first_rows FROM (SELECT DISTINCT row_id FROM raw_rows WHERE file_path = (SELECT min(file_path) FROM raw_rows))), m AS (SELECT run_name, max(step) AS step, count(DISTINCT step) % 7 AS file_ord, sum(tokens) % 100 AS row_ord FROM st GROUP BY run_name)
SELECT run_name, step, step * 8 AS by_steps, (file_ord * first_rows + row_ord)::BIGINT AS by_cursor, abs(step * 8 - (file_ord * first_rows + row_ord))::BIGINT AS apart FROM m, f""")
def resume_position(t: Tables) -> DataFrame:
    """Examples read by a run's steps, batch 4 and 2 accumulated, beside the estimate of its cursor (here made of its telemetry)."""
    first = t.raw_rows.agg(F.min("file_path").alias("first"))
    rows = t.raw_rows.select("row_id", "file_path").crossJoin(F.broadcast(first)).where("file_path = first").agg(F.count_distinct("row_id").alias("first_rows"))  # one row each
    cursor = steps(t).groupBy("run_name").agg(F.max("step").alias("step"), (F.count_distinct("step") % 7).alias("file_ord"), (F.sum("tokens") % 100).alias("row_ord"))
    p = cursor.crossJoin(F.broadcast(rows)).select("run_name", "step", L.resume_position(F.col("step"), 4, 2, F.col("file_ord"), F.col("row_ord"), F.col("first_rows")).alias("p"))
    return p.select("run_name", "step", "p.*")


@query(f"WITH {STEPS} SELECT run_name, step FROM st WHERE step BETWEEN 24 AND 26 OR step = 40")
def skip_ranges(t: Tables) -> DataFrame:
    return L.skipped(steps(t), "24-26,40").select("run_name", "step")


LR = "CASE WHEN step <= 20 THEN 1e-3 * step / 20 WHEN step <= 100 THEN 1e-5 + (1e-3 - 1e-5) * 0.5 * (1 + cos(pi() * (step - 20) / 80)) ELSE 1e-5 END"


@query(f"SELECT step, round({LR}, 9)::DOUBLE AS lr FROM (SELECT DISTINCT step FROM step_log)")
def lr_schedule(t: Tables) -> DataFrame:
    """The schedule of two processes: 10 of 60 steps warm up, four fifths of the rest decay, each counted twice."""
    return t.step_log.select("step").distinct().select("step", F.round(L.learning_rate(F.col("step"), 1e-3, 10, 60, 1e-5, 0.8, world=2), 9).alias("lr"))


NAMES = "n AS (SELECT DISTINCT run_name, run_name || '_step_' || step AS name, step FROM step_log WHERE step % 5 = 0 AND run_name IS NOT NULL UNION ALL SELECT DISTINCT run_name, run_name || '_final', NULL FROM step_log WHERE run_name IS NOT NULL)"


def checkpoints(t: Tables) -> DataFrame:
    c = t.step_log.where("run_name is not null")
    named = c.where("step % 5 = 0").select("run_name", F.concat("run_name", F.lit("_step_"), F.col("step").cast("string")).alias("name"))
    return named.unionByName(c.select("run_name", F.concat("run_name", F.lit("_final")).alias("name"))).distinct()


@query(f"WITH {NAMES} SELECT run_name, max(step) AS step FROM n GROUP BY run_name")
def latest_checkpoint(t: Tables) -> DataFrame:
    return checkpoints(t).groupBy("run_name").agg(F.max(L.checkpoint_step(F.col("name"))).alias("step"))


@query(f"WITH {NAMES} SELECT run_name, name, step, row_number() OVER (PARTITION BY run_name ORDER BY step DESC) <= 2 AS keep FROM n WHERE step IS NOT NULL")
def retain_latest_n(t: Tables) -> DataFrame:
    return L.retain_latest(checkpoints(t), 2)


@query(f"WITH {NAMES} SELECT run_name, CASE WHEN run_name LIKE 'aru%' THEN run_name || '_final' ELSE run_name || '_step_' || max(step) END AS branch FROM n GROUP BY run_name")
def best_branch(t: Tables) -> DataFrame:
    return L.best_branch(checkpoints(t), ["stage3_final", "aru-cs16-w1024_final"])


CLOCK = "CASE WHEN s >= 86400 THEN (s // 86400) || '-' || lpad((s % 86400 // 3600)::VARCHAR, 2, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') WHEN s >= 60 THEN (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE run_name END"


@query(f"WITH c AS (SELECT DISTINCT run_name, step * step * 97 AS s FROM step_log), d AS (SELECT {CLOCK} AS text, s FROM c) SELECT DISTINCT text, CASE WHEN s >= 60 THEN s::DOUBLE ELSE 'inf'::DOUBLE END AS seconds FROM d WHERE text IS NOT NULL")
def parse_duration(t: Tables) -> DataFrame:
    """Times of all steps, written as D-HH:MM:SS, HH:MM:SS or MM:SS, read again; names of runs are no time."""
    s = F.expr("step * step * 97")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day, hour, minute, second = F.expr("s div 86400"), F.expr("s % 86400 div 3600"), F.expr("s % 3600 div 60"), F.expr("s % 60")
    clock = F.when(F.col("s") >= 86400, F.concat(day.cast("string"), F.lit("-"), two(hour), F.lit(":"), two(minute), F.lit(":"), two(second)))
    clock = clock.when(F.col("s") >= 3600, F.concat(F.expr("s div 3600").cast("string"), F.lit(":"), two(minute), F.lit(":"), two(second))).when(F.col("s") >= 60, F.concat(F.expr("s div 60").cast("string"), F.lit(":"), two(second))).otherwise(F.col("run_name"))
    c = t.step_log.select("run_name", s.alias("s")).distinct().select(clock.alias("text")).where("text is not null").distinct()
    return c.select("text", P.duration_seconds("text").alias("seconds"))


@query("SELECT step, rank, (step + 7) // 8 * 8 AS aligned, (decoder_tokens + 5) // 6 AS each, (decoder_tokens + 5) // 6 * 6 - decoder_tokens AS empty FROM (SELECT DISTINCT step, rank, decoder_tokens FROM step_log WHERE decoder_tokens IS NOT NULL)")
def align_up(t: Tables) -> DataFrame:
    """Numbers made whole multiples, and elements shared out evenly among six ranks."""
    d = t.step_log.where("decoder_tokens is not null").select("step", "rank", "decoder_tokens").distinct()
    full = P.align_up(F.col("decoder_tokens"), 6)
    return d.select("step", "rank", P.align_up(F.col("step"), 8).alias("aligned"), F.expr("(decoder_tokens + 5) div 6").alias("each"), (full - F.col("decoder_tokens")).alias("empty"))


@query("SELECT stage, count(*) AS n_files, row_number() OVER (ORDER BY stage NULLS LAST) AS place FROM shard_files GROUP BY stage")
def sort_stages(t: Tables) -> DataFrame:
    """Stages in the order they are trained in; one row a stage."""
    from pyspark.sql import Window

    n = t.shard_files.groupBy("stage").agg(F.count("*").alias("n_files"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("stage"))).cast("bigint"))


@query("SELECT file_path, row_number() OVER (ORDER BY file_path) AS place FROM shard_files")
def sort_files(t: Tables) -> DataFrame:
    """Files in lexicographic order; one row a file."""
    from pyspark.sql import Window

    return t.shard_files.select("file_path", F.row_number().over(Window.orderBy("file_path")).cast("bigint").alias("place"))


@query("SELECT category AS task, n, row_number() OVER (ORDER BY n DESC, category) AS place FROM (SELECT category, count(*) AS n FROM benchmark_rows GROUP BY category) ORDER BY place LIMIT 5")
def sort_tasks(t: Tables) -> DataFrame:
    """The five tasks with the most items; one row a task is ranked."""
    from pyspark.sql import Window

    n = t.benchmark_rows.groupBy(F.col("category").alias("task")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "task")).cast("bigint")).where("place <= 5")


@query("SELECT file_path, regexp_extract(file_path, '_(\\d+)\\.', 1)::BIGINT AS number, row_number() OVER (ORDER BY regexp_replace(file_path, '\\d+', '', 'g'), list_transform(regexp_extract_all(file_path, '\\d+'), lambda x: x::BIGINT), file_path) AS place FROM shard_files")
def natural_sort(t: Tables) -> DataFrame:
    """Files in natural order: by their text, then by their numbers as numbers."""
    from pyspark.sql import Window

    w = Window.orderBy(*P.natural_key("file_path"))
    return t.shard_files.select("file_path", F.regexp_extract("file_path", r"_(\d+)\.", 1).cast("bigint").alias("number"), F.row_number().over(w).cast("bigint").alias("place"))


PARAMS = "CASE rank % 4 WHEN 0 THEN 'model.decoder.layer.' WHEN 1 THEN 'encoder.embed_model.layer.' WHEN 2 THEN 'adapter.fc.' ELSE 'head.' END || step || run_name"


@query(f"WITH {ONCE}, p AS (SELECT {PARAMS} AS name, decoder_tokens AS n FROM l) SELECT CASE WHEN name LIKE '%decoder%' THEN 'decoder' WHEN name LIKE '%encoder.embed_model%' THEN 'encoder' WHEN name LIKE '%adapter%' THEN 'adapter' WHEN name IS NOT NULL THEN 'decoder' END AS param_group, count(*) AS n_params, sum(n)::BIGINT AS n_elements FROM p GROUP BY 1")
def param_group_count(t: Tables) -> DataFrame:
    """Optimizer groups of a catalog of parameters, here made of the steps."""
    prefix = F.when(F.col("rank") % 4 == 0, "model.decoder.layer.").when(F.col("rank") % 4 == 1, "encoder.embed_model.layer.").when(F.col("rank") % 4 == 2, "adapter.fc.").otherwise("head.")
    return L.param_group_count(log(t).select(F.concat(prefix, F.col("step").cast("string"), "run_name").alias("name"), F.col("decoder_tokens").alias("n")))
