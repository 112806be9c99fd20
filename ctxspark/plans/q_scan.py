"""Queries on scans, order, shards, batches and sinks."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark import constants as C
from ctxspark.operators import order as O
from ctxspark.operators import rows as R
from ctxspark.plans.registry import Tables, query
from ctxspark.sources import files as S

FILES = "f AS (SELECT file_path, row_number() OVER (ORDER BY md5('42-' || file_path), file_path) - 1 AS file_ord FROM (SELECT DISTINCT file_path FROM shard_files WHERE file_path IS NOT NULL))"
KEPT = FILES + ", kept AS (SELECT *, (file_ord % 6)::BIGINT AS rank FROM f WHERE file_ord < (SELECT count(*) - count(*) % 6 FROM f))"
ONCE = "r AS (SELECT row_id, any_value(file_path) AS file_path, any_value(row_idx) AS row_idx FROM raw_rows GROUP BY row_id)"


def ord_sql(epoch: int = 0) -> str:
    return f"o{epoch} AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY md5('42-{epoch}-' || file_path || '-' || row_idx), row_idx, row_id) - 1 AS row_ord FROM r WHERE file_path IS NOT NULL)"


PLAN = f"{KEPT}, {ONCE}, {ord_sql()}, plan AS (SELECT row_id, file_path, rank, file_ord, row_ord FROM o0 JOIN kept USING (file_path))"


def rows_once(t: Tables) -> DataFrame:
    return R.once(t.raw_rows, "row_id", "file_path", "row_idx")


def plan(t: Tables) -> DataFrame:
    return O.scan_plan(rows_once(t), t.shard_files)


@query("SELECT row_id, file_path, row_idx, len(prompt)::BIGINT AS n_messages, length(target)::BIGINT AS target_chars FROM raw_rows")
def scan_parquet(t: Tables) -> DataFrame:
    n = F.when(F.col("prompt").isNotNull(), F.size("prompt").cast("bigint"))
    return t.raw_rows.select("row_id", "file_path", "row_idx", n.alias("n_messages"), F.length("target").cast("bigint").alias("target_chars"))


@query("SELECT pack_id, count(*) AS n_examples, sum(len(base_input_ids))::BIGINT AS n_ids FROM (SELECT example_id, any_value(pack_id) AS pack_id, any_value(base_input_ids) AS base_input_ids FROM base_examples GROUP BY example_id) GROUP BY pack_id")
def scan_packed(t: Tables) -> DataFrame:
    n = F.when(F.col("base_input_ids").isNotNull(), F.size("base_input_ids")).alias("n")
    return t.base_examples.select("example_id", "pack_id", n).distinct().groupBy("pack_id").agg(F.count("*").alias("n_examples"), F.sum("n").alias("n_ids"))


@query("SELECT 'raw_rows' AS tbl, count(*) AS n FROM raw_rows UNION ALL SELECT 'base_examples', count(*) FROM base_examples UNION ALL SELECT 'documents', count(*) FROM documents")
def row_count_meta(t: Tables) -> DataFrame:
    return S.row_counts(t.spark, {n: f"{t.path}/{n}.parquet" for n in ("raw_rows", "base_examples", "documents")})


@query("SELECT category, count(*) AS n FROM benchmark_rows WHERE category LIKE 'memwrap/ruler/%' GROUP BY category")
def category_filter(t: Tables) -> DataFrame:
    return t.benchmark_rows.where(F.col("category").startswith("memwrap/ruler/")).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT regexp_extract(category, '_(\\d+)$', 1) AS ctx, regexp_extract(category, '^memwrap/ruler/(.*)_\\d+$', 1) AS subtask, item_id FROM benchmark_rows WHERE regexp_matches(category, '^memwrap/ruler/.*_\\d+$')")
def scan_hf_split(t: Tables) -> DataFrame:
    return S.benchmark_split(t.benchmark_rows)


NESTED = "extra_info.ground_truth.answers"


@query(f"SELECT item_id, array_to_string(list_transform(CASE WHEN len({NESTED}) > 0 THEN {NESTED} WHEN item_id % 3 = 0 AND category <> '' THEN [category] WHEN item_id % 2 = 0 THEN ['a', NULL] ELSE [] END, lambda x: coalesce(x, '')), '|') AS answers FROM benchmark_rows")
def answers_coalesce(t: Tables) -> DataFrame:
    """Answers at their nested place, else a single one (here, of some items, the category), else a list."""
    single = F.when(F.col("item_id") % 3 == 0, F.col("category"))
    several = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("a"), F.lit(None).cast("string")))
    a = S.answers_of(F.col(NESTED), several, single)
    return t.benchmark_rows.select("item_id", F.array_join(F.transform(a, lambda x: F.coalesce(x, F.lit(""))), "|").alias("answers"))


@query(f"WITH {FILES} SELECT * FROM f")
def file_shuffle(t: Tables) -> DataFrame:
    return O.file_shuffle(t.shard_files)


@query(f"WITH {FILES} SELECT * FROM f WHERE file_ord < (SELECT count(*) - count(*) % 6 FROM f)")
def drop_last_files(t: Tables) -> DataFrame:
    return O.drop_last_files(O.file_shuffle(t.shard_files), C.RANKS)


@query(f"WITH {KEPT} SELECT file_path, file_ord, rank FROM kept")
def shard_round_robin(t: Tables) -> DataFrame:
    return O.shard_round_robin(O.drop_last_files(O.file_shuffle(t.shard_files), C.RANKS), C.RANKS)


@query(f"WITH {ONCE}, {ord_sql()} SELECT row_id, file_path, row_ord FROM o0")
def row_shuffle(t: Tables) -> DataFrame:
    return O.row_order(rows_once(t)).select("row_id", "file_path", "row_ord")


@query(f"WITH {ONCE}, {ord_sql(0)}, {ord_sql(1)} SELECT o0.row_id, o0.row_ord AS epoch_0, o1.row_ord AS epoch_1 FROM o0 JOIN o1 USING (row_id)")
def epoch_advance(t: Tables) -> DataFrame:
    rows = rows_once(t)
    one = O.row_order(rows, epoch=0).select("row_id", F.col("row_ord").alias("epoch_0"))
    return one.join(O.row_order(rows, epoch=1).select("row_id", F.col("row_ord").alias("epoch_1")), "row_id")


@query(f"WITH {PLAN} SELECT rank, row_id, file_ord, row_ord FROM plan WHERE file_ord > 20 OR (file_ord = 20 AND row_ord > 5)")
def cursor_resume(t: Tables) -> DataFrame:
    return O.scan_plan(rows_once(t), t.shard_files, after=(20, 5)).select("rank", "row_id", "file_ord", "row_ord")


@query(f"WITH {PLAN} SELECT rank, file_ord, row_ord // 8 AS batch, count(*) AS n, min(row_id) AS first_id FROM plan GROUP BY ALL")
def batch_rows(t: Tables) -> DataFrame:
    return O.batches(plan(t), 8).groupBy("rank", "file_ord", "batch").agg(F.count("*").alias("n"), F.min("row_id").alias("first_id"))


FINGERPRINT = "md5('{0}' || chr(10) || string_agg(file_path, chr(10) ORDER BY file_path))"


@query(f"WITH {FILES}, u AS (SELECT DISTINCT file_path FROM shard_files), p AS (SELECT {FINGERPRINT.format('42-6')} AS old, {FINGERPRINT.format('42-8')} AS new, count(*) AS n FROM u) SELECT 'fingerprint' AS what, old AS saved, new AS now FROM p UNION ALL SELECT 'current file', (SELECT file_path FROM f WHERE file_ord = 3), (SELECT file_path FROM f WHERE file_ord = 4)")
def fingerprint_check(t: Tables) -> DataFrame:
    """What has changed since a state was saved: here the number of ranks, and the file at the cursor."""
    ordered = O.file_shuffle(t.shard_files)
    current = ordered.where("file_ord = 3").select(F.col("file_path").alias("current_file"), F.lit(4).cast("bigint").alias("file_ord"))
    saved = O.fingerprint(t.shard_files, C.SEED, 6).crossJoin(current)  # one row each
    return O.resume_warnings(saved, t.shard_files, C.SEED, 8)


@query("SELECT item_id, category FROM benchmark_rows ORDER BY item_id LIMIT 50")
def sample_limit(t: Tables) -> DataFrame:
    return t.benchmark_rows.select("item_id", "category").orderBy("item_id").limit(50)


@query(f"WITH {FILES}, {ONCE} SELECT s.file_path, stage, corpus, file_ord, (SELECT count(*) FROM r WHERE r.file_path = s.file_path) AS n_rows FROM shard_files s JOIN f USING (file_path)")
def join_lookup(t: Tables) -> DataFrame:
    """Files with their order and number of rows; files without rows stay."""
    n = rows_once(t).groupBy("file_path").agg(F.count("*").alias("n_rows"))
    return t.shard_files.join(O.file_shuffle(t.shard_files), "file_path").join(n, "file_path", "left").select("file_path", "stage", "corpus", "file_ord", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query("SELECT a.ctx, b.subtask FROM (SELECT DISTINCT regexp_extract(category, '_(\\d+)$', 1) AS ctx FROM benchmark_rows WHERE regexp_matches(category, '^memwrap/ruler/.*_\\d+$')) a, (SELECT DISTINCT regexp_extract(category, '^memwrap/ruler/(.*)_\\d+$', 1) AS subtask FROM benchmark_rows WHERE regexp_matches(category, '^memwrap/ruler/.*_\\d+$')) b")
def cross_jobs(t: Tables) -> DataFrame:
    """The grid of jobs: every context length with every subtask, a few of each."""
    split = S.benchmark_split(t.benchmark_rows)
    grid = split.agg(F.array_sort(F.collect_set("ctx")).alias("c"), F.array_sort(F.collect_set("subtask")).alias("s"))
    return grid.select(F.explode("c").alias("ctx"), "s").select("ctx", F.explode("s").alias("subtask"))


@query("SELECT item_id, prompt, category FROM benchmark_rows")
def scan_jsonl(t: Tables) -> DataFrame:
    """Written as JSON lines and read again: the prompt and, by name, the metadata."""
    path = S.scratch(t.spark, "jsonl")
    S.write_jsonl(t.benchmark_rows.select("item_id", "prompt", "category"), path)
    return S.read_jsonl(t.spark, path).select(F.expr("cast(variant_get(meta, '$.item_id', 'bigint') as bigint)").alias("item_id"), "prompt", F.expr("variant_get(meta, '$.category', 'string')").alias("category"))


@query("SELECT completion_id, item_id, run_name, response FROM completions")
def sink_jsonl(t: Tables) -> DataFrame:
    path = S.scratch(t.spark, "jsonl")
    S.write_jsonl(t.completions.select("completion_id", "item_id", "run_name", "response"), path)
    return t.spark.read.schema("completion_id bigint, item_id bigint, run_name string, response string").json(path)


@query("SELECT coalesce(run_name, '__HIVE_DEFAULT_PARTITION__') AS run, count(*) AS n FROM completions GROUP BY 1")
def sink_partitioned(t: Tables) -> DataFrame:
    path = S.scratch(t.spark, "partitioned")
    S.write_partitioned(t.completions.select("completion_id", "item_id", "response", F.coalesce("run_name", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("run")), path, "run")
    return t.spark.read.schema("completion_id bigint, item_id bigint, response string, run string").json(path).groupBy("run").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT item_id, run_name FROM completions")
def sink_append_resume(t: Tables) -> DataFrame:
    """Runs of an append: the first stops halfway, the second adds what is missing, a third nothing, and a fourth finds the summary of the finished task."""
    done = t.completions.select("item_id", "run_name")
    path, summary = S.scratch(t.spark, "append"), S.scratch(t.spark, "summary")
    keys = ["item_id", "run_name"]
    S.append_missing(done.where("item_id % 2 = 0"), path, keys, summary)
    for _ in range(2):
        S.append_missing(done, path, keys, summary)
    S.write_summary(done.select(F.col("run_name").alias("task"), F.lit(1.0).alias("score")), summary)
    S.append_missing(done.withColumn("item_id", F.lit(-1).cast("bigint")), path, keys, summary)
    return t.spark.read.schema("item_id bigint, run_name string").parquet(path)


@query("SELECT vec_id, len(embedding)::BIGINT AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def sink_blob(t: Tables) -> DataFrame:
    """Vectors with their metadata keyed by id, written and read again."""
    path = S.scratch(t.spark, "blob")
    t.embeddings.select("vec_id", "embedding", F.to_json(F.struct("label")).alias("meta")).write.parquet(path)
    v = t.spark.read.schema("vec_id bigint, embedding array<float>, meta string").parquet(path)
    return v.select("vec_id", F.size("embedding").cast("bigint").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("WITH c AS (SELECT DISTINCT completion_id, run_name, response FROM completions), k AS (SELECT run_name AS task, count(*) AS n, avg(length(coalesce(response, ''))) AS mean FROM c GROUP BY run_name) SELECT task, n, round(mean, 4) AS mean, false AS is_overall FROM k UNION ALL SELECT NULL, sum(n)::BIGINT, round(avg(mean), 4), true FROM k")
def sink_summary(t: Tables) -> DataFrame:
    """A JSON summary of the runs, here of their responses' lengths, and of all of them."""
    path = S.scratch(t.spark, "summary")
    S.write_summary(t.completions.select("completion_id", F.col("run_name").alias("task"), F.length(F.coalesce("response", F.lit(""))).cast("double").alias("score"), "response").distinct(), path)
    return t.spark.read.schema("task string, n bigint, mean double, is_overall boolean").json(path).withColumn("mean", F.round("mean", 4))


@query(f"WITH {KEPT} SELECT rank, count(*) AS n_files, max(file_ord) AS last_file FROM kept GROUP BY rank")
def sink_ckpt_meta(t: Tables) -> DataFrame:
    """The state to keep beside a checkpoint, one row a rank, written as JSON and read again."""
    state = O.shard_round_robin(O.drop_last_files(O.file_shuffle(t.shard_files), C.RANKS), C.RANKS).groupBy("rank").agg(F.count("*").alias("n_files"), F.max("file_ord").alias("last_file"))
    path = S.scratch(t.spark, "state")
    S.write_jsonl(state, path)
    return t.spark.read.schema("rank bigint, n_files bigint, last_file bigint").json(path)


@query("SELECT item_id, category, length(prompt)::BIGINT AS prompt_chars FROM benchmark_rows")
def meta_passthrough(t: Tables) -> DataFrame:
    """All keys but the prompt travel along as one map."""
    meta = S.meta_map(t.benchmark_rows.select("item_id", "prompt", "category"), "prompt")
    return meta.select(F.col("meta")["item_id"].cast("bigint").alias("item_id"), F.col("meta")["category"].alias("category"), F.length("prompt").cast("bigint").alias("prompt_chars"))


