"""Written stages and exchange sizes."""

import time

from pyspark.sql import functions as F

from ctxspark.plans import stage


def test_written_and_cleaned(spark):
    df = stage.written(spark.range(5).toDF("x"), "test")
    assert sorted(r.x for r in df.collect()) == list(range(5))
    assert stage.cleanup(spark) >= 1 and stage.cleanup(spark) == 0


def test_exchange_parts(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert stage.exchange_parts(spark.createDataFrame([(1,)], "x int")) == least
    assert stage.exchange_parts(spark.range(10)) == least


def test_sizes_of_joins_and_unknown_inputs(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(20000).toDF("x").write.parquet(path)
    t = spark.read.parquet(path)
    joined = t.alias("a").join(t.alias("b"), "x").join(t.alias("c"), "x").join(t.alias("d"), "x")
    assert 0 < stage.planned_bytes(joined) <= 4 * stage.planned_bytes(t)
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1,)] * 40, 40), "x int")
    assert stage.exchange_parts(unknown) == max(40, int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_running_sums_of_a_hot_group(spark):
    import random

    from pyspark.sql import functions as F

    from ctxspark.plans.prefix import running

    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + ["b", None]), i, rng.choice([None, 1, 2, 5])) for i in range(2000)]
    rng.shuffle(rows)
    got = {r.i: (r.n, r.s) for r in running(spark.createDataFrame(rows, "k string, i bigint, v bigint"), ["k"], ["i"], {"n": F.lit(1), "s": F.col("v")}).collect()}
    want, state = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        n, s = state.get(k, (0, 0))
        state[k] = want[i] = (n + 1, s + (v or 0))
    assert got == want


def test_shuffle_files_go_with_the_stage(spark, tmp_path):
    """The files of a written stage's exchanges are gone when it is written, without a collection of the driver's garbage."""
    sc = spark.sparkContext._jsc.sc()
    blocks = lambda: sum(1 for x in (sc.env().blockManager().diskBlockManager().getAllFiles(),) for i in range(x.size()) if "shuffle_" in x.apply(i).getName())
    before = blocks()
    out = stage.written(spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).count(), "freed")
    for _ in range(50):
        if blocks() <= before:
            break
        time.sleep(0.1)
    assert blocks() <= before and out.count() == 100
