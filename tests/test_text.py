"""Golden cases of tokens, regions and sequences."""

import pytest
from pyspark.sql import functions as F

from ctxspark.functions import text as T
from ctxspark.operators import examples as E
from ctxspark.operators import rows as R
from ctxspark.operators import sequences as Q

S, END, M = "<|memory_start|>", "<|memory_end|>", "<|memory|>"


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).collect()[0]["y"]


def test_latent_count(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 16, 17, 32)], "n bigint").select(T.latent_count(F.col("n")).alias("a"), T.latent_count(F.col("n"), min_one=False).alias("b"), T.latent_count(F.col("n"), 3).alias("c")).collect()
    assert [(r.a, r.b, r.c) for r in got] == [(1, 0, 1), (1, 1, 1), (1, 1, 6), (2, 2, 6), (2, 2, 11)]


def test_extract_regions(spark):
    text = f"a{S}x\ny{END}b{S}{END}c"
    assert one(spark, text, T.regions("x")) == ["x\ny", ""]
    assert one(spark, text, T.outside("x")) == "abc"
    assert one(spark, f"{S} a {S} b {END} c {END}", T.regions("x")) == [f" a {S} b "]
    assert one(spark, f"a{S}b", T.regions("x")) == []
    assert one(spark, None, T.regions("x")) is None


def test_expand_and_spans(spark):
    text = f"p q {S}{' w' * 17}{END} r {S}{END}"
    assert one(spark, text, T.expand_placeholders("x")) == f"p q {S}{M * 2}{END} r {S}{M}{END}"
    assert [tuple(s) for s in one(spark, text, T.region_spans("x"))] == [(3, 5), (8, 9)]
    assert one(spark, "no region", T.region_spans("x")) == []
    assert one(spark, "", T.expand_placeholders("x")) == ""


def test_expand_base_example(spark):
    ids = [1, 2, 50257, 50258, 50259, 3, 4, 50257, 50258, 50259, 5]
    schema = "example_id bigint, pack_id bigint, shard int, base_input_ids array<bigint>, base_labels array<bigint>, memory_strings array<string>, memory_positions array<int>"
    words = lambda n: " ".join(["w"] * n)
    rows = [
        (1, 1, 0, ids, ids, [words(160), words(80)], [2, 7]), (2, 1, 0, ids, None, [words(80), words(160)], [7, 2]), (3, 1, 0, ids, ids, ["a"], [2, 7]),
        (4, 1, 0, ids, ids, ["a", "b"], [2, 9]), (5, 1, 0, [], [], None, None), (6, 1, 0, ids, ids, [None, "b"], [2, 7]), (7, 1, 0, ids, ids, ["a", "b"], [2, None]),
    ]
    got = {r.example_id: r for r in E.expand(spark.createDataFrame(rows, schema)).collect()}
    assert sorted(got) == [1, 2, 5, 6]
    assert got[1].seq_len == 24 and [tuple(s) for s in got[1].spans] == [(3, 13), (17, 22)]
    assert got[1].labels == [1, 2] + [-100] * 12 + [3, 4] + [-100] * 7 + [5]
    assert [tuple(s) for s in got[2].spans] == [(17, 22), (3, 13)] and set(got[2].labels) == {-100}
    assert got[5].seq_len == 0 and got[6].seq_len == 11


def test_expansion_cuts_at_any_place(spark):
    """Regions at the beginning, the end and beside one another, listed in any order."""
    r = [50257, 50258, 50259]
    ids = r + r + [7] + r
    schema = "example_id bigint, pack_id bigint, shard int, base_input_ids array<bigint>, base_labels array<bigint>, memory_strings array<string>, memory_positions array<int>"
    e = E.expand(spark.createDataFrame([(1, 1, 0, ids, [9] * 10, ["w " * 33, "", "w " * 17], [7, 0, 3])], schema)).collect()[0]
    assert e.input_ids == r + [50257, 50258, 50258, 50259] + [7] + [50257] + [50258] * 3 + [50259]
    assert e.labels == [-100] * 7 + [9] + [-100] * 5
    assert [tuple(s) for s in e.spans] == [(9, 12), (1, 2), (4, 6)]
    assert all(set(e.input_ids[s:t]) == {50258} and t - s == k for (s, t), k in zip(e.spans, e.latent_counts))


def test_sequences(spark):
    schema = "row_id bigint, prompt array<struct<role:string,content:string>>, target string"
    rows = [(1, None, None), (2, [], "x"), (3, [("user", None), (None, "b")], ""), (4, [("user", f"a {S}b{END} c")], "NA_string_only"), (5, None, "NA_string_only"), (6, [("user", f"q {S}{'w ' * 20}{END}")], "yes no")]
    df = spark.createDataFrame(rows, schema).withColumn("labels", F.lit("x")).withColumn("spans", F.lit(1))
    got = {r.row_id: r for r in Q.preprocess(df).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    for r in got.values():
        assert r.seq_len == len(r.input_ids) == len(r.labels) and 0 not in r.input_ids
        assert all(lab in (-100, i) for lab, i in zip(r.labels, r.input_ids))
        for (s, e), k, m in zip(r.spans, r.latent_counts, r.memory_ids):
            assert e - s == k == max(1, -(-len(m) // 16)) and set(r.input_ids[s:e]) == {50258} and (r.input_ids[s - 1], r.input_ids[e]) == (50257, 50259)
            assert set(r.labels[s - 1 : e + 1]) == {-100}
    assert [x == -100 for x in got[4].labels] == [False, True, True, True, False] and got[5].input_ids == []
    assert len(got[6].spans) == 1 and got[6].latent_counts == [2] and [x for x in got[6].labels if x != -100] == got[6].labels[-3:]
    plain = {r.row_id: r for r in Q.teacher(df).collect()}
    assert sorted(plain) == [1, 2, 3, 6] and plain[2].input_ids == got[2].input_ids and len(plain[6].input_ids) == got[6].seq_len + 18
    lengths = {r.row_id: r for r in R.lengths(df).collect()}
    assert {i: (r.seq_len, r.n_masked) for i, r in lengths.items()} == {i: (r.seq_len, r.labels.count(-100)) for i, r in got.items()}
    assert {r.row_id: r.total for r in R.stats_pre(df).collect()}[4] == 3
    assert Q.preprocess(df.limit(0)).count() == 0


def test_templates(spark):
    df = spark.createDataFrame([(1, [("user", "a"), ("user", None), ("x", "b")], "t"), (2, None, None)], "row_id bigint, prompt array<struct<role:string,content:string>>, target string")
    assert [(r.prompt_text, r.target_text) for r in Q.chat_texts(df, None).orderBy("row_id").collect()] == [("a\n\nb\n", "t"), ("", "")]
    with pytest.raises(Exception, match="no beginning"):
        Q.chat_texts(df, lambda m, prefix: F.lit("x") if prefix else F.lit("y")).collect()


@pytest.mark.parametrize("ids,counts,spans", [
    ([1, 50257, 50258, 50258, 50259, 2], [2], [(2, 4)]), ([50257, 50259, 50257, 50258, 50259], [0, 1], [(1, 1), (3, 4)]), ([1, 2], [3], []), ([50257, 50258, 50259, 50257, 50258, 50259], [1], [(1, 2)]),
    ([50257, 50258], [1], None), ([50257, 50258, 50258, 50259], [1], None), ([50257, 7, 50259], [1], None),
])
def test_find_regions(spark, ids, counts, spans):
    df = spark.createDataFrame([(ids, counts)], "ids array<bigint>, counts array<bigint>").select(Q.find_regions(F.col("ids"), F.col("counts")).alias("s"))
    if spans is None:
        with pytest.raises(Exception, match="placeholders and an end marker"):
            df.collect()
    else:
        assert [tuple(x) for x in df.collect()[0].s] == spans


@pytest.mark.parametrize("ids,counts,spans", [
    ([1, 50258, 50258, 2, 50258], [2, 1], [(1, 3), (4, 5)]), ([50258] * 5, [2, 3], [(0, 2), (2, 5)]), ([50258] * 5, [2], [(0, 2)]), ([1, 2], [2], []), ([], [1], []), ([1, 50258, 50258, 2, 50258], [1, 2], None), ([50258], [2], None),
])
def test_find_unwrapped(spark, ids, counts, spans):
    df = spark.createDataFrame([(ids, counts)], "ids array<bigint>, counts array<bigint>").select(Q.find_unwrapped(F.col("ids"), F.col("counts")).alias("s"))
    if spans is None:
        with pytest.raises(Exception, match="shorter than expected"):
            df.collect()
    else:
        assert [tuple(x) for x in df.collect()[0].s] == spans


def test_collate(spark):
    schema = "pack_id bigint, ord int, input_ids array<bigint>, labels array<bigint>, spans array<struct<start:bigint,end:bigint>>, latent_counts array<bigint>, memory_ids array<array<bigint>>"
    rows = [(1, 1, [4, 5], [4, 5], [(1, 2)], [1], [[8]]), (1, 0, [1, 2, 3], None, [(0, 1)], [1], [[9, 9]]), (2, 0, [6], None, [], [], [])]
    df = spark.createDataFrame(rows, schema)
    packs = Q.collate(df, ["pack_id"], ["ord"])
    a, b = packs.orderBy("pack_id").collect()
    assert (a.input_ids, a.labels, a.sample_lens, a.latent_counts, a.memory_ids) == ([1, 2, 3, 4, 5], [-100, -100, -100, 4, 5], [3, 2], [1, 1], [[9, 9], [8]])
    assert [tuple(s) for s in a.spans] == [(0, 1), (4, 5)] and (b.input_ids, b.labels) == ([6], None)
    assert [(len(r.input_ids), r.labels and len(r.labels)) for r in Q.pad_to(packs, 4).orderBy("pack_id").collect()] == [(5, 5), (4, None)]
    batch = Q.collate_batches(packs, [], "pack_id", 4, 0).orderBy("pack_id").collect()
    assert [r.input_ids for r in batch] == [[1, 2, 3, 4, 5], [6, 0, 0, 0, 0]] and batch[1].attention_mask == [1, 0, 0, 0, 0] and batch[1].labels is None
    with pytest.raises(ValueError):
        Q.collate_batches(packs, [], "pack_id", 0)
    assert Q.collate(df.limit(0), ["pack_id"], ["ord"]).count() == 0
