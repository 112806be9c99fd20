"""Packing, masks, windows and order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxspark.operators import order as O
from ctxspark.operators import packing as P
from ctxspark.operators import windows as W

ITEMS = "shard string, ord string, id bigint, n bigint"


def plain(rows, limit):
    out, shards = set(), {}
    for shard, ord_, i, n in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2])):
        if n > limit:
            continue
        fill, pack = shards.get(shard, (0, 0))
        if fill + n > limit:
            fill, pack = 0, pack + 1
        out.add((shard, i, n, pack, fill))
        shards[shard] = (fill + n, pack)
    return out


def test_golden(spark):
    rows = [("a", f"{i}", i, n) for i, n in enumerate([5, 6, 4, 20, 3, 7, 10])]
    items = spark.createDataFrame(rows, ITEMS)
    packed = P.pack_next_fit(items, 10)
    assert [(r.pack_id, r.pack_offset) for r in sorted(packed.collect(), key=lambda r: r.id)] == [(0, 0), (1, 0), (1, 6), (2, 0), (2, 3), (3, 0)]
    report = P.pack_report(items, packed, 10).collect()[0]
    assert (report.n_packs, report.n_skipped, report.fill_pct) == (4, 1, 87.5)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_of_a_hot_shard_agree(spark, seed):
    """One shard holds most items and spans many ranges; nulls, empty items, ties and oversized items occur."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 8 + ["b", "c", None]), f"{rng.randrange(300):04d}", i, rng.choice([0, 1, rng.randrange(100), rng.randrange(130)])) for i in range(3000)]
    items = spark.createDataFrame(rows, ITEMS).repartition(7)
    for span in (1, 3, 256):
        assert {tuple(r) for r in P.pack_next_fit(items, 100, span).collect()} == plain(rows, 100)


def test_transition_equals_placing():
    rng = np.random.default_rng(0)
    for _ in range(200):
        limit = int(rng.integers(5, 60))
        sizes = rng.integers(0, limit + 1, int(rng.integers(1, 40)))
        states = P.transition(sizes, limit)
        for fill in range(limit + 1):
            _, opened, after = next(s for s in reversed(states) if s[0] <= fill)
            packs, offsets = P.place(sizes, limit, fill)
            assert (opened, after + (0 if opened else fill)) == (packs[-1], offsets[-1] + sizes[-1])


def test_compose_equals_one_run():
    rng = np.random.default_rng(1)
    for _ in range(300):
        limit = int(rng.integers(5, 60))
        a, b, c = (rng.integers(0, limit + 1, int(rng.integers(1, 12))) for _ in range(3))
        states = P.compose(P.compose(P.transition(a, limit), P.transition(b, limit)), P.transition(c, limit))
        for fill in range(limit + 1):
            assert P.after(states, fill) == P.after(P.transition(np.concatenate([a, b, c]), limit), fill)


def test_empty(spark):
    items = spark.createDataFrame([], ITEMS)
    assert P.pack_next_fit(items).count() == 0


def test_masks(spark):
    packed = spark.createDataFrame([("a", 1, 130, 0, 0), ("a", 2, 126, 0, 130)], "shard string, id bigint, n bigint, pack_id bigint, pack_offset bigint")
    mask = P.block_mask(packed, 128, 256).collect()[0]
    assert mask.active_blocks == 3 and [tuple(b) for b in mask.blocks] == [(0, 0), (1, 0), (1, 1)]
    small = spark.createDataFrame([("a", 0, 3, 0, 0), ("a", 1, 2, 0, 3)], packed.schema)
    assert P.pack_lengths(small).select(P.doc_ids("lens", 8).alias("d")).collect()[0].d == [0, 0, 0, 1, 1, -1, -1, -1]
    with pytest.raises(Exception, match="more than 4 tokens"):
        spark.createDataFrame([([5],)], "lens array<bigint>").select(P.doc_ids("lens", 4)).collect()
    assert P.mask_pairs(small, 8).collect()[0].allowed == 9
    assert [(r.cu_start, r.cu_end, r.max_len) for r in P.cu_seqlens(small).orderBy("ord").collect()] == [(0, 3, 3), (3, 5, 3)]


def test_window_tiling(spark):
    seq = spark.createDataFrame([(1, 2500), (2, 0), (3, 1024)], "id bigint, n bigint")
    got = [tuple(r)[2:] for r in W.tile(seq).where("id = 1").orderBy("win").collect()]
    assert got == [(0, 1024, 64, 0, 256), (1024, 1024, 64, 256, 256), (2048, 452, 29, 256, 0)]
    assert {r.right for r in W.tile(seq, bidirectional=False).collect()} == {0}
    assert {r.id: r.n for r in W.tile(seq).groupBy("id").agg(F.sum("n_latent").alias("n")).collect()} == {1: 157, 3: 64}
    with pytest.raises(ValueError):
        W.tile(seq, window=1000)


def test_window_ids(spark):
    seq = spark.createDataFrame([(1, list(range(1, 26))), (2, []), (3, None), (4, [7])], "id bigint, ids array<bigint>")
    got = {(r.id, r.win): r for r in W.window_ids(seq, True, 10, 3, 5).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (4, 0)]
    assert got[1, 1].window_ids == list(range(8, 24)) + [0, 0] and (got[1, 1].pool_start, got[1, 1].pool_len, got[1, 1].markers) == (3, 10, [16, 17])
    assert got[1, 2].window_ids == list(range(18, 26)) + [0] and got[4, 0].window_ids == [7, 0] and got[4, 0].markers == [1]
    assert {r.win: len(r.window_ids) for r in W.window_ids(seq.where("id = 1"), False, 10, 3, 5, False).collect()} == {0: 10, 1: 13, 2: 8}
    batches = W.left_pad(W.window_ids(seq, False, 10, 3, 5), 3).orderBy("id", "win").collect()
    assert [r.batch for r in batches] == [0, 0, 0, 1] and [len(r.input_ids) for r in batches] == [16, 16, 16, 1]
    assert batches[2].attention_mask == [0] * 8 + [1] * 8 and batches[2].position_ids == [0] * 8 + list(range(8)) and batches[2].input_ids == [0] * 8 + list(range(18, 26))


def test_minibatches(spark):
    w = spark.createDataFrame([(0,)] * 5 + [(1,)] * 2, "rank bigint")
    assert {tuple(r) for r in W.minibatches(w, 2).collect()} == {(0, 5, 3, 0), (1, 2, 1, 2)}
    assert {tuple(r) for r in W.minibatches(w, 0).collect()} == {(0, 5, 1, 0), (1, 2, 1, 0)}
    assert W.minibatches(w.limit(0), 2).count() == 0


def test_one_dimensional(spark):
    from ctxspark.operators import sequences as Q

    flat = spark.createDataFrame([([1, 2],), ([],), (None,)], "x array<int>")
    assert [r.x for r in Q.one_dimensional(flat, "x").collect()] == [[1, 2], [], None] and Q.one_dimensional(flat, "x").schema["x"].dataType.elementType.simpleString() == "bigint"
    nested = spark.createDataFrame([([[1, 2], [3]],), ([],), (None,), ([None],)], "x array<array<int>>")
    assert [r.x for r in Q.one_dimensional(nested, "x").collect()] == [[1, 2], [], None, None]


def test_pooling(spark):
    h = spark.createDataFrame([(1, 0, [1.0, 1.0]), (1, 1, [3.0, 3.0]), (1, 2, [5.0, 5.0]), (2, 0, [2.0, 4.0])], "id bigint, pos bigint, vec array<float>")
    of = lambda df: {(r.id, r.grp): r.vec for r in df.collect()}
    assert of(W.pool_mean(h, ["id"], 2)) == {(1, 0): [2.0, 2.0], (1, 1): [5.0, 5.0], (2, 0): [2.0, 4.0]}
    assert of(W.pool_concat(h, ["id"], 2)) == {(1, 0): [1.0, 1.0, 3.0, 3.0], (1, 1): [5.0, 5.0, 0.0, 0.0], (2, 0): [2.0, 4.0, 0.0, 0.0]}
    assert of(W.pool_eos(h, spark.createDataFrame([(1, [1, 2])], "id bigint, markers array<bigint>"), ["id"])) == {(1, 0): [3.0, 3.0], (1, 1): [5.0, 5.0]}
    samples = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    back = {r.id: r.latents for r in W.regroup(samples, W.pool_mean(h, ["id"], 2).withColumn("win", F.lit(0)), 2).collect()}
    assert back == {1: [[2.0, 2.0], [5.0, 5.0]], 2: [[2.0, 4.0]], 3: [[0.0, 0.0]]}
    seg = spark.createDataFrame([("a", 1, [[1.0], [2.0]]), ("a", 2, [[3.0]]), (None, 3, [[4.0]])], "b string, id bigint, latents array<array<double>>")
    assert {(r.b, r.id, r.slot): (r.vec, r["mask"]) for r in W.segment_pad(seg, "b", 1).collect()} == {("a", 1, 0): ([1.0], 1), ("a", 1, 1): ([2.0], 1), ("a", 2, 0): ([3.0], 1), ("a", 2, 1): ([0.0], 0), (None, 3, 0): ([4.0], 1)}
    assert W.pool_mean(h.limit(0), ["id"], 2).count() == 0


def test_splice(spark):
    embeds = spark.createDataFrame([(1, i, [float(i)]) for i in range(5)], "id bigint, pos bigint, vec array<double>")
    spans = spark.createDataFrame([(1, 0, 1, 3)], "id bigint, region bigint, start bigint, end bigint")
    two = spark.createDataFrame([(1, 0, 0, [10.0]), (1, 0, 1, [11.0])], "id bigint, region bigint, slot bigint, vec array<double>")
    of = lambda df: [r.vec[0] for r in df.orderBy("pos").collect()]
    assert of(W.splice(embeds, spans, two)) == [0.0, 10.0, 11.0, 3.0, 4.0]
    for wrong in (two.limit(1), two.unionByName(two.where("slot = 1").withColumn("slot", F.lit(2).cast("bigint")))):
        with pytest.raises(Exception, match="as many latents"):
            W.splice(embeds, spans, wrong).collect()
    assert of(W.splice(embeds, spans, two.where("slot = 0"), strict=False)) == [0.0, 10.0, 2.0, 3.0, 4.0]
    assert of(W.splice(embeds, spans.withColumn("end", F.lit(2).cast("bigint")), two, strict=False)) == [0.0, 10.0, 2.0, 3.0, 4.0]


def test_order(spark):
    files = spark.createDataFrame([(f"f{i}",) for i in range(7)], "file_path string")
    rows = spark.createDataFrame([(i, f"f{i % 7}", i // 7) for i in range(70)] + [(99, None, 0)], "row_id bigint, file_path string, row_idx bigint")
    plan = O.scan_plan(rows, files, ranks=3)
    all_rows = plan.collect()
    assert len({r.file_path for r in all_rows}) == 6 and len(all_rows) == 60
    counts = {}
    for r in all_rows:
        counts.setdefault(r["rank"], set()).add(r.file_path)
    assert sorted(map(len, counts.values())) == [2, 2, 2]
    order = sorted((r.file_ord, r.row_ord, r.row_id) for r in all_rows)
    rest = sorted((r.file_ord, r.row_ord, r.row_id) for r in O.resume(plan, 2, 4).collect())
    assert rest == [x for x in order if x[:2] > (2, 4)]
    a, b = (O.row_order(rows, epoch=e).orderBy("row_id").collect() for e in (0, 1))
    assert [r.row_ord for r in a] != [r.row_ord for r in b]
