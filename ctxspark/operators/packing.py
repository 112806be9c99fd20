"""Packing of sequences, offsets, padding and document masks."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxspark import constants as C
from ctxspark.plans.stage import range_parts, written


def transition(sizes: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """What a run of items does to an open pack: (least fill, packs opened, fill after) by ranges of the fill before.

    All fills are followed at once; they soon coincide, since a new pack opened at the same item is the same from there on.
    """
    total, states = 0, []  # states: [least fill before, packs opened, fill], those that have opened a pack
    open_to = limit + 1  # fills below have opened none: theirs is the fill before plus the total
    for n in sizes.tolist():
        for s in states:
            if s[2] + n > limit:
                s[1], s[2] = s[1] + 1, n
            else:
                s[2] += n
        total += n
        least = max(0, limit - total + 1)
        if least < open_to:
            states.insert(0, [least, 1, n])
            open_to = least
        states = [s for i, s in enumerate(states) if not i or s[1:] != states[i - 1][1:]]
    return [*([(0, 0, total)] if open_to else []), *map(tuple, states)]


State = list[tuple[int, int, int]]


def after(states: State, fill: int) -> tuple[int, int]:
    """Packs opened and the fill behind a run that begins at ``fill``."""
    least, opened, end = states[bisect_right(states, fill, key=lambda s: s[0]) - 1]
    return opened, end + (0 if opened else fill)


def compose(first: State, second: State) -> State:
    """What two runs do one after the other, as one description."""
    out = []
    for i, (least, opened, end) in enumerate(first):
        if opened:
            more, fill = after(second, end)
            out.append((least, opened + more, fill))
            continue
        # no pack was opened: the second run begins at the fill before plus this total
        top = first[i + 1][0] if i + 1 < len(first) else None
        for threshold, more, fill in second:
            at = max(least, threshold - end)
            if top is None or at < top:
                if out and out[-1][0] == at:
                    out.pop()
                out.append((at, more, fill + (0 if more else end)))
    return [s for i, s in enumerate(out) if not i or s[1:] != out[i - 1][1:]]


def place(sizes: np.ndarray, limit: int, fill: int = 0, pack: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pack and offset of each item of next-fit: an item that doesn't fit into the open pack opens the next."""
    packs, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, n in enumerate(sizes.tolist()):
        if fill + n > limit:
            fill, pack = 0, pack + 1
        packs[i], offsets[i] = pack, fill
        fill += n
    return packs, offsets


def _segments(table: pa.Table) -> list[tuple[str, int, int]]:
    shards = table["shard"].to_pylist()
    cuts = [0, *(i for i in range(1, len(shards)) if shards[i] != shards[i - 1]), len(shards)]
    return [(shards[s], s, e) for s, e in zip(cuts, cuts[1:])]


_DESCRIBED = "block int, shard string, least array<bigint>, opened array<bigint>, fill array<bigint>"
_EDGES = pa.schema([("block", pa.int32()), ("shard", pa.string()), *((c, pa.list_(pa.int64())) for c in ("least", "opened", "fill"))])


def _edges(rows: list[tuple[int, str, State]]) -> pa.Table:
    return pa.table({"block": [b for b, _, _ in rows], "shard": [n for _, n, _ in rows], **{c: [[x[i] for x in s] for _, _, s in rows] for i, c in enumerate(("least", "opened", "fill"))}}, schema=_EDGES)


def _states(table: pa.Table) -> list[tuple[int, str, State]]:
    rows = sorted(table.to_pylist(), key=lambda r: (r["block"], r["shard"]))
    return [(r["block"], r["shard"], list(zip(r["least"], r["opened"], r["fill"]))) for r in rows]


def _joined(rows: list[tuple[int, str, State]], number: int) -> list[tuple[int, str, State]]:
    """Consecutive runs of one shard as one; the first and the last of these, which may go on in what is before and behind."""
    out: list[tuple[int, str, State]] = []
    for _, name, states in rows:
        if out and out[-1][1] == name:
            out[-1] = (number, name, compose(out[-1][2], states))
        else:
            out.append((number, name, states))
    return out if len(out) < 3 else [out[0], out[-1]]


def _starts(rows: list[tuple[int, str, State]], known: dict[tuple[int, str], tuple[int, int]], number: int | None = None) -> list[tuple[int, str, int, int]]:
    """(block, shard, fill, pack) at which each run begins; ``known`` has those of runs that go on from before, as runs of ``number``."""
    out, fill, pack, last = [], 0, 0, None
    for block, name, states in rows:
        if name != last:
            fill, pack = known.get((number, name), (0, 0)) if last is None else (0, 0)
            last = name
        out.append((block, name, fill, pack))
        more, fill = after(states, fill)
        pack += more
    return out


def pack_next_fit(items: DataFrame, limit: int = C.PACK, span: int = 256) -> DataFrame:
    """(shard, id, n, pack_id, pack_offset): next-fit packing of each shard's items in the order of ``ord``.

    ``items`` has (shard string, ord string, id bigint, n); a null shard is one shard, ties of ``ord`` go by id, and items over ``limit``
    are left out. Next-fit is sequential, yet a shard is not one task: items are cut into ranges of (shard, ord); each range tells
    what it does to any open pack. These short descriptions are composed by ``span`` ranges a task; the driver composes what comes of that, two rows
    for each ``span`` ranges, then the same tasks tell each range where it begins, and every range is packed on its own.
    """
    # sizes are dear to compute and used several times, by the filter, the sampling of ranges and the packing: written once, before the filter
    sized = written(items.select("shard", F.col("ord").cast("string").alias("ord"), F.col("id").cast("bigint").alias("id"), F.col("n").cast("bigint").alias("n")), "pack-items")
    kept = sized.where((F.col("n") <= limit) & F.col("n").isNotNull()).select(F.coalesce("shard", F.lit("")).alias("shard"), F.col("shard").isNull().alias("no_shard"), "ord", "id", "n")
    keys = ["no_shard", "shard", "ord", "id"]
    ranged = kept.repartitionByRange(range_parts(sized, each=16 << 20), *keys).withColumn("block", F.spark_partition_id())
    blocks = written(ranged, "pack-blocks")
    order = [(k, "ascending") for k in keys]

    def describe(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        table = table.set_column(table.schema.get_field_index("shard"), "shard", _named(table))
        parts = _segments(table)
        edge = parts if len(parts) < 3 else [parts[0], parts[-1]]
        n, block = table["n"].to_numpy(), table["block"][0].as_py()
        return _edges([(block, name, transition(n[s:e], limit)) for name, s, e in edge])

    described = written(blocks.groupBy("block").applyInArrow(describe, _DESCRIBED), "pack-edges").withColumn("span", F.expr(f"block div {int(span)}"))

    def up(table: pa.Table) -> pa.Table:
        return _edges(_joined(_states(table), table["span"][0].as_py()))

    top = sorted((r["block"], r["shard"], list(zip(r["least"], r["opened"], r["fill"]))) for r in described.groupBy("span").applyInArrow(up, _DESCRIBED).collect())
    known = {(b, name): (fill, pack) for b, name, fill, pack in _starts(top, {})}
    shared = items.sparkSession.sparkContext.broadcast(known)

    def down(table: pa.Table) -> pa.Table:
        rows = _starts(_states(table), shared.value, table["span"][0].as_py())
        kinds = {"block": pa.int32(), "shard": pa.string(), "fill": pa.int64(), "pack": pa.int64()}
        return pa.table({c: pa.array(x, k) for (c, k), x in zip(kinds.items(), zip(*rows))})

    starts = described.groupBy("span").applyInArrow(down, "block int, shard string, fill bigint, pack bigint")

    def run(table: pa.Table, begins: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"shard": pa.array([], pa.string()), **{c: pa.array([], pa.int64()) for c in ("id", "n", "pack_id", "pack_offset")}})
        at = {r["shard"]: (r["fill"], r["pack"]) for r in begins.to_pylist()}
        table = table.sort_by(order)
        named = table.set_column(table.schema.get_field_index("shard"), "shard", _named(table))
        n = table["n"].to_numpy()
        got = [place(n[s:e], limit, *at.get(name, (0, 0))) for name, s, e in _segments(named)]
        shard = pa.chunked_array([pa.array([None if x else s for s, x in zip(table["shard"].to_pylist(), table["no_shard"].to_pylist())], pa.string())])
        return pa.table({"shard": shard, "id": table["id"], "n": table["n"], "pack_id": np.concatenate([p for p, _ in got]), "pack_offset": np.concatenate([o for _, o in got])})

    return blocks.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(run, "shard string, id bigint, n bigint, pack_id bigint, pack_offset bigint")


def _named(table: pa.Table) -> pa.Array:
    """Shards by a name in the order of the ranges; the one without a shard is last."""
    return pa.array([("1" if x else "0") + s for s, x in zip(table["shard"].to_pylist(), table["no_shard"].to_pylist())], pa.string())


PACK = ["shard", "pack_id"]


def pack_lengths(packed: DataFrame) -> DataFrame:
    """(shard, pack_id, n_items, length, lens): ``lens`` in the order of the pack; a pack is bounded by its limit."""
    lens = F.transform(F.array_sort(F.collect_list(F.struct("pack_offset", "id", "n"))), lambda x: x["n"])
    return packed.groupBy(*PACK).agg(F.count("*").alias("n_items"), F.sum("n").alias("length"), lens.alias("lens"))


def pack_report(items: DataFrame, packed: DataFrame, limit: int = C.PACK) -> DataFrame:
    """Per shard: packs, packed and skipped items, least, mean and greatest fill in percent."""
    packs = packed.groupBy(*PACK).agg(F.count("*").alias("c"), F.sum("n").alias("length"))
    fill = F.col("length") * 100.0 / limit
    full = packs.groupBy("shard").agg(F.count("*").alias("n_packs"), F.sum("c").alias("n_packed"), F.min("length").alias("min_tokens"), F.max("length").alias("max_tokens"), F.round(F.avg(fill), 4).alias("fill_pct"))
    every = items.groupBy("shard").agg(F.sum(F.when(F.col("n") > limit, 1).otherwise(0)).cast("bigint").alias("n_skipped"))
    return every.join(full, every["shard"].eqNullSafe(full["shard"]), "left").select(every["shard"], "n_packs", "n_packed", "n_skipped", "min_tokens", "max_tokens", "fill_pct")


def doc_ids(lens: str, total: int):
    """The document number of each token, PAD_DOC for padding. Lengths over ``total`` raise an error when the row is read."""
    ids = F.flatten(F.transform(F.col(lens), lambda n, i: F.array_repeat(i, n.cast("int"))))
    fits = F.aggregate(lens, F.lit(0).cast("bigint"), lambda a, n: a + n) <= total
    full = F.concat(ids, F.array_repeat(F.lit(C.PAD_DOC), F.greatest(F.lit(0), F.lit(total) - F.size(ids))))
    return F.when(fits, full).otherwise(F.raise_error(f"the documents of a pack have more than {total} tokens"))


def cu_seqlens(packed: DataFrame) -> DataFrame:
    """(shard, pack_id, ord, cu_start, cu_end, max_len) of each item."""
    w = Window.partitionBy(*PACK)
    return packed.select("shard", "pack_id", (F.row_number().over(w.orderBy("pack_offset", "id")) - 1).cast("bigint").alias("ord"), F.col("pack_offset").alias("cu_start"), (F.col("pack_offset") + F.col("n")).alias("cu_end"), F.max("n").over(w).alias("max_len"))


def mask_pairs(packed: DataFrame, limit: int = C.PACK) -> DataFrame:
    """(shard, pack_id, allowed, dense, density): query and key pairs a causal document mask allows, in closed form."""
    pairs = packed.groupBy(*PACK).agg(F.sum(F.expr("n * (n + 1) div 2")).alias("allowed"), F.sum("n").alias("length"))
    return pairs.select(*PACK, "allowed", F.lit(limit * limit).cast("bigint").alias("dense"), F.round(F.col("allowed") / float(limit * limit), 6).alias("density"))


def block_mask(packed: DataFrame, block: int = 128, limit: int = C.PACK) -> DataFrame:
    """(shard, pack_id, active_blocks, total_blocks, blocks): blocks (q, k) of the mask with at least one allowed pair, in order."""
    first, last = F.expr(f"cast(pack_offset div {block} as int)"), F.expr(f"cast((pack_offset + n - 1) div {block} as int)")
    cells = F.flatten(F.transform(F.sequence(first, last), lambda q: F.transform(F.sequence(first, q), lambda k: F.struct(q.alias("q"), k.alias("k")))))
    per = packed.where("n > 0").groupBy(*PACK).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(cells)))).alias("blocks"))
    side = -(-limit // block)
    return per.select(*PACK, F.size("blocks").cast("bigint").alias("active_blocks"), F.lit(side * side).cast("bigint").alias("total_blocks"), "blocks")
