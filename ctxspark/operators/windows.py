"""Encoder windows over long regions, and pooling of vectors into latents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark import constants as C
from ctxspark.functions import text as T
from ctxspark.operators.sequences import repeated
from ctxspark.plans.prefix import running
from ctxspark.plans.stage import written


#: Takes windows (id, win, window_ids), gives hidden states (id, win, pos, vec). A model is a mapInArrow with this shape.
Encoder = Callable[[DataFrame], DataFrame]


def check_config(pooling: str, window: int, ratio: int) -> None:
    """Raises if windows could not be pooled into whole latents."""
    if pooling not in {"eos", "mean", "concat"}:
        raise ValueError(f"pooling is one of eos, mean and concat, not {pooling}")
    if window % ratio:
        raise ValueError(f"the window {window} is no multiple of the ratio {ratio}")


def tile(sequences: DataFrame, window: int = C.WINDOW, overlap: int = C.OVERLAP, ratio: int = C.RATIO, bidirectional: bool = True) -> DataFrame:
    """(id, win, start_pos, pool_len, n_latent, left, right) for sequences (id, n): tiles, their latents and context.

    Sequences without tokens have no window. Context is up to ``overlap`` tokens before and, if bidirectional, after a tile.
    """
    check_config("mean", window, ratio)
    t = sequences.where("n > 0").select("id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(window).cast("bigint"))).alias("start_pos"))
    pool = F.least(F.lit(window).cast("bigint"), F.col("n") - F.col("start_pos"))
    end = F.col("start_pos") + F.col("pool_len")
    right = F.least(F.col("n"), end + overlap) - end if bidirectional else F.lit(0).cast("bigint")
    return t.withColumn("pool_len", pool).select(
        "id", F.expr(f"start_pos div {window}").alias("win"), "start_pos", "pool_len", T.latent_count(F.col("pool_len"), ratio).alias("n_latent"), F.least(F.lit(overlap).cast("bigint"), F.col("start_pos")).alias("left"), right.alias("right")
    )


def window_ids(sequences: DataFrame, eos: bool = False, window: int = C.WINDOW, overlap: int = C.OVERLAP, ratio: int = C.RATIO, bidirectional: bool = True) -> DataFrame:
    """(id, win, pool_start, pool_len, n_latent, window_ids, markers) for sequences (id, ids): what the encoder reads for each tile.

    The tile's ids stand between their context. With ``eos``, one pad id for each latent is appended and ``markers`` are their places; else there are none.
    Tiles are cut out of each sequence in its own row; sequences without ids have no window, null ones none either.
    """
    check_config("mean", window, ratio)
    n = F.size("ids").cast("bigint")

    def one(start: Column) -> Column:
        pool = F.least(F.lit(window).cast("bigint"), n - start)
        left = F.least(F.lit(overlap).cast("bigint"), start)
        right = F.least(F.lit(overlap).cast("bigint"), n - start - pool) if bidirectional else F.lit(0).cast("bigint")
        k = T.latent_count(pool, ratio)
        body = F.slice("ids", (start - left + 1).cast("int"), (left + pool + right).cast("int"))
        markers = F.sequence(left + pool + right, left + pool + right + k - 1) if eos else F.array().cast("array<bigint>")
        read = F.concat(body, repeated(C.PAD_ID, k)) if eos else body
        return F.struct(F.floor(start / window).alias("win"), left.alias("pool_start"), pool.alias("pool_len"), k.alias("n_latent"), read.alias("window_ids"), markers.alias("markers"))

    starts = F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(window).cast("bigint"))
    return sequences.where(F.size("ids") > 0).select("id", F.explode(F.transform(starts, one)).alias("w")).select("id", "w.*")


def left_pad(windows: DataFrame, per_batch: int = 128) -> DataFrame:
    """``windows`` (id, win, window_ids, ...) with ``batch``, ``input_ids``, ``attention_mask`` and ``position_ids``.

    Windows of all sequences are numbered in the order of (id, win); ``per_batch`` of them are a batch, filled up on the left to its longest. Masked places
    have position 0, the others count from 0. Windows are written first: they are made once, not for their sizes and again.
    """
    if per_batch < 1:
        raise ValueError("a batch needs at least one window")
    windows = written(windows, "windows")
    size = windows.select("id", "win", F.size("window_ids").alias("__n"), F.lit(0).alias("__all"))
    batches = running(size, ["__all"], ["id", "win"], {"__no": F.lit(1)}).select("id", "win", "__n", F.floor((F.col("__no") - 1) / per_batch).cast("bigint").alias("batch"))
    longest = batches.groupBy("batch").agg(F.max("__n").alias("__to"))
    w = windows.join(batches.drop("__n"), ["id", "win"]).join(longest, "batch")
    gap, n = F.col("__to") - F.size("window_ids"), F.size("window_ids")
    counted = F.transform("window_ids", lambda x, i: i.cast("bigint"))
    return w.select(
        *windows.columns, "batch", F.concat(repeated(C.PAD_ID, gap), "window_ids").alias("input_ids"), F.concat(repeated(0, gap), repeated(1, n)).alias("attention_mask"), F.concat(repeated(0, gap), counted).alias("position_ids")
    )


def regroup(sequences: DataFrame, latents: DataFrame, width: int) -> DataFrame:
    """(id, n_latents, latents): the vectors of each sequence's windows in order; one without windows has one zero vector of ``width``.

    ``latents`` has (id, win, grp, vec). A sequence is bounded, so is its array.
    """
    per = latents.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("win", "grp", "vec"))), lambda x: x["vec"]).alias("latents"))
    zero = F.array(F.array_repeat(F.lit(0.0), width))
    j = sequences.select("id").join(per, "id", "left").withColumn("latents", F.coalesce("latents", zero))
    return j.select("id", F.size("latents").cast("bigint").alias("n_latents"), "latents")


def doubles(vec: Column | str) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def _groups(hidden: DataFrame, keys: list[str], ratio: int) -> DataFrame:
    """``hidden`` (keys, pos, vec) as (keys, grp, g): ``ratio`` vectors in a row each, in order; the last group of a sequence may be shorter."""
    h = hidden.select(*keys, "pos", doubles("vec").alias("vec"), F.expr(f"pos div {int(ratio)}").alias("grp"))
    return h.groupBy(*keys, "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vec"))), lambda x: x["vec"]).alias("g"))


def pool_mean(hidden: DataFrame, keys: list[str], ratio: int) -> DataFrame:
    """(keys, grp, vec): the mean of each group of ``ratio`` hidden vectors over its true size; ``pos`` counts from 0 in each sequence."""
    g = _groups(hidden, keys, ratio)
    total = F.aggregate(F.slice("g", 2, F.greatest(F.size("g") - 1, F.lit(0))), F.element_at("g", 1), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return g.select(*keys, "grp", F.transform(total, lambda x: x / F.size("g")).alias("vec"))


def pool_concat(hidden: DataFrame, keys: list[str], ratio: int) -> DataFrame:
    """(keys, grp, vec): the vectors of each group side by side, a short group filled with zeros."""
    g = _groups(hidden, keys, ratio)
    flat = F.flatten("g")
    return g.select(*keys, "grp", F.concat(flat, F.array_repeat(F.lit(0.0), ratio * F.size(F.element_at("g", 1)) - F.size(flat))).alias("vec"))


def pool_eos(hidden: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grp, vec): the vectors at each window's ``markers``, in their order."""
    at = windows.select(*keys, F.posexplode("markers").alias("grp", "pos"))
    return at.join(hidden, [*keys, "pos"]).select(*keys, F.col("grp").cast("bigint").alias("grp"), doubles("vec").alias("vec"))


def splice(embeds: DataFrame, spans: DataFrame, latents: DataFrame, strict: bool = True) -> DataFrame:
    """``embeds`` (id, pos, vec) with the vectors at spans' positions replaced by latents in their order.

    ``spans`` has (id, region, start, end), ``latents`` (id, region, slot, vec). A span without as many latents as positions raises an error when the rows are
    read; if not ``strict``, as in serving, the first of both are used and other positions stay as they are.
    """
    p = spans.select("id", "region", F.posexplode(F.when(F.col("end") > F.col("start"), F.sequence(F.col("start"), F.col("end") - 1)).otherwise(F.array(F.lit(None).cast("bigint")))).alias("slot", "pos")).withColumn("slot", F.col("slot").cast("bigint"))
    j = p.join(latents.select("id", "region", "slot", doubles("vec").alias("__new")), ["id", "region", "slot"], "full")
    if strict:
        whole = F.col("pos").isNotNull() & F.col("__new").isNotNull()
        j = j.withColumn("pos", F.when(whole, F.col("pos")).otherwise(F.raise_error("as many latents as positions are needed")))
        # an error must come up even for positions that no embedding has
        j = j.where(F.col("pos").isNotNull())
    else:
        j = j.where("pos is not null and __new is not null")
    return embeds.join(j.select("id", "pos", "__new"), ["id", "pos"], "full" if strict else "left").select("id", "pos", F.coalesce("__new", doubles("vec")).alias("vec"))


def segment_pad(segments: DataFrame, batch: str, width: int) -> DataFrame:
    """(batch, id, slot, vec, mask): every segment's latents up to the longest of its batch, zero vectors with mask 0 behind its own.

    ``segments`` has (batch, id, latents). Only the lengths are aggregated by batch. Rows with mask 1 are the segments again.
    """
    most = segments.groupBy(F.col(batch).alias("__b")).agg(F.max(F.size("latents")).alias("__to"))
    zero = F.array_repeat(F.lit(0.0), width)
    j = segments.join(most, segments[batch].eqNullSafe(F.col("__b"))).where("__to > 0")
    slots = F.transform(F.sequence(F.lit(0), F.col("__to") - 1), lambda i: F.struct(i.cast("bigint").alias("slot"), F.coalesce(doubles(F.get("latents", i)), zero).alias("vec"), F.when(i < F.size("latents"), 1).otherwise(0).cast("bigint").alias("mask")))
    return j.select(batch, "id", F.explode(slots).alias("s")).select(batch, "id", "s.*")


def minibatches(windows: DataFrame, size: int) -> DataFrame:
    """(rank, n_windows, n_batches, n_dummies) of windows (rank): batches of ``size`` windows each rank encodes, at least one, and how many empty ones
    it runs besides so that all ranks run as many. ``size`` 0 puts all windows of a rank into one batch. One row a rank meets the greatest of them.
    """
    n = F.expr(f"(n_windows + {size - 1}) div {size}") if size > 0 else F.lit(1)
    per = windows.groupBy("rank").agg(F.count("*").alias("n_windows")).withColumn("n_batches", F.greatest(F.lit(1), n).cast("bigint"))
    most = per.agg(F.max("n_batches").alias("most"))
    return per.crossJoin(most).select("rank", "n_windows", "n_batches", (F.col("most") - F.col("n_batches")).alias("n_dummies"))


def id_encoder(windows: DataFrame) -> DataFrame:
    """A deterministic stand-in: four remainders of each id."""
    at = windows.select("id", "win", F.posexplode("window_ids").alias("pos", "x"))
    return at.select("id", "win", F.col("pos").cast("bigint").alias("pos"), F.array(*((F.col("x") % m).cast("double") for m in (97, 89, 83, 79))).alias("vec"))


def encode(sequences: DataFrame, encoder: Encoder = id_encoder, width: int = 4, pooling: str = "mean", window: int = C.WINDOW, overlap: int = C.OVERLAP, ratio: int = C.RATIO, bidirectional: bool = True) -> DataFrame:
    """(id, n_latents, latents) of sequences (id, ids): windows with their context, encoded, pooled and put together again for each sequence.

    Context is encoded but not pooled. ``width`` is that of a latent: of a hidden state, times the ratio for ``concat``. Sequences without ids have one zero vector.
    """
    check_config(pooling, window, ratio)
    w = window_ids(sequences, pooling == "eos", window, overlap, ratio, bidirectional)
    hidden, keys = encoder(w.select("id", "win", "window_ids")), ["id", "win"]
    if pooling == "eos":
        latents = pool_eos(hidden, w, keys)
    else:
        # where a tile begins within its window is known by its number; what is behind it, by its sequence's length
        n = sequences.select("id", F.size("ids").alias("__n"))
        start = F.col("win") * window
        inner = hidden.join(n, "id").withColumn("pos", F.col("pos") - F.least(F.lit(overlap), start)).where(F.col("pos").between(0, window - 1) & (F.col("pos") + start < F.col("__n")))
        latents = (pool_mean if pooling == "mean" else pool_concat)(inner, keys, ratio)
    return regroup(sequences, latents, width)
