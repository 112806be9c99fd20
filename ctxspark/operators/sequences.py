"""Training sequences: ids, labels and the spans of memory placeholders, of raw rows and of packs.

A sequence is a row with ``input_ids``, ``labels`` (IGNORE where nothing is learnt), ``spans`` (half-open, one for each region's placeholders),
``latent_counts`` and ``memory_ids`` (the encoder's ids of each region). Everything is array expressions over one row, so a sequence costs no shuffle;
packs are put together by one aggregation, and a pack is bounded by its limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ctxspark import constants as C
from ctxspark.functions import text as T
from ctxspark.functions.tokenizer import STAND_IN, Tokenizer
from ctxspark.plans.stage import written

FIELDS = ["input_ids", "labels", "spans", "latent_counts", "memory_ids"]
#: Renders messages, with or without the prefix of an answer.
Template = Callable[[Column, bool], Column]


def big(x: int) -> Column:
    return F.lit(x).cast("bigint")


def repeated(x: int, n: Column) -> Column:
    return F.array_repeat(big(x), n.cast("int"))


def required(ok: Column, value: Column, message: str | Column) -> Column:
    """``value``, or an error when the row is read if ``ok`` is false."""
    return F.when(ok, value).otherwise(F.raise_error(message))


def chat_texts(rows: DataFrame, template: Template | None = T.render_chat) -> DataFrame:
    """(row_id, prompt_text, target_text) of chat rows.

    The target's text is what the whole conversation has after the prompt's; a template that doesn't begin the one with the other raises an error. Without
    a template, contents are joined by line feeds, the last of them included, and the target stays as it is. Null prompts, contents and targets are empty.
    """
    chat = rows.where(F.col("target").isNull() | (F.col("target") != C.CONTINUAL_TARGET))
    messages = F.coalesce("prompt", F.array().cast("array<struct<role:string,content:string>>"))
    answer = F.coalesce("target", F.lit(""))
    if template is None:
        joined = F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
        prompt = F.when((joined != "") & ~joined.endswith("\n"), F.concat(joined, F.lit("\n"))).otherwise(joined)
        return chat.select("row_id", prompt.alias("prompt_text"), answer.alias("target_text"))
    said = F.struct(F.lit("assistant").alias("role"), answer.alias("content"))
    both = chat.select("row_id", template(messages, True).alias("prompt_text"), template(F.concat(messages, F.array(said)), False).alias("full"))
    target = required(F.startswith("full", "prompt_text"), F.expr("substring(full, length(prompt_text) + 1)"), "the prompt is no beginning of the conversation")
    return both.select("row_id", "prompt_text", target.alias("target_text"))


def cut_regions(df: DataFrame, text: str, ratio: int, tok: Tokenizer) -> DataFrame:
    """``df`` with ``part_ids``, the ids between regions, ``memory_ids`` and ``latent_counts`` of its column ``text``."""
    d = df.withColumns({"part_ids": F.transform(T.outside_parts(text), tok.ids), "memory_ids": F.transform(T.regions(text), tok.embed_ids)})
    return d.withColumn("latent_counts", F.transform("memory_ids", lambda m: T.latent_count(F.size(m).cast("bigint"), ratio)))


def _woven(region: Callable[[Column], Column]) -> Column:
    """The parts with what stands for each region between them."""
    none = F.array().cast("array<bigint>")
    return F.flatten(F.transform(F.arrays_zip("part_ids", "latent_counts"), lambda z: F.concat(z["part_ids"], F.when(z["latent_counts"].isNull(), none).otherwise(region(z["latent_counts"])))))


def woven_ids() -> Column:
    return _woven(lambda k: F.concat(F.array(big(C.START_ID)), repeated(C.MEMORY_ID, k), F.array(big(C.END_ID))))


def woven_labels() -> Column:
    """The ids, but IGNORE for regions with their markers."""
    return _woven(lambda k: repeated(C.IGNORE, k + 2))


def woven_spans() -> Column:
    """Where the placeholders of each region are."""
    parts = F.transform(F.slice("part_ids", 1, F.size("latent_counts")), lambda p: F.size(p).cast("bigint"))
    before = T.prefix_sums(F.zip_with(parts, "latent_counts", lambda o, k: o + k + 2))
    z = F.arrays_zip(F.slice(before, 1, F.size("latent_counts")).alias("b"), parts.alias("o"), F.col("latent_counts").alias("k"))
    return F.transform(z, lambda x: F.struct((x["b"] + x["o"] + 1).alias("start"), (x["b"] + x["o"] + 1 + x["k"]).alias("end")))


def sft(rows: DataFrame, ratio: int = C.RATIO, tok: Tokenizer = STAND_IN, template: Template | None = T.render_chat) -> DataFrame:
    """(row_id, fields): expanded prompt and target of chat rows; the prompt is ignored. Regions are those of the prompt."""
    d = cut_regions(chat_texts(rows, template), "prompt_text", ratio, tok).withColumn("target_ids", tok.ids(F.col("target_text")))
    d = d.withColumns({"prompt_ids": woven_ids(), "spans": woven_spans()})
    return d.select("row_id", F.concat("prompt_ids", "target_ids").alias("input_ids"), F.concat(repeated(C.IGNORE, F.size("prompt_ids")), "target_ids").alias("labels"), "spans", "latent_counts", "memory_ids")


def teacher(rows: DataFrame, tok: Tokenizer = STAND_IN, template: Template | None = T.render_chat) -> DataFrame:
    """(row_id, input_ids, labels) of chat rows without compression: regions stay as text."""
    d = chat_texts(rows, template).select("row_id", tok.ids(F.col("prompt_text")).alias("p"), tok.ids(F.col("target_text")).alias("t"))
    return d.select("row_id", F.concat("p", "t").alias("input_ids"), F.concat(repeated(C.IGNORE, F.size("p")), "t").alias("labels"))


def continual(rows: DataFrame, ratio: int = C.RATIO, tok: Tokenizer = STAND_IN) -> DataFrame:
    """(row_id, fields) of continual rows: labels are the ids, but IGNORE from each region's start marker to its end marker."""
    text = rows.where(F.col("target") == C.CONTINUAL_TARGET).select("row_id", T.continual_text("prompt").alias("text"))
    return cut_regions(text, "text", ratio, tok).select("row_id", woven_ids().alias("input_ids"), woven_labels().alias("labels"), woven_spans().alias("spans"), "latent_counts", "memory_ids")


def preprocess(rows: DataFrame, ratio: int = C.RATIO, tok: Tokenizer = STAND_IN) -> DataFrame:
    """(row_id, format, fields, seq_len) of both formats."""
    both = sft(rows, ratio, tok).withColumn("format", F.lit("chat")).unionByName(continual(rows, ratio, tok).withColumn("format", F.lit("continual_pretraining")))
    return both.select("row_id", "format", *FIELDS, F.size("input_ids").cast("bigint").alias("seq_len"))


def find_regions(ids: Column, counts: Column) -> Column:
    """Spans of the placeholders behind start markers, as many as ``counts`` says of each; the sequence may hold fewer regions than expected.

    A region that goes past the end, has another id among its placeholders or no end marker behind them raises an error.
    """
    starts = F.slice(F.filter(F.transform(ids, lambda x, i: F.when(x == C.START_ID, i)), lambda i: i.isNotNull()), 1, F.size(counts))

    def span(i: Column, n: Column) -> Column:
        k = F.get(counts, n).cast("int")
        ok = (i + 1 + k < F.size(ids)) & (F.get(ids, i + 1 + k) == C.END_ID) & F.forall(F.slice(ids, i + 2, k), lambda x: x == C.MEMORY_ID)
        return required(ok, F.struct((i + 1).cast("bigint").alias("start"), (i + 1 + k).cast("bigint").alias("end")), F.concat(F.lit("region "), n.cast("string"), F.lit(": placeholders and an end marker are missing")))

    return F.transform(starts, span)


def runs_of(ids: Column, value: int) -> Column:
    """Half-open maximal runs of an id, as an array of (start, end) in order. Each place is compared with its neighbours only."""
    before = F.concat(F.array(F.lit(None).cast("bigint")), ids)
    after = F.concat(F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), F.array(F.lit(None).cast("bigint")))
    is_it = lambda x: F.coalesce(x == value, F.lit(False))
    mark = lambda side: F.filter(F.transform(F.arrays_zip(ids.alias("x"), side.alias("y")), lambda z, i: F.when(is_it(z["x"]) & ~is_it(z["y"]), i)), lambda i: i.isNotNull())
    return F.zip_with(mark(before), mark(after), lambda s, e: F.struct(s.cast("bigint").alias("start"), (e + 1).cast("bigint").alias("end")))


def find_unwrapped(ids: Column, counts: Column) -> Column:
    """Spans of placeholders without markers, as long as ``counts`` says of each, cut from the runs of placeholders one after the other.

    A run that ends within a span raises an error; what is left behind the last expected span is not looked at.
    """
    runs, ends = runs_of(ids, C.MEMORY_ID), T.prefix_sums(F.transform(counts, lambda k: k.cast("bigint")))
    sums = T.prefix_sums(F.transform(runs, lambda r: r["end"] - r["start"]))
    have = F.element_at(sums, -1)

    def span(k: Column, n: Column) -> Column:
        first = F.get(ends, n)
        # the run in which the first-th placeholder lies: the last that begins at or before it
        r = F.size(F.filter(sums, lambda s: s <= first)) - 1
        start = F.get(runs, r)["start"] + first - F.get(sums, r)
        ok = (k > 0) & (start + k <= F.get(runs, r)["end"])
        return F.when(first < have, required(F.coalesce(ok, F.lit(False)), F.struct(start.alias("start"), (start + k).alias("end")), "a run of placeholders is shorter than expected"))

    return F.filter(F.transform(counts, span), lambda s: s.isNotNull())


def padded(values: Column, to: Column, value: int) -> Column:
    """``values`` filled up on the right; longer ones stay as they are."""
    return F.concat(values, repeated(value, F.greatest(F.lit(0), to.cast("int") - F.size(values))))


def collate(examples: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, input_ids, labels, spans, latent_counts, memory_ids, sample_lens): the examples of each pack one behind the other.

    ``examples`` has the fields, ``by`` names the pack and ``order`` the place in it. Spans are moved by the lengths before them. Missing labels are
    IGNORE if any example of the pack has labels; if none has, the pack's are null.
    """
    packs = examples.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *FIELDS))).alias("e"))
    packs = packs.withColumn("sample_lens", F.transform("e", lambda x: F.size(x["input_ids"]).cast("bigint")))
    some = F.exists("e", lambda x: x["labels"].isNotNull())
    labels = F.flatten(F.transform("e", lambda x: F.coalesce(x["labels"], repeated(C.IGNORE, F.size(x["input_ids"])))))
    moved = F.zip_with("e", F.slice(T.prefix_sums(F.col("sample_lens")), 1, F.size("e")), lambda x, o: F.transform(x["spans"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"))))
    field = lambda name: F.flatten(F.transform("e", lambda x: x[name])).alias(name)
    return packs.select(*by, field("input_ids"), F.when(some, labels).alias("labels"), F.flatten(moved).alias("spans"), field("latent_counts"), field("memory_ids"), "sample_lens")


def one_dimensional(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` as an array of bigints: numbers of any width, or the first row of a nested array. Null and empty ones stay null and empty."""
    kind = df.schema[column].dataType
    nested = isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType)
    flat = F.when(F.size(column) == 0, F.array().cast("array<bigint>")).otherwise(F.get(column, F.lit(0)).cast("array<bigint>")) if nested else F.col(column).cast("array<bigint>")
    return df.withColumn(column, flat)


def pad_to(packs: DataFrame, target: int) -> DataFrame:
    """Packs with ids and labels filled up to ``target``; longer ones stay as they are, null labels stay null."""
    return packs.withColumns({"input_ids": padded(F.col("input_ids"), F.lit(target), C.PAD_ID), "labels": padded(F.col("labels"), F.lit(target), C.IGNORE)})


def pad_batches(sequences: DataFrame, batch: list[str], target: int = 0) -> DataFrame:
    """``sequences`` with ids and labels filled up to ``target`` or the longest of their batch, and ``attention_mask``.

    Only the lengths are aggregated; arrays meet one number for their batch. Sequences are written first: they are made once, not for the lengths and again.
    """
    sequences = written(sequences, "sequences")
    most = sequences.groupBy(*batch).agg(F.greatest(F.lit(target), F.max(F.size("input_ids"))).alias("__to"))
    same = F.lit(True)
    for i, b in enumerate(batch):
        most = most.withColumnRenamed(b, f"__b{i}")
        same = same & F.col(b).eqNullSafe(F.col(f"__b{i}"))
    j = sequences.join(most, same).withColumn("attention_mask", padded(F.transform("input_ids", lambda x: big(1)), F.col("__to"), 0))
    j = j.withColumns({"input_ids": padded(F.col("input_ids"), F.col("__to"), C.PAD_ID), "labels": padded(F.col("labels"), F.col("__to"), C.IGNORE)})
    return j.select(*sequences.columns, "attention_mask")


def collate_batches(packs: DataFrame, by: list[str], place: str, per_batch: int, target: int = C.PACK) -> DataFrame:
    """``packs`` with ``batch``, ``per_batch`` packs each by their number ``place``, filled up to ``target`` or the batch's longest."""
    if per_batch < 1:
        raise ValueError("a batch needs at least one pack")
    return pad_batches(packs.withColumn("batch", F.floor(F.col(place) / per_batch).cast("bigint")), [*by, "batch"], target)
