"""Raw rows: deliveries, formats, chat and continual sequences, labels and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark import constants as C
from ctxspark.functions import text as T


def is_chat() -> Column:
    """A predicate that reaches the scan; a null target is a chat row's."""
    return F.col("target").isNull() | (F.col("target") != C.CONTINUAL_TARGET)


def is_continual() -> Column:
    return F.col("target") == C.CONTINUAL_TARGET


def once(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows delivered again count once; ``columns`` must not differ between deliveries."""
    return rows.select(key, *columns).dropDuplicates([key])


def target_text() -> Column:
    """What follows the generation prefix; a null target is empty."""
    return F.concat(F.coalesce(F.col("target"), F.lit("")), F.lit(C.IM_END + "\n"))


def lengths(rows: DataFrame, ratio: int = C.RATIO) -> DataFrame:
    """(row_id, format, seq_len, n_trainable, n_masked) of the sequences of both formats, without making them."""
    columns = ["row_id", "format", "seq_len", "n_trainable", "n_masked"]
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    chat = rows.where(is_chat()).select("row_id", F.lit("chat").alias("format"), T.n_tokens(target_text()).alias("n_trainable"), T.n_expanded(T.render_chat("prompt"), ratio).alias("n_masked"))
    text = T.continual_text("prompt")
    masked = F.aggregate(T.region_latents(text, ratio), F.lit(0).cast("bigint"), lambda a, x: a + x + 2)
    other = rows.where(is_continual()).select("row_id", F.lit("continual_pretraining").alias("format"), total(F.transform(T.outside_parts(text), T.n_tokens)).alias("n_trainable"), masked.alias("n_masked"))
    return chat.unionByName(other).withColumn("seq_len", F.col("n_trainable") + F.col("n_masked")).select(columns)


def stats_pre(rows: DataFrame) -> DataFrame:
    """(row_id, format, trainable, non_trainable, total) before compression."""
    text = T.continual_text("prompt")
    bodies = F.aggregate(F.transform(T.regions(text), T.n_tokens), F.lit(0).cast("bigint"), lambda a, x: a + x)
    is_chat = T.row_format("target") == "chat"
    # tokens never span a region's edge, so the counts of the parts add up
    out = F.aggregate(F.transform(T.outside_parts(text), T.n_tokens), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(
        "row_id", T.row_format("target").alias("format"),
        F.when(is_chat, T.n_tokens(target_text())).otherwise(out).alias("trainable"),
        F.when(is_chat, T.n_tokens(T.render_chat("prompt"))).otherwise(bodies).alias("non_trainable"),
    ).withColumn("total", F.col("trainable") + F.col("non_trainable"))


def compression_stats(docs: DataFrame, key: str, ratio: int = C.RATIO) -> DataFrame:
    """Per ``key``: documents, compressed length, equivalent uncompressed length and the savings in percent."""
    k = T.region_latents("text", ratio)
    sizes = F.transform(T.regions("text"), T.n_embed_tokens)
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    real = total(F.transform(T.outside_parts("text"), T.n_tokens))
    per = docs.where("text is not null").select(key, real.alias("real"), total(k).alias("latents"), total(sizes).alias("embed"), (F.size(k) * 2).cast("bigint").alias("markers"))
    sums = per.groupBy(key).agg(F.count("*").alias("n_docs"), F.sum(F.col("real") + F.col("latents") + F.col("markers")).alias("compressed"), F.sum(F.col("real") + F.col("embed") + F.col("markers")).alias("equivalent"))
    saved = F.when(F.col("equivalent") == 0, F.lit(0.0)).otherwise(F.round((1 - F.col("compressed") / F.col("equivalent")) * 100, 1))
    return sums.withColumn("savings_pct", saved)
