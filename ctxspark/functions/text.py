"""Columns over texts: tokens, memory regions, placeholders, chat rendering. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxspark import constants as C


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Decoder tokens: markers are one token each. Null gives null, an empty text an empty array."""
    return F.regexp_extract_all(col(text), F.lit(C.TOKEN_PATTERN), F.lit(0))


def n_tokens(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(C.TOKEN_PATTERN)).cast("bigint")


def n_embed_tokens(text: Column | str) -> Column:
    """Tokens of the encoder's vocabulary, to which markers are ordinary text."""
    return F.regexp_count(col(text), F.lit(C.WORD_PATTERN)).cast("bigint")


def regions(text: Column | str) -> Column:
    """Bodies of memory regions from left to right; nesting is not read, an unclosed marker opens none."""
    return F.regexp_extract_all(col(text), F.lit(C.REGION_PATTERN), F.lit(1))


def outside_parts(text: Column | str) -> Column:
    """The text between regions: one part more than there are regions."""
    return F.split(col(text), C.REGION_PATTERN, -1)


def outside(text: Column | str) -> Column:
    return F.regexp_replace(col(text), F.lit(C.REGION_PATTERN), F.lit(""))


def latent_count(n: Column, ratio: int = C.RATIO, min_one: bool = True) -> Column:
    """ceil(n / ratio), at least 1 unless ``min_one`` is off."""
    up = F.floor((n + (ratio - 1)) / ratio).cast("bigint") if ratio & (ratio - 1) else F.shiftright(n + (ratio - 1), ratio.bit_length() - 1)
    return F.greatest(F.lit(1).cast("bigint"), up) if min_one else up


def region_latents(text: Column | str, ratio: int = C.RATIO, min_one: bool = True) -> Column:
    """For each region its number of latents."""
    return F.transform(regions(text), lambda b: latent_count(n_embed_tokens(b), ratio, min_one))


def expand_placeholders(text: Column | str, ratio: int = C.RATIO) -> Column:
    """Each region's body replaced by as many placeholders as it has latents; markers stay."""
    inner = F.transform(region_latents(text, ratio), lambda k: F.concat(F.lit(C.MEMORY_START), F.repeat(F.lit(C.MEMORY), k.cast("int")), F.lit(C.MEMORY_END)))
    parts = outside_parts(text)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.concat(F.element_at(parts, 1), F.array_join(F.zip_with(inner, rest, lambda a, b: F.concat(a, b)), ""))


def n_expanded(text: Column | str, ratio: int = C.RATIO) -> Column:
    """The number of tokens of the expanded text, without making it."""
    zero = F.lit(0).cast("bigint")
    kept = F.aggregate(F.transform(outside_parts(text), n_tokens), zero, lambda a, x: a + x)
    return kept + F.aggregate(region_latents(text, ratio), zero, lambda a, x: a + x + 2)


def prefix_sums(values: Column) -> Column:
    """Exclusive prefix sums and, last, the total: one element more than ``values``."""
    zero = F.array(F.lit(0).cast("bigint"))
    return F.aggregate(values, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def region_spans(text: Column | str, ratio: int = C.RATIO) -> Column:
    """Half-open spans [start, end) of each region's placeholders in the token sequence of the expanded text."""
    k = region_latents(text, ratio)
    before = prefix_sums(F.zip_with(F.transform(F.slice(outside_parts(text), 1, F.size(k)), n_tokens), k, lambda o, c: o + c + 2))
    lens = F.transform(F.slice(outside_parts(text), 1, F.size(k)), n_tokens)
    return F.transform(
        F.arrays_zip(F.slice(before, 1, F.size(k)).alias("b"), lens.alias("o"), k.alias("k")),
        lambda x: F.struct((x["b"] + x["o"] + 1).alias("start"), (x["b"] + x["o"] + 1 + x["k"]).alias("end")),
    )


def render_message(role: Column, content: Column) -> Column:
    return F.concat(F.lit(C.IM_START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")), F.lit(C.IM_END + "\n"))


def render_chat(messages: Column | str, generation_prefix: bool = True) -> Column:
    """The chat template over an array of (role, content); null roles and contents are empty. A null array renders as no message."""
    body = F.coalesce(F.array_join(F.transform(col(messages), lambda m: render_message(m["role"], m["content"])), ""), F.lit(""))
    return F.concat(body, F.lit(C.IM_START + "assistant\n")) if generation_prefix else body


def row_format(target: Column | str) -> Column:
    """chat or continual_pretraining; a null target is a chat row's."""
    return F.when(col(target) == C.CONTINUAL_TARGET, "continual_pretraining").otherwise("chat")


def continual_text(prompt: Column | str) -> Column:
    """The first message's content, empty if there is none."""
    return F.coalesce(F.get(col(prompt), F.lit(0))["content"], F.lit(""))
