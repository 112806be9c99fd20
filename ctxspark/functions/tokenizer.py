"""What operators need of tokenizers, and the stand-in that the queries use.

A tokenizer is a few functions of columns. A real one is an Arrow UDF with the same shape; operators take it as a parameter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxspark import constants as C
from ctxspark.functions import text as T

#: Ids of the stand-in's ordinary tokens are 1 to this number; 0 pads.
ORDINARY = C.START_ID - 1

# Ids of the markers.
MARKER_IDS = {C.MEMORY_START: C.START_ID, C.MEMORY: C.MEMORY_ID, C.MEMORY_END: C.END_ID, C.IM_START: C.IM_START_ID, C.IM_END: C.IM_END_ID}


@dataclass(frozen=True)
class Tokenizer:
    """``ids`` gives a text's decoder ids, markers one each, ``embed_ids`` the encoder's, to which markers are text; the rest counts them without making them."""

    ids: Callable[[Column], Column]
    embed_ids: Callable[[Column], Column]
    count: Callable[[Column], Column]
    embed_count: Callable[[Column], Column]


def hashed_id(token: Column) -> Column:
    """The stand-in's id of an ordinary token: 28 bits of its digest, folded into the vocabulary."""
    return F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("bigint") % ORDINARY + 1


def _decoder_id(token: Column) -> Column:
    marker = F.lit(None).cast("bigint")
    for name, number in MARKER_IDS.items():
        marker = F.when(token == name, F.lit(number).cast("bigint")).otherwise(marker)
    return F.when(token.startswith("<|"), marker).otherwise(hashed_id(token))


STAND_IN = Tokenizer(
    ids=lambda text: F.transform(T.tokens(text), _decoder_id),
    embed_ids=lambda text: F.transform(F.regexp_extract_all(text, F.lit(C.WORD_PATTERN), F.lit(0)), hashed_id),
    count=T.n_tokens,
    embed_count=T.n_embed_tokens,
)
