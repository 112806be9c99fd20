"""Columns that read model responses: directives, selections, answers, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxspark import constants as C
from ctxspark.functions.text import col

WHITE = " \t\n\x0b\f\r"
_S = rf"[{C.SPACE}]"
EXPAND = rf"(?is)^(.*)EXPAND{_S}*:{_S}*([0-9,{C.SPACE}]+)"
ANSWER = rf"(?is)^(.*?)ANSWER{_S}*:{_S}*(.+)"
SELECTED = rf"(?s)SELECTED:{_S}*([0-9,{C.SPACE}]+)"


def strip(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(WHITE))


def clean_response(text: Column | str) -> Column:
    """What comes before the first end marker, without white space around it."""
    return strip(F.substring_index(col(text), C.IM_END, 1))


def indices(digits: Column, n: Column | int) -> Column:
    """Sorted distinct 0-based indices below ``n`` of the 1-based numbers in a text."""
    n = F.lit(n) if isinstance(n, int) else n
    numbers = F.transform(F.regexp_extract_all(digits, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("bigint") - 1)
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda i: i.isNotNull() & (i >= 0) & (i < n))))


def parse_round(text: Column | str, n: Column | int) -> Column:
    """Struct (action, indices, answer) of a response.

    Of an EXPAND and an ANSWER directive the one that begins last counts; the answer is all that follows the first ANSWER. Without a
    directive the whole text is the answer. Indices out of range are left out.
    """
    t = strip(text)
    has_expand, has_answer = t.rlike(EXPAND), t.rlike(ANSWER)
    later = F.length(F.regexp_extract(t, EXPAND, 1)) > F.length(F.regexp_extract(t, ANSWER, 1))
    expand = has_expand & (~has_answer | later)
    answer = F.when(has_answer, clean_response(F.regexp_extract(t, ANSWER, 2))).otherwise(t)
    return F.struct(
        F.when(expand, F.lit("expand")).when(t.isNotNull(), F.lit("answer")).alias("action"),
        F.when(expand, indices(F.regexp_extract(t, EXPAND, 2), n)).alias("indices"),
        F.when(~expand, answer).alias("answer"),
    )


def parse_selection(text: Column | str, n: Column | int) -> Column:
    """0-based indices after SELECTED:, else those of the last line that isn't blank; [0] if there are none."""
    t = col(text)
    chosen = F.regexp_extract(t, SELECTED, 1)
    lines = F.filter(F.split(t, "\n", -1), lambda x: strip(x) != "")
    last = F.coalesce(F.element_at(F.when(F.size(lines) > 0, lines), -1), F.lit(""))
    source = F.when(F.size(F.regexp_extract_all(chosen, F.lit("[0-9]+"), F.lit(0))) > 0, chosen).otherwise(last)
    found = indices(source, n)
    zero = F.array(F.lit(0).cast("bigint"))
    return F.when(t.isNotNull(), F.when(F.size(found) > 0, found).otherwise(zero))


def forced_expand(text: Column | str, n: Column | int, most: int = 5) -> Column:
    """The first ``most`` 0-based indices of numbers of up to three digits in a response; [0] if there are none in range."""
    n = F.lit(n) if isinstance(n, int) else n
    short = F.filter(F.regexp_extract_all(col(text), F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda w: w.rlike("^[0-9]{1,3}$"))
    found = F.filter(F.transform(short, lambda x: x.cast("bigint") - 1), lambda i: (i >= 0) & (i < n))
    found = F.slice(F.array_sort(F.array_distinct(found)), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0).cast("bigint")))


def even_stride_pick(selected: Column, n: Column, least: int) -> Column:
    """``selected`` filled up to ``least`` indices below ``n``, the added ones spread evenly over those left."""
    rest = F.array_except(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>")), selected)
    need = F.least(F.lit(least), n) - F.size(selected)
    every = F.size(rest)
    picks = F.transform(F.sequence(F.lit(0), need - 1), lambda k: F.get(rest, F.floor(k * every / F.nullif(need, F.lit(0))).cast("int")))
    full = F.when(need <= 0, selected).when(need >= every, F.concat(selected, rest)).otherwise(F.concat(selected, picks))
    return F.array_sort(full)


def sample_lines(text: Column | str) -> Column:
    """Struct (prefix, body, question) of a sample's lines: one is the body, two are body and question, else the first, the middle and the last."""
    lines = F.split(col(text), "\n", -1)
    n = F.size(lines)
    middle = F.array_join(F.slice(lines, 2, F.greatest(n - 2, F.lit(0))), "\n")
    return F.struct(
        F.when(n >= 3, F.element_at(lines, 1)).otherwise("").alias("prefix"),
        F.when(n >= 3, middle).otherwise(F.element_at(lines, 1)).alias("body"),
        F.when(n >= 2, F.element_at(lines, -1)).otherwise("").alias("question"),
    )


def duration_seconds(text: Column | str) -> Column:
    """Seconds of D-HH:MM:SS, HH:MM:SS or MM:SS; infinity for anything else."""
    p = r"^(?:(\d+)-)?(?:(\d+):)?(\d+):(\d+)$"
    part = lambda i: F.coalesce(F.regexp_extract(col(text), p, i).try_cast("double"), F.lit(0.0))
    return F.when(col(text).rlike(p), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)).otherwise(F.lit(float("inf")))


def contains_any_case(text: Column, needle: Column) -> Column:
    return F.contains(F.lower(text), F.lower(needle))


def score_match_all(answers: Column | str, response: Column | str) -> Column:
    """100 times the share of non-null answers that the response contains, whatever the case; 0 without answers or response."""
    real = F.filter(col(answers), lambda a: a.isNotNull())
    text = F.coalesce(col(response), F.lit(""))
    hits = F.size(F.filter(real, lambda a: contains_any_case(text, a)))
    return F.when(F.size(real) > 0, 100.0 * hits / F.size(real)).otherwise(F.lit(0.0))


def natural_key(name: Column | str) -> tuple[Column, Column, Column]:
    """Sort keys of names with numbers in them: the text without digits, the numbers, the name."""
    numbers = F.transform(F.regexp_extract_all(col(name), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("bigint"))
    return F.regexp_replace(col(name), r"\d+", ""), numbers, col(name)


def align_up(n: Column, to: int) -> Column:
    """The least multiple of ``to`` that is not below ``n``."""
    return F.ceil(n / to).cast("bigint") * to
