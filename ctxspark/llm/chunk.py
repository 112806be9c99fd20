"""Splitting oversized texts at natural boundaries.

Method: a hierarchy of separators, applied recursively: section, paragraph, sentence, word, character. A stretch over
the limit is cut at the boundaries of the next finer level only; the parts are then packed greedily into pieces of at
most ``limit`` characters, each beginning with at most ``overlap`` characters of the end of the piece before. A text is read
once for all its boundaries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.records import BASE, RAW

SPACE = " \t\r\n"
#: Levels of boundaries from coarse to fine; what stands at a boundary belongs to neither side.
LEVELS = ("section", "paragraph", "sentence", "word")
SECTION, PARAGRAPH, SENTENCE, WORD = range(4)
CHARACTER = "none"
#: White space, or the place behind a full stop of scripts that need none after it. Runs are matched whole, so a text is read once.
_GAP = re.compile(r"[ \t\r\n]+|(?<=[。！？])(?![ \t\r\n])")
_HEADING = re.compile(r"#{1,6} ")
_CLUSTER = regex.compile(r"\X")


def boundaries(text: str) -> list[tuple[int, int, int]]:
    """(start, end, level) of all boundaries in order.

    Two line feeds in one run of white space end a paragraph; before a heading they end a section. What is left of such a run on either side
    of them is a boundary of words or, behind a full stop, of sentences.
    """
    out = []
    for m in _GAP.finditer(text):
        s, e = m.span()
        stop = s > 0 and text[s - 1] in ".!?。！？"
        first = text.find("\n", s, e)
        last = text.rfind("\n", s, e)
        if first == last:
            out.append((s, e, SENTENCE if stop else WORD))
            continue
        if first > s:
            out.append((s, first, SENTENCE if stop else WORD))
        out.append((first, last + 1, SECTION if last + 1 == e and _HEADING.match(text, e) else PARAGRAPH))
        if e > last + 1:
            out.append((last + 1, e, WORD))
    return out


def _characters(text: str, start: int, end: int, limit: int) -> list[tuple[int, int]]:
    """Stretches of at most ``limit`` characters; characters that make up one sign stay together unless they exceed the limit."""
    if text[start:end].isascii():
        return [(i, min(i + limit, end)) for i in range(start, end, limit)]
    out, at, stop = [], start, start
    for m in _CLUSTER.finditer(text, start, end):
        s, e = m.span()
        if e - at > limit and stop > at:
            out.append((at, stop))
            at = stop
        while e - at > limit:
            out.append((at, at + limit))
            at += limit
        stop = e
    return out + ([(at, end)] if end > at else [])


def cut(text: str, limit: int, hard: int | None = None) -> tuple[list[tuple[int, int]], int]:
    """Stretches of at most ``limit`` characters that cover ``text`` but for white space at boundaries, and the finest level used.

    Only stretches over the limit are cut further, so the result is that of the coarsest levels that suffice. Between
    characters, ``hard`` (the limit by default) are taken at a time.
    """
    whole, level = [(0, len(text), boundaries(text))], -1
    while any(e - s > limit for s, e, _ in whole):
        level += 1
        finer = []
        for s, e, inner in whole:
            if e - s <= limit:
                finer.append((s, e, []))
            elif level == len(LEVELS):
                finer += [(a, z, []) for a, z in _characters(text, s, e, hard or limit)]
            else:
                at, held = s, []
                for b in inner:
                    if b[2] == level:
                        if b[0] > at:
                            finer.append((at, b[0], held))
                        at, held = b[1], []
                    else:
                        held.append(b)
                if e > at:
                    finer.append((at, e, held))
        whole = finer
        if level == len(LEVELS):
            break
    return [(s, e) for s, e, _ in whole], level


def _tail(text: str, start: int, end: int, overlap: int) -> int:
    """Where the last ``overlap`` characters of [start, end) begin, moved to the next word's start if there is one."""
    at = max(start, end - overlap)
    if at == start or at == end:
        return at
    while at < end and not (text[at - 1] in SPACE and text[at] not in SPACE):
        at += 1
    return at if at < end else max(start, end - overlap)


def pieces(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], str]:
    """(start, end, new) of each piece, where [start, new) repeats the end of the piece before, and the level of the cuts:
    the coarsest of paragraph, sentence and word whose boundaries, with those before, leave pieces of at most ``limit``, or none.

    Pieces are plain substrings. The new parts of all pieces, with nothing left out between them, are the whole text: white
    space at a boundary goes to the piece before it if it fits and else begins the next.
    """
    if len(text) <= limit:
        return [(0, len(text), 0)] if text else [], ""
    parts, finest = cut(text, limit, limit - overlap)
    out: list[tuple[int, int, int]] = []
    start = new = end = 0
    for s, e in [*parts, (len(text), len(text))]:
        while e - start > limit:
            stop = max(end, min(s, start + limit))
            if stop > new:
                out.append((start, stop, new))
                again = _tail(text, start, stop, min(overlap, max(0, limit - (e - stop))))
                new = end = stop
                start = again if e - again <= limit else stop
            else:
                start = new
        end = e
    out.append((start, end, new))
    return out, CHARACTER if finest >= len(LEVELS) else LEVELS[max(finest, PARAGRAPH)]


def split_items(items: DataFrame, limit: int = 3000, overlap: int = 200) -> DataFrame:
    """Pieces of all texts over the limit.

    ``items`` has (src, rec_id, item_no, text); other columns are ignored. Returns (src, rec_id, item_no, cut_at, piece_no, first,
    n_repeated, piece): ``piece_no`` counts from 0, ``first`` is the piece's place in the text and ``n_repeated`` how many of its
    characters the piece before has too. Texts of at most ``limit`` characters, nulls among them, have no rows: they need no cut.
    Characters are code points. The same item given twice gives its rows twice.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    schema = "src string, rec_id bigint, item_no bigint, cut_at string, piece_no int, first int, n_repeated int, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for src, rec, no, text in zip(*(c.to_pylist() for c in b.columns)):
                cuts, level = pieces(text, limit, overlap)
                for i, (s, e, new) in enumerate(cuts):
                    rows.append((src, rec, no, level, i, s, new - s, text[s:e]))
                if len(rows) >= 2000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return items.where(F.length("text") > limit).select("src", "rec_id", "item_no", "text").mapInArrow(run, schema)


def raw_items(raw: DataFrame, longer: int = 0) -> DataFrame:
    """(src, rec_id, item_no, text) of the message contents of raw_rows with more than ``longer`` characters."""
    some = raw.where("row_id is not null").where(F.exists("prompt", lambda m: F.length(m["content"]) > longer))
    return some.select(F.col("row_id").alias("rec_id"), F.posexplode(F.transform("prompt", lambda m: m["content"]))).select(F.lit(RAW).alias("src"), "rec_id", F.col("pos").cast("bigint").alias("item_no"), F.col("col").alias("text"))


def base_items(base: DataFrame, longer: int = 0) -> DataFrame:
    """(src, rec_id, item_no, text) of the memory strings of base_examples with more than ``longer`` characters."""
    some = base.where("example_id is not null").where(F.exists("memory_strings", lambda s: F.length(s) > longer))
    return some.select(F.col("example_id").alias("rec_id"), F.posexplode("memory_strings")).select(F.lit(BASE).alias("src"), "rec_id", F.col("pos").cast("bigint").alias("item_no"), F.col("col").alias("text"))
