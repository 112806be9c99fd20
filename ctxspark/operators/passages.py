"""Passages of texts along sentences and paragraphs, and the prompts made of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark import constants as C
from ctxspark.functions import text as T
from ctxspark.functions.parsing import strip

SENTENCE_END = rf"(?<=[.!?])[{C.SPACE}]+"
PARAGRAPH_END = rf"\n[{C.SPACE}]*\n"


def sentences(text: Column | str) -> Column:
    """A text's sentences: cut at white space after ., ! or ?."""
    return F.split(T.col(text), SENTENCE_END, -1)


def paragraphs(text: Column | str) -> Column:
    return F.filter(F.split(T.col(text), PARAGRAPH_END, -1), lambda p: strip(p) != "")


def _fold(parts: list[str], sizes: list[int], limit: int, joint: str) -> list[str]:
    """Consecutive parts together while their sizes fit; a larger part stands alone."""
    out: list[list[str]] = []
    total = 0
    for part, n in zip(parts, sizes):
        if not out or total + n > limit:
            out.append([])
            total = 0
        out[-1].append(part)
        total += n
    return [p for p in (joint.join(x) for x in out) if p.strip()]


def _nested(paras: list[str], sizes: list[int], sents: list[list[str]], counts: list[list[int]], limit: int) -> list[str]:
    out, held, held_n = [], [], []
    for p, n, s, c in zip(paras, sizes, sents, counts):
        if n > limit:
            out += _fold(held, held_n, limit, "\n\n") + _fold(s, c, limit, " ")
            held, held_n = [], []
        else:
            held.append(p)
            held_n.append(n)
    return out + _fold(held, held_n, limit, "\n\n")


def _explode(df: DataFrame, fold) -> DataFrame:
    """(id, passage_no, passage) from rows whose columns after the id go to ``fold``; one row in, one fold, no groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nos, texts = [], [], []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                for i, p in enumerate(fold(*row[1:])):
                    ids.append(row[0])
                    nos.append(i)
                    texts.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int64()), pa.array(texts, pa.string())], names=["id", "passage_no", "passage"])

    return df.mapInArrow(run, "id bigint, passage_no bigint, passage string")


def chunk_sentences(texts: DataFrame, size: int = 450) -> DataFrame:
    """(id, passage_no, passage) of texts (id, text): whole sentences up to ``size`` tokens, joined by one space.

    A text within the size is one passage as it is, a longer sentence a passage of its own; blank passages are dropped.
    """
    s = sentences("text")
    df = texts.where("text is not null").select(F.col("id").cast("bigint"), "text", T.n_tokens("text").alias("n"), s.alias("s"), F.transform(s, T.n_tokens).alias("c"))
    return _explode(df, lambda text, n, s, c: [] if not text.strip() else [text] if n <= size else _fold(s, c, size, " "))


def chunk_paragraphs(texts: DataFrame, size: int = 450) -> DataFrame:
    """The same along paragraphs, joined by an empty line; a paragraph over the size is cut into sentences."""
    p = paragraphs("text")
    inner = F.transform(p, sentences)
    df = texts.where("text is not null").select(F.col("id").cast("bigint"), "text", T.n_tokens("text").alias("n"), p.alias("p"), F.transform(p, T.n_tokens).alias("c"), inner.alias("s"), F.transform(inner, lambda x: F.transform(x, T.n_tokens)).alias("sc"))
    return _explode(df, lambda text, n, p, c, s, sc: [] if not text.strip() else [text] if n <= size else _nested(p, c, s, sc, size))


def passages_of(chunks: DataFrame) -> DataFrame:
    """(id, passages): the passages of a text as one array in order; a text is bounded, so is its array."""
    return chunks.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("passage_no", "passage"))), lambda x: x["passage"]).alias("passages"))


def wrapped(text: Column) -> Column:
    return F.concat(F.lit(C.MEMORY_START), text, F.lit(C.MEMORY_END))


def _head(prefix: Column, gap: str) -> Column:
    p = F.rtrim(F.coalesce(prefix, F.lit("")))
    return F.when(p != "", F.concat(p, F.lit(gap))).otherwise("")


def _kept(passages: Column, line) -> Column:
    """Lines of the passages that aren't blank; each keeps its number."""
    lines = F.transform(passages, lambda p, i: F.when(strip(p) != "", line(p, i)))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def prompt_answer(prefix: Column, passages: Column, selected: Column, question: Column) -> Column:
    """Selected passages (0-based) as text, the others compressed, in their order, then the question."""
    line = lambda p, i: F.when(F.array_contains(selected, i.cast("bigint")), F.concat(F.lit("Passage "), i + 1, F.lit(" [open]:\n"), p)).otherwise(F.concat(F.lit("Passage "), i + 1, F.lit(" [compressed]: "), wrapped(p)))
    return F.concat(_head(prefix, "\n\n"), _kept(passages, line), F.lit("\n\n"), strip(question))


def prompt_compressed_only(prefix: Column, passages: Column, question: Column) -> Column:
    return prompt_answer(prefix, passages, F.array().cast("array<bigint>"), question)


def prompt_single_block(prefix: Column, body: Column, question: Column) -> Column:
    """The whole body in one region."""
    return F.concat(_head(prefix, "\n"), wrapped(F.concat(F.lit("\n"), body, F.lit("\n"))), F.lit("\n\n"), strip(question))


def prompt_triage(prefix: Column, passages: Column, question: Column, least: int = 1) -> Column:
    """Numbered compressed passages, the question and how to name the useful ones."""
    line = lambda p, i: F.concat(F.lit("Passage "), i + 1, F.lit(": "), wrapped(p))
    hint = f" When in doubt include a passage; name {least} or more unless fewer are surely enough." if least > 1 else ""
    ask = f"\n\nWhich passages may hold what the question needs?{hint} End with a line `SELECTED: <numbers>`."
    return F.concat(_head(prefix, "\n\n"), _kept(passages, line), F.lit("\n\n"), strip(question), F.lit(ask))


def prompt_round(prefix: Column, passages: Column, opened: Column, question: Column, rounds_left: Column) -> Column:
    """One round's prompt: compressed passages, the opened ones as text, the question, what may be answered.

    As long as nothing is open, a passage must be asked for first.
    """
    line = lambda p, i: F.concat(F.lit("Passage "), i + 1, F.lit(": "), wrapped(p))
    text = F.array_join(F.transform(opened, lambda i: strip(F.element_at(passages, (i + 1).cast("int")))), "\n\n")
    shown = F.when(F.size(opened) > 0, F.concat(F.lit("[Open passages]\n"), text, F.lit("\n\n"))).otherwise("")
    first = F.lit("Compressed passages can't be quoted. Ask for at least one now: `EXPAND: <numbers>`.")
    later = F.lit("Ask for more with `EXPAND: <numbers>`, or finish with `ANSWER: <answer>`.")
    left = F.concat(F.lit("Rounds left after this one: "), rounds_left.cast("string"), F.lit(".\n"))
    return F.concat(_head(prefix, "\n\n"), F.lit("[Passages, compressed]\n"), _kept(passages, line), F.lit("\n\n"), shown, F.lit("Question: "), strip(question), F.lit("\n\n"), left, F.when(F.size(opened) > 0, later).otherwise(first))


def tool_result(passages: Column, new: Column, rounds_left: Column) -> Column:
    """The newly opened passages, and the rounds left if there are any."""
    body = F.array_join(F.transform(F.array_sort(new), lambda i: F.concat(F.lit("Passage "), i + 1, F.lit(":\n"), strip(F.element_at(passages, (i + 1).cast("int"))))), "\n\n")
    return F.concat(F.lit("[Opened]\n"), body, F.when(rounds_left > 0, F.concat(F.lit("\n\nRounds left: "), rounds_left.cast("string"))).otherwise(""))


def chat_init(prefix: Column, passages: Column, question: Column, rounds: int = 5) -> Column:
    """System and first user message: rules, compressed passages, question."""
    line = lambda p, i: F.concat(F.lit("Passage "), i + 1, F.lit(": "), wrapped(p))
    rules = f"You read a long text in compressed passages. `EXPAND: <numbers>` opens passages, `ANSWER: <answer>` ends. Open at least one first. There are {rounds} rounds."
    user = F.concat(_head(prefix, "\n\n"), F.lit("[Passages, compressed]\n"), _kept(passages, line), F.lit("\n\nQuestion: "), strip(question))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(rules).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def python_tokens(text: str) -> int:
    """The number of tokens as the JVM counts them; for checks."""
    import regex

    return len(regex.findall(C.TOKEN_PATTERN, text))


