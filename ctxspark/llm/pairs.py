"""Broken prompt and response pairs.

Method: prompt and response are aligned by their words. Shingle containment finds responses made of the prompt's words, and the longest common
subsequence how much of the question comes back in order. Sentences are aligned with templates of refusals (``refusal``), languages compared by
profiles of characters (``language``). A response breaks off if brackets, fences, JSON values or lists are open, if its last sentence has no end
after others that have, or if its last word cannot be the end of an answer: by a lexicon of all responses, it is only the beginning of other
words, or a word that sentences hardly ever end with. The first that holds of empty, refusal, truncated inside a structure, copy, language and truncated
is the defect.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm import language as L
from ctxspark.llm.refusal import SENTENCE, is_refusal
from ctxspark.plans.stage import spread, written

CONTINUAL = "NA_string_only"
_WORD = re.compile(r"[^\W_]+")
_MARKER = re.compile(r"<\|\w*\|>")
_REGION = re.compile(r"<\|memory_start\|>.*?<\|memory_end\|>", re.DOTALL)
_FENCED = re.compile(r"```.*?(?:```|$)", re.DOTALL)
#: Shares of words from which a response is the question again, and for a lexicon how often a word must be seen and how rarely it ends sentences.
COPIED, OWN_ORDER, SEEN, RARELY = 0.6, 0.85, 30, 0.01
# What introduces a question that is given back, and answers to yes-or-no questions.
_INTRODUCES = frozenset("question frage pregunta pergunta domanda vraag fråga asked you vous sie usted você".split())
_YES_NO = frozenset("yes no sí si não sim oui non ja nein ne nee tak nie nej да нет".split())
# Words that want another after them: articles, determiners, prepositions, conjunctions, auxiliaries.
WANTS_MORE = frozenset("""
the a an of and or to with from into than because although while whose my your our their its every if unless until between towards onto via per whether
der die das dem den des ein eine einen einem einer und oder mit von vom zu zum zur im für bei nach dass weil wenn als
el la los las un una unos unas de del al y o en con por para que porque cuando entre desde su sus
le les une des du et ou dans pour par avec sur au aux que qui parce quand entre sans chez leur
os um uma uns umas do da dos das e em no na nos nas com por para que porque quando entre
il lo gli uno di della dei ed nel nella con per che perché quando tra
het een van en of met voor op bij naar dat omdat als och att med från till av som eller och w z na do i że dla от и в на с по для что из к
""".split())


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def common(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence."""
    at: dict[str, int] = {}
    for j, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    for w in a:
        u = row & at.get(w, 0)
        row = ((row + u) | (row - u)) & full
    return len(b) - row.bit_count()


def contained(a: list[str], b: list[str], k: int = 2) -> float:
    """The share of ``a``'s distinct runs of ``k`` words that ``b`` has."""
    x, y = set(zip(*(a[i:] for i in range(k)))), set(zip(*(b[i:] for i in range(k))))
    return len(x & y) / len(x) if x else 0.0


def question_of(last: str) -> str:
    """The question in a message: its text outside memory regions, or the last paragraph of that."""
    outside = _REGION.sub("\n\n", last) if "<|memory_start|>" in last else last
    parts = [p for p in (x.strip() for x in re.split(r"\n[ \t\r\n]*\n", outside)) if _WORD.search(p)]
    return parts[-1] if parts else outside


def is_copy(last: str, target: str) -> bool:
    """Nothing but the last message's words, in its order, and most of the question."""
    t, q = words(_MARKER.sub(" ", target)), words(question_of(last))
    if not t or not q:
        return False
    if t == q:
        return True
    if t[-1] in WANTS_MORE and t[-1] != q[-1]:
        return False  # it goes on to say something
    known = set(whole := words(_MARKER.sub(" ", last)))
    new = [w for w in t if w not in known]
    # what is new may introduce the question, be misspelt or a small word, but not say something
    if any(w in _YES_NO for w in new[:1]) or sum(w not in _INTRODUCES for w in new) * 10 > len(t):
        return False
    body = q
    for cut in SENTENCE.split(question_of(last)):  # the question may come back without the words that lead to it
        w = words(cut)
        if w and ("?" in cut or len(w) * 2 >= len(q)):
            body = w
    most = max(common(t, q) / len(q), common(t, body) / len(body))
    if len(t) >= len(q):
        most = max(most, common(t, whole) / len(whole))
    return most >= COPIED and (contained(t, whole) >= COPIED or common(t, whole) >= OWN_ORDER * len(t))


def is_foreign(last: str, system: str, target: str) -> bool:
    """In another language than the question, unasked. Code and JSON are in none."""
    said = _FENCED.sub(" ", _MARKER.sub(" ", target))
    if said.lstrip()[:1] in ("{", "["):
        return False
    question = question_of(last)
    return L.differ(said, question) is not None and L.differ(said, question, L.asked(_REGION.sub(" ", last) + " " + system)) is not None


_BULLET = re.compile(r"^[ \t]*([-*•]|\d+[.)])([ \t]+|$)")
_NUMBER = re.compile(r"(?<![\w,.])(\d{1,2})(?![\w,.])")
_ENDS = set(".!?。！？\"”’')]}»`")
_STOPS = ".!?。！？"


def _balanced(text: str) -> bool:
    """Whether all brackets outside of strings are closed and no string is open."""
    open_: list[str] = []
    quote = ""
    at = 0
    while at < len(text):
        c = text[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif c == '"':
            quote = c
        elif c in "([{":
            open_.append(c)
        elif c in ")]}" and open_:
            open_.pop()
        at += 1
    return not open_ and not quote


def _items_cut(lines: list[str], question: str) -> bool:
    """Whether a list breaks off: a bare bullet, fewer items than asked, or a last item unlike the others."""
    items = [_BULLET.sub("", x).strip() for x in lines]
    if not items[-1]:
        return True
    asked = _NUMBER.findall(question)
    if asked and len(items) < int(asked[0]):
        return True
    full = [x for x in items[:-1] if x]
    if full and all(x[-1] in _STOPS for x in full) and items[-1][-1] not in _STOPS:
        return True
    if items[-1][-1] in _STOPS:
        return False
    n, others = len(items[-1].split()), [len(x.split()) for x in full]
    return len(others) > 1 and n < min(others) == max(others) or bool(others) and n < min(others) - 1


def word_cut(last: str, text: str) -> bool | str:
    """Whether a text breaks off inside its last word, as far as the prompt tells; else the word, for the lexicon to tell."""
    w = words(text)
    if len(w) < 2 or not text[-len(w[-1]) :].islower():
        return False  # one word, a name or a number is an answer
    theirs = set(words(last))
    if w[-1] in theirs:
        return False if w[-1] not in L.ANY_COMMON else w[-1]
    return True if any(x.startswith(w[-1]) for x in theirs) else w[-1]


def structure_cut(last: str, target: str) -> bool | str | None:
    """Whether a code block, JSON value or list breaks off, or the last word of a list if the lexicon has to tell; None if the text is none of them."""
    text = _MARKER.sub("", target).strip()
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        return not _balanced(text.rsplit("```", 2)[-2])
    if text[:1] in ("{", "["):
        try:
            json.loads(text)
            return False
        except ValueError:
            return not _balanced(text)
    lines = [x for x in text.split("\n") if x.strip()]
    bullets = [x for x in lines if _BULLET.match(x)]
    question = question_of(last)
    if bullets and _BULLET.match(lines[-1]) and (len(lines) > 1 or len(words(text)) > 1 and _NUMBER.search(question) is not None):
        return _items_cut(bullets, question) or (word_cut(last, text) if text[-1].isalpha() else False)
    return None


def sentence_cut(last: str, target: str, fragment_words: int) -> bool | str:
    """Whether the last sentence breaks off, or the last word if the lexicon has to tell."""
    text = _MARKER.sub("", target).strip()
    while text and not (text[-1].isalnum() or text[-1] in _ENDS or text[-1] in "-–—,;:([{*•…"):
        text = text[:-1].rstrip()  # emoji and the like after the end
    if not text or text[-1] in _ENDS and not text.endswith("..."):
        return False
    if text[-1] in "…,;:-–—([{*•" or text.endswith("..."):
        return True
    w = words(text)
    # no end of a sentence: a fragment is a complete answer, but not after sentences, nor if it wants another word
    if len([s for s in SENTENCE.split(text) if words(s)]) > 1 or len(w) > fragment_words or len(w) > 1 and w[-1] in WANTS_MORE and text[-len(w[-1]) :].islower():
        return True
    return word_cut(last, text)


def defect_of(last: str | None, system: str | None, target: str | None, fragment_words: int = 16) -> tuple[str | None, str | None]:
    """The defect of one pair or None, and the last word if its being truncated depends on the lexicon."""
    last, system = last or "", system or ""
    plain = _MARKER.sub(" ", target or "")
    if not _WORD.search(plain):
        return "empty", None
    if is_refusal(plain):
        return "refusal", None
    cut = structure_cut(last, target)
    if cut is True:
        return "truncated", None
    if is_copy(last, target):
        return "copy", None
    if is_foreign(last, system, target):
        return "language", None
    if cut is None:
        cut = sentence_cut(last, target, fragment_words)
    if isinstance(cut, str):
        return None, cut
    return ("truncated", None) if cut else (None, None)


def lexicon(targets: DataFrame) -> DataFrame:
    """(word, n, n_last) of the words of ``targets`` (target) but for each one's last: how often they stand in them, and how often at a sentence's end."""
    low = targets.where("target is not null").select(F.lower("target").alias("t"))
    each = F.expr(r"regexp_extract_all(t, '[\\p{L}\\p{N}]+(?=[^\\p{L}\\p{N}]+[\\p{L}\\p{N}]|[^\\p{L}\\p{N}]*[.!?。！？])', 0)")
    ends = F.expr(r"regexp_extract_all(t, '([\\p{L}\\p{N}]+)[^\\p{L}\\p{N}.!?。！？]*[.!?。！？]', 1)")
    every = low.select(F.explode(each).alias("word"), F.lit(0).alias("last")).unionByName(low.select(F.explode(ends).alias("word"), F.lit(1).alias("last")))
    return every.groupBy("word").agg(F.sum(1 - F.col("last")).alias("n"), F.sum("last").alias("n_last"))


def defective_pairs(rows: DataFrame, fragment_words: int = 16) -> DataFrame:
    """(row_id, defect): the defective ones among chat rows.

    ``rows`` has (row_id, prompt, target); other columns are ignored. Chat rows have at least one message and another target
    than the sign of continual rows; a null target is an empty one. The last message with its null content read as empty is what
    the target answers; system messages may ask for a language. Null ids, null and empty prompts have no rows; a row
    given twice counts once. A response without an end of a sentence and of more than ``fragment_words`` words is a sentence and broken off; a shorter one is
    judged by its last word.
    """
    chat = rows.where(F.col("row_id").isNotNull() & (F.size("prompt") > 0) & (F.col("target").isNull() | (F.col("target") != CONTINUAL)))
    system = F.array_join(F.transform(F.filter("prompt", lambda m: m["role"] == "system"), lambda m: m["content"]), "\n")
    pairs = chat.select(F.col("row_id").cast("bigint").alias("row_id"), F.get("prompt", F.size("prompt") - 1)["content"].alias("last"), system.alias("system"), "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = b.column(0).to_pylist(), [defect_of(*x, fragment_words) for x in zip(*(c.to_pylist() for c in b.columns[1:]))]
            keep = [i for i, d in enumerate(found) if d != (None, None)]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), *(pa.array([found[i][k] for i in keep], pa.string()) for k in (0, 1))], names=["row_id", "defect", "word"])

    found = written(spread(pairs).mapInArrow(run, "row_id bigint, defect string, word string").distinct(), "pairs")
    # what the lexicon says of the words in question: not more of them travel than there are
    asked = found.where("defect is null").select("word").distinct()
    known = written(lexicon(chat.select("target")), "pairs-lexicon")
    counts = known.join(asked, "word")
    beginnings = F.explode(F.expr("transform(sequence(2, length(word) - 1), i -> substring(word, 1, i))"))
    longer = known.where("length(word) > 2").select(beginnings.alias("word"))
    begins = longer.join(asked, "word", "left_semi").distinct().withColumn("begins", F.lit(True))
    judged = found.where("defect is null").join(counts, "word", "left").join(begins, "word", "left")
    # common words only: others may be rare at ends by what the texts are about
    never_last = F.col("word").isin(sorted(L.ANY_COMMON)) & (F.col("n") >= SEEN) & (F.col("n_last") < F.col("n") * RARELY)
    cut = judged.where(F.when(F.col("n").isNull(), F.col("begins").isNotNull()).otherwise(never_last))
    return found.where("defect is not null").select("row_id", "defect").unionByName(cut.select("row_id", F.lit("truncated").alias("defect")))
