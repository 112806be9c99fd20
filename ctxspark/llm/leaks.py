"""Evaluation texts leaking into training text.

Method: a BM25 inverted index of the test items, asked by every training passage with block-max WAND. A test passage is indexed as windows of
2r - 1 words that begin every r words, so that each run of r words lies in one; a training text asks in passages that overlap by r - 1
words. Terms are short runs of ``TERM`` words. A window's threshold is the least BM25 score that any of its r-runs has, so no
window that shares an r-run with a passage scores below it. Impacts are divided by their window's threshold, so that the threshold is 1
for all and the bounds of lists and blocks are sharp.

All passages of a batch are asked in step: each has a cursor in the posting list of each of its terms. The lists of a passage are ordered by
the windows at their cursors; the pivot is the first at which the summed bounds of the lists reach 1. Windows before it can't score enough and
are passed over. If the maxima of the blocks that hold the pivot don't reach 1 either, the cursors go past the end of the nearest block; else they go to the
pivot and it is scored. Windows that score enough are verified: an r-run in common, word by word; then the question and the answers.

The index is made from items of a bounded number of characters, broadcast, and asked by every training text; more items take several turns.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.vec import U, Words, chunks, mix
from ctxspark.plans.prefix import running
from ctxspark.plans.stage import spread, written

K1, B = 1.2, 0.75
CHUNK = 1 << 20
PASSAGE_WORDS = 64
TERM = 3
#: Postings in a block.
BLOCK = 64
#: Characters of test items (passages, questions, answers) in one index; it takes about 30 bytes for each.
INDEX_CHARS = 8 << 20
#: Words of a test passage in one row; longer ones are indexed in parts.
PART_WORDS = 50_000
START, END = "<|memory_start|>", "<|memory_end|>"
_REGION = re.compile(re.escape(START) + "(.*?)" + re.escape(END), re.DOTALL)
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def passages(prompt: str | None) -> list[str]:
    """The texts between memory markers; an unclosed or missing marker gives none."""
    return _REGION.findall(prompt or "")


def _plain(text: str | None) -> str:
    return " " + " ".join(words(text or "")) + " "


class Index:
    """Windows of test passages as arrays that travel by broadcast. ``parts`` are (item_id, passage, question, answers), all as words with single spaces."""

    def __init__(self, parts: list[tuple[int, str, str, list[str]]], run: int):
        self.run, self.term = run, min(TERM, run)
        self.item_ids = np.array([i for i, _, _, _ in parts], np.int64)
        self.questions, self.answers = [q for _, _, q, _ in parts], [a for _, _, _, a in parts]
        # equal passages are indexed once
        self.texts = list(dict.fromkeys(p for _, p, _, _ in parts))
        number = {p: i for i, p in enumerate(self.texts)}
        self.owners: dict[int, list[int]] = defaultdict(list)
        for n, (_, p, _, _) in enumerate(parts):
            self.owners[number[p]].append(n)
        docs: list[np.ndarray] = []
        owner: list[int] = []
        w = Words(self.texts)
        h, at = w.runs(self.term)
        of = w.text[at]
        first = np.searchsorted(of, np.arange(len(self.texts) + 1))
        for n in range(len(self.texts)):
            terms = h[first[n] : first[n + 1]]  # the terms of the passage by their first word
            for s in range(0, int(w.count[n]) - run + 1, run):
                docs.append(terms[s : s + 2 * run - self.term])
                owner.append(n)
        self.owner = np.array(owner, np.int64)
        h, at = w.runs(run)
        self.grams = np.unique(self.gram_keys(h, w.text[at]))
        self._weigh(docs)

    @staticmethod
    def gram_keys(h: np.ndarray, text: np.ndarray) -> np.ndarray:
        return mix(h ^ mix(text.astype(U) + U(1)))

    def _weigh(self, docs: list[np.ndarray]) -> None:
        inside = self.run - self.term + 1  # terms of an r-run
        count = len(docs)
        self.terms, df = np.unique(np.concatenate([np.unique(d) for d in docs] or [np.zeros(0, U)]), return_counts=True)
        idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
        mean = sum(map(len, docs)) / max(1, count)
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for d, doc in enumerate(docs):
            number = np.searchsorted(self.terms, doc)
            t, back, tf = np.unique(number, return_inverse=True, return_counts=True)
            weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(doc) / mean))
            least = math.inf
            for s in range(len(doc) - inside + 1):
                least = min(least, float(weight[np.unique(back[s : s + inside])].sum()))
            rows.append((t, np.full(len(t), d), weight / (least * (1 - 1e-5))))
        empty = np.zeros(0, np.int64)
        t, doc, impact = (np.concatenate(x) for x in zip(*rows)) if rows else (empty, empty, empty.astype(float))
        order = np.lexsort((doc, t))
        t, self.doc, self.impact = t[order], doc[order].astype(np.int32), impact[order].astype(np.float32)
        self.start = np.searchsorted(t, np.arange(len(self.terms) + 1))
        self.key = t * (count + 1) + self.doc  # postings by term and window
        self.bound = np.maximum.reduceat(self.impact, self.start[:-1]) if len(t) else self.impact
        # blocks of postings: the place behind each and its greatest impact
        n_blocks = -(-np.diff(self.start) // BLOCK)
        self.block_start = np.concatenate([[0], np.cumsum(n_blocks)])
        first = np.repeat(self.start[:-1], n_blocks) + (np.arange(self.block_start[-1]) - np.repeat(self.block_start[:-1], n_blocks)) * BLOCK
        self.block_max = np.maximum.reduceat(self.impact, first) if len(t) else self.impact
        self.block_last = self.doc[np.concatenate([first[1:], [len(t)]]).astype(np.int64)[: len(first)] - 1] if len(t) else self.doc

    def nbytes(self) -> int:
        arrays = sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))
        return arrays + sum(map(len, self.texts)) + sum(map(len, self.questions)) + sum(len(a) for x in self.answers for a in x)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The number of each term, or -1."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def wand(self, query: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(query, window) of all windows whose impacts of the query's distinct terms sum to 1, and how many were scored."""
        count, bound, scored = len(self.owner), self.bound[term], 0
        cursor, end = self.start[term], self.start[term + 1]
        out_q, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(query):
            doc = self.doc[cursor].astype(np.int64)
            order = np.lexsort((doc, query))
            query, term, bound, cursor, end, doc = (x[order] for x in (query, term, bound, cursor, end, doc))
            first = np.nonzero(np.concatenate([[True], query[1:] != query[:-1]]))[0]
            size = np.diff(np.concatenate([first, [len(query)]]))
            total = np.cumsum(bound, dtype=np.float64)
            total -= np.repeat(total[first] - bound[first], size)
            enough = total >= 1
            last = np.repeat(np.logical_or.reduceat(enough, first), size)  # queries whose bounds can't reach 1 are done
            query, term, bound, cursor, end, doc, enough = (x[last] for x in (query, term, bound, cursor, end, doc, enough))
            if not len(query):
                break
            first = np.nonzero(np.concatenate([[True], query[1:] != query[:-1]]))[0]
            size = np.diff(np.concatenate([first, [len(query)]]))
            of = np.repeat(np.arange(len(first)), size)
            # the first place of each query at which the bounds are enough
            place = np.where(enough, np.arange(len(query)), len(query))
            pivot = doc[np.minimum.reduceat(place, first)]
            upto = doc <= pivot[of]
            # the block of each list that holds the pivot
            block = self.block_start[term] + (self._seek(term, pivot[of]) - self.start[term]) // BLOCK
            ended = (block >= self.block_start[term + 1]) | ~upto
            block = np.minimum(block, len(self.block_max) - 1)
            reach = np.add.reduceat(np.where(ended, 0, self.block_max[block]), first)
            skip = reach < 1
            beyond = np.where(ended, count, self.block_last[block].astype(np.int64) + 1)
            beyond = np.minimum(np.minimum.reduceat(np.where(upto, beyond, count), first), np.minimum.reduceat(np.where(upto, count, doc), first))
            # at the pivot with all lists up to it: score and go on; else only move there
            ready = np.minimum.reduceat(np.where(upto, doc, count), first) == pivot
            impact = np.add.reduceat(np.where(upto & (doc == pivot[of]), self.impact[cursor], 0), first)
            score = ready & ~skip
            scored += int(score.sum())
            good = score & (impact >= 1)
            out_q.append(query[first[good]])
            out_d.append(pivot[good])
            target = np.where(skip, np.maximum(beyond, pivot + 1), np.where(ready, pivot + 1, pivot))
            cursor = np.where(upto, np.maximum(cursor, self._seek(term, target[of])), cursor)
            left = cursor < end
            query, term, bound, cursor, end = (x[left] for x in (query, term, bound, cursor, end))
        return np.concatenate(out_q), np.concatenate(out_d), scored

    def _seek(self, term: np.ndarray, window: np.ndarray) -> np.ndarray:
        """The place of the first posting of each term at or behind a window; its list's end if there is none."""
        return np.searchsorted(self.key, term * (len(self.owner) + 1) + window)

    def ask(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, part, matching runs) for all texts that share a run of words with a part, by their places in the lists."""
        if not len(self.owner):
            return []
        run, w = self.run, Words(texts)
        h, at = w.runs(self.term)
        term = self.lookup(h)
        # an r-run has so many known terms in succession: others ask nothing
        inside = run - self.term + 1
        known = np.cumsum(np.concatenate([[0], term >= 0]))
        starts = np.nonzero(known[inside:] - known[:-inside] == inside)[0]
        starts = starts[(at[starts + inside - 1] - at[starts] == inside - 1) & (w.text[at[starts]] == w.text[at[starts + inside - 1]])]
        live = np.zeros(len(term) + 1, np.int32)
        np.add.at(live, starts, 1)
        np.add.at(live, starts + inside, -1)
        live = np.nonzero(np.cumsum(live)[:-1] > 0)[0]
        if not len(live):
            return []
        first = np.cumsum(w.count) - w.count
        stride = PASSAGE_WORDS - run + 1
        local, text = at[live] - first[w.text[at[live]]], w.text[at[live]]
        k = local // stride
        also = (local % stride < run - self.term) & (k > 0)  # the passage before has it too
        of = np.concatenate([text, text[also]]) * (int(w.count.max()) + 1) + np.concatenate([k, k[also] - 1])
        pairs = np.unique(np.stack([of, np.concatenate([term[live], term[live][also]])], 1), axis=0)
        query, doc, _ = self.wand(pairs[:, 0], pairs[:, 1])
        if not len(query):
            return []

        # verification: the runs of the passages in common with the window's passage
        asked = np.unique(np.stack([query, self.owner[doc]], 1), axis=0)
        text, k, passage = asked[:, 0] // (int(w.count.max()) + 1), asked[:, 0] % (int(w.count.max()) + 1), asked[:, 1]
        begin = first[text] + k * stride
        length = np.minimum(begin + stride, first[text] + w.count[text] - run + 1) - begin  # runs that begin in this passage and not in the next
        gram, run_at = w.runs(run)
        lo = np.searchsorted(run_at, begin)
        n = np.searchsorted(run_at, begin + np.maximum(length, 0)) - lo
        which = np.repeat(np.arange(len(asked)), n)
        where = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        keys = self.gram_keys(gram[where], passage[which])
        hit = self.grams[np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)] == keys
        total: Counter = Counter()
        lowered: dict[int, str] = {}
        for i, p in zip(which[hit].tolist(), run_at[where[hit]].tolist()):
            j = int(text[i])
            plain = lowered.setdefault(j, texts[j].lower())
            base = int(w.flat.starts[j])
            shared = " " + " ".join(plain[b - base : e - base] for b, e in zip(w.begin[p : p + run].tolist(), w.end[p : p + run].tolist())) + " "
            if shared in self.texts[passage[i]]:
                total[j, int(passage[i])] += 1
        return sorted((j, part, c) for (j, p), c in total.items() for part in self.owners[p])


def item_parts(items: DataFrame, run: int) -> DataFrame:
    """(item_id, part, passage, question, answers, chars): what is indexed of the items, a long passage in parts that overlap by run - 1 words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, prompt, answers in zip(*(c.to_pylist() for c in b.columns)):
                question = _plain(prompt.rpartition(END)[2]) if prompt and END in prompt else "  "
                known = [x for x in map(_plain, answers or []) if x.strip()]
                for text in passages(prompt):
                    w = words(text)
                    for s in range(0, len(w) - run + 1, PART_WORDS):
                        passage = " " + " ".join(w[s : s + PART_WORDS + run - 1]) + " "
                        rows.append((item, len(rows), passage, question, known, len(passage) + len(question) + sum(map(len, known))))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["item_id", "part", "passage", "question", "answers", "chars"])

    return items.mapInArrow(cut, "item_id bigint, part bigint, passage string, question string, answers array<string>, chars bigint")


def leaked_items(texts: DataFrame, items: DataFrame, run: int = 13, index_chars: int = INDEX_CHARS) -> DataFrame:
    """(src, rec_id, item_id, n_runs, has_question, has_answer): every text with at least ``run`` consecutive words of an item's passage.

    ``texts`` has (src, rec_id, text), ``items`` (item_id, prompt, answers); other columns are ignored. Words are maximal runs of
    letters and digits of the lower-cased text; an item's passage is what its memory markers enclose, its question what follows
    the last one. ``n_runs`` counts the places of the text where such a run begins, for each passage of the item; ``has_question`` and ``has_answer`` say
    whether the text holds the question's words and any answer's. Null ids, null texts and items without a passage of ``run`` words have no rows; a
    record given twice is one, items with one passage are reported each. One index takes ``index_chars`` characters of items and one part more at most;
    a part whose question and answers alone exceed that raises an error.
    """
    spark = texts.sparkSession
    items = items.where("item_id is not null").select("item_id", "prompt", "answers").dropDuplicates(["item_id"])
    texts = spread(texts.where("rec_id is not null and text is not null").select("src", "rec_id", "text"))
    parts = written(item_parts(items, run), "leak-items")
    sums = parts.agg(F.sum("chars").alias("total"), F.max("chars").alias("most")).collect()[0]
    if (sums["most"] or 0) > index_chars + 8 * PART_WORDS * 4:
        raise ValueError("the question and answers of an item are too long for an index")
    turns = -(-(sums["total"] or 0) // index_chars)
    if turns > 1:
        numbered = running(parts.select("item_id", "part", "chars").withColumn("all", F.lit(0)), ["all"], ["item_id", "part"], {"sum": F.col("chars")})
        turn = numbered.select("item_id", "part", ((F.col("sum") - 1) / index_chars).cast("bigint").alias("turn"))
        parts = written(parts.join(turn, ["item_id", "part"]), "leak-turns")
    schema = "src string, rec_id bigint, item_id bigint, part bigint, n_runs bigint, has_question boolean, has_answer boolean"
    found = spark.createDataFrame([], schema) if not turns else None
    for t in range(turns):
        mine = (parts.where(F.col("turn") == t) if turns > 1 else parts).orderBy("item_id", "part").select("item_id", "part", "passage", "question", "answers")
        rows = mine.collect()  # index_chars and one part at most
        index = Index([(r[0], r[2], r[3], r[4]) for r in rows], run)
        shared = spark.sparkContext.broadcast((index, np.array([r[1] for r in rows], np.int64)))
        one = texts.mapInArrow(_asking(shared), schema)
        found = one if found is None else found.unionByName(one)
    once = found.groupBy("src", "rec_id", "item_id", "part").agg(F.max("n_runs").alias("n_runs"), F.max("has_question").alias("q"), F.max("has_answer").alias("a"))
    return once.groupBy("src", "rec_id", "item_id").agg(F.sum("n_runs").alias("n_runs"), F.max("q").alias("has_question"), F.max("a").alias("has_answer"))


def _asking(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, number = shared.value
        for b in batches:
            src, ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for s, e in chunks([len(t) for t in texts], CHUNK):
                found = ix.ask(texts[s:e])
                if not found:
                    continue
                plain = {j: _plain(texts[s + j]) for j in {j for j, _, _ in found}}
                rows = [(src[s + j], ids[s + j], int(ix.item_ids[i]), int(number[i]), c, bool(ix.questions[i].strip()) and ix.questions[i] in plain[j], any(a in plain[j] for a in ix.answers[i])) for j, i, c in found]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["src", "rec_id", "item_id", "part", "n_runs", "has_question", "has_answer"])

    return run
