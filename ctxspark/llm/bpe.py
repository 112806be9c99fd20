"""Encoding with byte-level BPE vocabularies of public tokenizers.

A text is cut into words by the tokenizer's pattern; each distinct word of a batch is encoded once and kept.

Method: contiguous rank arrays. A short word is one row of an array of parts with the rank of each adjacent pair beside
it; the row is scanned for its least rank, the boundary there is deleted, the rest moves up, and the two ranks next to it are
looked up again, until no pair has a rank. All new words of a batch of about equal length take these steps together, one array
operation for all rows. Words of more than ``SHORT`` bytes would be quadratic and take a heap over linked parts instead.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.vec import U, chunks
from ctxspark.plans.stage import spread

FOLDER = "/opt/tokenizers"
#: The pattern that goes with the byte-level vocabularies: fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 96
CHUNK = 1 << 19
KEPT_WORDS = 400_000
_NONE = np.int32(1 << 30)
_LOADED: dict[tuple[str, str], Encoder] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a vocabulary file with one base64 string and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes texts of one process; words seen before are looked up."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.split = regex.compile(PATTERN).findall
        self.byte = np.zeros(256, np.int32)
        pairs = {}
        for word, rank in ranks.items():
            if len(word) == 1:
                self.byte[word[0]] = rank
            for i in range(1, len(word)):
                a, b = ranks.get(word[:i]), ranks.get(word[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        # open addressing over a power of two with at most a quarter in use
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        for key, rank in pairs.items():
            at = self._slot(np.array([key], np.int64))[0]
            while self.slots[at] != -1:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.slots[at], self.ranks[at] = key, rank
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each adjacent pair of parts, or a number above all ranks."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.slots[at[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.ranks[at[open_[same]]]
            open_ = open_[~same & (held != -1)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_rows(self, parts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges all rows of ``parts``, of which ``n`` are in use, to their ends."""
        width = parts.shape[1]
        ranks = np.full(parts.shape, _NONE, np.int32)
        if width > 1:
            r, c = np.nonzero(np.arange(width - 1) < (n - 1)[:, None])
            ranks[r, c] = self.pair_ranks(parts[r, c], parts[r, c + 1])
        live = np.arange(len(parts))
        columns = np.arange(width)
        while len(live):
            at = ranks[live].argmin(1)
            best = ranks[live, at]
            going = best < _NONE
            live, at, best = live[going], at[going], best[going]
            if not len(live):
                break
            # delete the boundary after ``at``: later parts and ranks move one place up
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            p, k = parts[live[:, None], source], ranks[live[:, None], source]
            k[:, -1] = _NONE
            rows = np.arange(len(live))
            p[rows, at] = best
            n[live] -= 1
            parts[live] = p
            k[rows, at] = _NONE
            right = np.nonzero(at + 1 < n[live])[0]
            k[right, at[right]] = self.pair_ranks(p[right, at[right]], p[right, at[right] + 1])
            left = np.nonzero(at > 0)[0]
            k[left, at[left] - 1] = self.pair_ranks(p[left, at[left] - 1], p[left, at[left]])
            ranks[live] = k
        return parts, n

    def merge_long(self, word: bytes) -> list[int]:
        """The same for one long word: least rank first, leftmost among equals, in n log n."""
        part = [int(x) for x in self.byte[np.frombuffer(word, np.uint8)]]
        last = len(part)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        get = self.pairs.get
        heap = [(r, i, a, b) for i, (a, b) in enumerate(pairwise(part)) if (r := get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= last or part[j] != b:
                continue
            part[i], part[j] = rank, -1
            after[i] = after[j]
            if after[i] < last:
                before[after[i]] = i
                if (r := get(rank << 32 | part[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, part[after[i]]))
            if (h := before[i]) >= 0 and (r := get(part[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h, part[h], rank))
        return [x for x in part if x >= 0]

    def learn(self, words: list[str]) -> None:
        """Encodes new words and keeps them."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        done: list[np.ndarray | None] = [None] * len(raw)
        for i in np.nonzero(size > SHORT)[0].tolist():
            done[i] = np.array(self.merge_long(raw[i]), np.int32)
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= SHORT]
        for limit in (4, 6, 8, 12, 16, 24, 40, SHORT):
            low = np.searchsorted(size[order], 0 if limit == 4 else limit_before, "right")  # noqa: F821
            limit_before = limit
            rows = order[low : np.searchsorted(size[order], limit, "right")]
            for s in range(0, len(rows), 1 << 14):
                group = rows[s : s + (1 << 14)]
                n = size[group].copy()
                parts = np.zeros((len(group), limit), np.int32)
                parts[np.arange(limit) < n[:, None]] = self.byte[np.frombuffer(b"".join([raw[i] for i in group]), np.uint8)]
                parts, n = self.merge_rows(parts, n)
                for i, row in zip(group.tolist(), np.split(parts[np.arange(limit) < n[:, None]], np.cumsum(n)[:-1])):
                    done[i] = row
        n = np.fromiter(map(len, done), np.int64, len(done))
        first, total = len(self.number), int(n.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(words) > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        self.pool[self.used : self.used + total] = np.concatenate(done)
        self.begin[first : first + len(words)] = self.used + np.cumsum(n) - n
        self.length[first : first + len(words)] = n
        self.used += total
        self.number.update(zip(words, range(first, first + len(words))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's begin (one more than there are texts)."""
        words, counts = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = self.split(t)
            counts[i] = len(found)
            words += found
        if len(self.number) > KEPT_WORDS:
            self.forget()
        new = set(words).difference(self.number)
        if new:
            self.learn(list(new))
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        n = self.length[at]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(self.begin[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, bounds


def encoder(name: str = "byte_bpe_50k", folder: str = FOLDER) -> Encoder:
    """The encoder of a vocabulary file, loaded once in a process."""
    if (name, folder) not in _LOADED:
        _LOADED[name, folder] = Encoder(read_ranks(str(Path(folder) / f"{name}.tiktoken")))
    return _LOADED[name, folder]


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def encode_texts(df: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``keep`` columns and ``ids``, the token ids of each row's ``text``.

    No special tokens are added, and strings of markers in a text are ordinary text. Null and empty texts have an empty
    list. Rows stay as they are, repeated ones too; other columns are dropped, so a column named ids or text in the input
    clashes with nothing unless it is in ``keep``. Texts of any length are encoded whole.
    """
    fields = [f"`{df.schema[c].name}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(name, folder)
        for b in batches:
            texts = _texts(b.column(len(keep)))
            for s, t in chunks([len(x) for x in texts], CHUNK):
                ids, bounds = e.encode(texts[s:t])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(i).slice(s, t - s) for i in range(len(keep))] + [lists], names=[*keep, "ids"])

    return spread(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, ", ".join([*fields, "ids array<int>"]))


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``keep`` columns and ``n_tokens``; nulls and empty texts have 0."""
    fields = [f"`{df.schema[c].name}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(name, folder)
        for b in batches:
            texts = _texts(b.column(len(keep)))
            for s, t in chunks([len(x) for x in texts], CHUNK):
                _, bounds = e.encode(texts[s:t])
                yield pa.RecordBatch.from_arrays([b.column(i).slice(s, t - s) for i in range(len(keep))] + [pa.array(np.diff(bounds))], names=[*keep, "n_tokens"])

    return spread(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, ", ".join([*fields, "n_tokens bigint"]))
