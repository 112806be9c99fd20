"""Exchanges of many small keys as packed blobs instead of rows.

A task packs (key, owner, value) triples into one blob for each bucket of keys; Spark shuffles the
blobs by bucket and a reducer works on flat arrays. Owners are 64-bit ids and are sent once per blob.
A key costs 6 to 14 bytes of shuffle and no per-row work in the JVM.

Up to ``LEVEL`` buckets are reached in one exchange. More of them would leave few keys in each blob, so the first exchange
then goes to ``LEVEL`` coarse buckets, where the blobs are packed anew for the fine ones: a task holds few of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U = np.uint64
SCHEMA = "bucket int, kind int, n int, keys binary, owner_ids binary, owners binary, vals binary, tags binary"
LEVEL = 4096
#: Tasks of an exchange at most; buckets bound what a task holds at a time, and a task may have several.
TASKS = 20_000
_SCRAMBLE = U(0x9E3779B97F4A7C15)
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in _NAMES[3:])])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of equal key ranges by the upper 24 bits; the lower 32 go into the blob."""
    return ((keys >> U(40)) * U(buckets) >> U(24)).astype(np.int32)


def pack(kind: int, buckets: int, keys: np.ndarray, owners: np.ndarray, vals: np.ndarray | None = None, wide: bool = False, keyless: bool = False, tags: np.ndarray | None = None) -> list[tuple]:
    """Rows of SCHEMA for the triples, at most one for each bucket.

    Owners are sent once for each run of triples, so triples should come grouped by owner; ``tags``, 64 bits that are the same for all triples of an
    owner, go with them. ``wide`` keeps all 64 bits of a key instead of 32 and the bucket; ``keyless`` uses keys only to choose the bucket.
    """
    if not len(keys):
        return []
    b = bucket_of(keys, buckets)
    order = np.argsort(b, kind="stable")
    b, owners = b[order], owners[order]
    keys = np.zeros(0, np.uint8) if keyless else keys[order] if wide else (keys[order] & U(0xFFFFFFFF)).astype(np.uint32)
    vals = None if vals is None else vals[order].astype(np.uint32)
    cuts = np.concatenate([[0], np.nonzero(np.diff(b))[0] + 1, [len(b)]])
    runs = np.nonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (owners[1:] != owners[:-1])]))[0]
    length = np.diff(np.concatenate([runs, [len(b)]]))
    length = length.astype(np.uint16 if length.max() < 1 << 16 else np.uint32)
    ids, at = owners[runs], np.searchsorted(runs, cuts)
    tags = None if tags is None else tags[order][runs]
    rows = []
    for i, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        r = slice(int(at[i]), int(at[i + 1]))
        rows.append((int(b[s]), kind, e - s, keys[s:e].tobytes(), length[r].tobytes(), ids[r].tobytes(), b"" if vals is None else vals[s:e].tobytes(), b"" if tags is None else tags[r].tobytes()))
    return rows


def route(buckets: int, keys: np.ndarray, name: bytes, owners: np.ndarray, vals: np.ndarray) -> list[tuple]:
    """ROUTED rows of 64-bit keys, owners and 32-bit values under one name, in the buckets of their owners."""
    b = bucket_of(owners, buckets)
    order = np.argsort(b, kind="stable")
    b, keys, owners, vals = b[order], keys[order].astype(np.int64), owners[order], vals[order].astype(np.int32)
    cuts = np.concatenate([[0], np.nonzero(np.diff(b))[0] + 1, [len(b)]]).tolist() if len(b) else [0]
    return [(int(b[s]), ROUTED, e - s, keys[s:e].tobytes(), name, owners[s:e].tobytes(), vals[s:e].tobytes(), b"") for s, e in zip(cuts[:-1], cuts[1:])]


def unpack(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, owners, values and tags of rows of one bucket; zeros where keys, values or tags were not sent."""
    wide = any(len(r["keys"]) == 8 * r["n"] for r in rows)
    kind = U if wide else np.uint32
    keys, owners, vals, tags = [np.zeros(0, kind)], [np.zeros(0, U)], [np.zeros(0, np.uint32)], [np.zeros(0, U)]
    for r in rows:
        ids = np.frombuffer(r["owners"], U)
        length = np.frombuffer(r["owner_ids"], np.uint16 if len(r["owner_ids"]) == 2 * len(ids) else np.uint32)
        keys.append(np.frombuffer(r["keys"], kind) if r["keys"] else np.zeros(r["n"], kind))
        owners.append(np.repeat(ids, length))
        vals.append(np.frombuffer(r["vals"], np.uint32) if r["vals"] else np.zeros(r["n"], np.uint32))
        tags.append(np.repeat(np.frombuffer(r["tags"], U), length) if r["tags"] else np.zeros(r["n"], U))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(vals), np.concatenate(tags)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    if not rows:
        return pa.RecordBatch.from_arrays([pa.array([], t.type) for t in _ARROW], schema=_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def first_level(parts: int) -> tuple[int, bool]:
    """How many buckets to pack for, and whether with wide keys, so that ``meet`` brings the blobs to ``parts`` buckets."""
    return (parts, False) if parts <= LEVEL else (LEVEL, True)


def by_bucket(df: DataFrame, parts: int) -> DataFrame:
    """Rows in tasks by ``bucket``, one for each bucket as far as there are tasks; buckets that are hashed would share some and leave others empty."""
    return df.repartitionById(parts, "bucket") if parts <= TASKS else df.repartition(TASKS, "bucket")


def meet(blobs: DataFrame, parts: int) -> DataFrame:
    """The blobs with all of a bucket in one task, to be grouped by bucket without another exchange."""
    if parts > LEVEL:
        blobs = by_bucket(blobs, LEVEL).mapInArrow(_finer(LEVEL, parts), SCHEMA)
    return by_bucket(blobs, parts)


def _finer(coarse: int, parts: int, limit: int = 3_000_000):
    """Blobs of coarse buckets with wide keys packed anew for ``parts`` buckets."""

    def again(rows: list[dict]) -> list[tuple]:
        out = []
        for kind in sorted({r["kind"] for r in rows}):
            mine = [r for r in rows if r["kind"] == kind]
            if kind == PLAIN:
                out += [(r["bucket"] * parts // coarse, *(r[c] for c in _NAMES[1:])) for r in mine]
                continue
            if kind == ROUTED:
                for r in mine:
                    out += route(parts, np.frombuffer(r["keys"], np.int64), r["owner_ids"], np.frombuffer(r["owners"], U), np.frombuffer(r["vals"], np.int32))
                continue
            keys, owners, vals, tags = unpack(mine)
            keyless = not any(r["keys"] for r in mine)
            has = lambda c: any(r[c] for r in mine)
            out += pack(kind, parts, owners * _SCRAMBLE if keyless else keys, owners, vals if has("vals") else None, True, keyless, tags if has("tags") else None)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for r in b.to_pylist():
                held.append(r)
                n += r["n"]
                if n >= limit:
                    yield batch(again(held))
                    held, n = [], 0
        if held:
            yield batch(again(held))

    return run


# Kinds of blobs of the search for shared keys.
TRIPLE, MARKER, CREDIT, PLAIN, ROUTED = 0, 1, 2, 3, 4


def _shared(keys: np.ndarray, owners: np.ndarray, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, the first place of each key, whether two owners have it, and each place's key number."""
    order = np.argsort(keys, kind="stable")
    k, o = keys[order], owners[order]
    first = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0] if len(k) else np.zeros(0, np.int64)
    both = np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first) if len(k) else np.zeros(0, bool)
    if marked is not None and len(k):
        both |= np.logical_or.reduceat(marked[order], first)
    return order, first, both, np.cumsum(np.isin(np.arange(len(k)), first, assume_unique=True)) - 1 if len(k) else first


class SharedKeys:
    """The map side of the search for keys that occur with at least two owners.

    Keys that two owners have within one flush are settled here: their owners are credited at once and
    one marker goes out for all, so a key that a third of all records have costs one entry a flush. With ``counted`` no
    values are kept and owners only learn how many of their keys are shared.
    """

    def __init__(self, buckets: int, limit: int = 1_000_000, wide: bool = False, counted: bool = False):
        self.buckets, self.limit, self.wide, self.counted, self.held, self.parts = buckets, limit, wide, counted, 0, []

    def add(self, keys: np.ndarray, owners: np.ndarray, vals: np.ndarray | None = None) -> list[tuple]:
        self.parts.append((keys, owners, np.zeros(len(keys), np.uint32) if vals is None else vals.astype(np.uint32)))
        self.held += len(keys)
        return self.flush() if self.held >= self.limit else []

    def flush(self) -> list[tuple]:
        if not self.held:
            return []
        keys, owners, vals = (np.concatenate(x) for x in zip(*self.parts))
        self.held, self.parts = 0, []
        order, first, both, number = _shared(keys, owners)
        rows = pack(MARKER, self.buckets, keys[order[first[both]]], np.zeros(int(both.sum()), U), wide=self.wide)
        local = np.zeros(len(keys), bool)
        local[order] = both[number]
        rows += pack(TRIPLE, self.buckets, keys[~local], owners[~local], None if self.counted else vals[~local], self.wide)
        # credits need no meeting; they travel in the bucket of a scrambled owner
        owners, vals = owners[local], vals[local]
        if self.counted and len(owners):
            owners, vals = np.unique(owners, return_counts=True)
        return rows + pack(CREDIT, self.buckets, owners * _SCRAMBLE, owners, vals, keyless=True)


def settle(rows: list[dict], counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The reduce side: owner and value, or number, of every triple whose key two owners have."""
    triples, markers, credits = ([r for r in rows if r["kind"] == k] for k in (TRIPLE, MARKER, CREDIT))
    keys, owners, vals, _ = unpack(triples)
    mk = unpack(markers)[0]
    n = len(keys)
    sent = np.concatenate([np.zeros(n, bool), np.ones(len(mk), bool)])
    every = np.concatenate([keys, mk])
    order, _, both, number = _shared(every, np.concatenate([owners, np.zeros(len(mk), U)]), sent)
    hit = order[both[number]] if len(every) else np.zeros(0, np.int64)
    hit = np.sort(hit[hit < n])
    _, co, cv, _ = unpack(credits)
    return np.concatenate([owners[hit], co]), np.concatenate([np.ones(len(hit), np.uint32) if counted else vals[hit], cv])
