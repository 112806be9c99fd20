"""Near-duplicate records: an exact similarity self-join on sets of word runs.

Method: universe-partition pigeonhole. Two sets with Jaccard similarity of at least t differ in at most
h = (1 - t) / (1 + t) * (|a| + |b|) elements. The universe of hashed word runs is cut into m segments by hash,
m by size band. If levels a_i from {0 (skip), 1 (equal), 2 (equal up to one element)} sum to h + 1, at least one
segment must differ by less than its level. The smaller record of a pair indexes its segments and their
one-deletion neighbourhoods once, in its own band; the larger one probes each band it can meet at levels
chosen by cost. What meets is verified exactly on the sets. Empty segments say the same of all sets and are neither indexed nor
probed; the few records that have too few other ones meet the rest by their rarest runs instead.

Before that, runs that occur in one set only are found by an exchange of packed keys: a record needs the share t of
its runs to occur elsewhere too, so the others leave without an index entry. Nothing here is approximate, but for
64-bit hashes standing for word runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm import exchange as X
from ctxspark.llm.vec import Flat, U, Words, chunks, mix
from ctxspark.plans.stage import PART, exchange_parts, least_parts, spread, written

CHUNK = 1 << 20
SKETCH_BITS = 20
SKETCH_SLICES = 64
PARITY_BITS = 512
FILTER_BITS = 27
#: Bytes of signatures that one round brings to their buckets, for each byte of the input; and what a run of a set costs there, in the index and for a band in which it probes.
ROUND, INDEXED, PROBED = 1.5, 12, 5.6


def run_sets(texts: list[str], salts: np.ndarray, k: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of at least ``least_words`` words: row, set id and size; the sorted-by-row distinct run hashes of all rows."""
    w = Words(texts)
    h, at = w.runs(k)
    row = w.text[at]
    keep = w.count[row] >= least_words
    h, row = mix(h[keep] + salts[row[keep]]), row[keep]
    _, idx = np.unique(mix(h ^ mix(row.astype(U) + U(1))), return_index=True)
    idx.sort()
    h, row = h[idx], row[idx]
    if not len(h):
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, U), z, h
    first = np.nonzero(np.concatenate([[True], row[1:] != row[:-1]]))[0]
    size = np.diff(np.concatenate([first, [len(row)]]))
    sid = mix(np.add.reduceat(mix(h), first) + size.astype(U) * U(0x9E3779B97F4A7C15))
    return row[first], sid, size, h


def _salts(src: list[str], n: int) -> np.ndarray:
    """One number for each table, so that the universes of two tables are disjoint."""
    flat = Flat(sorted(set(src)))
    h = flat.hashes(flat.starts, flat.starts + flat.sizes)
    by = dict(zip(sorted(set(src)), h))
    return np.fromiter((by[s] for s in src), U, n)


def _scan(buckets: int, wide: bool, k: int, least_words: int):
    """Texts to blobs: the runs of each set, and the record directory as PLAIN rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, turn = X.SharedKeys(buckets, wide=wide, counted=True), 0
        for b in batches:
            src, ids, texts = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            for s, e in chunks([len(t) for t in texts], CHUNK):
                rows, sid, size, h = run_sets(texts[s:e], _salts(src[s:e], e - s), k, least_words)
                if not len(rows):
                    continue
                out = shared.add(h, np.repeat(sid, size))
                for name in sorted(set(src[s:e])):
                    own = np.array([src[s + r] == name for r in rows])
                    out.append((turn % buckets, X.PLAIN, int(own.sum()), ids[s:e][rows[own]].astype(np.int64).tobytes(), name.encode(), sid[own].tobytes(), size[own].astype(np.int32).tobytes(), b""))
                turn += 1
                yield X.batch(out)
        out = shared.flush()
        if out:
            yield X.batch(out)

    return run


def _count(buckets: int, wide: bool):
    """One bucket of runs: how many of the runs of each set another set has too, and the directory, both as blobs for the buckets of the sets."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        owners, number = X.settle(rows, counted=True)
        sid, at = np.unique(owners, return_inverse=True)
        out = X.pack(X.CREDIT, buckets, sid, np.zeros(len(sid), U), np.bincount(at, weights=number, minlength=len(sid)), wide)
        for r in rows:
            if r["kind"] == X.PLAIN:
                out += X.route(buckets, np.frombuffer(r["keys"], np.int64), r["owner_ids"], np.frombuffer(r["owners"], U), np.frombuffer(r["vals"], np.int32))
        return pa.Table.from_batches([X.batch(out)])

    return run


_MEMBERS = pa.schema([("src", pa.string()), ("rec_id", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("first", pa.bool_())])


def _alive(t_num: int, t_den: int):
    """One bucket of sets: each record once; ``first`` marks one record of each set of which others have the share t of the runs.

    Sets meet their counts by the lower 32 bits; those that share them in a bucket count as having both numbers, so none leaves that must stay.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        plain = [r for r in rows if r["kind"] == X.ROUTED]
        if not plain:
            return _MEMBERS.empty_table()
        names = sorted({r["owner_ids"] for r in plain})
        src = np.repeat([names.index(r["owner_ids"]) for r in plain], [r["n"] for r in plain])
        rec, sid, n = (np.concatenate([np.frombuffer(r[c], t) for r in plain]) for c, t in (("keys", np.int64), ("owners", U), ("vals", np.int32)))
        order = np.lexsort((rec, src, sid))
        src, rec, sid, n = src[order], rec[order], sid[order], n[order]
        first = np.concatenate([[True], sid[1:] != sid[:-1]])
        once = first | np.concatenate([[True], (src[1:] != src[:-1]) | (rec[1:] != rec[:-1])])
        low = U(0xFFFFFFFF)
        keys, _, number, _ = X.unpack([r for r in rows if r["kind"] == X.CREDIT])
        keys, at = np.unique(np.concatenate([keys.astype(U), sid]) & low, return_inverse=True)
        shared = np.bincount(at, weights=np.concatenate([number, np.zeros(len(sid))]))[at[len(number) :]]
        first &= shared * t_den >= n.astype(np.int64) * t_num
        return pa.table([pa.array([x.decode() for x in names]).take(pa.array(src[once])), rec[once], sid[once].view(np.int64), n[once], first[once]], schema=_MEMBERS)

    return run


def _filter_slot(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U) + U(11)) >> U(64 - FILTER_BITS)).astype(np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of one task's keys, in slices of fixed size."""
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for b in batches:
        at = _filter_slot(b.column(0).to_numpy())
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    own = [(i, x.tobytes()) for i, x in enumerate(np.split(bits, SKETCH_SLICES)) if x.any()]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], names=["slice", "bits"])


def _or_marks(table: pa.Table) -> pa.Table:
    return pa.table({"slice": table["slice"][:1].cast(pa.int32()), "bits": pa.array([np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()]).tobytes()])})


def key_filter(keys: DataFrame):
    """A broadcast of bits for ``marked``, 16 MB whatever the number of ``keys``, which are one bigint column."""
    out = np.zeros((SKETCH_SLICES, (1 << FILTER_BITS - 3) // SKETCH_SLICES), np.uint8)
    for r in keys.mapInArrow(_mark, "slice int, bits binary").groupBy("slice").applyInArrow(_or_marks, "slice int, bits binary").toLocalIterator():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out.ravel())


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those of the filter: all of them, and few others."""
    at = _filter_slot(keys)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _kept(bits):
    """Rows whose first column may be in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(marked(bits.value, b.column(0).to_numpy())))

    return run


def _sets(k: int, least_words: int, alive):
    """Texts to (src, sid, n, runs, bits), of records whose key may be in the filter ``alive``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(marked(alive.value, b.column(2).to_numpy())))
            src, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for s, e in chunks([len(t) for t in texts], CHUNK):
                rows, sid, size, h = run_sets(texts[s:e], _salts(src[s:e], e - s), k, least_words)
                if len(rows):
                    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([src[s + r] for r in rows]), pa.array(sid.view(np.int64)), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))), pa.array(list(parities(size, h)))], names=["src", "sid", "n", "runs", "bits"])

    return run


def _sketch_slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of hashed runs of one task, in slices of fixed size."""
    total = np.zeros(1 << SKETCH_BITS, np.int32)
    for b in batches:
        total += np.bincount(_sketch_slot(b.column(0).flatten().to_numpy().view(U)), minlength=len(total)).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(total, SKETCH_SLICES)])], names=["slice", "counts"])


def _sum_sketch(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.int32) for c in table["counts"].to_pylist())
    return pa.table({"slice": table["slice"][:1].cast(pa.int32()), "counts": pa.array([total.tobytes()])})


def frequencies(sets: DataFrame) -> np.ndarray:
    """In how many sets the runs of each slot are: one array of 2**SKETCH_BITS numbers, 4 MB whatever the size of the data."""
    out = np.zeros((SKETCH_SLICES, (1 << SKETCH_BITS) // SKETCH_SLICES), np.int32)
    for r in sets.select("runs").mapInArrow(_sketch, "slice int, counts binary").groupBy("slice").applyInArrow(_sum_sketch, "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.int32)
    return out.ravel()


def parities(size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each set, the parity of the number of elements in each of PARITY_BITS slots, as rows of int64.

    Two sets' parities differ in at most as many bits as the sets differ in elements.
    """
    row = np.repeat(np.arange(len(size)), size)
    slot = (mix(h + U(3)) >> U(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(row * PARITY_BITS + slot, minlength=len(size) * PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(size), -1)


def bands(least: int, ratio: float, top: int = 1 << 31) -> np.ndarray:
    """Upper sizes of the bands, each about ``ratio`` times the one before."""
    out = [max(1, least)]
    while out[-1] < top:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out, np.int64)


def differences(a: np.ndarray, b: np.ndarray, t_num: int, t_den: int) -> np.ndarray:
    """The most elements in which sets of sizes a and b may differ at Jaccard similarity t_num / t_den."""
    return (a + b) * (t_den - t_num) // (t_den + t_num)


def segments_of(top: np.ndarray, t_num: int, t_den: int) -> np.ndarray:
    """How many segments a band has: about two elements in each, and levels enough for the largest set that can meet the band."""
    return np.maximum(top // 2, (top * (t_den - t_num) // t_num + 2) // 2 + 1)


def segment_sums(rec: np.ndarray, h: np.ndarray, n_rec: int, m: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segment of each element as a place in the concatenated segments of all records, the segments' sums, their record and number."""
    off = np.concatenate([[0], np.cumsum(m)])
    seg = ((mix(h + U(0x5851F42D)) >> U(32)) * m[rec].astype(U) >> U(32)).astype(np.int64)
    place = off[rec] + seg
    sums = np.zeros(off[-1], U)
    np.add.at(sums, place, mix(h))
    of = np.repeat(np.arange(n_rec), m)
    number = np.arange(off[-1]) - off[of]
    return place, sums, of, mix(number.astype(U) * U(0x9E3779B97F4A7C15) + seed[of])


def choose_levels(rec: np.ndarray, count: np.ndarray, low: np.ndarray, second: np.ndarray, need: np.ndarray, n_rec: int) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest levels of segments that sum to ``need`` for each record, and which records can't reach it.

    ``low`` and ``second`` are the two smallest frequencies of a segment's elements. Equality is expected to meet as many sets as have the
    rarest element; one deletion, those with the rarest of the rest. Empty segments have no level and single elements no second one: what
    they stand for is the same for all sets, so its key would be hot. Records that can't do without have level 0 everywhere.
    """
    one = low.astype(float)
    two = np.maximum(one, one + (count - 1) * one + second)
    some, more = np.nonzero(count > 0)[0], np.nonzero(count > 1)[0]
    cost, seg = np.concatenate([one[some], two[more]]), np.concatenate([some, more])
    order = np.lexsort((np.arange(len(cost)), cost, rec[seg]))
    owner = rec[seg[order]]
    starts = np.searchsorted(owner, np.arange(n_rec))
    needy = np.bincount(owner, minlength=n_rec) < need
    taken = order[(np.arange(len(order)) - starts[owner] < need[owner]) & ~needy[owner]]
    level = np.zeros(len(rec), np.int8)
    np.add.at(level, seg[taken], 1)
    return level, needy


# Kinds of signature blobs; NEEDY ones name a record and the band in which it needs another way.
INDEX_EQUAL, INDEX_DELETED, PROBE_EQUAL, PROBE_DELETED, NEEDY = 10, 11, 12, 13, 14


def signatures(sid: np.ndarray, size: np.ndarray, h: np.ndarray, tops: np.ndarray, frequency: np.ndarray, t_num: int, t_den: int, first: int = 0, end: int = 1 << 31) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, signature, number of the set) of the sets for the index and for the probes of bands from ``first`` to before ``end``; of NEEDY, (kind, band, number)."""
    rec = np.repeat(np.arange(len(sid)), size)
    home = np.searchsorted(tops, size)
    freq = frequency[_sketch_slot(h)]

    def cut(sub: np.ndarray, band: np.ndarray):
        """Segments of the records ``sub`` in ``band``."""
        take = np.isin(rec, sub)
        new = np.full(len(sid), -1)
        new[sub] = np.arange(len(sub))
        r, hh = new[rec[take]], h[take]
        m = segments_of(tops[band], t_num, t_den)
        return r, hh, freq[take], m, *segment_sums(r, hh, len(sub), m, mix(band.astype(U) + U(7)))

    own = np.nonzero((home >= first) & (home < end))[0]
    r, hh, _, m, place, sums, of, number = cut(own, home[own])
    count = np.bincount(place, minlength=len(sums))
    some, more = count > 0, (count > 1)[place]
    yield INDEX_EQUAL, mix(sums + number)[some], own[of[some]]
    yield INDEX_DELETED, mix(sums[place] - mix(hh) + number[place])[more], own[r[more]]

    smallest = -(-size * t_num // t_den)
    lowest = np.searchsorted(tops, smallest)
    for step in range(int((home - lowest).max(initial=0)) + 1):
        sub = np.nonzero((home - step >= np.maximum(lowest, first)) & (home - step < end))[0]
        band = home[sub] - step
        r, hh, f, m, place, sums, of, number = cut(sub, band)
        count = np.bincount(place, minlength=len(sums))
        order = np.lexsort((f, place))
        low, second = np.full(len(sums), 0, np.int64), np.full(len(sums), 0, np.int64)
        at = np.concatenate([[0], np.cumsum(count)])[:-1]
        has, more = count > 0, count > 1
        low[has] = f[order[at[has]]]
        second[more] = f[order[at[more] + 1]]
        need = differences(size[sub], np.minimum(size[sub], tops[band]), t_num, t_den) + 1
        level, needy = choose_levels(of, count, low, second, need, len(sub))
        one, two = level >= 1, level >= 2
        sig = mix(sums + number)
        yield PROBE_EQUAL, sig[one], sub[of[one]]
        yield PROBE_DELETED, sig[two], sub[of[two]]
        gone = two[place]
        yield PROBE_EQUAL, mix(sums[place[gone]] - mix(hh[gone]) + number[place[gone]]), sub[r[gone]]
        yield NEEDY, band[needy], sub[needy]


def rounds(load: dict[int, int], most: float, t_num: int, t_den: int, tops: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(first band, end, part, of, bytes): the search in rounds of at most about ``most`` bytes of signatures, by the runs that sets have in each band.

    A band that has more alone takes several rounds, each with its part of the signatures.
    """
    low = {b: int(np.searchsorted(tops, -(-(int(tops[b - 1]) + 1 if b else 1) * t_num // t_den))) for b in load}
    cost: dict[int, float] = dict.fromkeys(range(max(load, default=-1) + 1), 0.0)
    for b, n in load.items():
        cost[b] += INDEXED * n
        for x in range(low[b], b + 1):
            cost[x] += PROBED * n
    out: list[tuple[int, int, int, int, float]] = []
    first, held = 0, 0.0
    for b, c in cost.items():
        if held and held + c > most:
            out.append((first, b, 0, 1, held))
            first, held = b, 0.0
        held += c
        if held > most:
            of = int(-(-held // most))
            out += [(first, b + 1, i, of, held / of) for i in range(of)]
            first, held = b + 1, 0.0
    return [*out, (first, len(cost), 0, 1, held)] if held else out


def _bands(tops: np.ndarray):
    """(n) to (band, runs), one row for each band in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(0).to_numpy().astype(np.int64)
            band, at = np.unique(np.searchsorted(tops, n), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(band.astype(np.int32)), pa.array(np.bincount(at, weights=n, minlength=len(band)).astype(np.int64))], names=["band", "runs"])

    return run


def _sign(buckets: int, wide: bool, tops: np.ndarray, frequency, t_num: int, t_den: int, first: int, end: int, turn: int, turns: int, labelled: bool):
    """(sid, n, runs, label) to the signature blobs of one round, with the label as their tag where there are labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).to_numpy().astype(np.int64)
            sids, lists, labels = b.column(0).to_numpy().view(U), b.column(2), b.column(3).to_numpy().view(U)
            for s, e in chunks(sizes, 200_000):
                out, part = [], lists.slice(s, e - s)
                sid, label = sids[s:e], labels[s:e]
                for kind, sig, of in signatures(sid, sizes[s:e], part.flatten().to_numpy().view(U), tops, frequency.value, t_num, t_den, first, end):
                    if kind == NEEDY:
                        out += X.pack(kind, buckets, mix(sid[of]), sid[of], sig, keyless=True) if turn == 0 else []
                        continue
                    if turns > 1:
                        mine = sig % U(turns) == U(turn)
                        sig, of = sig[mine], of[mine]
                    out += X.pack(kind, buckets, sig, sid[of], None, wide, tags=label[of] if labelled else None)
                if out:
                    yield X.batch(out)

    return run


def _meet(index: np.ndarray, owner: np.ndarray, mark: np.ndarray, probe: np.ndarray, prober: np.ndarray, probe_mark: np.ndarray, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index owner and prober for equal keys and different labels, in blocks of about ``block`` pairs."""
    _, key = np.unique(np.concatenate([index, probe]), return_inverse=True)
    names, label = np.unique(np.concatenate([mark, probe_mark]), return_inverse=True)
    both = key.astype(np.int64) * len(names) + label
    code, probe_code, first = both[: len(index)], both[len(index) :], key[len(index) :].astype(np.int64) * len(names)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    # owners of the key before and behind those with the prober's label
    find = lambda x, side: np.searchsorted(code, x, side)
    lo = np.concatenate([find(first, "left"), find(probe_code, "right")])
    hi = np.concatenate([find(probe_code, "left"), find(first + len(names), "left")])
    n, prober = hi - lo, np.concatenate([prober, prober])
    hit = n > 0
    lo, n, prober = lo[hit], n[hit], prober[hit]
    ends = np.cumsum(n)
    s = 0
    while s < len(n):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + block, "right")))
        c = n[s:e]
        at = np.repeat(lo[s:e] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
        yield owner[at], np.repeat(prober[s:e], c)
        s = e


def _star(index: np.ndarray, owner: np.ndarray, probe: np.ndarray, prober: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, its least index owner with every prober and its least prober with every index owner."""
    common = np.intersect1d(index, probe)

    def least(keys, who):
        take = np.isin(keys, common)
        keys, who = keys[take], who[take]
        order = np.lexsort((who, keys))
        keys, who = keys[order], who[order]
        first = np.searchsorted(keys, common)
        return keys, who, who[first] if len(common) else who

    (ik, io, i0), (pk, po, p0) = least(index, owner), least(probe, prober)
    return np.concatenate([i0[np.searchsorted(common, pk)], io]), np.concatenate([po, p0[np.searchsorted(common, ik)]])


_FOUND = "a bigint, b bigint, band int"


def _pairs(star: bool, labelled: bool):
    """Candidates of one bucket, whose sets' labels are the sets themselves unless they are ``labelled``, distinct within it, and its needy records as (a, null, band)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        by = {k: X.unpack([r for r in rows if r["kind"] == k]) for k in (INDEX_EQUAL, INDEX_DELETED, PROBE_EQUAL, PROBE_DELETED, NEEDY)}
        found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        for i, p in ((INDEX_EQUAL, PROBE_EQUAL), (INDEX_DELETED, PROBE_DELETED)):
            (ik, io, _, im), (pk, po, _, pm) = by[i], by[p]
            for a, b in [_star(ik, io, pk, po)] if star else _meet(ik, io, im if labelled else io, pk, po, pm if labelled else po):
                a, b = a[a != b], b[a != b]
                found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1).view(np.int64), axis=0))
        out = np.unique(np.concatenate(found), axis=0)
        _, who, band, _ = by[NEEDY]
        needy = pa.table({"a": who.view(np.int64), "b": pa.nulls(len(who)).cast(pa.int64()), "band": band.astype(np.int32)})
        return pa.concat_tables([pa.table({"a": out[:, 0], "b": out[:, 1], "band": pa.nulls(len(out)).cast(pa.int32())}), needy])

    return run


def _prefix(tops: np.ndarray, wanted: list[int] | None, frequency, t_num: int, t_den: int):
    """(band, run, sid, label) of the rarest runs of sets, of which similar sets share one: of the sets whose own band is wanted, or of (sid, n, runs, label, band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, size, label, lists = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), b.column(3).to_numpy(), b.column(2)
            band = np.searchsorted(tops, size) if wanted is not None else b.column(4).to_numpy().astype(np.int64)
            h = lists.flatten().to_numpy()
            rec = np.repeat(np.arange(len(sid)), size)
            order = np.lexsort((h, frequency.value[_sketch_slot(h.view(U))], rec))
            place = np.arange(len(rec)) - np.repeat(np.cumsum(size) - size, size)
            keep = place < (size - (-(-size * t_num // t_den)) + 1)[rec]
            if wanted is not None:
                keep &= np.isin(band, wanted)[rec]
            r = rec[keep]
            yield pa.RecordBatch.from_arrays([pa.array(band[r].astype(np.int32)), pa.array(h[order][keep]), pa.array(sid[r]), pa.array(label[r])], names=["band", "run", "sid", "label"])

    return run


class Search:
    """The run sets of some texts, written, and the search for candidates among them."""

    def __init__(self, texts: DataFrame, k: int = 5, t_num: int = 4, t_den: int = 5, least_words: int = 0, ratio: float = 1.25):
        """See ``similar_sets``."""
        self.t_num, self.t_den, self.tops = t_num, t_den, bands(4, ratio)
        texts = texts.where("rec_id is not null and text is not null").select("src", "rec_id", "text")
        self.parts = parts = exchange_parts(texts)
        self.coarse, self.wide = X.first_level(parts)
        blobs = X.meet(spread(texts).mapInArrow(_scan(self.coarse, self.wide, k, least_words), X.SCHEMA), parts)
        counts = X.meet(blobs.groupBy("bucket").applyInArrow(_count(self.coarse, self.wide), X.SCHEMA), parts)
        records = written(counts.groupBy("bucket").applyInArrow(_alive(t_num, t_den), "src string, rec_id bigint, sid bigint, n int, first boolean"), "near-members")
        self.members = records.select("src", "rec_id", "sid", "n")
        key = F.xxhash64("src", "rec_id").alias("key")
        alive = key_filter(records.where("first").select(key))
        self.sets = written(spread(texts).select("src", "text", key).mapInArrow(_sets(k, least_words, alive), "src string, sid bigint, n int, runs array<bigint>, bits array<bigint>").dropDuplicates(["sid"]), "near-sets")
        self.frequency = texts.sparkSession.sparkContext.broadcast(frequencies(self.sets))

    def candidates(self, labels: DataFrame | None = None, star: bool = False) -> DataFrame:
        """(a, b): pairs of sets that may be similar, none of one label if ``labels`` (sid, label) are given.

        With ``star``, only some of them: enough that sets with a signature in common hang together.
        """
        sets = self.sets.select("sid", "n", "runs")
        sets = sets.withColumn("label", F.col("sid")) if labels is None else sets.join(labels, "sid")
        labelled = labels is not None
        load = self.sets.select("n").mapInArrow(_bands(self.tops), "band int, runs bigint").groupBy("band").agg(F.sum("runs").alias("runs"))
        found = sets.sparkSession.createDataFrame([], _FOUND)
        for first, end, part, of, size in rounds({r["band"]: r["runs"] for r in load.collect()}, ROUND * self.parts * PART, self.t_num, self.t_den, self.tops):  # at most as many as there are bands
            parts = min(self.parts, max(least_parts(sets), math.ceil(size / PART)))
            coarse, wide = X.first_level(parts)
            blobs = sets.mapInArrow(_sign(coarse, wide, self.tops, self.frequency, self.t_num, self.t_den, first, end, part, of, labelled), X.SCHEMA)
            found = found.unionByName(written(X.meet(blobs, parts).groupBy("bucket").applyInArrow(_pairs(star, labelled), _FOUND), "near-found"))
        pairs = found.where("band is null").select("a", "b")
        needy = found.where("band is not null").select(F.col("a").alias("sid"), "band")
        bands_ = [] if star else [r["band"] for r in needy.select("band").distinct().collect()]  # at most as many as there are bands
        if bands_:
            index = sets.mapInArrow(_prefix(self.tops, bands_, self.frequency, self.t_num, self.t_den), "band int, run bigint, sid bigint, label bigint").toDF("band", "run", "a", "la")
            probes = sets.join(needy, "sid").select("sid", "n", "runs", "label", "band").mapInArrow(_prefix(self.tops, None, self.frequency, self.t_num, self.t_den), "band int, run bigint, sid bigint, label bigint").toDF("band", "run", "b", "lb")
            pairs = pairs.unionByName(index.join(probes, ["band", "run"]).where("la <> lb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        return pairs.distinct()

    def verified(self, candidates: DataFrame) -> DataFrame:
        """(src, a, b, n_shared, n_union) of the candidates that are similar."""
        sets, t_num, t_den = self.sets, self.t_num, self.t_den
        # most candidates differ too much already in their parities, so few need both sets in one place
        small = lambda c: sets.select(F.col("sid").alias(c), F.col("src").alias(f"src_{c}"), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
        differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        close = (
            candidates.join(small("a"), "a").join(small("b"), "b").where("src_a = src_b")
            .where(F.least("n_a", "n_b") * t_den >= F.greatest("n_a", "n_b") * t_num)
            .where(differ * (t_den + t_num) <= (F.col("n_a") + F.col("n_b")) * (t_den - t_num))
            .select(F.col("src_a").alias("src"), "a", "b", "n_a", "n_b")
        )
        close = written(close, "near-close")
        met = key_filter(close.select("a").unionByName(close.select("b").toDF("a")))
        kept = sets.select("sid", "runs").mapInArrow(_kept(met), "sid bigint, runs array<bigint>")
        runs = lambda c: kept.select(F.col("sid").alias(c), F.col("runs").alias(f"runs_{c}"))
        compared = lambda some: (
            some.join(runs("a"), "a").join(runs("b"), "b")
            .withColumn("n_shared", F.size(F.array_intersect("runs_a", "runs_b")))
            .withColumn("n_union", F.col("n_a") + F.col("n_b") - F.col("n_shared"))
            .where(F.col("n_shared") * t_den >= F.col("n_union") * t_num)
            .select("src", "a", "b", "n_shared", "n_union")
        )
        # a pair carries the runs of one of its sets, so many pairs are compared in rounds
        sent = 8 * (close.agg(F.sum(F.col("n_a").cast("bigint"))).first()[0] or 0)
        turns = max(1, math.ceil(sent / (ROUND * self.parts * PART)))
        if turns == 1:
            return compared(close)
        turn = F.pmod(F.xxhash64("b", "a"), F.lit(turns))
        return reduce(DataFrame.unionByName, [written(compared(close.where(turn == i)), "near-similar") for i in range(turns)])


def similar_sets(texts: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of distinct run sets, and every record's set.

    ``texts`` has (src, rec_id, text); other columns are ignored and a record may come several times. Returns
    ``pairs`` (src, a, b, n_shared, n_union) of set ids whose Jaccard similarity on runs of ``k`` words (5) is at least
    ``t_num / t_den`` (4/5), and ``members`` (src, rec_id, sid, n), one row for a record of at least ``least_words`` words (0) and
    one run. Null ids and null or wordless texts are in neither; equal sets have one id, so copies are not paired.
    Pairs are only formed within one ``src``.
    """
    s = Search(texts, **how)
    return s.verified(s.candidates()), s.members


def similar_records(texts: DataFrame, **how) -> DataFrame:
    """(src, id_a, id_b), id_a < id_b: all pairs of records with similar or equal run sets; see ``similar_sets``."""
    pairs, members = similar_sets(texts, **how)
    pairs = written(pairs.select("src", "a", "b"), "near-pairs")
    a, b = members.select("src", F.col("sid").alias("a"), F.col("rec_id").alias("id_1")), members.select("src", F.col("sid").alias("b"), F.col("rec_id").alias("id_2"))
    across = pairs.join(a, ["src", "a"]).join(b, ["src", "b"]).select("src", "id_1", "id_2")
    repeated = members.groupBy("src", F.col("sid").alias("a")).count().where("count > 1").drop("count")
    again = a.join(repeated, ["src", "a"], "left_semi")
    within = again.join(again.withColumnRenamed("id_1", "id_2"), ["src", "a"]).where("id_1 < id_2").select("src", "id_1", "id_2")
    return across.unionByName(within).select("src", F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the connected components of undirected ``edges`` (a, b), named by their least node.

    Alternating large-star and small-star steps; each is one aggregation and one join on written tables, so nothing is gathered
    by component, and a long chain takes a number of rounds logarithmic in its length. Loops at a node are ignored.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        step = written(step.distinct(), "cc")
        same = step.count() == edges.count() and step.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = step
        if same:
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def similar_groups(texts: DataFrame, **how) -> DataFrame:
    """(src, rec_id, group_id, n_copies): the group of each record of at least ``least_words`` words and one run.

    Groups are the connected components of similarity; ``group_id`` is the least rec_id of the group, ``n_copies`` the number of other records
    with the same run set. See ``similar_sets`` for the rest. A group of many sets does not cost all its pairs: first, sets with a signature in common
    are linked to one of them; then only pairs across the groups found so far are searched and verified, which gives the same components.
    """
    s = Search(texts, **how)
    first = written(s.verified(s.candidates(star=True)).select("a", "b"), "near-links")
    labels = s.sets.select("sid").join(components(first).withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("label"))
    labels = written(labels, "near-labels")
    across = s.verified(s.candidates(labels)).select("a", "b")
    of = lambda c: labels.select(F.col("sid").alias(c), F.col("label").alias(f"l{c}"))
    between = written(across.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "near-links")
    roots = labels.select(F.col("sid").alias("node"), F.col("label").alias("root"))
    if not between.isEmpty():  # groups of groups
        merged = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = roots.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    copies = s.members.groupBy("sid").agg(F.count("*").alias("c"), F.min("rec_id").alias("first"))
    sets = copies.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "c", "first", F.coalesce("root", "sid").alias("root"))
    sets = written(sets, "near-roots")
    names = sets.groupBy("root").agg(F.min("first").alias("group_id"))
    return s.members.join(sets.join(names, "root"), "sid").select("src", "rec_id", "group_id", (F.col("c") - 1).alias("n_copies"))


def similar_links(texts: DataFrame, **how) -> DataFrame:
    """(src, rec_id, n_links, n_copies): for each record with a set, how many other sets are similar to its own and how many records have the same."""
    pairs, members = similar_sets(texts, **how)
    pairs = written(pairs.select("a", "b"), "near-pairs")
    links = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("sid")).agg(F.count("*").alias("n_links"))
    copies = members.groupBy("sid").agg(F.count("*").alias("c")).join(links, "sid", "left")
    return members.join(copies, "sid").select("src", "rec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("c") - 1).alias("n_copies"))
