"""Long exact spans shared between texts.

Method: prefix-partitioned suffix trees. Only suffixes near anchors matter: every stretch of ``least`` characters holds an anchor,
the place with the smallest hash of ``anchor`` characters within a window, chosen by the window's content alone, so equal stretches
have equal anchors. An exchange of packed hashes drops the anchors whose characters no other text has. Around each one that is left,
the window that can hold a stretch over it goes to the partition of the suffixes with its prefix, the characters of the anchor.

Prefixes are of variable length: one that more than ``group`` windows have is made longer, to the right and to the left (a stretch over
it covers at least half of what is missing on one of the sides), so a partition never holds more than memory takes; a prefix of ``least``
characters is a stretch itself and needs no tree. In a partition the suffixes from the anchors and the reversed prefixes before them are
sorted by their characters; with the lengths common to neighbours these are a suffix tree and its mirror. The windows below one node
of depth r in the one and one of depth l in the other share a maximal repeat of l + r characters; those of at least ``least`` with two
texts below are shared spans. Trees compare characters, so hashes only choose what is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm import exchange as X
from ctxspark.llm.vec import Flat, U, chunks, mix
from ctxspark.plans.stage import exchange_parts, spread, written

CHUNK = 1 << 20
GROUP = 50_000


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each window of ``w``; shorter by w - 1."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = pick(x[: len(x) - step], x[step:])
        have += step
    return x


def anchors(flat: Flat, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all texts, and the hashes of their ``k`` characters."""
    h = mix(flat.grams(k))
    w = least - k + 1
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, U)
    low = _slide(h, w, np.minimum)
    begins = np.arange(len(low))
    text = flat.owner()[: len(low)]
    low = np.where(begins + least <= flat.starts[text] + flat.sizes[text], low, U(0))
    # the windows that hold a place are the w that begin at or before it
    high = _slide(np.concatenate([np.zeros(w - 1, U), low, np.zeros(w - 1, U)]), w, np.maximum)
    at = np.nonzero(high == h)[0]
    return at, mix(h[at] + U(1))  # the least hashes are all small; scrambled again they spread over the partitions


def digests(texts: list[str]) -> np.ndarray:
    """128 bits of each text, as two columns: the first is the text's id, both together stand for its characters."""
    raw = b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts)
    return np.frombuffer(raw, U).reshape(-1, 2)


def _scan(buckets: int, wide: bool, k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, turn = X.SharedKeys(buckets, wide=wide), 0
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_pylist()
            for s, e in chunks([len(t) for t in texts], CHUNK):
                flat, digest = Flat(texts[s:e]), digests(texts[s:e])
                at, h = anchors(flat, k, least)
                text = np.searchsorted(flat.starts, at, "right") - 1
                out = shared.add(h, digest[text, 0], at - flat.starts[text])
                out.append((turn % buckets, X.PLAIN, e - s, ids[s:e].tobytes(), digest[:, 1].tobytes(), digest[:, 0].tobytes(), flat.sizes.astype(np.int32).tobytes(), b""))
                turn += 1
                yield X.batch(out)
        out = shared.flush()
        if out:
            yield X.batch(out)

    return run


_PREFIXES = pa.schema([("tid", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _branching(table: pa.Table) -> pa.Table:
    """One partition: the anchors whose prefix two texts have, and the directory of texts."""
    rows = table.to_pylist()
    tid, pos = X.settle(rows)
    none = pa.nulls(len(tid)).cast(pa.int64())
    out = [pa.table({"tid": tid.view(np.int64), "doc_id": none, "digest": none, "n": none.cast(pa.int32()), "pos": pos.astype(np.int32)})]
    for r in rows:
        if r["kind"] == X.PLAIN:
            out.append(pa.table({"tid": np.frombuffer(r["owners"], np.int64), "doc_id": np.frombuffer(r["keys"], np.int64), "digest": np.frombuffer(r["owner_ids"], np.int64), "n": np.frombuffer(r["vals"], np.int32), "pos": pa.nulls(r["n"]).cast(pa.int32())}))
    return pa.concat_tables([t.cast(_PREFIXES) for t in out])


WINDOWS = "tid bigint, pos int, lead int, win string"


def _windows(k: int, least: int):
    """(tid, pos, lead, win) of (tid, text, places): the window around each place, ``lead`` characters of it before the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tids, texts, lists = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2)
            n = np.diff(lists.offsets.to_numpy())
            known = digests(texts)[:, 0] == tids.view(U)  # an id may come with another text too
            places, n = lists.flatten().to_numpy()[np.repeat(known, n)], np.where(known, n, 0)
            ends = np.cumsum(n)
            for s, e in chunks([len(t) + int(m) * 2 * least for t, m in zip(texts, n.tolist())], 4 * CHUNK):
                lo, hi = int(ends[s] - n[s]), int(ends[e - 1])
                part = places[lo:hi].astype(np.int64)
                own = np.repeat(np.arange(s, e), n[s:e])
                first = np.maximum(0, part + k - least)
                wins = [texts[t][a:z] for t, a, z in zip(own.tolist(), first.tolist(), (part + least).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(tids[own]), pa.array(part.astype(np.int32)), pa.array((part - first).astype(np.int32)), pa.array(wins, pa.string())], names=["tid", "pos", "lead", "win"])

    return run


def _rank(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of characters, and how many characters each row in order shares with the one before; 0 ends a row."""
    n, w = codes.shape
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * w), n, [None, pa.py_buffer(codes.astype(">u4").tobytes())])
    order = pc.array_sort_indices(flat).to_numpy()
    differ = np.ones((n, w + 1), bool)
    a, b = codes[order[1:]], codes[order[:-1]]
    differ[1:, :w] = (a != b) | (a == 0)
    common = differ.argmax(1)
    common[0] = 0
    return order, common


def repeats(lead: np.ndarray, wins: list[str], tid: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, l) of all stretches of ``least`` characters that two texts share: they begin l characters before the window's anchor.

    The windows' suffixes from their anchors are the leaves of a tree, what stands before the anchors, reversed, those of another. Two leaves
    have a common node of depth r in the first if no neighbours between them share fewer than r characters. A stretch that begins l before the
    anchor is common to the leaves below one node of depth l in the mirror and one of depth least - l in the tree.
    """
    room = least - k
    flat = Flat(wins)
    place = flat.starts + lead
    end = flat.starts + flat.sizes
    right = place[:, None] + np.arange(least)
    codes = np.where(right < end[:, None], flat.codes[np.minimum(right, len(flat.codes) - 1)] + np.uint32(1), np.uint32(0))
    order_r, common_r = _rank(codes)
    left = place[:, None] - 1 - np.arange(room)
    codes = np.where(left >= flat.starts[:, None], flat.codes[np.maximum(left, 0)] + np.uint32(1), np.uint32(0)) if room else np.zeros((len(wins), 0), np.uint32)
    order_l, common_l = _rank(codes) if room else (np.arange(len(wins)), np.zeros(len(wins), np.int64))
    node_r, node_l = np.empty(len(wins), np.int64), np.empty(len(wins), np.int64)
    found_w, found_l = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for l in range(room + 1):
        node_r[order_r] = np.cumsum(common_r < least - l)
        node_l[order_l] = np.cumsum(common_l < l) if l else 0
        keys = node_r * (len(wins) + 1) + node_l
        by = np.argsort(keys, kind="stable")
        ks, ts = keys[by], tid[by]
        first = np.nonzero(np.concatenate([[True], ks[1:] != ks[:-1]]))[0]
        two = np.minimum.reduceat(ts, first) != np.maximum.reduceat(ts, first)
        hit = by[np.repeat(two, np.diff(np.concatenate([first, [len(ks)]])))]
        found_w.append(hit)
        found_l.append(np.full(len(hit), l))
    return np.concatenate(found_w), np.concatenate(found_l)


RUNS = "tid bigint, first bigint, last bigint"


def _runs(tid: np.ndarray, start: np.ndarray) -> pa.Table:
    """Runs of consecutive starts of each text."""
    order = np.lexsort((start, tid))
    tid, start = tid[order], start[order]
    if not len(tid):
        return pa.table({"tid": tid, "first": start, "last": start})
    cut = np.nonzero(np.concatenate([[True], (tid[1:] != tid[:-1]) | (start[1:] > start[:-1] + 1)]))[0]
    last = np.concatenate([cut[1:], [len(tid)]]) - 1
    return pa.table({"tid": tid[cut], "first": start[cut], "last": start[last]})


def _trees(k: int, least: int):
    """One partition of the suffixes: the starts of its shared stretches, as runs by text."""

    def run(table: pa.Table) -> pa.Table:
        tid, pos = table["tid"].to_numpy(), table["pos"].to_numpy().astype(np.int64)
        at, l = repeats(table["lead"].to_numpy().astype(np.int64), table["win"].to_pylist(), tid, k, least)
        return _runs(tid[at], pos[at] - l)

    return run


def _spans(least: int):
    """One slice of the texts: maximal runs of shared places."""

    def run(table: pa.Table) -> pa.Table:
        tid, first, last = (table[c].to_numpy() for c in ("tid", "first", "last"))
        order = np.lexsort((first, tid))
        tid, first, last = tid[order], first[order], last[order]
        # a run is joined to those before it if it begins within or directly after what they cover
        text = np.cumsum(np.concatenate([[0], tid[1:] != tid[:-1]]))
        top = int(last.max()) + least + 2
        cover = np.maximum.accumulate(text * top + last) - text * top
        new = np.concatenate([[True], (tid[1:] != tid[:-1]) | (first[1:] > cover[:-1] + least)])
        at = np.nonzero(new)[0]
        end = np.concatenate([at[1:], [len(tid)]]) - 1
        return pa.table({"tid": tid[at], "first_pos": first[at], "end_pos": cover[end] + least})

    return run


def _longer(m: int, least: int) -> int:
    return m + -(-(least - m) // 2)


def _stretch(win: str, lead: str, s: str, m: str):
    """The characters of a prefix: ``m`` from ``s`` before the anchor."""
    return F.expr(f"substring({win}, {lead} - {s} + 1, {m})")


def shared_starts(windows: DataFrame, k: int, least: int, group: int) -> DataFrame:
    """(tid, first, last): runs of starts of shared stretches in ``windows`` (tid, pos, lead, win) around equal anchors."""
    found = []
    parts = exchange_parts(windows, each=1 << 20)
    level = windows.withColumns({"s": F.lit(0), "m": F.lit(k)})  # a prefix begins s characters before the anchor and has m
    m = k
    while True:
        keyed = level.withColumn("key", F.xxhash64("s", _stretch("win", "lead", "s", "m")))
        hot = written(keyed.groupBy("key").count().where(F.col("count") > group).select("key"), "span-hot")
        any_hot = not hot.isEmpty()
        cold = keyed.join(hot, "key", "left_anti") if any_hot else keyed
        bucketed = X.by_bucket(cold.select(F.pmod("key", F.lit(parts)).cast("int").alias("bucket"), "tid", "pos", "lead", "win"), parts)
        found.append(bucketed.groupBy("bucket").applyInArrow(_trees(k, least), RUNS))
        if not any_hot:
            break
        m = _longer(m, least)
        # a stretch over the prefix has half of what it lacks, or more, on the right or on the left
        over = keyed.join(hot, "key", "left_semi").drop("key")
        right = over.where(F.length("win") - F.col("lead") + F.col("s") >= m).select("tid", "pos", "lead", "win", "s", F.lit(m).alias("m"))
        left = over.select("tid", "pos", "lead", "win", (F.col("s") + m - F.col("m")).alias("s"), F.lit(m).alias("m")).where("s <= lead")
        level = written(right.unionByName(left).dropDuplicates(["tid", "pos", "s"]), "span-longer")
        if m == least:
            start = F.col("pos").cast("bigint") - F.col("s")
            cells = level.select("tid", start.alias("first"), "s", _stretch("win", "lead", "s", "m").alias("key"))
            both = cells.groupBy("key", "s").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo <> hi").select("key", "s")
            found.append(cells.join(both, ["key", "s"], "left_semi").select("tid", "first", F.col("first").alias("last")))
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def shared_spans(documents: DataFrame, least: int = 100, anchor: int | None = None, group: int = GROUP) -> DataFrame:
    """(doc_id, first_pos, end_pos): the maximal runs of places that lie in a stretch of at least ``least`` characters
    which occurs, character by character, in the text of another doc_id too.

    ``documents`` has (doc_id, text); other columns are ignored. Places count code points from 0, and end_pos is one past
    the last. Null ids, null texts and texts shorter than ``least`` have no rows. Of equal texts of at least ``least`` characters
    each is shared as a whole; texts of one length and one 128-bit digest are equal. An id that comes twice with one text is one document.
    """
    k = anchor or max(1, least // 2)
    docs = documents.where(f"doc_id is not null and length(text) >= {int(least)}").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = exchange_parts(docs)
    coarse, wide = X.first_level(parts)
    blobs = X.meet(spread(docs).mapInArrow(_scan(coarse, wide, k, least), X.SCHEMA), parts)
    prefixes = written(blobs.groupBy("bucket").applyInArrow(_branching, "tid bigint, doc_id bigint, digest bigint, n int, pos int"), "span-prefixes")
    directory = prefixes.where("doc_id is not null").select("tid", "digest", "doc_id", "n").distinct()
    copied = directory.groupBy("tid", "digest").agg(F.count("*").alias("copies"))
    # one document stands for all with its text; places of a text are as many as it has anchors
    stands = prefixes.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.collect_set("pos").alias("places")).where(F.size("places") > 0)
    chosen = docs.hint("shuffle_hash").join(stands.hint("shuffle_hash"), "doc_id").select("tid", "text", "places")
    windows = written(chosen.mapInArrow(_windows(k, least), WINDOWS), "span-windows")
    starts = shared_starts(windows, k, least, group)
    slices = X.by_bucket(starts.withColumn("bucket", F.pmod(F.xxhash64("tid"), F.lit(parts)).cast("int")), parts)
    spans = slices.groupBy("bucket").applyInArrow(_spans(least), "tid bigint, first_pos bigint, end_pos bigint")
    owners = directory.join(copied, ["tid", "digest"])
    whole = owners.where("copies > 1").select("doc_id", F.lit(0).cast("bigint").alias("first_pos"), F.col("n").cast("bigint").alias("end_pos"))
    single = owners.where("copies = 1").select("tid", "doc_id").join(spans, "tid").select("doc_id", "first_pos", "end_pos")
    return whole.unionByName(single).distinct()


def shared_amounts(documents: DataFrame, least: int = 100, anchor: int | None = None) -> DataFrame:
    """(doc_id, n_chars, n_shared, n_spans): for every non-null doc_id how many characters of its text lie in shared spans.

    Null texts count as empty. Rows are one for each doc_id; 0 where nothing is shared.
    """
    spans = shared_spans(documents, least, anchor).groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("first_pos")).alias("n_shared"), F.count("*").alias("n_spans"))
    every = documents.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("n_chars"))
    return every.join(spans, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))
