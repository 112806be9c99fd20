"""Filling containers of fixed capacity with items.

Method: swap-based local search. Items are first put, largest first, where they leave the least space. Then items move
between underfull containers, or are exchanged one for one or two for one, always so that the fuller one gains more than
the other had: the sum of squared fills rises with each step, and the emptiest containers run empty.

Items are spread by the hash of their key over groups of about ``group_items`` that are filled independently, one task
each; a group wastes at most part of a container more than all items together would.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.plans.stage import written

GROUP_ITEMS = 20_000


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers of item numbers: largest items first, each where the least space stays free; equal sizes keep their order."""
    bins: list[list[int]] = []
    by_space: dict[int, list[int]] = {}
    spaces: list[int] = []  # the free spaces there are, sorted
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect_left(spaces, s)
        if at < len(spaces):
            space = spaces[at]
            b = by_space[space].pop()
            if not by_space[space]:
                del by_space[space], spaces[at]
            bins[b].append(i)
        else:
            space, b = capacity, len(bins)
            bins.append([i])
        if space > s or not s:
            rest = space - s
            if rest not in by_space:
                by_space[rest] = []
                insort(spaces, rest)
            by_space[rest].append(b)
    return bins


class Search:
    """Local search over the underfull containers."""

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes.tolist(), capacity
        self.fill = [sum(self.sizes[i] for i in b) for b in bins]
        self.bins = bins
        self.open = [b for b, f in enumerate(self.fill) if f < capacity]
        #: sorted (size, container, item) of what lies in underfull containers
        self.items = sorted((self.sizes[i], b, i) for b in self.open for i in bins[b] if self.sizes[i])
        #: sorted (sum, container) of two items that lie in one underfull container, each sum once; a container of capacity c has no more than c of them
        self.sums = {b: self._sums(b) for b in self.open}
        self.pairs = sorted((s, b) for b in self.open for s in self.sums[b])

    def _sums(self, b: int) -> dict[int, tuple[int, int]]:
        """The sums of two items of container ``b``, with a pair for each."""
        mine: dict[int, list[int]] = {}
        for i in self.bins[b]:
            if self.sizes[i]:
                mine.setdefault(self.sizes[i], []).append(i)
        sizes = sorted(mine)
        out = {2 * s: (mine[s][0], mine[s][1]) for s in sizes if len(mine[s]) > 1}
        for k, s in enumerate(sizes):
            for t in sizes[k + 1 :]:
                out.setdefault(s + t, (mine[s][0], mine[t][0]))
        return out

    def _renew(self, b: int, closed: bool = False) -> None:
        """Brings the pairs of container ``b`` up to date."""
        old, new = self.sums.get(b, {}), {} if closed else self._sums(b)
        for s in old.keys() - new.keys():
            del self.pairs[bisect_left(self.pairs, (s, b))]
        for s in new.keys() - old.keys():
            insort(self.pairs, (s, b))
        self.sums[b] = new

    def _largest_pair(self, top: int, least: int, target: int):
        """The largest sum of two items of at most ``top`` and at least ``least`` in a container other than ``target``, as (sum, container)."""
        at = bisect_right(self.pairs, (top, len(self.bins))) - 1
        while at >= 0 and self.pairs[at][0] >= least:
            if self.pairs[at][1] != target:
                return self.pairs[at]
            at -= 1
        return None

    def _largest(self, top: int, least: int, target: int):
        """The largest item of at most ``top`` and at least ``least`` outside ``target``, so that the squared fills rise."""
        at = bisect_right(self.items, (top, len(self.bins), 0)) - 1
        while at >= 0 and self.items[at][0] >= least:
            if self.items[at][1] != target:
                return self.items[at]
            at -= 1
        return None

    def _place(self, i: int, source: int, target: int) -> None:
        s = self.sizes[i]
        self.bins[source].remove(i)
        self.bins[target].append(i)
        self.fill[source] -= s
        self.fill[target] += s
        del self.items[bisect_left(self.items, (s, source, i))]
        insort(self.items, (s, target, i))

    def _close(self, b: int) -> None:
        for i in self.bins[b]:
            at = bisect_left(self.items, (self.sizes[i], b, i))
            if at < len(self.items) and self.items[at] == (self.sizes[i], b, i):
                del self.items[at]
        self._renew(b, closed=True)

    def gain(self, b: int) -> bool:
        """The best step that makes container ``b`` fuller, if one raises the squared fills."""
        space = self.capacity - self.fill[b]
        best = None  # (gain, items that come, their container, items that go)

        def offer(gain: int, come: list[int], source: int, go: list[int]) -> None:
            nonlocal best
            if 0 < gain <= space and self.fill[b] + gain > self.fill[source] and (best is None or gain > best[0]):
                best = gain, come, source, go

        if x := self._largest(space, 1, b):
            offer(x[0], [x[2]], x[1], [])
        mine = sorted({self.sizes[i]: i for i in self.bins[b] if self.sizes[i]}.items())
        for s, i in mine:  # one for one
            if best and best[0] == space:
                break
            if x := self._largest(s + space, s + 1, b):
                offer(x[0] - s, [x[2]], x[1], [i])
        if not best or best[0] < space:
            for k, (s, i) in enumerate(mine):  # two of ours for a larger one
                for t, j in mine[k + 1 :]:
                    if x := self._largest(s + t + space, s + t + 1, b):
                        offer(x[0] - s - t, [x[2]], x[1], [i, j])
        if not best or best[0] < space:
            for s, i in mine:  # two of another container's for one of ours
                if x := self._largest_pair(s + space, s + 1, b):
                    offer(x[0] - s, list(self.sums[x[1]][x[0]]), x[1], [i])
        if not best:
            return False
        _, come, source, go = best
        for i in go:
            self._place(i, b, source)
        for i in come:
            self._place(i, source, b)
        self._renew(source)
        if self.fill[b] == self.capacity:
            self._close(b)
        else:
            self._renew(b)
        return True

    def run(self, passes: int) -> list[list[int]]:
        for _ in range(passes):
            self.open = sorted((b for b in self.open if 0 < self.fill[b] < self.capacity), key=lambda b: (-self.fill[b], b))
            moved = False
            for b in self.open:
                while 0 < self.fill[b] < self.capacity and self.gain(b):
                    moved = True
            if not moved:
                break
        empty = [i for b, f in enumerate(self.fill) if not f for i in self.bins[b]]
        kept = [b for k, b in enumerate(self.bins) if self.fill[k]]
        if empty:  # items of no size
            kept = kept or [[]]
            kept[-1] += empty
        return kept


def fill(sizes: np.ndarray, capacity: int, passes: int = 20) -> list[list[int]]:
    """Containers of item numbers, none over ``capacity``; all sizes are at most that."""
    return Search(best_fit(sizes, capacity), sizes, capacity).run(passes)


def _group(capacity: int, passes: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece_no", "ascending")])
        bins = fill(table["n_tokens"].to_numpy(), capacity, passes)
        n = np.fromiter(map(len, bins), np.int64, len(bins))
        order = np.concatenate([np.array(sorted(b), np.int64) for b in bins])
        first = table["grp"][0].as_py() << 32
        place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        out = table.take(pa.array(order))
        return pa.table({"container": pa.array(first + np.repeat(np.arange(len(bins)), n)), "place": pa.array(place.astype(np.int32)), "doc_id": out["doc_id"], "piece_no": out["piece_no"], "first_token": out["first_token"], "n_tokens": out["n_tokens"]})

    return run


def fill_containers(sizes: DataFrame, capacity: int = 2048, group_items: int = GROUP_ITEMS, passes: int = 20) -> DataFrame:
    """Assigns texts to containers of ``capacity`` tokens.

    ``sizes`` has (doc_id, n_tokens); other columns are ignored. Returns (container, place, doc_id, piece_no, first_token,
    n_tokens): a text of at most ``capacity`` tokens is one piece, number 0; a longer one is cut after every ``capacity``
    tokens. ``place`` counts from 0 in each container. Texts without tokens, a null size among them, get a place in a
    container all the same. Null ids have no rows; an id given several times counts once, with its largest size.
    ``passes`` bounds the search over one group's containers, not the items it holds.
    """
    n = F.greatest(F.coalesce(F.max("n_tokens"), F.lit(0)), F.lit(0)).cast("bigint")
    once = written(sizes.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(n.alias("n")), "fill-sizes")
    pieces = once.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((n - 1) div {capacity} as int)")))).alias("piece_no"), "n").select(
        "doc_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("piece_no").cast("bigint") * capacity).alias("n_tokens")
    )
    groups = max(1, round(pieces.count() / group_items))  # pieces of sizes that are written: no text is read again
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(groups)))
    return grouped.groupBy("grp").applyInArrow(_group(capacity, passes), "container bigint, place int, doc_id bigint, piece_no int, first_token bigint, n_tokens bigint")


def fill_report(containers: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: (n_containers, n_tokens, least_containers, fill_pct); no assignment takes fewer containers than ``least_containers``.

    ``containers`` is the result of ``fill_containers``. An empty one has no containers and a null ``fill_pct``.
    """
    per = containers.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    sums = per.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
    return sums.select("n_containers", "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"), F.round(F.try_divide(F.col("n_tokens") * 100.0, F.col("n_containers") * F.lit(capacity)), 3).alias("fill_pct"))
