"""Problem 8: items of varying length in containers of fixed capacity.

Lengths are whole numbers up to the capacity, so the plan needs only how many items have each length.
Exact complements come first: for each length the gap it leaves is looked up among the single lengths,
the sums of two and the sums of three, and as many containers as the counts allow are filled exactly.
What is left is packed best-fit, longest first. The plan is made once per capacity, in a task of its own, from at
most ``capacity`` counts, whatever the number of items; the items then take the places of their length.

Edge cases, all covered by tests: an item longer than the capacity is cut into full pieces and a rest;
an item without tokens takes no container (null) but keeps its row; equal lengths and repeated rows
each take a place; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.ordered import fragment, rank_rows
from quern.session import cut_lineage

#: A pattern: so many containers with these lengths in each.
Pattern = tuple[int, tuple[int, ...]]


class _Sums:
    """Which gaps single lengths, pairs and triples of available lengths fill exactly."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        there = (counts > 0).astype(np.float64)
        size = 1 << int(np.ceil(np.log2(2 * len(counts) + 2)))
        pairs = np.fft.irfft(np.fft.rfft(there, size) ** 2, size)[: len(counts)]
        #: Sums of two lengths at the start. Lengths only run out, so a sum that is absent stays absent.
        self.pair = np.rint(pairs) > 0

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.counts[gap] > 0 else None

    def double(self, gap: int, most: int) -> tuple[int, ...] | None:
        """The pair with the longest part of at most ``most``."""
        if gap < 2 or not self.pair[gap]:
            return None
        low = np.arange(max(1, gap - most), gap // 2 + 1)
        hit = low[(self.counts[low] > 0) & (self.counts[gap - low] > 0)]
        for b in hit[:4]:
            c = gap - int(b)
            if b != c or self.counts[b] > 1:
                return (c, int(b))
        return None

    def triple(self, gap: int, most: int) -> tuple[int, ...] | None:
        top = min(most, gap - 2)
        if top < 1:
            return None
        parts = np.arange(top, 0, -1)
        for d in parts[(self.counts[parts] > 0) & self.pair[gap - parts]]:
            if (rest := self.double(gap - int(d), int(d))) and self._enough((int(d), *rest)):
                return (int(d), *rest)
        return None

    def _enough(self, parts: tuple[int, ...]) -> bool:
        return all(self.counts[p] >= parts.count(p) for p in set(parts))


def exact_patterns(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Containers filled exactly by one to four items, longest first; takes them out of ``counts``."""
    out: list[Pattern] = []
    if counts[capacity]:
        out.append((int(counts[capacity]), (capacity,)))
        counts[capacity] = 0
    sums = _Sums(counts)
    for a in range(capacity - 1, 0, -1):
        gap = capacity - a
        while counts[a] > 0:
            counts[a] -= 1  # one is taken while its complement is looked for
            rest = sums.single(gap) or sums.double(gap, a) or sums.triple(gap, a)
            counts[a] += 1
            if rest is None:
                break
            parts = (a, *rest)
            k = min(int(counts[p]) // parts.count(p) for p in set(parts))
            for p in parts:
                counts[p] -= k
            out.append((k, parts))
    return out


def best_fit_patterns(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over what is left, many equal items at a time."""
    open_at: dict[int, list[Pattern]] = {}
    gaps: list[int] = []
    done: list[Pattern] = []

    def put(k: int, parts: tuple[int, ...]) -> None:
        gap = capacity - sum(parts)
        if gap == 0:
            done.append((k, parts))
        else:
            if gap not in open_at:
                open_at[gap] = []
                insort(gaps, gap)
            open_at[gap].append((k, parts))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        counts[length] = 0
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):  # no open container has room
                each = capacity // length
                if left >= each:
                    put(left // each, (length,) * each)
                if left % each:
                    put(1, (length,) * (left % each))
                break
            gap = gaps[at]
            k, parts = open_at[gap].pop()
            if not open_at[gap]:
                del open_at[gap], gaps[at]
            take = min(k, left)
            if k > take:
                put(k - take, parts)
            put(take, (*parts, length))
            left -= take
    return done + [p for group in open_at.values() for p in group]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Containers for ``counts[length]`` items of each length from 1 to ``capacity``."""
    there = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        there[length] = n
    return exact_patterns(there, capacity) + best_fit_patterns(there, capacity)


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first place of each run, first container of the run, containers in the run."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    filled: dict[int, int] = {}
    container = 0
    for k, parts in patterns:
        for p in parts:
            at = filled.get(p, 0)
            runs.setdefault(p, []).append((at, container, k))
            filled[p] = at + k
        container += k
    return {p: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for p, r in runs.items()}  # type: ignore[misc]


def pieces(sizes: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    """``window_id, doc_id, piece_no, start, tokens`` of sized items: whole, or cut where they exceed the capacity."""
    each = F.explode(F.array(*[F.struct(F.lit(w).cast("bigint").alias("window_id"), F.lit(c).cast("bigint").alias("capacity")) for w, c in windows]))
    rows = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("size"), each.alias("w")).select("doc_id", "size", "w.*")
    last = F.greatest(F.expr("(size + capacity - 1) div capacity") - 1, F.lit(0))
    cut = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    start = F.col("piece_no") * F.col("capacity")
    return cut.select("window_id", "doc_id", "piece_no", start.alias("start"), F.least("capacity", F.col("size") - start).alias("tokens"))


_RUNS = ("window_id", "tokens", "first", "base", "n")


def _planned(capacity: dict[int, int]):
    """Runs of places of one window's lengths."""

    def run(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        runs = places(plan(dict(zip(counts["tokens"].tolist(), counts["count"].tolist())), capacity[key[0]]))
        return pd.DataFrame([(key[0], p, *x) for p, r in runs.items() for x in zip(*(a.tolist() for a in r))], columns=list(_RUNS))

    return run


def _place(at: dict[int, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            container = np.full(len(b), -1, dtype=np.int64)
            for (window, length), rows in b.groupby(["window_id", "tokens"]).indices.items():
                if length:
                    first, base, n = at[window][length]
                    rank = b["rank"].to_numpy()[rows]
                    run_of = np.searchsorted(first, rank, side="right") - 1
                    container[rows] = base[run_of] + (rank - first[run_of])
            yield b.assign(container=pd.Series(container, index=b.index).astype("Int64").where(container >= 0)).drop(columns="rank")

    return run


def pack(sizes: DataFrame, windows: DataFrame) -> DataFrame:
    """``window_id, container, doc_id, piece_no, start, tokens``: which item, or piece of one, lies in which container.

    ``sizes``: ``doc_id, tokens``. ``windows``: ``window_id, capacity_tokens``, a small table of settings.
    What goes to the driver are the runs of places of each length of each window: the plan, not the items.
    """
    fixed = [(int(r[0]), int(r[1])) for r in windows.select("window_id", "capacity_tokens").distinct().orderBy("window_id").collect() if r[0] is not None and r[1] and r[1] > 0]
    if not fixed:
        return sizes.limit(0).selectExpr("0L as window_id", "0L as container", "doc_id", "0L as piece_no", "0L as start", "0L as tokens")
    items = fragment(pieces(cut_lineage(sizes), fixed), ["window_id", "tokens"], ["doc_id", "piece_no"])
    counts = items.filter("tokens > 0").groupBy("window_id", "tokens").count().repartition(4 * len(fixed), "window_id")
    planned = counts.groupBy("window_id").applyInPandas(_planned(dict(fixed)), ", ".join(f"{c} bigint" for c in _RUNS))
    runs: dict[int, dict[int, list[tuple[int, int, int]]]] = {w: {} for w, _ in fixed}
    for w, length, *run in planned.collect():
        runs[w].setdefault(length, []).append(tuple(run))
    at = {w: {length: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(r))) for length, r in by.items()} for w, by in runs.items()}
    ranked = rank_rows(items, ["window_id", "tokens"], ["doc_id", "piece_no"], "rank").select("window_id", "doc_id", "piece_no", "start", "tokens", "rank")
    schema = "window_id bigint, doc_id bigint, piece_no bigint, start bigint, tokens bigint, container bigint"
    return ranked.mapInPandas(_place(at), schema).select("window_id", "container", "doc_id", "piece_no", "start", "tokens")


def use_of(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """``window_id, containers, tokens, unused_share`` of a packing."""
    sums = packed.filter("container is not null").groupBy("window_id").agg(F.max("container").alias("last"), F.sum("tokens").alias("tokens"))
    both = sums.join(F.broadcast(windows.select("window_id", "capacity_tokens").distinct()), "window_id")  # a table of settings
    room = (F.col("last") + 1) * F.col("capacity_tokens")
    return both.select("window_id", (F.col("last") + 1).alias("containers"), "tokens", F.round(1 - F.col("tokens") / room, 6).alias("unused_share"))
