"""Filling containers of permitted capacities with items, by best fit on the size histogram.

Sizes are whole numbers up to the largest capacity, so their histogram has at most that many rows, whatever the
number of items. Best fit runs on the histogram in the driver and yields bin patterns with multiplicities; items then
find their place in Spark by their rank among the items of the same size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Permitted container sizes in tokens.
CAPACITIES = (512, 1024, 2048)
#: Items of one size are ranked within hash buckets of about this many, so that no task holds a whole size.
RANKED = 100_000


@dataclass(frozen=True)
class Pattern:
    """``bins`` containers of ``capacity``, each holding ``items``: (size, how many) pairs."""

    items: tuple[tuple[int, int], ...]
    bins: int
    capacity: int


def bin_cost(capacity: int, exponent: float = 1.0) -> float:
    return float(capacity) ** exponent


def best_fit(histogram: dict[int, int], capacities: tuple[int, ...], choose) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over a histogram: contents with multiplicities. ``choose(size)`` is the capacity to open.

    Groups of equal bins are moved as one, and a size splits at most one group, so the groups stay few.
    """
    open_at: dict[int, list[tuple[tuple, int]]] = {}
    residuals: list[int] = []
    closed = []

    def put(residual: int, content: tuple, n: int) -> None:
        if n and residual:
            if residual not in open_at:
                open_at[residual] = []
                insort(residuals, residual)
            open_at[residual].append((content, n))
        elif n:
            closed.append((content, n))

    def add(content: tuple, size: int, k: int) -> tuple:
        if content and content[-1][0] == size:
            return (*content[:-1], (size, content[-1][1] + k))
        return (*content, (size, k))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            i = bisect_left(residuals, size)
            if i < len(residuals):
                residual = residuals[i]
                content, n = open_at[residual].pop()
                if not open_at[residual]:
                    del open_at[residual], residuals[i]
                k = residual // size
                whole = min(n, left // k)
                if whole:
                    put(residual - k * size, add(content, size, k), whole)
                    left -= whole * k
                if n > whole and left and left < k:
                    put(residual - left * size, add(content, size, left), 1)
                    whole, left = whole + 1, 0
                put(residual, content, n - whole)
            else:
                capacity = choose(size)
                k = capacity // size
                n, rest = divmod(left, k)
                put(capacity - k * size, ((size, k),), n)
                put(capacity - rest * size, ((size, rest),), int(rest > 0))
                left = 0
    return closed + [g for r in residuals for g in open_at[r]]


def plan_bins(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, exponent: float = 1.0) -> list[Pattern]:
    """The cheapest plan over the opening policies, each bin finally downsized to the least capacity for its content.

    Policies: for each permitted capacity as the usual one to open, an item opens the cheapest bin of at least that
    size that holds it; and the policy that opens the capacity with the least cost per filled token when filled with
    items of this size alone. The cost of a bin is ``capacity ** exponent``.
    """
    sizes = tuple(sorted(capacities))
    if not histogram:
        return []
    if min(histogram) < 1 or max(histogram) > sizes[-1]:
        raise ValueError("sizes must lie between 1 and the largest capacity")
    fit = lambda content: next(c for c in sizes if c >= content)
    cost = lambda c: bin_cost(c, exponent)
    policies = [lambda s, c=c: max(c, fit(s)) for c in sizes]
    policies.append(lambda s: min((c for c in sizes if c >= s), key=lambda c: cost(c) / (c // s * s)))
    best = None
    for choose in policies:
        plan = [Pattern(content, n, fit(sum(s * k for s, k in content))) for content, n in best_fit(histogram, sizes, choose)]
        total = sum(cost(p.capacity) * p.bins for p in plan)
        if best is None or total < best[0]:
            best = total, plan
    return sorted(best[1], key=lambda p: (p.capacity, p.items), reverse=True)


def slot_table(plan: list[Pattern]) -> pd.DataFrame:
    """Where the items of each size go: ranks from ``start`` on fill, ``per_bin`` to a bin, the bins from ``first_bin`` on."""
    rows, used, first = [], {}, 0
    for p in plan:
        for size, k in p.items:
            rows.append((size, used.get(size, 0), k, first, p.capacity))
            used[size] = used.get(size, 0) + k * p.bins
        first += p.bins
    out = pd.DataFrame(rows, columns=["size", "start", "per_bin", "first_bin", "capacity"], dtype="int64")
    return out.sort_values(["size", "start"], ignore_index=True)


def cut_to_capacity(items: DataFrame, largest: int, size: str = "n_tokens") -> DataFrame:
    """One row per piece: an item over ``largest`` is cut into full pieces and a rest; others stay whole. Adds piece, start, size."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    pieces = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((n - 1) / largest), F.lit(0)).cast("bigint"))
    return (
        items.withColumn("piece", F.explode(pieces))
        .withColumn("start", F.col("piece") * largest)
        .withColumn("size", F.least(F.lit(largest), n - F.col("start")).cast("int"))
    )


def pack(items: DataFrame, *, key: str = "doc_id", size: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES, exponent: float = 1.0) -> DataFrame:
    """Containers of all items: (key, piece, start, size, bin_id, capacity).

    Items of null or zero size take no room and come out with null bin_id and capacity. Repeated items are packed as
    often as they stand; ties of size are ranked by key. ``items`` is read twice: give a materialized table.
    """
    pieces = cut_to_capacity(items.select(key, size), max(capacities), size).select(key, "piece", "start", "size")
    histogram = {r["size"]: r["n"] for r in pieces.filter("size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = items.sparkSession.sparkContext.broadcast(slot_table(plan_bins(histogram, capacities, exponent)))
    # rank within a size: row number within a hash bucket, plus the rows of the buckets before
    buckets = -(-max(histogram.values(), default=1) // RANKED)
    bucketed = pieces.withColumn("_b", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)).cast("int"))
    group = W.partitionBy("size", "_b")
    ranked = bucketed.withColumn("_r", F.row_number().over(group.orderBy(key, "piece")) - 1)
    counts = bucketed.groupBy("size", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("size").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = ranked.join(before, ["size", "_b"]).select(key, "piece", "start", "size", (F.col("_r") + F.col("_before")).cast("bigint").alias("_rank"))
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = slots.value
        base = 1 << 40  # more than the ranks of one size
        keys = table["size"].to_numpy() * base + table["start"].to_numpy()
        for b in batches:
            sizes, ranks = b["size"].to_numpy(np.int64), b["_rank"].to_numpy(np.int64)
            empty = sizes <= 0
            at = np.where(empty, -1, np.searchsorted(keys, sizes * base + ranks, "right") - 1)
            hit = table.reindex(at)  # -1 is no row
            bins = hit["first_bin"].to_numpy() + (ranks - hit["start"].to_numpy()) // hit["per_bin"].to_numpy()
            out = b.drop(columns="_rank")
            out["bin_id"] = pd.array(pd.Series(bins), "Int64")
            out["capacity"] = pd.array(hit["capacity"].reset_index(drop=True), "Int32")
            yield out

    return placed.mapInPandas(run, f"`{key}` {kind}, piece bigint, start bigint, size int, bin_id bigint, capacity int")
