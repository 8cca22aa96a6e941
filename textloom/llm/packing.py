"""Filling containers of fixed capacity by best-fit decreasing (problem 8).

What best-fit decreasing does depends on the sizes alone, and there are at most ``capacity`` different sizes. The plan
is therefore made from the histogram of all sizes, which is bounded by the capacity whatever the number of rows, with
a segment tree over remaining capacities that finds the tightest open container in logarithmic time. It equals the plan
of placing row after row, as rows of one size are interchangeable. Rows then look up their place by their rank within
their size; ranks are counted in buckets, so that one size may hold any share of the rows.

Defined results: a row longer than the capacity is split into pieces of full capacity and a rest; rows of size 0 (null
and empty texts) go into the tightest container then open; capacities that are null or below 1 are left out.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import cut

ROWS_PER_BUCKET = 250_000
#: Capacities beyond this are refused, as the plan's size is bounded by the capacity.
MAX_CAPACITY = 1 << 22


class RemainingTree:
    """A segment tree over remaining capacities 0..capacity that knows which of them have an open container."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << max(1, capacity).bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, remaining: int, is_open: bool) -> None:
        node = remaining + self.leaves
        self.any[node] = is_open
        node >>= 1
        while node:
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]
            node >>= 1

    def tightest(self, size: int) -> int:
        """The least remaining capacity of at least ``size`` that is open, or -1."""
        node = size + self.leaves
        if self.any[node]:
            return size
        while node > 1:
            if not node & 1 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing of whole groups of equal items.

    Returns the ranges (size, first rank, first container, items a container, first position) and the number of
    containers. The items of a range fill its containers one after the other.
    """
    tree, ranges, containers = RemainingTree(capacity), [], 0
    open_at: dict[int, deque[tuple[int, int, int]]] = {}  # remaining -> runs of alike containers (first, count, items)

    def put(remaining: int, run: tuple[int, int, int]) -> None:
        runs = open_at.setdefault(remaining, deque())
        if not runs:
            tree.set(remaining, True)
        runs.append(run)

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            remaining = tree.tightest(size)
            if remaining < 0:
                each = left if size == 0 else capacity // size
                count = -(-left // each)
                run, remaining = (containers, count, 0), capacity
                containers += count
            else:
                run = open_at[remaining].popleft()
                if not open_at[remaining]:
                    tree.set(remaining, False)
            first, count, items = run
            each = left if size == 0 else remaining // size
            full = min(count, left // each)
            if full:
                ranges.append((size, rank, first, each, items))
                put(remaining - each * size, (first, full, items + each))
                left, rank, first, count = left - full * each, rank + full * each, first + full, count - full
            if left and count:
                ranges.append((size, rank, first, each, items))
                put(remaining - left * size, (first, 1, items + left))
                left, rank, first, count = 0, rank + left, first + 1, count - 1
            if count:
                open_at.setdefault(remaining, deque())
                if not open_at[remaining]:
                    tree.set(remaining, True)
                open_at[remaining].appendleft((first, count, items))
    return ranges, containers


def _place(plans: dict[int, tuple[np.ndarray, ...]]):
    """(id, piece, capacity, size, rank) -> container and position, by binary search in the capacity's ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            capacity, size, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("capacity", "size", "rank"))
            container, position = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for c, (sizes, ranks, firsts, each, items) in plans.items():
                own = np.flatnonzero(capacity == c)
                if not len(own):
                    continue
                low, high = np.searchsorted(sizes, size[own], "left"), np.searchsorted(sizes, size[own], "right")
                at = np.zeros(len(own), np.int64)
                for s in np.unique(size[own]):
                    these = np.flatnonzero(size[own] == s)
                    a, b = low[these[0]], high[these[0]]
                    at[these] = a + np.searchsorted(ranks[a:b], rank[own][these], "right") - 1
                after = rank[own] - ranks[at]
                container[own], position[own] = firsts[at] + after // each[at], items[at] + after % each[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("piece"), batch.column("capacity"), batch.column("size"), pa.array(container), pa.array(position)],
                names=["id", "piece", "capacity", "n_tokens", "container", "position"],
            )

    return run


def pack(sizes: DataFrame, capacities: DataFrame, id_column: str = "doc_id", size_column: str = "n_tokens", name_column: str = "capacity_name", capacity_column: str = "capacity_tokens") -> DataFrame:
    """(name, id, piece, n_tokens, container, position) for every row of ``sizes`` and every row of ``capacities``."""
    named = capacities.where(F.col(capacity_column) >= 1).select(F.col(name_column).alias("name"), F.col(capacity_column).cast("bigint").alias("capacity")).distinct()
    limits = [r[0] for r in named.select("capacity").distinct().orderBy("capacity").limit(1001).collect()]
    if len(limits) > 1000 or any(c > MAX_CAPACITY for c in limits):
        raise ValueError("too many or too large capacities")
    rows = cut(sizes.select(F.col(id_column).alias("id"), F.coalesce(F.col(size_column), F.lit(0)).cast("bigint").alias("size")))
    every = rows.withColumn("capacity", F.explode(F.array([F.lit(c).cast("bigint") for c in limits])))
    each = F.greatest(F.lit(1), F.expr("cast((size + capacity - 1) div capacity as bigint)"))
    items = every.select("id", "capacity", "size", F.posexplode(F.sequence(F.lit(1).cast("bigint"), each)).alias("piece", "_")).drop("_")
    items = items.withColumn("size", F.least(F.col("capacity"), F.col("size") - F.col("piece") * F.col("capacity")))
    counted = items.groupBy("capacity", "size").count().collect()  # at most capacity rows for each capacity
    plans, total = {}, 0
    for c in limits:
        histogram = {r["size"]: r["count"] for r in counted if r["capacity"] == c}
        total = max(total, sum(histogram.values()))
        ranges = sorted(plan(histogram, c)[0], key=lambda r: r[:2])
        plans[c] = tuple(np.array(column, np.int64) for column in zip(*ranges)) if ranges else tuple(np.zeros(0, np.int64) for _ in range(5))
    buckets = -(-max(total, 1) // ROWS_PER_BUCKET)
    items = items.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    within = Window.partitionBy("capacity", "size", "bucket").orderBy("id", "piece")
    ranked = items.withColumn("rank", F.row_number().over(within).cast("bigint") - 1)
    if buckets > 1:
        before = Window.partitionBy("capacity", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = items.groupBy("capacity", "size", "bucket").count().select("capacity", "size", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
        ranked = ranked.join(offsets, ["capacity", "size", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    kind = rows.schema["id"].dataType.simpleString()
    placed = ranked.select("id", "piece", "capacity", "size", "rank").mapInArrow(_place(plans), f"id {kind}, piece int, capacity bigint, n_tokens bigint, container bigint, position bigint")
    return placed.join(F.broadcast(named), "capacity").select(F.col("name").alias(name_column), F.col("id").alias(id_column), "piece", "n_tokens", "container", "position")
