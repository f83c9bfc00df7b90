"""Filling containers of fixed capacity with items of varying length: best-two-fit on the size histogram.

Sizes are whole numbers up to the capacity, so a corpus of any length is described by at most ``capacity``
counts. The driver packs that histogram, not the items: it makes *patterns* (the sizes in one container) and
uses each as often as the counts allow, so its work and memory depend on the capacity only. Items are then
ranked within their size and take the rank's place in the patterns.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlight.session import materialise, ship_package

ROWS_PER_SALT = 500_000
MAX_CAPACITY = 1 << 20


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (sizes, repetitions) that use up ``counts`` (size -> number, 1 <= size <= capacity).

    A container takes the largest size left and then, again and again, the largest that still fits. While it
    has room left, its smallest item (but for the first) gives way to two unpacked ones if these fill the
    expanded gap more tightly.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if left and not 1 <= min(left) <= max(left) <= capacity:
        raise ValueError("sizes must lie in 1..capacity")
    sizes = sorted(left)
    patterns: list[tuple[list[int], int]] = []

    def take(size: int) -> None:
        left[size] -= 1
        if not left[size]:
            del left[size]
            sizes.remove(size)

    def give_back(size: int) -> None:
        if size not in left:
            insort(sizes, size)
            left[size] = 0
        left[size] += 1

    while sizes:
        pattern = [sizes[-1]]
        take(pattern[0])
        gap = capacity - pattern[0]
        while True:
            while gap and (at := bisect_right(sizes, gap)):
                pattern.append(sizes[at - 1])
                gap -= pattern[-1]
                take(pattern[-1])
            if not gap or len(pattern) == 1:
                break
            pair = _best_pair(sizes, left, gap + pattern[-1])
            if pair is None or sum(pair) <= pattern[-1]:
                break
            gap += pattern[-1] - sum(pair)
            give_back(pattern.pop())
            for size in pair:
                take(size)
            pattern = pattern[:1] + sorted([*pattern[1:], *pair], reverse=True)
        use = Counter(pattern)
        again = min(left.get(s, 0) // n for s, n in use.items())
        for size, n in use.items():
            if again:
                left[size] -= again * n
                if not left[size]:
                    del left[size]
                    sizes.remove(size)
        patterns.append((pattern, 1 + again))
    return patterns


def _best_pair(sizes: list[int], left: dict[int, int], room: int) -> tuple[int, int] | None:
    """The two unpacked sizes with the greatest sum that fits."""
    some = np.array(sizes[: bisect_right(sizes, room)])
    if not len(some):
        return None
    other = np.searchsorted(some, room - some, "right") - 1
    # a size goes with itself only if there are two of it
    own = other == np.arange(len(some))
    single = np.array([left[s] < 2 for s in some[own].tolist()], bool)
    other[np.flatnonzero(own)[single]] -= 1
    total = np.where(other >= 0, some + some[np.maximum(other, 0)], -1)
    at = int(total.argmax())
    return None if total[at] < 0 else (int(some[at]), int(some[other[at]]))


def _slots(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Where the ranks of each size go: arrays of size, first rank, first container, items per container."""
    rows, used, container = [], Counter(), 0
    for pattern, times in patterns:
        for size, n in Counter(pattern).items():
            rows.append((size, used[size], container, n))
            used[size] += n * times
        container += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3], np.int64(container)


def items(sizes: DataFrame, key: str, n: str, capacity: int) -> DataFrame:
    """``key, piece, size, start``: rows as items; only a row above the capacity is cut, into full pieces and a rest."""
    total = F.coalesce(F.col(n), F.lit(0)).cast("long")
    pieces = F.greatest(F.ceil(total / F.lit(capacity)), F.lit(1)).cast("int")
    return (
        sizes.select(F.col(key), total.alias("__n"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
        .withColumn("start", F.col("piece").cast("long") * capacity)
        .select(key, "piece", F.least(F.col("__n") - F.col("start"), F.lit(capacity)).alias("size"), "start")
    )


def pack(sizes: DataFrame, key: str, n: str, capacity: int) -> DataFrame:
    """Assign every row of ``sizes`` (unique ``key``, length ``n``) to containers of ``capacity``.

    Result: ``container_id`` (from 0, without holes), ``key``, ``piece``, ``start``, ``size``. Rows of length 0
    (and null) take no room; they are spread over the containers by their key's hash. Rows longer than the
    capacity fill whole containers with their full pieces; their rest is packed like any other item.
    ``sizes`` is read twice; pass a stored table.
    """
    if not 1 <= capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must lie in 1..{MAX_CAPACITY}")
    ship_package(sizes.sparkSession)
    all_items = items(sizes, key, n, capacity)
    counts = {int(s): int(c) for s, c in all_items.groupBy("size").count().collect()}  # at most capacity + 1 rows
    total = sum(counts.values())
    counts.pop(0, None)
    slot_size, slot_rank, slot_container, slot_use, containers = _slots(best_two_fit(counts, capacity))
    width = np.int64(total + 1)
    shared = sizes.sparkSession.sparkContext.broadcast((slot_size * width + slot_rank, slot_rank, slot_container, slot_use))
    salts = max(8, total // ROWS_PER_SALT)

    # the rank of an item within its size, without gathering a size in one task
    salted = all_items.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)))
    group = Window.partitionBy("size", "salt")
    offsets = salted.groupBy("size", "salt").agg(F.count("*").alias("n_salt"))
    offsets = offsets.select(
        F.col("size").alias("o_size"), F.col("salt").alias("o_salt"),
        F.coalesce(F.sum("n_salt").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    )
    ranked = salted.withColumn("r", F.row_number().over(group.orderBy(key, "piece"))).join(
        offsets, (F.col("size") == F.col("o_size")) & (F.col("salt") == F.col("o_salt")), "inner"
    ).select(key, "piece", "start", "size", (F.col("offset") + F.col("r") - 1).alias("rank"), F.pmod(F.xxhash64(key), F.lit(max(1, int(containers)))).alias("spare"))
    kind = sizes.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_key, slot_rank, slot_container, slot_use = shared.value
        for batch in batches:
            size = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            out = batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            some = size > 0
            at = np.searchsorted(slot_key, size[some] * width + rank[some], "right") - 1
            out = out.copy()
            out[some] = slot_container[at] + (rank[some] - slot_rank[at]) // slot_use[at] if some.any() else out[some]
            yield pa.RecordBatch.from_arrays([pa.array(out), *[batch.column(i) for i in range(4)]], names=["container_id", key, "piece", "start", "size"])

    return ranked.mapInArrow(place, f"container_id long, `{key}` {kind}, piece int, start long, size long")


def pack_budgets(token_counts: dict[str, DataFrame], key: str, n: str, budgets: list[tuple[int, str, int]]) -> DataFrame:
    """:func:`pack` for each (budget_id, tokenizer, capacity); ``token_counts`` by tokenizer, stored."""
    out = None
    for budget_id, tokenizer, capacity in budgets:
        one = pack(token_counts[tokenizer], key, n, capacity).select(F.lit(budget_id).cast("int").alias("budget_id"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def stored_counts(counts: DataFrame) -> DataFrame:
    return materialise(counts, "tokens")
