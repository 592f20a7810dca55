"""Problem 8: filling containers of fixed capacity by sum-of-squares packing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import DEFAULT_DIR
from .common import map_rows
from .tokens import count

CAPACITY = 2048
#: Documents packed as one independent stream; the containers left open at a
#: stream's end are then a vanishing share of it.
DOCS_A_STREAM = 40_000


class SquarePacker:
    """Online packer: an item goes to the fill level that keeps the sum of squared
    counts of partially filled containers smallest (ties: the fuller container).

    ``level[h]`` counts the open containers filled to ``h``; containers of one
    level are interchangeable, so a stack of their numbers is all it keeps.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity)]
        self.made = 0

    def put(self, size: int) -> tuple[int, int, int]:
        """Container number, offset and place within the container for an item of ``size`` (1 to capacity)."""
        c, level = self.capacity, self.level
        if size == c:
            self.made += 1
            return self.made - 1, 0, 0
        # Opening one changes the sum by 2 N(size) + 1; moving one from h to h + size by
        # 2 N(h + size) - 2 N(h) + 2, where full containers do not count (then 1 - 2 N(h)).
        there = level[1 : c - size + 1]
        cost = 2 * level[1 + size : c + 1] - 2 * there + 2
        cost[-1] -= 1
        cost[there == 0] = np.iinfo(np.int64).max
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))
        if cost[best] <= 2 * level[size] + 1:
            filled = best + 1
            number, place = self.open[filled].pop()
            level[filled] -= 1
        else:
            filled, number, place = 0, self.made, 0
            self.made += 1
        if filled + size < c:
            level[filled + size] += 1
            self.open[filled + size].append((number, place + 1))
        return number, filled, place


def plan(items: Iterable[tuple], capacity: int) -> Iterator[tuple]:
    """``(key, size)`` to ``(key, piece, container, position, start, length)``; an item longer
    than the capacity fills whole containers of its own, and its rest is packed as an item."""
    packer = SquarePacker(capacity)
    for key, size in items:
        if not size or size < 0:
            yield key, 0, None, None, 0, 0
            continue
        piece, start = 0, 0
        while start < size:
            length = min(capacity, size - start)
            number, offset, _ = packer.put(length)
            yield key, piece, number, offset, start, length
            piece, start = piece + 1, start + length


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, streams: int = 1, key_type: str = "long") -> DataFrame:
    """``key, piece, container, container_offset, start, length``: where each piece of each item lies.

    Items are dealt to ``streams`` independent packers by a hash of the key and
    arrive in key order, so the plan does not depend on the input's partitions.
    Items of null or no size take no space (one row, ``container`` null). No item is
    split unless it is longer than the capacity; repeated rows are items of their own.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        at, own = None, []

        def flush() -> Iterator[tuple]:
            for k, piece, number, offset, start, length in plan(own, capacity):
                yield k, piece, None if number is None else f"{at}-{number}", offset, start, length

        for stream, k, n in rows:
            if stream != at:
                if own:
                    yield from flush()
                at, own = stream, []
            own.append((k, n))
        if own:
            yield from flush()

    dealt = sizes.select(F.pmod(F.xxhash64(F.col(key)), F.lit(streams)).cast("int").alias("_stream"), F.col(key), F.col(size).cast("int").alias(size))
    dealt = dealt.repartition(streams, "_stream").sortWithinPartitions("_stream", key, size)
    return map_rows(dealt, ["_stream", key, size], f"`{key}` {key_type}, piece int, container string, container_offset int, start int, length int", run)


def pack_documents(df: DataFrame, capacity: int = CAPACITY, tokenizers: str = DEFAULT_DIR) -> DataFrame:
    """Problem 8 over ``doc_id, text``: sizes in tokens of the 50k byte-level vocabulary.

    One cheap count of rows fixes the number of packers, so each packs some
    ``DOCS_A_STREAM`` documents whatever the table's size.
    """
    rows = df.select(F.count(F.lit(1))).first()[0]
    return pack(count(df, tokenizers=tokenizers), capacity=capacity, streams=max(1, -(-rows // DOCS_A_STREAM)))


def usage(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens and share of space used."""
    each = placed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("length").alias("n"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.try_divide(F.sum("n"), F.count(F.lit(1)) * F.lit(float(capacity))).alias("used"))


def violations(placed: DataFrame, sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """One row that counts what must not be: containers that hold more than ``capacity``, pieces that overlap within one,
    items of other pieces than their size allows (or whose pieces are not their size); with the number of items placed. Keys must be unique."""
    inside = placed.where(F.col("container").isNotNull())
    whole = inside.groupBy("container").agg(F.sum("length").alias("n"), F.max(F.col("container_offset") + F.col("length")).alias("last"))
    held = whole.agg(F.count_if(F.col("n") > capacity).alias("overfull"), F.count_if(F.col("n") != F.col("last")).alias("overlapping"))
    items = placed.groupBy(key).agg(F.sum("length").alias("_placed"), F.count_if(F.col("container").isNotNull()).alias("_pieces"))
    joined = sizes.join(items, key, "left")
    wrong = (~F.col("_placed").eqNullSafe(F.col(size).cast("long"))) | (F.col("_pieces") != F.ceil(F.col(size) / capacity))
    one = joined.agg(F.count_if(wrong).alias("split"), F.count(F.col("_placed")).alias("documents"))
    return held.withColumn("_one", F.lit(1)).join(one.withColumn("_one", F.lit(1)), "_one").drop("_one")
