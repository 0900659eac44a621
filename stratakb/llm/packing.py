"""Filling containers of fixed capacity by planning over the histogram of lengths.

Lengths are whole tokens up to the capacity, so their histogram has at most `capacity` rows whatever
the number of documents. Best fit decreasing is planned over those counts: a plan row says that a run
of containers holds certain lengths. Documents then take the planned slots by their rank within
their length. Ranks are counted in salted parts, as many as a length asks for, so one that holds a
third of all documents is no single task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
#: Items of one length that one task ranks.
PART_ROWS = 250_000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, dict[int, int]]]:
    """(first container, containers, {length: items in each}) of best fit decreasing over counts.

    A container takes the longest length that is left, then again and again the longest that fits. The
    same filling is used for as many containers as the counts allow, so each plan row uses up a
    length or drops below what a container of it takes: the plan has O(capacity) rows.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    lengths = sorted(left)
    rows, at = [], 0
    while lengths:
        room, used = capacity, Counter()
        i = len(lengths) - 1
        while i >= 0 and room > 0:
            n = lengths[i]
            if n <= room:
                take = min(left[n] - used[n], room // n)
                used[n] += take
                room -= take * n
            i -= 1
        used = {n: c for n, c in used.items() if c}
        times = min(left[n] // c for n, c in used.items())
        rows.append((at, times, used))
        at += times
        for n, c in used.items():
            left[n] -= times * c
        lengths = [n for n in lengths if left[n]]
    return rows


def pieces(sizes: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, start, length): an item of up to capacity whole, a longer one cut at multiples of the capacity."""
    sizes = sizes.where("size >= 1")
    steps = F.sequence(F.lit(0), ((F.col("size") - 1) / capacity).cast("int"))
    steps = sizes.select(key, "size", F.explode(steps).alias("k"))
    return steps.select(key, (F.col("k") * capacity).cast("int").alias("start"), F.least(F.lit(capacity), F.col("size") - F.col("k") * capacity).cast("int").alias("length"))


def pack(sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """(container_id, key, start, end): each piece of each item with its token range.

    sizes has the unique key and size, the tokens of the item; rows with a null size or a size under 1
    are in no container; only an item longer than the capacity is cut. An empty table gives no rows.
    A length of many items is ranked in parts of about part_rows.
    """
    spark = sizes.sparkSession
    items = pieces(sizes.select(key, F.col("size").cast("int")), key, capacity)
    total = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    used: Counter = Counter()
    runs: list[tuple[int, int, int, int]] = []  # length, rank from which, first container, items of that length in each
    for first, times, filling in plan(total, capacity):
        for length, each in filling.items():
            runs.append((length, used[length], first, each))
            used[length] += times * each
    if not runs:
        return items.select(F.lit(0).cast("long").alias("container_id"), key, "start", F.col("start").alias("end")).limit(0)
    parts = F.broadcast(spark.createDataFrame([(n, -(-c // part_rows)) for n, c in total.items()], "length int, parts int"))  # at most capacity rows
    salted = items.join(parts, "length").withColumn("part", F.pmod(F.xxhash64(key, "start"), "parts").cast("int"))
    counts = salted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy(key, "start")) - 1
    ranked = salted.withColumn("rank", rank).join(offset, ["length", "part"]).select(key, "start", "length", (F.col("rank") + F.col("offset")).alias("rank"))
    runs.sort()
    length, rank_from, first, each = (np.array(x, np.int64) for x in zip(*runs))
    code = (length << 44) + rank_from

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, start, at = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "start", "rank"))
            run = np.searchsorted(code, (n << 44) + at, "right") - 1
            container = first[run] + (at - rank_from[run]) // each[run]
            yield pa.record_batch([pa.array(container), batch.column(key), batch.column("start"), pa.array((start + n).astype(np.int32))], names=["container_id", key, "start", "end"])

    kind = sizes.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"container_id long, {key} {kind}, start int, end int")


def containers(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(container_id, used, items, ranges): one row a container, its items in order of key and range."""
    return packed.groupBy("container_id").agg(
        F.sum(F.col("end") - F.col("start")).cast("long").alias("used"),
        F.count(F.lit(1)).alias("items"),
        F.sort_array(F.collect_list(F.struct(F.col(key), F.col("start"), F.col("end")))).alias("ranges"),
    )
