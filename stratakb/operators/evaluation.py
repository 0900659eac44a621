"""Evaluation of ranked lists: hit ranks, recall, reciprocal rank, groups, path contribution, report differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_ranks(expected: DataFrame, ranked: DataFrame, query: str, item: str) -> DataFrame:
    """(query, rank): best rank of an expected item per query, null where none was returned."""
    hits = expected.select(query, item).distinct().join(ranked.select(query, item, "rank"), [query, item])
    best = hits.groupBy(query).agg(F.min("rank").alias("rank"))
    return expected.select(query).distinct().join(best, query, "left")


def recall_at(k: int, rank: str = "rank") -> Column:
    return F.round(F.coalesce(F.avg(F.coalesce((F.col(rank) <= k).cast("int"), F.lit(0))), F.lit(0.0)), 4)


def mean_reciprocal_rank(rank: str = "rank") -> Column:
    return F.round(F.coalesce(F.avg(F.coalesce(F.lit(1.0) / F.col(rank), F.lit(0.0))), F.lit(0.0)), 4)


def summary() -> list[Column]:
    """Aggregates of a table of hit ranks; zeros for an empty one."""
    return [F.count(F.lit(1)).alias("queries"), *[recall_at(k).alias(f"recall_{k}") for k in (1, 3, 5, 10)], mean_reciprocal_rank().alias("mrr")]


def merged_rank(first: Column, held: Column, second: Column, before: Column) -> Column:
    """Rank of an item in a list that takes one list whole and then what else a second has: its rank in the first, else behind its `held` rows, less the `before` rows of the second that the first has too."""
    return F.coalesce(first, held + second - before)


def path_contribution(ranks: DataFrame, k: int = 5) -> DataFrame:
    """One row: recall at k of the vector list, of the lexical list and of both as one, and how many queries only the lexical list rescues.

    ranks has embedding_rank, grep_rank and full_rank of each query, null where the expected item is missing; an empty table gives zeros.
    """
    hit = lambda c: F.coalesce((F.col(c) <= k).cast("int"), F.lit(0))
    share = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    rescued = hit("full_rank") * (1 - hit("embedding_rank"))
    return ranks.agg(
        share(hit("embedding_rank")).alias("embedding_only_recall_5"),
        share(hit("grep_rank")).alias("grep_only_recall_5"),
        share(hit("full_rank")).alias("full_recall_5"),
        F.coalesce(F.sum(rescued), F.lit(0)).cast("long").alias("grep_rescue_count"),
        share(rescued).alias("grep_rescue_pct"),
    )


def grouped_summary(ranks: DataFrame, *groups: str) -> DataFrame:
    """The summary overall and by each of the groups in one pass over grouping sets; blank values are 'unknown'."""
    filled = ranks.select("rank", *[F.coalesce(F.nullif(F.trim(g), F.lit("")), F.lit("unknown")).alias(g) for g in groups])
    sets = [[], *[[F.col(g)] for g in groups]]
    return filled.groupingSets(sets, *groups).agg(*summary())


def report_difference(left: DataFrame, right: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """(metric, left, right, delta): full outer by name, the delta where both sides have a value."""
    a, b = left.select(name, F.col(value).alias("left")), right.select(name, F.col(value).alias("right"))
    return a.join(b, name, "full").withColumn("delta", F.round(F.col("right") - F.col("left"), 4))
