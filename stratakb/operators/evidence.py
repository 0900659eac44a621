"""Evidence pools: best row per key, character budgets, merging lists, first-seen order, session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, group: list[str], score: str, position: str) -> DataFrame:
    """The row with the best score of each group, ties to the first position; a null score sorts last."""
    order = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), position)
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def within_budget(df: DataFrame, group: str, position: str, size: str, budget: int) -> DataFrame:
    """Rows of each group in order of position until the sum of sizes first exceeds the budget."""
    running = F.sum(size).over(Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", running).where(F.col("used") <= budget)


def merged_first(lists: list[DataFrame], key: list[str], position: str) -> DataFrame:
    """Union of lists in which a key keeps its first row: earlier lists first, then by position; blank keys are dropped."""
    out = None
    for i, df in enumerate(lists):
        one = df.withColumn("_list", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return first_of(out, key, position, "_list").withColumnRenamed("_list", "list")


def first_of(out: DataFrame, key: list[str], position: str, list_: str = "list") -> DataFrame:
    """merged_first of lists that are one table, told apart by a column."""
    for k in key:
        out = out.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    order = Window.partitionBy(*key).orderBy(list_, position)
    return out.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def last_rows(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each group in the given order, numbered from the oldest of them."""
    newest = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    kept = df.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n)
    oldest = Window.partitionBy(group).orderBy(F.desc("_back"))
    return kept.withColumn("position", F.row_number().over(oldest)).drop("_back")
