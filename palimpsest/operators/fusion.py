"""Ranked lists: rank, cut, fuse, compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
DEPTH = 50


def topk(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts groups before the shuffle (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def rrf(lists: DataFrame, k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list_id, list_no, edge_id, rank): query_id, edge_id, fused, rank.

    Ties follow the order in which lists are read: the first list that has the item, then its rank there."""
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("list_id") == name, float(w)).otherwise(weight)
    fused = lists.groupBy("query_id", "edge_id").agg(
        F.sum(weight / (k + F.col("rank"))).alias("fused"), F.min(F.struct("list_no", "rank")).alias("first"), F.array_sort(F.collect_set("list_id")).alias("matched")
    )
    order = Window.partitionBy("query_id").orderBy(F.round("fused", 9).desc(), "first", "edge_id")
    return fused.select("query_id", "edge_id", F.round("fused", 9).alias("fused"), "matched", F.row_number().over(order).alias("rank"))


def as_list(ranked: DataFrame, name: str, number: int) -> DataFrame:
    return ranked.select("query_id", F.lit(name).alias("list_id"), F.lit(number).alias("list_no"), "edge_id", "rank")


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Ordered distinct: the first row of each key."""
    return topk(df, by, order, 1, "nth").drop("nth")


def fit_to_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """The longest prefix of each query's list whose characters, by four, stay within the budget: the first fact that
    does not fit ends the list. A budget of 0 is none."""
    if not budget:
        return ranked
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.length(F.coalesce("fact", F.lit("")))).over(upto)
    return ranked.withColumn("spent", F.floor(spent / 4).cast("bigint")).where(F.col("spent") <= budget)
