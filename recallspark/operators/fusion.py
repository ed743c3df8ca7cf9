"""Rank fusion of branches: branches(qid keys..., branch, rank, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60
AGREEMENT = 0.10


def _checked(k: int, agreement: float = 0.0) -> None:
    if k < 1 or agreement < 0:
        raise ValueError("k must be at least 1 and the agreement weight not negative")


def fuse(branches: DataFrame, *, strategy: str = "discounted_agreement", k: int = K, agreement: float = AGREEMENT, weights: dict[str, float] | None = None, by: tuple[str, ...] = ("scope", "qid")) -> DataFrame:
    """(by..., id, score, best_rank) with the score rounded to 12 digits.

    rrf: sum of 1 / (k + rank). weighted_rrf: the same with a weight for each branch. discounted_agreement: the largest
    such value plus agreement times the smallest if there are two or more. One aggregation over the union of the branches.
    """
    _checked(k, agreement)
    rr = 1.0 / (k + F.col("rank"))
    if strategy == "rrf":
        score: Column = F.sum(rr)
    elif strategy == "weighted_rrf":
        w = F.lit(1.0)
        for name, x in (weights or {}).items():
            w = F.when(F.col("branch") == name, F.lit(x)).otherwise(w)
        score = F.sum(w * rr)
    elif strategy == "discounted_agreement":
        score = F.max(rr) + F.when(F.count("*") > 1, agreement * F.min(rr)).otherwise(F.lit(0.0))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return branches.groupBy(*by, "id").agg(F.round(score, 12).alias("score"), F.min("rank").alias("best_rank"))


def rank_memories(fused: DataFrame, memories: DataFrame, limit: int, by: tuple[str, ...] = ("scope", "qid")) -> DataFrame:
    """The first limit of each query: score, importance, active first, latest update, smallest id."""
    rows = fused.join(memories.select("id", "importance", "is_active", "updated_at"), "id")
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("importance").desc(), F.col("is_active").desc(), F.col("updated_at").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def rank_messages(fused: DataFrame, messages: DataFrame, limit: int, by: tuple[str, ...]) -> DataFrame:
    """The first limit of each target: score, best branch rank, earliest, smallest id."""
    keys = [*(c for c in by if c in messages.columns), "id"]
    rows = fused.join(messages.select(*keys, "created_at"), keys)
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "best_rank", "created_at", "id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def merge_distinct(lists: DataFrame, limit: int, by: tuple[str, ...] = ("scope", "qid")) -> DataFrame:
    """Ordered union of lists(by..., list_no, pos, id): the first occurrence wins; rank is the place after that."""
    first = lists.withColumn("n", F.row_number().over(Window.partitionBy(*by, "id").orderBy("list_no", "pos"))).filter("n = 1")
    w = Window.partitionBy(*by).orderBy("list_no", "pos")
    return first.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit).select(*by, "rank", "id")
