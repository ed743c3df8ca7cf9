"""Who and where: users and conversations by their external names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ScopeError
from ..storage import written


def checked_names(rows: DataFrame, *columns: str) -> DataFrame:
    """rows, if none of the columns is null or blank in any of them."""
    bad = rows.filter(" or ".join(f"{c} is null or trim({c}) = ''" for c in columns))
    if bad.limit(1).count():
        raise ScopeError(f"{', '.join(columns)} must not be blank")
    return rows


def resolution(asked: DataFrame, conversations: DataFrame) -> DataFrame:
    """(qid, n, conv_id) for asked(qid, user_id, name), where user_id may be null: how many of conversations(conv_id, user_id, name) have the name (and are the user's), and one of them."""
    a, c = asked.select("qid", F.col("user_id").alias("au"), F.col("name").alias("an")), conversations.select("conv_id", "user_id", "name")
    hit = (F.col("name") == F.col("an")) & (F.col("au").isNull() | (F.col("user_id") == F.col("au")))
    return a.join(c, hit, "left").groupBy("qid").agg(F.count("conv_id").alias("n"), F.min("conv_id").alias("conv_id"))


def resolve(asked: DataFrame, conversations: DataFrame) -> DataFrame:
    """(qid, conv_id): the one conversation each name means. None, or more than one without a user to tell them apart, is an error."""
    found = written(resolution(asked, conversations), "scopes")
    bad = found.filter("n <> 1").limit(1).collect()
    if bad:
        raise ScopeError("no such conversation" if bad[0]["n"] == 0 else "the conversation's name is ambiguous")
    return found.select("qid", "conv_id")


def get_or_create(known: DataFrame, wanted: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(all, new): the rows of known(keys..., id) with those of wanted(keys...) that it lacks, once each, under new ids behind the largest; asking again creates nothing."""
    last = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    fresh = wanted.select(*keys).distinct().join(known.select(*keys), list(keys), "left_anti")
    fresh = written(fresh.orderBy(*keys).withColumn("id", F.monotonically_increasing_id() + F.lit(last + 1)), "created")
    return known.select(*keys, "id").unionByName(fresh), fresh
