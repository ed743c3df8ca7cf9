"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white space characters.
SPACE = "[\\x20\\x09-\\x0D]+"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="recallspark-")
    return _own_dir[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again.

    The written table survives the loss of executors, unlike cached blocks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recallspark-{uuid.uuid4().hex[:12]}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch sent to Python; a larger row goes alone.
BATCH_BYTES = 4 << 20


def batch_rows(of: DataFrame, rows: int = 1000) -> None:
    """Sets how much the session sends to Python at once, in rows and bytes: little, so that workers hold little."""
    of.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    of.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Rows up to which a table of one row for each group is sent to every task.
SMALL_ROWS = 50_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, counted now; larger ones are joined by key."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def chi2_cdf(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom <= x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1.0
    while chi2_cdf(hi, k) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2
