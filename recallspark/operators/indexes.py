"""Stored vector indexes: tables by scope with a manifest, kept in step with their rows by unchanged, append or rebuild."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IndexError_, StaleIndexError
from ..storage import children, delete, exists, small, written
from . import vector

FORMAT = 1
_MANIFEST = "format int, model string, dimensions int, n long"


@dataclass(frozen=True)
class Index:
    """rows(scope, id, pos, v): the vectors of an index in the order in which they were added."""

    path: str
    model: str
    dimensions: int
    rows: DataFrame


def save(rows: DataFrame, path: str, model: str) -> Index:
    """Writes rows(scope, id, pos, v), all of them valid vectors of one dimension, as the next generation of the index at path. Readers see it once it is complete; the last one
    stays for those that still read it, older ones go."""
    spark = rows.sparkSession
    one = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"), F.count_if(~F.coalesce(vector.valid(F.col("v")), F.lit(False))).alias("bad")).first()
    if one["bad"] or one["least"] != one["most"]:
        raise IndexError_("the vectors of an index are valid and of one dimension")
    old = _generations(spark, path)
    k = max(old, default=0) + 1
    rows.select("scope", "id", "pos", "v").write.mode("overwrite").parquet(f"{path}/g{k}/vectors")
    spark.createDataFrame([(FORMAT, model, one["most"] or 0, one["n"])], _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/g{k}/manifest")
    for g in old:
        if g < k - 1:
            delete(spark, f"{path}/g{g}")
    return Index(path, model, one["most"] or 0, spark.read.parquet(f"{path}/g{k}/vectors"))


def _generations(spark: SparkSession, path: str) -> list[int]:
    return [int(n[1:]) for n in children(spark, path) if n[:1] == "g" and n[1:].isdigit()]


def load(spark: SparkSession, path: str, model: str, *, validate: Callable[[dict], None] | None = None) -> Index:
    """The newest complete index at path. Missing, of another format or model, or with another number of rows or dimension than its manifest says: an error.

    validate may raise on the manifest, given as a dict, for what else a caller asks of it.
    """
    whole = [g for g in _generations(spark, path) if exists(spark, f"{path}/g{g}/manifest/_SUCCESS") and exists(spark, f"{path}/g{g}/vectors/_SUCCESS")]
    if not whole:
        raise IndexError_("there is no index")
    at = f"{path}/g{max(whole)}"
    found = spark.read.schema(_MANIFEST).json(f"{at}/manifest").collect()
    if len(found) != 1 or found[0]["format"] != FORMAT:
        raise IndexError_("the manifest cannot be read")
    m = found[0].asDict()
    if m["model"] != model:
        raise StaleIndexError("the index is of another model")
    if validate is not None:
        validate(m)
    rows = spark.read.parquet(f"{at}/vectors")
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.min(F.size("v")).alias("e")).first()
    if seen["n"] != m["n"] or (seen["n"] and (seen["d"] != m["dimensions"] or seen["e"] != m["dimensions"])):
        raise IndexError_("vectors and manifest do not agree")
    return Index(path, model, m["dimensions"], rows)


def plan(index: DataFrame, rows: DataFrame) -> DataFrame:
    """(scope, plan): what each scope of rows(scope, id, pos) needs: unchanged, append (the index holds an exact prefix) or rebuild."""
    from .context import is_append

    return is_append(index.select("scope", "pos", "id"), rows.select("scope", "pos", "id"))


def sync(spark: SparkSession, rows: DataFrame, path: str, model: str, embed: Callable[[DataFrame], DataFrame]) -> tuple[Index, DataFrame]:
    """Brings the index at path in step with rows(scope, id, pos, text, model, v) and returns it with (action, n).

    Vectors are taken from the index where the scope's plan lets them stay, from the row where they are of the model and valid, and are embedded
    otherwise: embed gets (scope, id, pos, text) and adds v. Actions: kept, stored, embedded, dropped. Supersession of a memory is no change, since state is
    filtered after the search.
    """
    try:
        have = load(spark, path, model).rows
    except (IndexError_, StaleIndexError):
        have = spark.createDataFrame([], "scope string, id long, pos long, v array<double>")
    plans = small(plan(have, rows))
    stay = have.join(plans.filter("plan <> 'rebuild'"), "scope").select("scope", "id", F.col("v").alias("old"))
    marked = vector.needs_sync(rows, model).join(stay, ["scope", "id"], "left")
    marked = written(marked.withColumn("action", F.when(F.col("old").isNotNull(), "kept").when(~F.col("stale"), "stored").otherwise("embedded")), "index-plan")
    ready = marked.filter("action <> 'embedded'").select("scope", "id", "pos", F.coalesce("old", vector.normalize(F.col("v"))).alias("v"))
    fresh = embed(marked.filter("action = 'embedded'").select("scope", "id", "pos", "text")).select("scope", "id", "pos", vector.normalize(F.col("v")).alias("v"))
    all_rows = written(ready.unionByName(fresh), "index-rows")
    gone = have.join(rows.select("scope", "id"), ["scope", "id"], "left_anti").agg(F.lit("dropped").alias("action"), F.count("*").alias("n"))
    counts = written(marked.groupBy("action").agg(F.count("*").alias("n")).unionByName(gone), "index-counts")
    return save(all_rows, path, model), counts


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(scope, qid, rank, id, score) for queries(scope, qid, v) of the index's dimension; other queries are an error."""
    bad = queries.filter(~F.coalesce(vector.valid(F.col("v")) & (F.size("v") == index.dimensions), F.lit(False))).limit(1).count()
    if bad:
        raise IndexError_("a query's vector is not valid or of another dimension than the index")
    return vector.topk(index.rows.select("scope", "id", "v"), queries.withColumn("v", vector.normalize(F.col("v"))), k)
