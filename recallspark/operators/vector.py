"""Exact inner-product search over unit vectors, and the checks of stored vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EmbeddingError
from ..shipping import ship
from ..storage import small, written

#: Vectors and queries of a block.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 1024
#: Query blocks up to which all of them are sent to every task.
FEW_BLOCKS = 32


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def valid(v: Column) -> Column:
    """Not empty, finite, not zero."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (norm(v) > 0)


def normalize(v: Column) -> Column:
    """The unit vector in double precision; null for vectors that are not valid."""
    return F.when(valid(v), F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0])


def needs_embedding(model: Column, vector: Column, wanted: str) -> Column:
    return ~model.eqNullSafe(F.lit(wanted)) | vector.isNull()


def needs_sync(rows: DataFrame, wanted: str) -> DataFrame:
    """rows(scope, id, model, v) with stale: of another model, without a vector or with one that is not valid; all of a scope whose vectors differ in dimension.

    The dimensions of a scope are an aggregation joined back, so that a large scope is no task of its own.
    """
    usable = F.when(F.col("v").isNotNull(), F.size("v"))
    dims = rows.groupBy("scope").agg(F.coalesce(F.min(usable) != F.max(usable), F.lit(False)).alias("mixed"))
    out = rows.join(small(dims), "scope")
    return out.withColumn("stale", needs_embedding(F.col("model"), F.col("v"), wanted) | ~F.coalesce(valid(F.col("v")), F.lit(False)) | F.col("mixed")).drop("mixed")


def checked(rows: DataFrame, model: str) -> DataFrame:
    """rows(scope, id, model, v) if all are of the one model and each scope's vectors of one dimension and valid; else EmbeddingError."""
    bad = needs_sync(rows, model).filter("stale").groupBy("scope").count().limit(1).collect()
    if bad:
        raise EmbeddingError(f"{bad[0]['count']} vectors of scope {bad[0]['scope']} are missing, of another model or dimension, or not valid")
    return rows


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(scope, block, ids, flat): the vectors of a scope in blocks of about size, one row each."""
    n = small(rows.groupBy("scope").agg(F.ceil(F.count("*") / size).cast("int").alias("nb")))
    placed = rows.select("scope", F.col(key).cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).join(n, "scope").withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    packed = placed.groupBy("scope", "block").agg(F.collect_list(F.struct("id", "v")).alias("x"))
    return packed.select("scope", "block", F.transform("x", lambda x: x["id"]).alias("ids"), F.flatten(F.transform("x", lambda x: x["v"])).alias("flat"))


def topk(vectors: DataFrame, queries: DataFrame, k: int, *, digits: int = 6) -> DataFrame:
    """(scope, qid, rank, id, score): the k of vectors(scope, id, v) of a query's scope nearest to queries(scope, qid, v).

    Ties of the rounded score go to the smaller id. Both sides are packed in blocks of bounded size; every two blocks of a scope meet in a
    task, which multiplies them and keeps k for each query, so no scope and no set of queries is gathered anywhere.
    """
    ship(vectors)
    v = _blocks(vectors.withColumn("scope", F.col("scope").cast("string")), "id", VECTOR_BLOCK)
    q = written(_blocks(queries.withColumn("scope", F.col("scope").cast("string")), "qid", QUERY_BLOCK), "query-blocks").withColumnsRenamed({"block": "q_block", "ids": "q_ids", "flat": "q_flat"})
    if q.count() <= FEW_BLOCKS:
        pairs = v.join(F.broadcast(q), "scope")
    else:
        # each block goes where each block of the other side goes; the key of a meeting is the two numbers, so a large scope is spread
        v = written(v, "vector-blocks")
        nv, nq = small(v.groupBy("scope").agg(F.max("block").alias("nv"))), small(q.groupBy("scope").agg(F.max("q_block").alias("nq")))
        left = v.join(nq, "scope").withColumn("q_block", F.explode(F.sequence(F.lit(0), "nq"))).drop("nq")
        right = q.join(nv, "scope").withColumn("block", F.explode(F.sequence(F.lit(0), "nv"))).drop("nv")
        pairs = left.join(right, ["scope", "block", "q_block"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                scope, ids, x, qids, q = (batch.column(c)[i] for c in range(5))
                ids, qids = ids.values.to_numpy(), qids.values.to_numpy()
                x, q = x.values.to_numpy().reshape(len(ids), -1), q.values.to_numpy().reshape(len(qids), -1)
                score = np.round(q @ x.T, digits)
                if len(ids) > k:
                    last = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
                    qi, xi = np.nonzero(score >= last[:, None])
                else:
                    qi, xi = (a.ravel() for a in np.indices(score.shape))
                got = score[qi, xi]
                order = np.lexsort((ids[xi], -got, qi))
                qi, xi, got = qi[order], xi[order], got[order]
                few = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
                qi, xi, got = qi[few], xi[few], got[few]
                yield pa.RecordBatch.from_arrays([pa.array([scope.as_py()] * len(qi), pa.string()), pa.array(qids[qi]), pa.array(ids[xi]), pa.array(got)], ["scope", "qid", "id", "score"])

    found = pairs.select("scope", "ids", "flat", "q_ids", "q_flat").mapInArrow(multiply, "scope string, qid long, id long, score double")
    w = Window.partitionBy("scope", "qid").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("scope", "qid", "rank", "id", "score")


def oversampled(vectors: DataFrame, queries: DataFrame, state: DataFrame, limit: int, multiplier: int = 5) -> DataFrame:
    """(scope, qid, rank, id, score): the limit * multiplier nearest, then the state filter; ranks are places after it, and nothing is cut again.

    state: the (id) that pass. Filters after the search can leave fewer than limit rows.
    """
    near = topk(vectors, queries, limit * multiplier)
    kept = near.join(state.select("id"), "id", "left_semi")
    w = Window.partitionBy("scope", "qid").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w).cast("long")).select("scope", "qid", "rank", "id", "score")
