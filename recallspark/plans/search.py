"""Hybrid search: structured, lexical and vector branches over memories, fused, for many queries in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, lexical, structured, vector

MOST_LIMIT, BRANCH_FACTOR, VECTOR_FACTOR = 100, 5, 5


def branches(memories: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, *, limit: int, filters: structured.Filters, lexical_backend: str = "bm25", intents: DataFrame | None = None) -> DataFrame:
    """(scope, qid, branch, rank, id). BM25 statistics are those of the filtered memories; the vector index holds all of them and is filtered after the search."""
    if not 1 <= limit <= MOST_LIMIT:
        raise ValueError(f"limit must be from 1 to {MOST_LIMIT}")
    cut = min(MOST_LIMIT, limit * BRANCH_FACTOR)
    passing = memories.filter(structured.condition(filters))
    lex = lexical.bm25_topk if lexical_backend == "bm25" else lexical.fts_topk
    out = lex(passing.select("scope", "id", "text"), queries, cut).select("scope", "qid", F.lit("bm25").alias("branch"), "rank", "id")
    near = vector.oversampled(vectors, query_vectors, passing, limit, VECTOR_FACTOR)
    out = out.unionByName(near.select("scope", "qid", F.lit("vector").alias("branch"), "rank", "id"))
    fixed = structured.explicit(memories, filters, cut).select("scope", "rank", "id")
    lists = queries.select("scope", "qid").join(fixed, "scope").select("scope", "qid", F.lit(2).alias("list_no"), F.col("rank").alias("pos"), "id")
    if intents is not None:
        guessed = structured.by_intent(memories, intents, filters, cut)
        lists = lists.unionByName(guessed.select("scope", "qid", F.lit(1).alias("list_no"), F.col("rank").alias("pos"), "id"))
    merged = fusion.merge_distinct(lists, cut).select("scope", "qid", F.lit("structured").alias("branch"), "rank", "id")
    return out.unionByName(merged)


def hybrid_search(memories: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, *, limit: int = 10, filters: structured.Filters | None = None, lexical_backend: str = "bm25", strategy: str = "discounted_agreement", intents: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(scope, qid, rank, id, score) for queries(scope, qid, text); vectors(scope, id, v), query_vectors(scope, qid, v); intents as structured.by_intent() takes them."""
    found = branches(memories, queries, vectors, query_vectors, limit=limit, filters=filters or structured.Filters(), lexical_backend=lexical_backend, intents=intents)
    fused = fusion.fuse(found, strategy=strategy, weights=weights)
    return fusion.rank_memories(fused, memories, limit).select("scope", "qid", "rank", "id", "score")


def hits(found: DataFrame, ranked: DataFrame, memories: DataFrame) -> DataFrame:
    """ranked(scope, qid, rank, id, score) with the memory's text, importance and state, and its rank in each branch of found, null where the branch lacks it."""
    place = lambda b: F.min(F.when(F.col("branch") == b, F.col("rank"))).alias(f"{b}_rank")
    by = found.groupBy("scope", "qid", "id").agg(*[place(b) for b in ("bm25", "vector", "structured")])
    return ranked.select("scope", "qid", "rank", "id", "score").join(by, ["scope", "qid", "id"], "left").join(memories.select("id", "text", "importance", "is_active"), "id").select("scope", "qid", "rank", "id", "score", "text", "importance", "is_active", "bm25_rank", "vector_rank", "structured_rank")


#: The nine compared ways to fuse; a single branch, or a strategy with its parameter.
VARIANTS = (
    ("bm25_only", "bm25", None), ("vector_only", "vector", None), ("current_rrf", "rrf", None),
    ("weighted_rrf_bm25_0.25", "weighted_rrf", 0.25), ("weighted_rrf_bm25_0.50", "weighted_rrf", 0.50), ("weighted_rrf_bm25_0.75", "weighted_rrf", 0.75),
    ("discounted_agreement_lambda_0.10", "discounted_agreement", 0.10), ("discounted_agreement_lambda_0.25", "discounted_agreement", 0.25), ("discounted_agreement_lambda_0.50", "discounted_agreement", 0.50),
)


def all_variants(found: DataFrame, memories: DataFrame, limit: int) -> DataFrame:
    """(variant, scope, qid, rank, id, score): every variant over the same branches, which are scored once.

    The branches are aggregated to one row for each memory and query; each variant is an expression over it.
    """
    rr = lambda b: F.max(F.when(F.col("branch") == b, 1.0 / (fusion.K + F.col("rank"))))
    wide = found.groupBy("scope", "qid", "id").agg(rr("bm25").alias("b"), rr("vector").alias("v"), rr("structured").alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    most, n = F.greatest("b", "v", "s"), sum(F.col(c).isNotNull().cast("int") for c in "bvs")
    second = F.when(n > 1, F.least("b", "v", "s")).otherwise(0.0)
    scores = []
    for label, strategy, x in VARIANTS:
        score = {"bm25": F.col("b"), "vector": F.col("v"), "rrf": zero(F.col("b")) + zero(F.col("v")) + zero(F.col("s"))}.get(strategy)
        if strategy == "weighted_rrf":
            score = x * zero(F.col("b")) + zero(F.col("v")) + zero(F.col("s"))
        elif strategy == "discounted_agreement":
            score = most + x * second
        scores.append(F.struct(F.lit(label).alias("variant"), F.round(score, 12).alias("score")))
    rows = wide.select("scope", "qid", "id", F.explode(F.array(*scores)).alias("x")).select("scope", "qid", "id", "x.variant", "x.score").filter("score is not null")
    return fusion.rank_memories(rows, memories, limit, ("variant", "scope", "qid")).select("variant", "scope", "qid", "rank", "id", "score")
