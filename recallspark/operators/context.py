"""Conversation context: interactions, windows before a target, lexical and semantic older messages, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms, tokenize
from .fusion import fuse, rank_messages
from .lexical import bm25_topk

RECENT, LEXICAL, SEMANTIC, OLDER = 6, 3, 3, 6
SUMMARY_TRIGGER, SUMMARY_KEEP = 20, 6


def usable_messages(messages: DataFrame) -> DataFrame:
    """User and assistant messages with text."""
    return messages.filter(F.col("role").isin("user", "assistant") & (F.trim("content") != ""))


def interactions(messages: DataFrame) -> DataFrame:
    """messages(conv_id, created_at, id, role) with interaction: a user message and the assistant's directly after it are one, any other message is its own."""
    w = Window.partitionBy("conv_id").orderBy("created_at", "id")
    joins = (F.col("role") == "assistant") & F.coalesce(F.lag("role").over(w) == "user", F.lit(False))
    return messages.withColumn("start", (~joins).cast("long")).withColumn("interaction", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("start")


def last_targets(messages: DataFrame) -> DataFrame:
    """The last message of each conversation as its target: (conv_id, target_at, target_id, target_text)."""
    last = messages.groupBy("conv_id").agg(F.max(F.struct("created_at", "id", "content")).alias("t"))
    return last.select("conv_id", F.col("t.created_at").alias("target_at"), F.col("t.id").alias("target_id"), F.col("t.content").alias("target_text"))


def before(messages: DataFrame, targets: DataFrame) -> DataFrame:
    """Messages of the target's conversation before it, by (created_at, id)."""
    return messages.join(targets, "conv_id").filter(F.struct("created_at", "id") < F.struct(F.col("target_at"), F.col("target_id")))


def recent(messages: DataFrame, targets: DataFrame, n: int = RECENT) -> DataFrame:
    """The n messages before each target, with place 1 for the earliest of them."""
    w = Window.partitionBy("conv_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    cut = before(messages, targets).withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)
    return cut.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("created_at", "id")).cast("long")).drop("back")


def lexical_queries(targets: DataFrame) -> DataFrame:
    """(conv_id, query): up to twelve telling words of the target, joined by " | "."""
    return targets.select("conv_id", F.array_join(query_terms(tokenize(F.col("target_text"))), " | ").alias("query"))


def older(messages: DataFrame, targets: DataFrame, n: int = RECENT) -> DataFrame:
    """Messages before the target that are not among its n recent ones."""
    near = recent(messages, targets, n).select("conv_id", "id")
    return before(messages, targets).join(near, ["conv_id", "id"], "left_anti")


def lexical_older(messages: DataFrame, targets: DataFrame, n_recent: int = RECENT, k: int = LEXICAL) -> DataFrame:
    """(conv_id, rank, id, score): BM25 over the older messages of the conversation, which alone give the statistics."""
    docs = older(messages, targets, n_recent).select(F.col("conv_id").alias("scope"), "id", F.col("content").alias("text"))
    queries = lexical_queries(targets).select(F.col("conv_id").alias("scope"), F.lit(0).alias("qid"), F.col("query").alias("text"))
    return bm25_topk(docs, queries, k).select(F.col("scope").alias("conv_id"), "rank", "id", "score")


def semantic_older(messages: DataFrame, targets: DataFrame, vectors: DataFrame, n_recent: int = RECENT, k: int = SEMANTIC, multiplier: int = 3) -> DataFrame:
    """(conv_id, rank, id, score): of the whole conversation the k * multiplier nearest to the target's vector, then without the target, recent and later
    ones, then the first k. vectors(conv_id, id, v) are unit vectors; ids need only be unique within a conversation. A conversation is scored against its own target only."""
    mine = messages.join(vectors, ["conv_id", "id"]).select("conv_id", "id", "created_at", "v")
    goal = targets.join(vectors.select("conv_id", F.col("id").alias("target_id"), F.col("v").alias("q")), ["conv_id", "target_id"]).select("conv_id", "q")
    score = F.round(F.aggregate(F.zip_with("v", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x), 6)
    w = Window.partitionBy("conv_id").orderBy(F.col("score").desc(), "created_at", "id")
    near = mine.join(goal, "conv_id").withColumn("score", score).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k * multiplier)
    kept = near.select("conv_id", "id", "score", "pos").join(older(messages, targets, n_recent).select("conv_id", "id"), ["conv_id", "id"], "left_semi")
    w2 = Window.partitionBy("conv_id").orderBy("pos")
    return kept.withColumn("rank", F.row_number().over(w2).cast("long")).filter(F.col("rank") <= k).select("conv_id", "rank", "id", "score")


def older_context(messages: DataFrame, targets: DataFrame, vectors: DataFrame, n_recent: int = RECENT, k: int = OLDER) -> DataFrame:
    """(conv_id, id, score, place): both branches fused by reciprocal ranks, the first k, in the order of time."""
    branches = lexical_older(messages, targets, n_recent).select("conv_id", F.lit("lexical").alias("branch"), "rank", "id").unionByName(semantic_older(messages, targets, vectors, n_recent).select("conv_id", F.lit("semantic").alias("branch"), "rank", "id"))
    kept = rank_messages(fuse(branches, strategy="rrf", by=("conv_id",)), messages, k, ("conv_id",))
    w = Window.partitionBy("conv_id").orderBy("created_at", "id")
    return kept.withColumn("place", F.row_number().over(w).cast("long")).select("conv_id", "id", "score", "place")


def distinct_older(selected: DataFrame) -> DataFrame:
    """Older messages once by role and content, the earliest of each."""
    w = Window.partitionBy("conv_id", "role", "content").orderBy("created_at", "id")
    return selected.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def summary_due(messages: DataFrame, markers: DataFrame | None = None, trigger: int = SUMMARY_TRIGGER, keep: int = SUMMARY_KEEP) -> DataFrame:
    """(conv_id, n_eligible, first_id, marker_id) of conversations whose summary is due.

    Uncovered messages come after the marker(conv_id, marker_at, marker_id); the last keep of them wait; trigger or more others are summarised and the last
    of these is the new marker.
    """
    rows = messages if markers is None else after_markers(messages, markers)
    w = Window.partitionBy("conv_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    open_ = rows.withColumn("back", F.row_number().over(w)).filter(F.col("back") > keep)
    due = open_.groupBy("conv_id").agg(F.count("*").alias("n_eligible"), F.min(F.struct("created_at", "id"))["id"].alias("first_id"), F.max(F.struct("created_at", "id"))["id"].alias("marker_id"))
    return due.filter(F.col("n_eligible") >= trigger)


def after_markers(messages: DataFrame, markers: DataFrame) -> DataFrame:
    """The messages behind the marker(conv_id, marker_at, marker_id) of their conversation; all of one without a marker."""
    rows = messages.join(markers.withColumnRenamed("marker_id", "old_id"), "conv_id", "left")
    return rows.filter(F.col("marker_at").isNull() | (F.struct("created_at", "id") > F.struct(F.col("marker_at"), F.col("old_id")))).select(*messages.columns)


def resume_progress(sessions: DataFrame) -> DataFrame:
    """sessions(conv_id, session, n_turns, done) with total, the turns up to the session, and resumed: whether it and all before it are done, so that a run goes on behind it."""
    w = Window.partitionBy("conv_id").orderBy("session").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sessions.withColumn("total", F.sum("n_turns").over(w)).withColumn("resumed", F.min(F.col("done").cast("int")).over(w) == 1)


def uncovered_interactions(covered: DataFrame) -> DataFrame:
    """(conv_id, boundary) from covered(conv_id, interaction, done): one after the last covered interaction, 0 if there is none."""
    return covered.groupBy("conv_id").agg(F.coalesce(F.max(F.when(F.col("done"), F.col("interaction"))), F.lit(0)).cast("long").alias("boundary"))


def is_append(old_ids: DataFrame, new_ids: DataFrame) -> DataFrame:
    """(scope, plan) from (scope, pos, id) lists: "unchanged", "append" if the old ids are an exact prefix of the new ones, else "rebuild"."""
    pairs = old_ids.select("scope", "pos", F.col("id").alias("old")).join(new_ids.select("scope", "pos", F.col("id").alias("new")), ["scope", "pos"], "full_outer")
    seen = pairs.groupBy("scope").agg(F.count_if(F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).alias("bad"), F.count_if(F.col("old").isNull()).alias("more"))
    return seen.select("scope", F.when(F.col("bad") > 0, "rebuild").when(F.col("more") > 0, "append").otherwise("unchanged").alias("plan"))
