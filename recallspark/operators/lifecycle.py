"""Write lifecycle of facts as windows: ADD, NOOP, SUPERSEDE, validity intervals, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConflictError
from ..functions.text import normalize


def actions(writes: DataFrame) -> DataFrame:
    """writes(user_id, fact_key, seq, norm_value, ...) with action and island.

    Within a key, in the order of seq: the first write adds, one with the value in force does nothing, any other supersedes. The value
    in force is always the last one written, so the fold is a comparison with the row before. island numbers the runs of equal values.
    """
    w = Window.partitionBy("user_id", "fact_key").orderBy("seq")
    n = F.row_number().over(w)
    same = F.col("norm_value").eqNullSafe(F.lag("norm_value").over(w))
    out = writes.withColumn("action", F.when(n == 1, "ADD").when(same, "NOOP").otherwise("SUPERSEDE"))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("island", F.sum((F.col("action") != "NOOP").cast("long")).over(running))


def facts(writes: DataFrame) -> DataFrame:
    """One row for each version of a fact: (user_id, fact_key, island, memory_id, norm_value, valid_from, valid_to, superseded_by, is_active, n_writes, updated_at).

    Id, value and start are those of the first write of a run; the next version ends it. A version is updated by each write of its run, and
    when it ends. writes need memory_id and at.
    """
    folded = actions(writes)
    firsts = folded.groupBy("user_id", "fact_key", "island").agg(
        F.min_by("memory_id", "seq").alias("memory_id"), F.min_by("norm_value", "seq").alias("norm_value"), F.min("at").alias("valid_from"), F.count("*").alias("n_writes"), F.max("at").alias("last_at")
    )
    w = Window.partitionBy("user_id", "fact_key").orderBy("island")
    out = firsts.withColumn("valid_to", F.lead("valid_from").over(w)).withColumn("superseded_by", F.lead("memory_id").over(w))
    return out.withColumn("is_active", F.col("superseded_by").isNull()).withColumn("updated_at", F.coalesce("valid_to", "last_at")).drop("last_at")


def active(versions: DataFrame) -> DataFrame:
    return versions.filter("is_active")


def as_of(versions: DataFrame, at: object) -> DataFrame:
    """The versions in force at a time: valid_from <= at < valid_to."""
    t = F.lit(at).cast("timestamp_ntz")
    return versions.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))))


def provenance(writes: DataFrame) -> DataFrame:
    """(user_id, fact_key, island, sources): distinct source ids of a version in the order first seen. writes need sources, an array."""
    flat = actions(writes).select("user_id", "fact_key", "island", "seq", F.posexplode("sources").alias("pos", "source"))
    first = flat.groupBy("user_id", "fact_key", "island", "source").agg(F.min(F.struct("seq", "pos")).alias("first"))
    ordered = first.groupBy("user_id", "fact_key", "island").agg(F.array_sort(F.collect_list(F.struct("first", "source"))).alias("x"))
    return ordered.select("user_id", "fact_key", "island", F.transform("x", lambda s: s["source"]).alias("sources"))


def open_dedup(rows: DataFrame) -> DataFrame:
    """rows(user_id, id, text) with action and kept_id: of equal normalised texts of a user the smallest id adds, later ones do nothing.

    The first of a group comes from an aggregation and a join, so a text that very many rows share is no task of its own.
    """
    keyed = rows.withColumn("norm_text", normalize(F.col("text")))
    first = keyed.groupBy("user_id", "norm_text").agg(F.min("id").alias("kept_id"))
    out = keyed.join(first, ["user_id", "norm_text"])
    return out.withColumn("action", F.when(F.col("id") == F.col("kept_id"), "ADD").otherwise("NOOP"))


def episodic_dedup(rows: DataFrame) -> DataFrame:
    """rows(user_id, id, text, sources): as open_dedup, but the sets of sources must be equal too."""
    keyed = rows.withColumn("norm_text", normalize(F.col("text"))).withColumn("source_set", F.array_sort(F.array_distinct("sources")))
    first = keyed.groupBy("user_id", "norm_text", "source_set").agg(F.min("id").alias("kept_id"))
    out = keyed.join(first, ["user_id", "norm_text", "source_set"])
    return out.withColumn("action", F.when(F.col("id") == F.col("kept_id"), "ADD").otherwise("NOOP"))


def violations(versions: DataFrame) -> DataFrame:
    """Fact keys with more than one active version: none, unless a snapshot was damaged."""
    return active(versions).groupBy("user_id", "fact_key").count().filter("count > 1")


def checked_unique(versions: DataFrame) -> DataFrame:
    """versions, if no fact key has more than one in force; else ConflictError."""
    if violations(versions).limit(1).count():
        raise ConflictError("a fact has more than one version in force")
    return versions


def invalid_sources(candidates: DataFrame, messages: DataFrame) -> DataFrame:
    """(candidate_id, source): sources of candidates(candidate_id, user_id, conv_id, sources) that do not exist, or are another user's or
    another conversation's. A batch is written only if there are none."""
    flat = candidates.select("candidate_id", F.col("user_id").alias("cu"), F.col("conv_id").alias("cc"), F.explode("sources").alias("source"))
    known = messages.select(F.col("id").alias("source"), "user_id", "conv_id")
    right = (F.col("user_id") == F.col("cu")) & (F.col("cc").isNull() | (F.col("conv_id") == F.col("cc")))
    return flat.join(known, "source", "left").filter(~F.coalesce(right, F.lit(False))).select("candidate_id", "source")
