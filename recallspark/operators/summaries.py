"""Rolling summaries and the assembled context of an extraction."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ContextError, SummaryError
from ..shipping import ship
from ..storage import written
from . import context

SUMMARIES = "conv_id long, summary_text string, marker_at long, marker_id long"


def summary_request(previous: Column, messages: Column) -> Column:
    """The request as JSON: the previous summary, null if there is none, and the newly covered messages, an array<struct<role, content>>."""
    return F.to_json(F.struct(previous.alias("previous_summary"), messages.alias("messages")), {"ignoreNullFields": "false"})


def update_summaries(messages: DataFrame, summaries: DataFrame, summarizer: Callable[[str], str], *, trigger: int = context.SUMMARY_TRIGGER, keep: int = context.SUMMARY_KEEP) -> DataFrame:
    """summaries(conv_id, summary_text, marker_at, marker_id) after one round: conversations of messages(conv_id, created_at, id, role, content) whose
    summary is due get a new text and marker, the others keep theirs. changed tells them apart.

    The summarizer, a plain function of the request, sees the previous summary and only the newly covered messages. A blank answer,
    or a marker that is no message of its conversation, is an error and changes nothing.
    """
    ship(messages)
    foreign = summaries.filter(F.col("marker_id").isNotNull()).join(messages.select("conv_id", F.col("id").alias("marker_id")), ["conv_id", "marker_id"], "left_anti")
    if foreign.limit(1).count():
        raise SummaryError("a marker is not a message of its conversation")
    markers = summaries.select("conv_id", "marker_at", "marker_id")
    due = context.summary_due(messages, markers, trigger, keep).select("conv_id", F.col("marker_id").alias("to_id"))
    rows = messages.join(due, "conv_id").join(summaries, "conv_id", "left")
    to = messages.select("conv_id", F.col("id").alias("to_id"), F.col("created_at").alias("to_at"))
    place = F.struct("created_at", "id")
    rows = rows.join(to, ["conv_id", "to_id"]).filter((F.col("marker_at").isNull() | (place > F.struct("marker_at", "marker_id"))) & (place <= F.struct("to_at", "to_id")))
    # the messages between two markers are one request, so they meet by definition
    asked = rows.groupBy("conv_id", "to_at", "to_id").agg(F.first("summary_text").alias("previous"), F.array_sort(F.collect_list(F.struct("created_at", "id", "role", "content"))).alias("m"))
    request = summary_request(F.col("previous"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))

    @F.pandas_udf("string")
    def write(requests: pd.Series) -> pd.Series:
        return requests.map(lambda r: (summarizer(r) or "").strip())

    made = written(asked.select("conv_id", write(request).alias("summary_text"), F.col("to_at").alias("marker_at"), F.col("to_id").alias("marker_id")), "summaries")
    if made.filter("summary_text = ''").limit(1).count():
        raise SummaryError("the summarizer gave a blank text")
    old = summaries.join(made.select("conv_id"), "conv_id", "left_anti").select("conv_id", "summary_text", "marker_at", "marker_id")
    return made.withColumn("changed", F.lit(True)).unionByName(old.withColumn("changed", F.lit(False)))


def valid_targets(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, target_id) once each of asked(conv_id, target_id); a conversation without targets, or a target that is no message of its conversation, is an error."""
    once = asked.select("conv_id", "target_id").distinct()
    if once.filter("target_id is null").limit(1).count() or once.join(messages.select("conv_id", F.col("id").alias("target_id")), ["conv_id", "target_id"], "left_anti").limit(1).count():
        raise ContextError("a target is not a message of its conversation")
    return once


def semantic_query(texts: Column, roles: Column) -> Column:
    """The targets' texts, a line each: those of the user, or all if none is of the user."""
    rows = F.arrays_zip(roles.alias("role"), texts.alias("text"))
    mine = F.filter(rows, lambda x: x["role"] == "user")
    return F.array_join(F.transform(F.when(F.size(mine) > 0, mine).otherwise(rows), lambda x: x["text"]), "\n")


def extraction_context(messages: DataFrame, targets: DataFrame, vectors: DataFrame, summaries: DataFrame, *, n_recent: int = context.RECENT, n_older: int = context.OLDER) -> DataFrame:
    """(conv_id, summary, recent, older): for each target what comes before it and nothing else: the rolling summary, the recent messages and
    the relevant older ones, which are in no other part and once by role and content; arrays of struct<role, content> in the order of time.
    """
    if n_recent < 1 or n_older < 1:
        raise ContextError("limits must be positive")
    turn = F.struct("created_at", "id", "role", "content")
    pack = lambda rows, name: rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias(name))
    near = pack(context.recent(messages, targets, n_recent), "recent")
    chosen = context.older_context(messages, targets, vectors, n_recent, n_older).select("conv_id", "id").join(messages, ["conv_id", "id"])
    far = pack(context.distinct_older(chosen), "older")
    none = F.expr("cast(array() as array<struct<role: string, content: string>>)")
    out = targets.select("conv_id").join(summaries.select("conv_id", F.col("summary_text").alias("summary")), "conv_id", "left").join(near, "conv_id", "left").join(far, "conv_id", "left")
    return out.select("conv_id", "summary", F.coalesce("recent", none).alias("recent"), F.coalesce("older", none).alias("older"))


def extraction_request(summary: Column, recent: Column, older: Column, targets: Column) -> Column:
    """The prompt of an extraction: four named sections, each JSON on one line, of which only the last is evidence for new memories."""
    line = lambda name, x: F.concat(F.lit(f"{name}: "), x)
    parts = (("conversation summary", F.coalesce(F.to_json(F.struct(summary.alias("text"))), F.lit("{}"))), ("older messages", F.to_json(older)), ("recent messages", F.to_json(recent)), ("messages to extract from", F.to_json(targets)))
    return F.concat_ws("\n", *[line(n, x) for n, x in parts])
