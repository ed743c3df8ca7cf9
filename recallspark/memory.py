"""The facade: add messages, search, answer. State is Parquet snapshots under one folder."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, providers
from .errors import ConflictError, ProvenanceError, ResumeError, RetrievalError, ScopeError
from .functions import identity
from .operators import context, evaluation, indexes, lifecycle, scopes, summaries
from .operators.structured import Filters
from .plans import search as plans
from .storage import exists, scratch, written

MESSAGES = "user_id string, conv_id long, id long, created_at long, role string, content string"
WRITES = "user_id string, conv_id long, seq long, memory_id long, at long, memory_type string, memory_text string, subject_type string, predicate string, value string, importance double, sources array<long>, fact_key string, norm_value string"


class MemoryLayer:
    """One store of many users' messages and facts. Every write is a batch that is checked as a whole before it becomes visible."""

    def __init__(self, spark: SparkSession, folder: str, *, extractor: Callable[[str, str], str] = providers.offline_extractor, embedding: Callable[[str], list[float]] = providers.offline_embedding, reader: Callable[[str], str] = providers.offline_reader) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.extractor, self.embedding, self.reader = extractor, embedding, reader

    def _table(self, name: str, schema: str) -> DataFrame:
        if not exists(self.spark, f"{self.folder}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    @property
    def messages(self) -> DataFrame:
        return self._table("messages", MESSAGES)

    @property
    def writes(self) -> DataFrame:
        return self._table("writes", WRITES)

    def add(self, messages: DataFrame) -> DataFrame:
        """Stores messages(user_id, conv_id, role, content, n), n their order, groups them to interactions, extracts candidates and appends them as writes.

        Messages that are stored already, by (user, conversation, order), are left out, so adding twice changes nothing. Returns the actions.
        """
        scopes.checked_names(messages, "user_id")
        new = messages.select("user_id", "conv_id", (F.col("conv_id") * 1_000_000 + F.col("n")).alias("id"), F.col("n").cast("long").alias("created_at"), "role", "content")
        new = written(new.join(self.messages.select("user_id", "id"), ["user_id", "id"], "left_anti").select("user_id", "conv_id", "id", "created_at", "role", "content"), "new-messages")
        new.write.mode("append").parquet(f"{self.folder}/messages")
        # only conversations with something new are grouped again
        touched = self.messages.join(new.select("user_id", "conv_id").distinct(), ["user_id", "conv_id"], "left_semi")
        seen = self.writes.select("conv_id", F.explode("sources").alias("id")).distinct()
        grouped = context.interactions(context.usable_messages(touched)).groupBy("user_id", "conv_id", "interaction").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "content"))).alias("m"))
        rows = grouped.select("user_id", "conv_id", "interaction", F.array_join(F.transform("m", lambda x: x["content"]), "\n").alias("text"), F.transform("m", lambda x: x["id"]).alias("sources"))
        fresh = rows.withColumn("first", F.element_at("sources", 1)).join(seen.withColumnRenamed("id", "first"), ["conv_id", "first"], "left_anti")
        found = providers.extract(fresh.select("conv_id", "interaction", "text", "sources"), self.extractor, config.get().attempts).filter("error is null")
        users = rows.select("conv_id", "interaction", "user_id")
        made = found.join(users, ["conv_id", "interaction"]).withColumn("seq", F.col("conv_id") * 1_000_000_000 + F.col("interaction") * 1000 + F.col("memory_no"))
        made = made.withColumn("predicate", identity.resolve_predicate(F.col("predicate"))).withColumn("value", F.when(F.col("predicate").isNotNull(), F.col("value")))
        key = identity.fact_key(F.col("memory_type"), F.col("subject_type"), F.col("user_id"), F.col("predicate"), F.col("value"))
        made = made.select("user_id", "conv_id", "seq", F.col("seq").alias("memory_id"), F.col("seq").alias("at"), "memory_type", "memory_text", identity.subject_type(F.col("subject_type")).alias("subject_type"), "predicate", "value", "importance", "sources", key.alias("fact_key"), identity.value_identity(F.col("value")).alias("norm_value"))
        self.write(made)
        return lifecycle.actions(self.writes.filter("fact_key is not null")).select("user_id", "fact_key", "memory_id", "action")

    def version(self) -> int:
        """How many batches of writes the store has seen."""
        return self._table("commits", "batch string").count()

    def write(self, candidates: DataFrame, *, expected: int | None = None) -> None:
        """Appends a batch of writes, or nothing if one of them names a foreign or missing message, or if expected is given and another writer has committed since that version."""
        bad = lifecycle.invalid_sources(candidates.select(F.col("memory_id").alias("candidate_id"), "user_id", "conv_id", "sources"), self.messages)
        if bad.limit(1).count():
            raise ProvenanceError("a candidate names messages that are not its user's")
        staged = scratch(self.spark, "staged")
        candidates.write.parquet(staged)
        if expected is not None and self.version() != expected:
            raise ConflictError("another writer has changed the store")
        self.spark.read.schema(WRITES).parquet(staged).write.mode("append").parquet(f"{self.folder}/writes")
        self.spark.createDataFrame([(staged.rsplit("/", 2)[-2],)], "batch string").write.mode("append").parquet(f"{self.folder}/commits")

    def ingest(self, sessions: DataFrame, *, done: Callable[[int, int], None] | None = None, failed: Callable[[int, Exception], None] | None = None) -> int:
        """Adds sessions(session, user_id, conv_id, role, content, n) one after the other and notes each that is complete; called again, it goes on behind the last one.

        What is stored must be what the noted sessions brought; a part of a session is no place to go on from and a ResumeError. done gets the session and its messages so far,
        failed the session and the error, which is raised on. Returns how many sessions were added.
        """
        noted = {r["session"]: r["n"] for r in self._table("sessions", "session long, n long").collect()}
        if self.messages.count() != sum(noted.values()):
            raise ResumeError("stored messages are not those of the sessions noted as complete")
        count = 0
        for r in sessions.groupBy("session").agg(F.count("*").alias("n")).orderBy("session").collect():  # one row a session
            if r["session"] in noted:
                continue
            try:
                self.add(sessions.filter(F.col("session") == r["session"]).drop("session"))
            except Exception as e:
                if failed is not None:
                    failed(r["session"], e)
                raise
            self.spark.createDataFrame([(r["session"], r["n"])], "session long, n long").write.mode("append").parquet(f"{self.folder}/sessions")
            count += 1
            if done is not None:
                done(r["session"], sum(noted.values()) + r["n"])
            noted[r["session"]] = r["n"]
        return count

    def uncovered(self) -> DataFrame:
        """(user_id, conv_id, interaction, ids): interactions behind the last one that some memory covers, in whose order a recovery goes on."""
        rows = context.interactions(context.usable_messages(self.messages)).groupBy("user_id", "conv_id", "interaction").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        marked = written(evaluation.covered(rows, self.writes.select("memory_id", "sources")), "covered")
        edge = context.uncovered_interactions(marked.select("conv_id", "interaction", "done"))
        return marked.join(edge, "conv_id").filter(F.col("interaction") > F.col("boundary")).select("user_id", "conv_id", "interaction", "ids")

    @property
    def summaries(self) -> DataFrame:
        at = self._table("summaries", "conv_id long, summary_text string, marker_at long, marker_id long, round long")
        last = at.groupBy("conv_id").agg(F.max_by(F.struct("summary_text", "marker_at", "marker_id"), "round").alias("s"))
        return last.select("conv_id", "s.summary_text", "s.marker_at", "s.marker_id")

    def summarize(self, summarizer: Callable[[str], str] = providers.offline_summary, *, trigger: int | None = None, keep: int | None = None) -> DataFrame:
        """One round of rolling summaries; returns those that changed."""
        s = config.get()
        rounds = self._table("summaries", "conv_id long, summary_text string, marker_at long, marker_id long, round long").agg(F.coalesce(F.max("round"), F.lit(0)).alias("r")).first()["r"]
        made = summaries.update_summaries(context.usable_messages(self.messages), self.summaries, summarizer, trigger=s.summary_trigger if trigger is None else trigger, keep=s.summary_keep if keep is None else keep)
        changed = written(made.filter("changed").drop("changed").withColumn("round", F.lit(rounds + 1).cast("long")), "new-summaries")
        changed.write.mode("append").parquet(f"{self.folder}/summaries")
        return changed.drop("round")

    def memories(self) -> DataFrame:
        """All versions of facts, and open and episodic memories once each."""
        facts = lifecycle.facts(self.writes.filter("fact_key is not null"))
        rows = self.writes.select(F.col("memory_id").alias("id"), F.col("user_id").alias("scope"), F.col("memory_text").alias("text"), "importance", "memory_type", "predicate", "subject_type", "fact_key", "value", F.col("conv_id").alias("conversation_id"), F.col("at").alias("created_at"), "sources")
        versions = facts.select(F.col("memory_id").alias("id"), "is_active", F.coalesce("valid_to", "valid_from").alias("updated_at"))
        open_ = lifecycle.open_dedup(rows.filter("fact_key is null and memory_type = 'semantic'").withColumn("user_id", F.col("scope"))).filter("action = 'ADD'")
        episodes = lifecycle.episodic_dedup(rows.filter("memory_type = 'episodic'").withColumn("user_id", F.col("scope"))).filter("action = 'ADD'")
        other = open_.select(*rows.columns).unionByName(episodes.select(*rows.columns)).withColumn("is_active", F.lit(True)).withColumn("updated_at", F.col("created_at"))
        return rows.join(versions, "id").select(*rows.columns, "is_active", "updated_at").unionByName(other)

    def index(self) -> indexes.Index:
        """The stored index of the memories' vectors, brought in step: only memories it lacks are embedded."""
        rows = self.memories().select("scope", "id", F.col("id").alias("pos"), "text", F.lit(None).cast("string").alias("model"), F.lit(None).cast("array<double>").alias("v"))
        path = f"{self.folder}/index/{config.get().embedding_model}"
        return indexes.sync(self.spark, rows, path, config.get().embedding_model, lambda x: providers.embed(x, embedding=self.embedding))[0]

    def search(self, queries: DataFrame, *, limit: int = 10, filters: Filters | None = None, intents: DataFrame | None = None, infer: bool = False) -> DataFrame:
        """Ranked memories for queries(scope, qid, text); a scope that has no messages, or a blank query, is an error. infer asks the offline intent of each query where none are given."""
        if queries.filter("text is null or trim(text) = ''").limit(1).count():
            raise RetrievalError("a query must not be blank")
        known = self.messages.select(F.col("user_id").alias("scope")).distinct()
        if queries.join(known, "scope", "left_anti").limit(1).count():
            raise ScopeError("no such user")
        memories = self.memories()
        asked = providers.embed(queries, embedding=self.embedding).select("scope", "qid", "v")
        if intents is None and infer:
            intents = providers.infer_intents(queries).filter("ok and predicate is not null").select("scope", "qid", "predicate", "value", "temporal_scope")
        s = config.get()
        return plans.hybrid_search(memories, queries, self.index().rows.select("scope", "id", "v"), asked, limit=limit, filters=filters, lexical_backend=s.lexical_backend, strategy=s.fusion_strategy, intents=intents)

    def answer(self, queries: DataFrame, *, limit: int = 10) -> DataFrame:
        """(scope, qid, answer, abstained), each from the query's own hits alone."""
        hits = self.search(queries, limit=limit).join(self.memories().select("id", "text", "is_active"), "id")
        w = F.array_sort(F.collect_list(F.struct("rank", "text", F.when(F.col("is_active"), "current").otherwise("historical").alias("status"))))
        by = hits.groupBy("scope", "qid").agg(w.alias("m"))
        refs = F.transform("m", lambda x, i: F.struct(F.concat(F.lit("M"), (i + 1).cast("string")).alias("ref"), x["text"].alias("text"), x["status"].alias("status")))
        found = queries.select("scope", "qid", F.col("text").alias("query")).join(by.withColumn("memories", refs), ["scope", "qid"], "left")
        empty = F.expr("cast(array() as array<struct<ref: string, text: string, status: string>>)")
        return providers.answer(found.withColumn("memories", F.coalesce("memories", empty)).select("scope", "qid", "query", "memories"), self.reader)

    def export(self, path: str) -> None:
        """The memories with their sources, as JSON lines."""
        self.memories().withColumn("sources", F.array_join("sources", ",")).write.mode("overwrite").json(os.path.join(path, "memories"))


