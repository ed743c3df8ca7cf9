"""Views of the driver's tables in the model's terms, and readers for other formats."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RecallError
from ..shipping import ship
from ..storage import exists, small, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories: the language is the user's scope, the labels give state and type, later ids are later in time."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("scope"), "text", F.col("n_chars").cast("double").alias("importance"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("is_active"), F.when(F.coalesce("toxic", F.lit(0)) == 1, "episodic").otherwise("semantic").alias("memory_type"),
        F.col("source").alias("conversation_id"), F.col("doc_id").alias("created_at"), F.col("doc_id").alias("updated_at"),
        F.lit(None).cast("string").alias("predicate"), F.lit(None).cast("string").alias("subject_type"), F.lit(None).cast("string").alias("fact_key"), F.lit(None).cast("string").alias("value"),
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item asked in every scope: (scope, qid, text)."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    scopes = table(spark, sf_dir, "documents").select(F.col("lang").alias("scope")).distinct()
    return items.crossJoin(small(scopes)).select("scope", "qid", "text")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages: (conv_id, created_at, id, role, content); the id is unique within a conversation, and over all of them only below 1,000 turns each."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").alias("created_at"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.col("text").alias("content"))


#: Event types as predicates: two names of one single-valued predicate, another single one, a multi-valued one, an unknown one.
EVENT_PREDICATES = {"view": "Current City", "click": "location", "signup": "timezone", "purchase": "programming language", "error": "mood"}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as extracted facts about users, in the order of (ts, event_id)."""
    e = table(spark, sf_dir, "events")
    names = F.create_map(*[F.lit(x) for kv in EVENT_PREDICATES.items() for x in kv])
    value = F.concat(F.lit(" V "), F.floor(F.col("value") / 10).cast("bigint").cast("string"))
    return e.select(
        F.struct(F.col("ts"), F.col("event_id")).alias("seq"), F.col("event_id").alias("memory_id"), F.col("ts").alias("at"), F.col("user_id").cast("string").alias("user_id"),
        F.lit("semantic").alias("memory_type"), F.lit("User").alias("subject_type"), F.element_at(names, F.col("event_type")).alias("predicate"), value.alias("value"),
        F.array(F.concat(F.lit("m"), (F.col("event_id") % 7).cast("string")), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))).alias("sources"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-delimited results. One broken line a file, which a writer that was cut off leaves at its end, is left out; more of them are damage and an error."""
    broken = "_broken string"
    rows = spark.read.schema(f"{schema}, {broken}").option("columnNameOfCorruptRecord", "_broken").json(path).withColumn("_file", F.input_file_name())
    rows = written(rows, "lines")
    if rows.filter("_broken is not null").groupBy("_file").count().filter("count > 1").limit(1).count():
        raise RecallError("more than one broken line in a file of results")
    return rows.filter("_broken is null").drop("_broken", "_file")


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A stored state, or None if there is none; damaged content is an error."""
    if not exists(spark, path):
        return None
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def jdbc_options(url: str) -> dict[str, str]:
    """Options of the JDBC reader for a database URL; postgres:// and postgresql+driver:// mean the same. Credentials leave the URL."""
    u = urlsplit(url)
    kind = u.scheme.split("+")[0]
    kind = {"postgres": "postgresql"}.get(kind, kind)
    if kind not in ("postgresql", "mysql", "mariadb") or not u.hostname:
        raise ValueError("not a database URL")
    out = {"url": f"jdbc:{kind}://{u.hostname}{f':{u.port}' if u.port else ''}{u.path}{f'?{u.query}' if u.query else ''}"}
    if u.username:
        out["user"] = unquote(u.username)
    if u.password:
        out["password"] = unquote(u.password)
    return out | ({"driver": "org.postgresql.Driver"} if kind == "postgresql" else {})


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database; give partitionColumn, lowerBound, upperBound and numPartitions for large ones."""
    return spark.read.format("jdbc").options(**jdbc_options(url), dbtable=name, **options).load()


def freeze(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each frame as a table written once, on which all parts of a comparison work."""
    return {n: written(f, n) for n, f in frames.items()}


def incompatibilities(stored: dict, wanted: dict) -> list[str]:
    """The names whose values in a stored run's settings are not those wanted; a run may only be continued if there are none."""
    return sorted(n for n in stored.keys() | wanted.keys() if stored.get(n) != wanted.get(n))


def select_sample(rows: DataFrame, index: int | None) -> DataFrame:
    """The rows of the sample of a number, in the order of sample_id, or all."""
    if index is None:
        return rows
    found = rows.select("sample_id").distinct().orderBy("sample_id").offset(index).limit(1)
    if index < 0 or not found.count():
        raise ValueError(f"there is no sample {index}")
    return rows.join(F.broadcast(found), "sample_id", "left_semi")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, session, session_date, pos, speaker, dia_id, text, caption) of a nested conversation file with session_N keys."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("s"))
    one = raw.select(F.get_json_object("s", "$.sample_id").alias("sample_id"), F.from_json(F.get_json_object("s", "$.conversation"), "map<string,string>").alias("c"))
    keys = one.select("sample_id", "c", F.explode(F.map_entries("c")).alias("e")).withColumn("session", F.regexp_extract("e.key", r"^session_(\d+)$", 1)).filter("session <> ''")
    turns = keys.select("sample_id", F.col("session").cast("int").alias("session"), F.element_at("c", F.concat(F.lit("session_"), "session", F.lit("_date_time"))).alias("session_date"), F.posexplode(F.from_json("e.value", "array<struct<speaker: string, dia_id: string, text: string, blip_caption: string>>")).alias("pos", "t"))
    return turns.select("sample_id", "session", "session_date", "pos", "t.speaker", "t.dia_id", "t.text", F.col("t.blip_caption").alias("caption"))


def turn_content(date: str = "session_date", speaker: str = "speaker", text: str = "text", caption: str = "caption"):  # noqa: ANN201
    """A turn as one message text."""
    shared = F.when(F.col(caption).isNotNull() & (F.col(caption) != ""), F.concat(F.lit(" [shared image: "), F.col(caption), F.lit("]"))).otherwise("")
    return F.concat(F.lit("[Session date: "), F.col(date), F.lit("] "), F.col(speaker), F.lit(": "), F.col(text), shared)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A snapshot as Parquet; the committer makes it visible as a whole."""
    df.write.mode(mode).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save_artifacts(frames: dict[str, DataFrame], folder: str) -> None:
    """The results of a comparison, one JSON-lines folder each."""
    for name, frame in frames.items():
        write_report(frame, f"{folder}/{name}")
