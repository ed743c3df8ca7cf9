"""Versions of the stored tables and the steps between them."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lifecycle
from .storage import exists

Tables = dict[str, DataFrame]


def _with(t: DataFrame, **columns: str) -> DataFrame:
    """t with the columns that it lacks, as nulls of their types, and the others cast to theirs."""
    return t.withColumns({c: F.col(c).cast(kind) if c in t.columns else F.lit(None).cast(kind) for c, kind in columns.items()})


def _base(spark: SparkSession, t: Tables) -> Tables:
    empty = {
        "messages": "user_id string, conv_id long, id long, created_at long, role string, content string",
        "writes": "user_id string, conv_id long, seq long, memory_id long, at long, memory_type string, memory_text string, subject_type string, predicate string, value string, importance int, sources array<long>, fact_key string",
    }
    return {n: t.get(n, spark.createDataFrame([], s)) for n, s in empty.items()}


def _summaries(spark: SparkSession, t: Tables) -> Tables:
    return {"summaries": t.get("summaries", spark.createDataFrame([], "conv_id long, summary_text string, marker_at long, marker_id long"))}


def _retrieval(spark: SparkSession, t: Tables) -> Tables:
    return {"writes": _with(t["writes"], importance="double", norm_value="string", embedding="array<double>", embedding_model="string")}


def _message_vectors(spark: SparkSession, t: Tables) -> Tables:
    return {"messages": _with(t["messages"], embedding="array<double>", embedding_model="string")}


def _unique_facts(spark: SparkSession, t: Tables) -> Tables:
    lifecycle.checked_unique(lifecycle.facts(t["writes"].filter("fact_key is not null")))
    return {}


#: What each version changes; a step gets all tables and returns those it changes.
STEPS: tuple[Callable[[SparkSession, Tables], Tables], ...] = (_base, _summaries, _retrieval, _message_vectors, _unique_facts)


def version(spark: SparkSession, folder: str) -> int:
    """The newest version whose tables stand complete; 0 for a new folder."""
    done = [k for k in range(1, len(STEPS) + 1) if exists(spark, f"{folder}/v{k}/done/_SUCCESS")]
    return max(done, default=0)


def tables(spark: SparkSession, folder: str) -> Tables:
    at = version(spark, folder)
    return {n: spark.read.parquet(f"{folder}/v{at}/{n}") for n in ("messages", "writes", "summaries") if exists(spark, f"{folder}/v{at}/{n}/_SUCCESS")}


def upgrade(spark: SparkSession, folder: str, to: int = len(STEPS)) -> int:
    """Runs the steps that are missing. Each writes its version beside the last and is seen once it is complete, so an upgrade that breaks off is run again."""
    for k in range(version(spark, folder) + 1, to + 1):
        now = tables(spark, folder)
        now |= STEPS[k - 1](spark, now)
        for name, t in now.items():
            t.write.mode("overwrite").parquet(f"{folder}/v{k}/{name}")
        spark.range(1).write.mode("overwrite").parquet(f"{folder}/v{k}/done")
    return version(spark, folder)


def main(arguments: list[str] | None = None) -> int:
    """spark-submit migrations.py FOLDER [VERSION]"""
    from .config import session

    args = sys.argv[1:] if arguments is None else arguments
    if not 1 <= len(args) <= 2:
        print("usage: migrations FOLDER [VERSION]", file=sys.stderr)
        return 2
    print(upgrade(session("migrations"), args[0], int(args[1]) if len(args) == 2 else len(STEPS)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
