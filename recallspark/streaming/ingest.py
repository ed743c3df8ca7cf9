"""Continuous ingestion: stateful lifecycle and append-only index maintenance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship

_OUT = "user_id string, fact_key string, event_id long, action string"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The actions of a key's writes in the order of (ts, event_id); the state is the value in force."""
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    started, value = (True, state.get[0]) if state.exists else (False, None)
    out = []
    for event_id, new in zip(rows["event_id"], rows["norm_value"], strict=True):
        new = None if pd.isna(new) else new
        out.append("ADD" if not started else "NOOP" if new == value else "SUPERSEDE")
        started, value = True, new
    state.update((value,))
    yield pd.DataFrame({"user_id": key[0], "fact_key": key[1], "event_id": rows["event_id"].to_numpy(), "action": out})


def lifecycle_stream(writes: DataFrame) -> DataFrame:
    """(user_id, fact_key, event_id, action) of a stream writes(user_id, fact_key, ts, event_id, norm_value).

    State is one value for each fact key. Order within a key is that of arrival in micro-batches, then of (ts, event_id).
    """
    ship(writes)
    return writes.groupBy("user_id", "fact_key").applyInPandasWithState(_fold, _OUT, "value string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what there is; each micro-batch is written under its number, so one that is replayed replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").load(f"{sf_dir}/{name}.parquet*")


def append_index(spark: SparkSession, batch: DataFrame, index: str, number: int) -> None:
    """Adds rows(scope, id, v) to an index table, without those it has already; a replayed batch replaces itself."""
    try:
        have = spark.read.parquet(index).filter(F.col("batch") != number).select("scope", "id")
        batch = batch.join(have, ["scope", "id"], "left_anti")
    except Exception as e:  # the first batch finds no index
        if "PATH_NOT_FOUND" not in str(e):
            raise
    batch.dropDuplicates(["scope", "id"]).write.mode("overwrite").parquet(f"{index}/batch={number}")
