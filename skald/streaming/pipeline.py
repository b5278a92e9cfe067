"""From a log to the state tables, in batch or as a stream; both run the same transformation.

A micro-batch keeps new ids only, takes each session's last rows from the state as history, scores, extracts and appends. It reads the buckets of ids and of sessions
that it touches, not the whole state. Rows are in order of arrival, in batch and stream alike; rows that arrive late are scored
against what came before them, and earlier rows are not scored again. The engine's own number of a batch names what it
writes, and it reads what earlier batches wrote, so a batch that runs twice writes the same files twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import cut
from ..functions.embedding import hashed
from ..functions import text as T
from ..operators import extraction, importance
from ..sources.jsonl import ADAPTERS
from ..sources.store import StateStore, bucket
from ..sources.tail import register

HISTORY = importance.LOOK_BACK


def index_batch(rows: DataFrame, store: StateStore, batch: int, embedder: Callable[[Column], Column] = hashed) -> None:
    """rows (id, session_id, seq, role, content, timestamp, has_tool)"""
    first = rows.groupBy("id").agg(F.min("seq").alias("seq"))
    came = cut(rows.join(first, ["id", "seq"], "left_semi"))
    touched = came.agg(F.collect_set(bucket("id")), F.collect_set(bucket("session_id"))).first()  # at most BUCKETS each
    new = cut(came.join(store.known_ids(touched[0], batch), "id", "left_anti"))
    if new.isEmpty():
        return
    columns = ["id", "session_id", "seq", "role", "content", "timestamp"]
    past = cut(store.recent(touched[1], batch))
    own = past.join(new.select("session_id").distinct(), "session_id", "left_semi")
    both = new.select(*columns, "has_tool", F.lit(False).alias("old")).unionByName(own.select(*columns, F.lit(False).alias("has_tool"), F.lit(True).alias("old")))
    scored = cut(importance.score(both).filter("not old"))
    entities = extraction.entities(scored)
    ids = T.captures(F.col("content"), T.ENTITIES)
    messages = scored.select("id", "session_id", "seq", "role", "content", "timestamp", embedder(F.col("content")).alias("embedding"), F.col("state_delta").alias("importance_state_delta"), F.col("reference_frequency").alias("importance_reference_freq"), F.col("trajectory_discontinuity").alias("importance_trajectory_disc"), F.col("total").alias("importance_total"), ids.alias("entity_ids"))
    decisions = extraction.decisions(scored).withColumn("id", F.col("decision_id")).withColumn("superseded", F.lit(False)).withColumn("superseded_by", F.lit(None).cast("string"))
    stones = extraction.corrections(scored).withColumn("id", F.col("tombstone_id"))
    store.append("decisions", decisions, batch)
    store.append("tombstones", stones, batch)
    store.append("entities", extraction.upsert(entities.withColumn("ts", F.col("timestamp"))), batch)
    store.append("sessions", new.groupBy(F.col("session_id").alias("id")).agg(F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.count("*").alias("message_count")), batch)
    store.append("messages", messages, batch)
    store.replace_recent(past.unionByName(new.select(*columns)), HISTORY, batch)
    store.append_ids(new, batch)


MODES = ("live", "catchup", "watch")


def follow(spark: SparkSession, log: str, state: str, session_id: str, adapter: str = "jsonl", mode: str = "live", seconds: int = 1, embedder: Callable[[Column], Column] = hashed):
    """A running query that keeps the state up with the log.

    live: every `seconds`, without end; catchup: up to the log's present end; watch: `log` is a folder, and each file put there is read once, whole. In the folder,
    messages are ordered by batch, file and line."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    register(spark)
    store = StateStore(spark, state)
    lines = spark.readStream.text(log) if mode == "watch" else spark.readStream.format("skald_log").load(log)

    def run(batch: DataFrame, number: int) -> None:
        seq = F.lit(number << 44) + F.monotonically_increasing_id() if mode == "watch" else F.col("offset")
        numbered = batch.select(seq.alias("seq"), "value")
        rows = ADAPTERS[adapter](cut(numbered) if mode == "watch" else numbered).withColumn("session_id", F.lit(session_id))
        index_batch(rows, store, number, embedder)

    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", f"{state}/_checkpoint")
    writer = writer.trigger(availableNow=True) if mode == "catchup" else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()
