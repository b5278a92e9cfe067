"""State tables as Parquet: messages, decisions, tombstones, entities, relations and sessions under one folder.

Appends are keyed by the batch that made them (folder batch=N, overwritten if the batch is repeated), so a repeated micro-batch leaves no second copy.
Entities and sessions are written as what a batch adds to them and are put together when they are read. Two small tables keep micro-batches from reading the whole
state: `ids` by hash buckets of the identifier, and `recent`, the last rows of each session by buckets of the session, in versions that a manifest names."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import list_names, read_text, write_text_atomically

BUCKETS = 64
# The columns of the state tables.
SCHEMAS = {
    "messages": "id string, session_id string, seq bigint, role string, content string, timestamp string, embedding array<float>, importance_state_delta double, importance_reference_freq double, importance_trajectory_disc double, importance_total double, entity_ids array<string>",
    "decisions": "id string, session_id string, seq bigint, pos int, description string, timestamp string, superseded boolean, superseded_by string",
    "tombstones": "id string, session_id string, seq bigint, pos int, superseded string, corrected_to string, reason string, timestamp string",
    "entities": "id string, type string, value string, first_seen string, last_seen string, reference_count bigint",
    "sessions": "id string, started_at string, ended_at string, message_count bigint",
    "entity_relations": "id bigint, entity_from string, entity_to string, relation string, first_seen string, last_seen string",
}


_RECENT = "id string, session_id string, seq bigint, role string, content string, timestamp string, bucket int"
_MERGED = {
    "entities": lambda df: df.groupBy("id").agg(F.min_by("type", "batch").alias("type"), F.min_by("value", "batch").alias("value"), F.min_by("first_seen", "batch").alias("first_seen"), F.max_by("last_seen", "batch").alias("last_seen"), F.sum("reference_count").alias("reference_count")),
    "sessions": lambda df: df.groupBy("id").agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.sum("message_count").alias("message_count")),
}


def bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


class StateStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, table: str) -> DataFrame:
        at = f"{self.path}/{table}"
        if not self.batches(table):
            return self.spark.createDataFrame([], SCHEMAS[table])
        df = self.spark.read.schema(SCHEMAS[table] + ", batch bigint").parquet(at)
        return _MERGED[table](df) if table in _MERGED else df.drop("batch")

    def batches(self, table: str) -> list[int]:
        return [int(n[6:]) for n in list_names(self.spark, f"{self.path}/{table}") if n.startswith("batch=")]

    def append(self, table: str, rows: DataFrame, batch: int) -> None:
        names = [c.strip().split(" ")[0] for c in SCHEMAS[table].split(", ")]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def append_ids(self, rows: DataFrame, batch: int) -> None:
        rows.select("id", bucket("id").alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/ids/batch={batch}")

    def known_ids(self, buckets: list[int], before: int) -> DataFrame:
        """Identifiers of the given buckets that batches before this one wrote; other folders aren't read."""
        if not any(b < before for b in self.batches("ids")):
            return self.spark.createDataFrame([], "id string")
        df = self.spark.read.schema("id string, batch bigint, bucket int").parquet(f"{self.path}/ids")
        return df.filter(F.col("bucket").isin(buckets) & (F.col("batch") < before)).select("id")

    def _recent_manifest(self, before: int) -> dict[str, int]:
        done = [int(n[:-5]) for n in list_names(self.spark, f"{self.path}/recent/_manifest") if n.endswith(".json")]
        done = [n for n in done if n < before]
        return json.loads(read_text(self.spark, f"{self.path}/recent/_manifest/{max(done)}.json")) if done else {}

    def recent(self, buckets: list[int], before: int) -> DataFrame:
        """The last rows of all sessions in the given buckets, as batches before this one left them."""
        known = self._recent_manifest(before)
        paths = [f"{self.path}/recent/version={known[str(b)]}/bucket={b}" for b in buckets if str(b) in known]
        names = [c.split(" ")[0] for c in _RECENT.split(", ")][:-1]
        if not paths:
            return self.spark.createDataFrame([], _RECENT).select(*names)
        return self.spark.read.schema(_RECENT).parquet(*paths).select(*names)

    def replace_recent(self, rows: DataFrame, keep: int, version: int) -> None:
        """rows: those that `recent` gave and the new ones; the last `keep` of each session, by arrival, become the new version of their buckets."""
        last = rows.withColumn("_r", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("seq")))).filter(F.col("_r") <= keep).drop("_r")
        at = f"{self.path}/recent/version={version}"
        last.withColumn("bucket", bucket("session_id")).write.mode("overwrite").partitionBy("bucket").parquet(at)
        written = {n[7:]: version for n in list_names(self.spark, at) if n.startswith("bucket=")}
        if f"{version}.json" not in list_names(self.spark, f"{self.path}/recent/_manifest"):  # else the batch is repeated
            write_text_atomically(self.spark, f"{self.path}/recent/_manifest/{version}.json", json.dumps(self._recent_manifest(version) | written))

    def add_relations(self, rows: DataFrame, batch: int | None = None) -> None:
        """One row per (from, to, relation), the one with the smallest id; known ones stay as they are."""
        key = ["entity_from", "entity_to", "relation"]
        batch = 1 + max(self.batches("entity_relations"), default=-1) if batch is None else batch
        others = [c for c in rows.columns if c not in key]
        first = rows.groupBy(*key).agg(F.min(F.struct("id", *[c for c in others if c != "id"])).alias("_f")).select(*key, "_f.*")
        self.append("entity_relations", first.join(self.read("entity_relations").select(*key), key, "left_anti"), batch)

    def relations(self, entity: str) -> DataFrame:
        return self.read("entity_relations").filter((F.col("entity_from") == entity) | (F.col("entity_to") == entity))

    def close(self) -> None:
        """Nothing is held open."""
