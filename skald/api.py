"""The tools over one session's state: recent messages, entities, decisions, corrections, search, context frame and status. Answers are JSON texts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.embedding import hashed
from .operators import extraction, frame, search
from .operators.timestamps import normalise_timestamps
from .sources.store import StateStore


class Conversation:
    def __init__(self, spark: SparkSession, state: str, session_id: str, embedder=hashed):
        self.spark, self.store, self.session_id, self.embedder = spark, StateStore(spark, state), session_id, embedder

    def _own(self, table: str) -> DataFrame:
        return self.store.read(table).filter(F.col("session_id") == self.session_id)

    def get_recent_messages(self, n: int | None = None) -> DataFrame:
        """The last n, newest first; nothing or 0 means ten, a negative number all."""
        rows = self._own("messages").orderBy(F.desc("timestamp"), F.desc("seq"))
        n = n or 10
        return rows if n < 0 else rows.limit(n)

    def get_messages_by_session(self) -> DataFrame:
        return self._own("messages").orderBy("timestamp", "seq")

    def get_important_messages(self, n: int = 10) -> DataFrame:
        return self._own("messages").orderBy(F.desc("importance_total"), "seq").limit(n)

    def get_entities(self, exact: bool = False) -> DataFrame:
        messages = self._own("messages").withColumn("entity_ids", F.to_json("entity_ids"))
        entities = self.store.read("entities")
        return entities.join(extraction.session_entities(messages, entities, exact).select("id"), "id", "left_semi").orderBy("first_seen", "id")

    def get_entity_graph(self) -> tuple[DataFrame, DataFrame]:
        return self.store.read("entities"), self.store.read("entity_relations")

    def get_relations(self, entity_id: str) -> DataFrame:
        return self.store.relations(entity_id)

    def index_relation(self, entity_from: str, entity_to: str, relation: str) -> None:
        """Adds an edge to the graph; a known one stays as it is."""
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        row = self.spark.createDataFrame([(entity_from, entity_to, relation)], "entity_from string, entity_to string, relation string")
        number = self.store.read("entity_relations").agg(F.coalesce(F.max("id") + 1, F.lit(1).cast("bigint"))).first()[0]
        self.store.add_relations(row.select(F.lit(number).alias("id"), "*", now.alias("first_seen"), now.alias("last_seen")))

    def get_session(self) -> dict | None:
        row = self.store.read("sessions").filter(F.col("id") == self.session_id).first()
        return row.asDict() if row else None

    def get_decisions(self) -> DataFrame:
        return self._own("decisions").filter(~F.col("superseded")).orderBy("timestamp", "seq", "pos")

    def get_corrections(self) -> DataFrame:
        return self._own("tombstones").orderBy(F.desc("timestamp"), F.desc("seq"), F.desc("pos"))

    def search_similar(self, query: str, k: int = 5) -> DataFrame:
        from .operators import vectors

        return vectors.top_k(self._own("messages"), self._embed(query), k, "seq")

    def _embed(self, query: str) -> list[float]:
        return self.spark.createDataFrame([(query,)], "t string").select(self.embedder(F.col("t"))).first()[0]

    def search_conversation(self, query: str, k: int | None = None, graph_depth: int | None = None) -> dict:
        entities, relations = self.get_entity_graph()
        rows = self._own("messages").select("seq", "id", "session_id", "role", "content", "timestamp", "embedding")
        rows = normalise_timestamps(rows, None).withColumnRenamed("utc_us", "us")
        found = search.hybrid(rows, entities, relations, query, self._embed(query), k or 5, graph_depth or 2)
        return {"query": query, "results": [r.asDict() for r in found.collect()], "stats": self._stats()}

    def _stats(self) -> dict:
        r = self.store.read("entity_relations").select("entity_from", "entity_to").distinct()
        return {"vectors": self._own("messages").select("id").distinct().count(), "entities": self.store.read("entities").count(), "relations": r.count()}

    def get_context_frame(self, budget: int | None = None) -> str:
        m = self._own("messages").withColumn("ord", F.col("timestamp"))
        d = self._own("decisions").filter(~F.col("superseded")).withColumn("ord", F.col("timestamp"))
        order = F.struct("first_seen", "id").alias("o")
        e = self.get_entities().select(F.lit(self.session_id).alias("session_id"), order, "type", "value")
        row = frame.context_frames(m, d, e, budget or 2000).first()
        return row["frame"] if row else ""

    def get_status(self) -> dict:
        return {
            "messages": self._own("messages").count(),
            "entities": self.store.read("entities").select("id").distinct().count(),
            "decisions": self.get_decisions().count(),
            "tombstones": self._own("tombstones").count(),
            "retriever": self._stats(),
            "sessionId": self.session_id,
            "version": __version__,
        }

    def call(self, tool: str, arguments: dict | None = None) -> dict:
        """A tool by name: {content: JSON text} or {content: message, isError: True}."""
        a = arguments or {}
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        tools = {
            "get_recent_messages": lambda: rows(self.get_recent_messages(a.get("n")).drop("embedding")),
            "get_entities": lambda: rows(self.get_entities()),
            "get_decisions": lambda: rows(self.get_decisions()),
            "get_corrections": lambda: rows(self.get_corrections()),
            "search_conversation": lambda: self.search_conversation(a["query"], a.get("k"), a.get("graph_depth")),
            "get_context_frame": lambda: {"frame": self.get_context_frame(a.get("budget"))},
            "get_status": self.get_status,
        }
        if tool not in tools:
            return {"content": f"Unknown tool: {tool}", "isError": True}
        try:
            return {"content": json.dumps(tools[tool](), indent=2, default=str)}
        except Exception as e:
            return {"content": f"Error: {e}", "isError": True}
