"""Importance of messages from three signals: change of state, references to entities in earlier messages, break of direction.

Rows: session_id, seq, content, and optionally has_tool and an ordering column `ord`. Nulls in content count as empty.
Ties are ordered by seq. An earlier row is one before it in (ord, seq) of the same session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .history import HOT_ROWS, with_history

# Weights of the signals and of what changes the state.
WEIGHTS = {"state": 0.45, "reference": 0.25, "direction": 0.30}
DECISION, CORRECTION, TOOL = 0.5, 0.7, 0.3
LOOK_BACK, LENGTHS, FEW = 20, 5, 3


def state_delta(content: Column, has_tool: Column) -> Column:
    signal = F.when(T.matches_any(content, T.DECISIONS), DECISION).otherwise(0.0) + F.when(T.matches_any(content, T.CORRECTIONS), CORRECTION).otherwise(0.0)
    return F.least(F.lit(1.0), signal + F.when(F.coalesce(has_tool, F.lit(False)), TOOL).otherwise(0.0))


def _prepared(messages: DataFrame) -> DataFrame:
    df = messages.withColumn("content", F.coalesce("content", F.lit("")))
    if "has_tool" not in df.columns:
        df = df.withColumn("has_tool", F.lit(False))
    return df if "ord" in df.columns else df.withColumn("ord", F.col("seq"))


def score(messages: DataFrame, weights: dict | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds state_delta, reference_frequency, trajectory_discontinuity and total; one exchange by session, no join."""
    w_ = {**WEIGHTS, **(weights or {})}
    df = _prepared(messages)

    def add(w):
        return {
            "_h": F.collect_list(F.lower("content")).over(w.rowsBetween(-LOOK_BACK, -1)),
            "_len": F.sum(T.units(F.col("content"))).over(w.rowsBetween(-LENGTHS, -1)),
        }

    df = with_history(df, "session_id", ["ord", "seq"], LOOK_BACK, add, hot_rows)
    entities = T.captures(F.col("content"), T.ENTITIES)
    hits = F.aggregate(F.transform(entities, lambda e: F.size(F.filter("_h", lambda x: F.contains(x, F.lower(e))))), F.lit(0), lambda a, x: a + x)
    average = F.coalesce(F.col("_len"), F.lit(0)) / F.lit(float(LENGTHS))
    length = T.units(F.col("content"))
    ratio = F.when(average == 0, F.when(length > 0, 0.5).otherwise(0.0)).when((length / average > 2) | (length / average < 0.3), 0.5).otherwise(0.0)
    direction = F.when(F.col("_n") < FEW, 0.0).when(T.matches_any(F.col("content"), T.SHIFTS), 0.8).otherwise(ratio)
    df = df.withColumns(
        {
            "state_delta": state_delta(F.col("content"), F.col("has_tool")),
            "reference_frequency": F.least(F.lit(1.0), hits / F.lit(5.0)),
            "trajectory_discontinuity": direction,
        }
    )
    total = F.col("state_delta") * w_["state"] + F.col("reference_frequency") * w_["reference"] + F.col("trajectory_discontinuity") * w_["direction"]
    return df.withColumn("total", F.least(F.lit(1.0), total)).drop("_h", "_len", "_n")
