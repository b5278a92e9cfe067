"""Context frames: a session's entities, decisions and latest messages within a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

LATEST, CUT = 10, 200


def context_frames(messages: DataFrame, decisions: DataFrame, entities: DataFrame, budget: int = 2000) -> DataFrame:
    """(session_id, frame). messages (session_id, ord, seq, role, content), decisions (session_id, ord, seq, pos, description), entities
    (session_id, o, type, value); o orders them.

    Entity and decision sections are never cut. Of the last ten messages the oldest that fit are taken until one doesn't, and printed
    newest first. Sessions without messages have no frame here; nulls count as empty texts."""
    w = W.partitionBy("session_id").orderBy(F.desc("ord"), F.desc("seq"))
    last = messages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= LATEST)
    last = last.withColumn("line", F.concat(F.lit("\n"), F.coalesce("role", F.lit("")), F.lit(": "), T.prefix(F.coalesce("content", F.lit("")), CUT)))
    lists = last.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("r"), "line"))).alias("m"))  # at most ten each
    ds = decisions.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("ord", "seq", "pos", F.concat(F.lit("- "), F.coalesce("description", F.lit(""))).alias("line")))).alias("d"))
    es = entities.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("o", F.concat(F.lit("- "), F.coalesce("value", F.lit("")), F.lit(" ("), F.coalesce("type", F.lit("")), F.lit(")")).alias("line")))).alias("e"))
    rows = lists.join(ds, "session_id", "left").join(es, "session_id", "left")
    section = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(title + "\n"), F.array_join(F.col(c)["line"], "\n")))
    rows = rows.withColumn("_e", section("## Entities", "e")).withColumn("_d", section("## Decisions", "d"))
    base = T.tokens(F.concat_ws("\n", "_e", "_d"))
    rows = rows.withColumn("_base", base)
    grown = F.aggregate(
        "m",
        F.struct(F.col("_base").alias("t"), F.lit("").alias("s"), F.lit(False).alias("full")),
        lambda a, x: F.when(a["full"] | (a["t"] + T.tokens(x["line"]) > budget), F.struct(a["t"].alias("t"), a["s"].alias("s"), F.lit(True).alias("full"))).otherwise(
            F.struct((a["t"] + T.tokens(x["line"])).alias("t"), F.concat(x["line"], a["s"]).alias("s"), F.lit(False).alias("full"))
        ),
    )
    rows = rows.withColumn("_m", grown["s"])
    latest = F.when(F.col("_m") != "", F.concat(F.lit("## Recent Messages"), F.col("_m")))
    return rows.select("session_id", F.concat_ws("\n\n", "_e", "_d", latest).alias("frame"))
