"""Hybrid search: vector hits and graph chunks, merged, re-ranked and enriched with neighbouring messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import cut
from ..functions import text as T
from . import graph, vectors

# Neighbours lie closer than this; how many; how a repeated chunk's score is folded in.
CLOSE_US, NEIGHBOURS, KEEP, ADD = 300_000_000, 3, 0.7, 0.3


def neighbours(hits: DataFrame, messages: DataFrame, salts: int = 8) -> DataFrame:
    """(hit, seq, role, content, rank): of each hit (hit, us) the first three messages (seq, us, role, content) in arrival order that lie less than
    five minutes away. Times are cut into buckets of that length, so that a hash join on the bucket meets all candidates;
    buckets are salted by arrival number, and each task passes on three rows per hit at most. Null times have no neighbours."""
    bucket = F.floor(F.col("us") / CLOSE_US)
    left = hits.filter("us is not null").select("hit", F.col("us").alias("at"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = messages.filter("us is not null").select("seq", "us", "role", "content", bucket.alias("bucket"), F.pmod(F.xxhash64("seq"), F.lit(salts)).cast("int").alias("salt"))
    near = left.join(right, ["bucket", "salt"]).filter((F.abs(F.col("at") - F.col("us")) < CLOSE_US) & (F.col("hit") != F.col("seq")))
    w = W.partitionBy("hit").orderBy("seq")
    return near.select("hit", "seq", "role", "content").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= NEIGHBOURS)


LATEST = 128


def merge(found: DataFrame, k: int) -> DataFrame:
    """One row per id of chunks (id, content, score, type, ord): the first in order gives content and type, later ones are folded into its score
    one after the other; the k best remain.

    Folding is a sum with weights that fall by KEEP for each later chunk: what lies before the last LATEST chunks of an id weighs less than 1e-19 together and can't
    change a double, so each task passes on at most LATEST rows per id, and no id is gathered in one row."""
    whole = found.groupBy("id").agg(F.count("*").alias("n"), F.min_by("content", "ord").alias("content"), F.min_by("type", "ord").alias("type"), F.min("ord").alias("ord"))
    last = W.partitionBy("id").orderBy(F.desc("ord"))
    tail = found.select("id", "ord", "score", F.row_number().over(last).alias("i")).filter(F.col("i") <= LATEST)
    weight = F.pow(F.lit(KEEP), F.col("i") - 1) * F.when(F.col("i") == F.col("n"), 1.0).otherwise(ADD)
    folded = tail.join(whole.select("id", "n"), "id").groupBy("id").agg(F.sum(F.col("score") * weight).alias("score"))
    merged = whole.join(folded, "id").select("id", "score", "content", "type", "ord")
    return merged.orderBy(F.desc(F.round("score", 9)), "ord").limit(k)


def hybrid(messages: DataFrame, entities: DataFrame, relations: DataFrame, query: str, vector: list[float], k: int = 5, depth: int = 2) -> DataFrame:
    """(id, content, score, type): messages (seq, id, role, content, embedding, us) and entities for a query."""
    hits = vectors.top_k(messages.filter("embedding is not null"), vector, 2 * k, "seq")
    place = F.row_number().over(W.orderBy(F.desc("score"), "seq"))  # over 2 k rows
    rk = F.array(F.lpad(place.cast("string"), 20, "0"))
    # 2 k rows, asked for several times below
    hits = cut(hits).select("id", "content", "score", F.lit("message").alias("type"), F.struct(F.lit(0).alias("source"), F.lit(0).alias("d"), rk.alias("rk"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("edge")).alias("ord"), F.col("seq").alias("hit"), "us")
    start = graph.query_entities(entities, query).select("id", F.col("id").alias("ord"))
    parts = graph.chunks(entities, relations, graph.bfs(entities, relations, start, depth))
    best = merge(hits.select("id", "content", "score", "type", "ord").unionByName(parts), k)
    context = neighbours(hits.select("hit", "us"), messages.select("seq", "us", "role", "content"))
    text = F.concat(F.lit("\n\nContext: "), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "role", "content"))), lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit(": "), T.prefix(F.coalesce(x["content"], F.lit("")), 100), F.lit("..."))), "\n"))
    context = context.groupBy("hit").agg(text.alias("context")).join(hits.select("hit", "id"), "hit").select("id", "context")
    return best.join(context, "id", "left").select("id", F.when(F.col("type") == "message", F.concat("content", F.coalesce("context", F.lit("")))).otherwise(F.col("content")).alias("content"), "score", "type")
