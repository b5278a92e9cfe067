"""The entity graph: breadth-first expansion, its chunks, undirected paths and query texts for a graph database.

Relations are followed from `entity_from` to `entity_to`. A target that isn't an entity is neither emitted nor expanded, but the path to it is.
Order within a level is that of a queue: it is kept as the list of relation numbers that led to a node, compared like words, so no
level is ever numbered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import cut


def query_entities(entities: DataFrame, query: str) -> DataFrame:
    """Entities whose value stands in the query, ignoring case; an empty value stands in every query."""
    return entities.filter(F.contains(F.lit(query.lower()), F.lower("value")))


def _sortable(number: Column) -> Column:
    """A number from 0 as a text that sorts like it."""
    return F.lpad(number.cast("string"), 20, "0")


def bfs(entities: DataFrame, relations: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(id, d, rk): entities reached from starts (id, ord; a number from 0 or a text) within `depth` steps, at their first visit. Every level joins the
    frontier with the relations once and is written out; the loop runs depth + 1 times, whatever the data."""
    known = entities.select("id").filter("id is not null").distinct()
    edges = relations.select(F.col("entity_from").alias("id"), F.col("entity_to").alias("to"), F.col("id").alias("edge"))
    place = F.col("ord") if dict(starts.dtypes)["ord"] == "string" else _sortable(F.col("ord"))
    frontier = starts.select("id", F.array(place).alias("rk"))
    visited, reached = None, None
    for d in range(depth + 1):
        level = frontier.groupBy("id").agg(F.min("rk").alias("rk"))
        if visited is not None:
            level = level.join(visited, "id", "left_anti")
        level = cut(level)
        visited = level.select("id") if visited is None else cut(visited.unionByName(level.select("id")))
        here = level.join(known, "id", "left_semi").select("id", F.lit(d).alias("d"), "rk")
        reached = here if reached is None else reached.unionByName(here)
        if d < depth:
            frontier = here.join(edges, "id").select(F.col("to").alias("id"), F.concat("rk", F.array(_sortable(F.col("edge")))).alias("rk"))
    return reached


def chunks(entities: DataFrame, relations: DataFrame, reached: DataFrame) -> DataFrame:
    """(id, content, score, type, ord): one chunk per reached entity and one per relation that leaves it. Of a repeated entity the row seen last counts, of those
    the one with the largest type and value."""
    seen = [c for c in ("last_seen", "first_seen") if c in entities.columns]
    last = entities.groupBy("id").agg(F.max_by(F.struct("type", "value"), F.struct(*seen, "type", "value")).alias("e"))
    nodes = reached.join(last.select("id", F.col("e.type").alias("t"), F.col("e.value").alias("v")), "id")
    own = nodes.select("id", F.concat("t", F.lit(": "), "v").alias("content"), (F.lit(1.0) - F.lit(0.3) * F.col("d")).alias("score"), F.lit("entity").alias("type"), F.struct(F.lit(1).alias("source"), "d", "rk", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("edge")).alias("ord"))
    out = nodes.join(relations.select(F.col("entity_from").alias("id"), "entity_to", "relation", F.col("id").cast("long").alias("edge")), "id")
    paths = out.select(F.concat("id", F.lit("->"), "entity_to").alias("id"), F.concat("v", F.lit(" --["), "relation", F.lit("]--> "), "entity_to").alias("content"), (F.lit(0.8) - F.lit(0.2) * F.col("d")).alias("score"), F.lit("path").alias("type"), F.struct(F.lit(1).alias("source"), "d", "rk", F.lit(1).alias("kind"), "edge").alias("ord"))
    return own.unionByName(paths)


def undirected_paths(relations: DataFrame, starts: DataFrame, depth: int = 2, limit: int | None = 20) -> DataFrame:
    """(start, end, hops, edges): ways of 1 to depth relations in either direction that use no relation twice. With a limit, the first ones in
    order are kept, the limit being part of the query."""
    both = relations.select(F.col("entity_from").alias("a"), F.col("entity_to").alias("b"), F.col("id").cast("long").alias("e"))
    both = both.unionByName(both.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
    ways = starts.select(F.col("id").alias("start"), F.col("id").alias("end"), F.expr("cast(array() as array<bigint>)").alias("edges"))
    found = None
    for _ in range(depth):
        step = ways.join(both, ways["end"] == both["a"]).filter(~F.array_contains("edges", F.col("e")))
        ways = step.select("start", F.col("b").alias("end"), F.concat("edges", F.array("e")).alias("edges"))
        found = ways if found is None else found.unionByName(ways)
    found = found.select("start", "end", F.size("edges").alias("hops"), "edges")
    return found if limit is None else found.orderBy("hops", "start", "edges").limit(limit)


# The texts that a graph database is to be sent.
_TRAVERSAL = """
    MATCH (e:Entity)
    WHERE e.id IN [{ids}]
    MATCH path = (e)-[r*1..{depth}]-(related:Entity)
    RETURN e.id AS start, nodes(path) AS entities, relationships(path) AS relations
    LIMIT 20
  """
_VECTOR = """
    MATCH (m:Message)
    WHERE m.embedding IS NOT NULL
    WITH m, vector.similarity.cosine(m.embedding, {vector}) AS sim
    RETURN m.id AS id, m.content AS content, sim AS score
    ORDER BY sim DESC
    LIMIT {k}
  """


def traversal_text(ids: list[str], depth: int = 2) -> str:
    """For undirected_paths; ids are not escaped, as in the model."""
    return _TRAVERSAL.format(ids=", ".join(f"'{i}'" for i in ids), depth=depth)


def vector_text(vector: list[float], k: int = 5) -> str:
    """For a vector search."""
    return _VECTOR.format(vector="[" + ",".join(f"{x:g}" if float(x).is_integer() else repr(float(x)) for x in vector) + "]", k=k)
