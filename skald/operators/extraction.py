"""Entities, decisions and corrections named in messages, and their tables.

Every pattern that matches gives one item, in the patterns' order (pos from 0); repeats stay. Null contents give nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import ship
from ..functions import text as T


def _explode(messages: DataFrame, patterns: list[str], name: str) -> DataFrame:
    return messages.select("*", F.posexplode(T.captures(F.col("content"), patterns)).alias("pos", name))


def entities(messages: DataFrame) -> DataFrame:
    return _explode(messages, T.ENTITIES, "entity")


def decisions(messages: DataFrame) -> DataFrame:
    found = _explode(messages, T.DECISIONS, "description")
    return found.withColumn("decision_id", F.concat(F.lit("decision_"), F.col("id"), F.lit("_"), F.col("pos")))


def corrections(messages: DataFrame) -> DataFrame:
    """superseded is what the pattern caught; what it was corrected to isn't known."""
    found = _explode(messages, T.CORRECTIONS, "superseded")
    return found.withColumn("corrected_to", F.lit("")).withColumn("reason", F.lit("Correction detected")).withColumn("tombstone_id", F.concat(F.lit("tombstone_"), F.col("id"), F.lit("_"), F.col("pos")))


def structure(messages: DataFrame) -> DataFrame:
    """All three as one struct per message."""
    c = F.col("content")
    return messages.withColumn("structure", F.struct(T.captures(c, T.ENTITIES).alias("entities"), T.captures(c, T.DECISIONS).alias("decisions"), T.captures(c, T.CORRECTIONS).alias("corrections")))


def upsert(sightings: DataFrame, old: DataFrame | None = None, type_: Column | None = None) -> DataFrame:
    """The entity table after sightings (entity, ts, seq, pos): the first sighting gives type, value and first_seen, the last in order gives
    last_seen, reference_count counts. With `old`, its rows come before the sightings."""
    o = F.struct("ts", "seq", "pos")
    new = sightings.groupBy(F.col("entity").alias("id")).agg(F.min_by(type_ if type_ is not None else F.lit("extracted"), o).alias("type"), F.min_by("entity", o).alias("value"), F.min_by("ts", o).alias("first_seen"), F.max_by("ts", o).alias("last_seen"), F.count("*").alias("reference_count"))
    if old is None:
        return new
    both = old.withColumn("_g", F.lit(0)).unionByName(new.withColumn("_g", F.lit(1)))
    return both.groupBy("id").agg(F.min_by("type", "_g").alias("type"), F.min_by("value", "_g").alias("value"), F.min_by("first_seen", "_g").alias("first_seen"), F.max_by("last_seen", "_g").alias("last_seen"), F.sum("reference_count").alias("reference_count"))


def session_entities(messages: DataFrame, entities: DataFrame, exact: bool = False, block: int = 200_000) -> DataFrame:
    """(session_id, id): entities whose id stands in the entity_ids text of a message of the session.

    As written, ids are patterns with % and _ over the JSON text, without regard to ASCII case. Ids without wildcards are searched with an
    automaton that finds all of them in one pass over each text; of an id with wildcards the automaton finds the longest plain part, and only where that
    stands is the whole pattern tried. Ids are sent to the tasks in blocks of at most `block`. exact compares array elements instead, as a hash join."""
    rows = messages.select("session_id", "entity_ids").filter("session_id is not null and entity_ids is not null")
    if exact:
        own = rows.select("session_id", F.explode(F.from_json("entity_ids", "array<string>")).alias("id")).distinct()
        return own.join(entities.select("id").distinct(), "id", "left_semi").select("session_id", "id")
    ship(messages.sparkSession)
    ids = entities.select("id").filter("id is not null").distinct()
    blocks = max(1, -(-ids.count() // block))
    texts = rows.distinct()
    found = None
    for b in range(blocks):
        some = [r[0] for r in ids.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()]  # about `block` of them
        shared = messages.sparkSession.sparkContext.broadcast(some)
        here = texts.mapInPandas(lambda batches, shared=shared: _find_ids(batches, shared.value), "session_id string, id string")
        found = here if found is None else found.unionByName(here)
    return found.distinct()


def _fold(s: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s) if not s.isascii() else s.lower()


def _find_ids(batches, ids: list[str]):
    import re

    import ahocorasick
    import pandas as pd

    automaton, words = ahocorasick.Automaton(), {}
    always = [i for i in ids if not i.strip("%")]
    loose = []  # nothing but wildcards
    for i in ids:
        if i in always:
            continue
        folded = _fold(i)
        pattern = None
        if "%" in i or "_" in i:
            pattern = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in folded), re.S)
            folded = max(re.split("[%_]", folded), key=len)
        if folded:
            words.setdefault(folded, []).append((i, pattern))
        else:
            loose.append((i, pattern))
    for k, v in words.items():
        automaton.add_word(k, v)
    if words:
        automaton.make_automaton()
    for b in batches:
        seen = set()
        for session, text in zip(b["session_id"], b["entity_ids"]):
            t = _fold(text)
            seen.update((session, i) for i in always)
            if words:
                met = {x for _, v in automaton.iter(t) for x in v}
                seen.update((session, i) for i, p in met if p is None or p.search(t))
            seen.update((session, i) for i, p in loose if p.search(t))
        yield pd.DataFrame(sorted(seen), columns=["session_id", "id"])
