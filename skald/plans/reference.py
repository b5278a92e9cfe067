"""Queries of the conversation engine's own operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import read_table
from ..functions import text as T
from ..operators import extraction, frame, graph, history, importance, search, vectors
from ..sources import jsonl
from .views import FIRST, MSG_EVENTS, messages, msg_events

EVENTS = f"({MSG_EVENTS.format(events='events')})"
QUERY = "how does birchkv feed oxbowkv and quartzpipe"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f=None, *, sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register(f) if f else register


def re2(p: str) -> str:
    return p.replace(".+", "[^\\n\\r\\x{2028}\\x{2029}]+").replace("'", "''")


def any_of(patterns: list[str], c: str = "content") -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '{re2(p)}', 'i')" for p in patterns) + ")"


TRIM = "\\t\\n\\x0b\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"


def caught(patterns: list[str], c: str = "content") -> str:
    """A list of trimmed first groups."""
    one = [f"CASE WHEN regexp_matches({c}, '{re2(p)}', 'i') THEN regexp_replace(regexp_extract({c}, '{re2(p)}', 1, 'i'), '^[{TRIM}]+|[{TRIM}]+$', '', 'g') END" for p in patterns if "(.+" in p]
    return f"list_filter([{', '.join(one)}], lambda x: x IS NOT NULL)"


def units(c: str) -> str:
    return f"(length({c}) + length(regexp_replace({c}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


# --- reads -------------------------------------------------------------------------------------------------------


@query(sql=f"""SELECT session_id, seq, id, role, CAST(rn AS BIGINT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(timestamp, '') DESC, seq DESC) AS rn
    FROM {FIRST} m) y WHERE rn <= 10""")
def recent_messages(spark: SparkSession, d: str) -> DataFrame:
    """The last ten of each session."""
    w = W.partitionBy("session_id").orderBy(F.desc("ord"), F.desc("seq"))
    return messages(spark, d).select("session_id", "seq", "id", "role", F.row_number().over(w).cast("long").alias("rn")).filter("rn <= 10")


@query(sql=f"SELECT session_id, seq, id, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(timestamp, ''), seq) - 1 AS position FROM {FIRST} m")
def messages_by_session(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).select("session_id", "seq", "id", "ord")
    return history.with_history(rows, "session_id", ["ord", "seq"], 0, lambda w: {}).select("session_id", "seq", "id", F.col("_n").alias("position"))


def _placed(rows: DataFrame, newest_first: bool) -> DataFrame:
    at = F.coalesce("timestamp", F.lit(""))
    w = W.partitionBy("session_id").orderBy(at.desc() if newest_first else at, *[F.coalesce(c, F.lit("")) for c in rows.columns if c not in ("timestamp", "session_id")])
    return rows.withColumn("position", F.row_number().over(w).cast("long"))


@query(sql="""SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(timestamp, ''), coalesce(id, ''), coalesce(description, '')) AS position
    FROM (SELECT DISTINCT id, session_id, description, timestamp FROM decisions WHERE NOT coalesce(superseded, FALSE)) x""")
def active_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Oldest first in each session."""
    rows = read_table(spark, d, "decisions").filter(~F.coalesce("superseded", F.lit(False))).select("id", "session_id", "description", "timestamp").distinct()
    return _placed(rows, False)


@query(sql="""SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(timestamp, '') DESC, coalesce(id, ''), coalesce(superseded, ''), corrected_to, coalesce(reason, '')) AS position
    FROM (SELECT DISTINCT id, session_id, superseded, coalesce(corrected_to, '') AS corrected_to, reason, timestamp FROM tombstones) x""")
def tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Newest first in each session."""
    rows = read_table(spark, d, "tombstones").select("id", "session_id", "superseded", F.coalesce("corrected_to", F.lit("")).alias("corrected_to"), "reason", "timestamp").distinct()
    return _placed(rows, True)


@query(sql=f"""SELECT m.session_id, m.messages, coalesce(dd.decisions, 0) AS decisions, coalesce(tt.tombstones, 0) AS tombstones, (SELECT count(DISTINCT id) FROM entities) AS entities
    FROM (SELECT session_id, count(*) AS messages FROM {FIRST} x GROUP BY 1) m
    LEFT JOIN (SELECT session_id, count(DISTINCT id) AS decisions FROM decisions WHERE NOT coalesce(superseded, FALSE) GROUP BY 1) dd ON dd.session_id = m.session_id
    LEFT JOIN (SELECT session_id, count(DISTINCT id) AS tombstones FROM tombstones GROUP BY 1) tt ON tt.session_id = m.session_id""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """The entity count is of all sessions."""
    count = messages(spark, d).groupBy("session_id").agg(F.count("*").alias("messages"))
    ds = read_table(spark, d, "decisions").filter(~F.coalesce("superseded", F.lit(False))).select("session_id", "id").distinct().groupBy("session_id").agg(F.count("id").alias("decisions"))
    ts = read_table(spark, d, "tombstones").select("session_id", "id").distinct().groupBy("session_id").agg(F.count("id").alias("tombstones"))
    es = read_table(spark, d, "entities").agg(F.count_distinct("id").alias("entities"))  # one row
    joined = count.join(ds, "session_id", "left").join(ts, "session_id", "left").join(F.broadcast(es))
    return joined.select("session_id", "messages", F.coalesce("decisions", F.lit(0)).alias("decisions"), F.coalesce("tombstones", F.lit(0)).alias("tombstones"), "entities")


@query(sql=f"""SELECT (SELECT count(DISTINCT id) FROM {FIRST} m WHERE len(embedding) > 0) AS vectors, (SELECT count(DISTINCT id) FROM entities) AS entities,
    (SELECT count(*) FROM (SELECT DISTINCT entity_from, entity_to FROM entity_relations) r) AS relations""")
def retriever_stats(spark: SparkSession, d: str) -> DataFrame:
    v = messages(spark, d, "embedding").filter(F.size("embedding") > 0).agg(F.count_distinct("id").alias("vectors"))
    e = read_table(spark, d, "entities").agg(F.count_distinct("id").alias("entities"))
    r = read_table(spark, d, "entity_relations").select("entity_from", "entity_to").distinct().agg(F.count("*").alias("relations"))
    return v.join(F.broadcast(e)).join(F.broadcast(r))  # one row each


@query(sql=f"SELECT session_id, min(timestamp) AS started_at, max(timestamp) AS ended_at, count(*) AS message_count FROM {FIRST} m GROUP BY 1")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).groupBy("session_id").agg(F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.count("*").alias("message_count"))


# --- importance --------------------------------------------------------------------------------------------------


def delta_sql(tool: str) -> str:
    return f"least(1.0::DOUBLE, CASE WHEN {any_of(T.DECISIONS)} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {any_of(T.CORRECTIONS)} THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {tool} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)"


def score_sql(table: str, order: str, tool: str) -> str:
    return f"""SELECT session_id, seq, sd, rf, td, least(1.0::DOUBLE, sd * 0.45::DOUBLE + rf * 0.25::DOUBLE + td * 0.30::DOUBLE) AS total FROM (
      SELECT session_id, seq, {delta_sql(tool)} AS sd,
        least(1.0::DOUBLE, list_sum(list_append(list_transform(ents, lambda e: len(list_filter(coalesce(h, []), lambda x: contains(x, lower(e))))), 0)) / 5.0::DOUBLE) AS rf,
        CASE WHEN n < 3 THEN 0.0::DOUBLE WHEN {any_of(T.SHIFTS)} THEN 0.8::DOUBLE
          WHEN total5 = 0 THEN CASE WHEN u > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
          WHEN u / (total5 / 5.0::DOUBLE) > 2 OR u / (total5 / 5.0::DOUBLE) < 0.3::DOUBLE THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS td
      FROM (SELECT *, {caught(T.ENTITIES)} AS ents, list(lower(content)) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS h,
          coalesce(sum(u) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS total5, row_number() OVER w - 1 AS n
        FROM (SELECT * REPLACE (coalesce(content, '') AS content), {units("coalesce(content, '')")} AS u FROM {table} t0) t1 WINDOW w AS (PARTITION BY session_id ORDER BY {order}, seq)) t2) t3"""


EVENT_SCORES, MESSAGE_SCORES = score_sql(EVENTS, "seq", "has_tool"), score_sql(FIRST, "coalesce(timestamp, '')", "FALSE")


@query(sql=f"SELECT session_id, seq, {delta_sql('has_tool')} AS state_delta FROM {EVENTS} m")
def state_delta(spark: SparkSession, d: str) -> DataFrame:
    return msg_events(spark, d).select("session_id", "seq", importance.state_delta(F.col("content"), F.col("has_tool")).alias("state_delta"))


@query(sql=f"SELECT session_id, seq, rf AS reference_frequency FROM ({EVENT_SCORES}) s")
def reference_frequency(spark: SparkSession, d: str) -> DataFrame:
    return importance.score(msg_events(spark, d)).select("session_id", "seq", "reference_frequency")


@query(sql=f"SELECT session_id, seq, td AS trajectory_discontinuity FROM ({EVENT_SCORES}) s")
def trajectory_discontinuity(spark: SparkSession, d: str) -> DataFrame:
    return importance.score(msg_events(spark, d)).select("session_id", "seq", "trajectory_discontinuity")


@query(sql=f"SELECT session_id, seq, sd AS state_delta, rf AS reference_frequency, td AS trajectory_discontinuity, round(total, 9) AS total FROM ({EVENT_SCORES}) s")
def importance_score(spark: SparkSession, d: str) -> DataFrame:
    return importance.score(msg_events(spark, d)).select("session_id", "seq", "state_delta", "reference_frequency", "trajectory_discontinuity", F.round("total", 9).alias("total"))


@query(sql=f"SELECT session_id, seq, sd AS state_delta, rf AS reference_frequency, td AS trajectory_discontinuity, round(total, 9) AS total FROM ({MESSAGE_SCORES}) s")
def importance_score_messages(spark: SparkSession, d: str) -> DataFrame:
    return importance.score(messages(spark, d)).select("session_id", "seq", "state_delta", "reference_frequency", "trajectory_discontinuity", F.round("total", 9).alias("total"))


@query(sql=f"SELECT session_id, seq, round(total, 9) AS total FROM ({EVENT_SCORES}) s ORDER BY round(total, 9) DESC, seq LIMIT 50")
def important_messages(spark: SparkSession, d: str) -> DataFrame:
    return importance.score(msg_events(spark, d)).select("session_id", "seq", F.round("total", 9).alias("total")).orderBy(F.desc("total"), "seq").limit(50)


# --- extraction --------------------------------------------------------------------------------------------------


def exploded_sql(columns: str, table: str, patterns: list[str], name: str, c: str = "content") -> str:
    return f"SELECT {columns}, CAST(p - 1 AS BIGINT) AS pos, l[p] AS {name} FROM (SELECT *, unnest(range(1, len(l) + 1)) AS p FROM (SELECT *, {caught(patterns, c)} AS l FROM {table} t) a) b"


@query(sql=exploded_sql("session_id, seq", EVENTS, T.ENTITIES, "entity"))
def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    return extraction.entities(msg_events(spark, d)).select("session_id", "seq", F.col("pos").cast("long").alias("pos"), "entity")


@query(sql=exploded_sql("doc_id", "(SELECT * FROM documents WHERE text IS NOT NULL)", T.ENTITIES, "entity", "text"))
def extract_entities_documents(spark: SparkSession, d: str) -> DataFrame:
    return extraction.entities(read_table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))).select("doc_id", F.col("pos").cast("long").alias("pos"), "entity")


@query(sql=exploded_sql("session_id, seq", EVENTS, T.DECISIONS, "description"))
def extract_decisions(spark: SparkSession, d: str) -> DataFrame:
    return extraction.decisions(msg_events(spark, d)).select("session_id", "seq", F.col("pos").cast("long").alias("pos"), "description")


@query(sql=exploded_sql("session_id, seq", EVENTS, T.CORRECTIONS, "superseded"))
def extract_corrections(spark: SparkSession, d: str) -> DataFrame:
    return extraction.corrections(msg_events(spark, d)).select("session_id", "seq", F.col("pos").cast("long").alias("pos"), "superseded")


@query(sql=exploded_sql("session_id, seq", f"(SELECT * FROM {FIRST} f WHERE content IS NOT NULL)", T.DECISIONS, "description"))
def extract_decisions_messages(spark: SparkSession, d: str) -> DataFrame:
    return extraction.decisions(messages(spark, d)).select("session_id", "seq", F.col("pos").cast("long").alias("pos"), "description")


_WITH_TEXT = f"(SELECT * FROM {FIRST} f WHERE content IS NOT NULL)"


@query(sql=exploded_sql("session_id, seq", _WITH_TEXT, T.ENTITIES, "entity"))
def extract_entities_messages(spark: SparkSession, d: str) -> DataFrame:
    return extraction.entities(messages(spark, d)).select("session_id", "seq", F.col("pos").cast("long").alias("pos"), "entity")


@query(sql=exploded_sql("session_id, seq", _WITH_TEXT, T.CORRECTIONS, "superseded"))
def extract_corrections_messages(spark: SparkSession, d: str) -> DataFrame:
    return extraction.corrections(messages(spark, d)).select("session_id", "seq", F.col("pos").cast("long").alias("pos"), "superseded")


@query(sql=f"""SELECT session_id, seq, array_to_string({caught(T.ENTITIES)}, '|') AS entities, array_to_string({caught(T.DECISIONS)}, '|') AS decisions, array_to_string({caught(T.CORRECTIONS)}, '|') AS corrections
    FROM {_WITH_TEXT} m""")
def structure_messages(spark: SparkSession, d: str) -> DataFrame:
    """All three of each message at once."""
    rows = extraction.structure(messages(spark, d).filter("content is not null"))
    return rows.select("session_id", "seq", *[F.array_join(F.col(f"structure.{k}"), "|").alias(k) for k in ("entities", "decisions", "corrections")])


SIGHTINGS = exploded_sql("ts, seq", EVENTS, T.ENTITIES, "entity")


@query(sql=f"""SELECT entity AS id, 'extracted' AS type, entity AS value, arg_min(seq, (seq, pos)) AS first_seen, arg_max(seq, (seq, pos)) AS last_seen, count(*) AS reference_count
    FROM ({SIGHTINGS}) s GROUP BY entity""")
def entities_upsert(spark: SparkSession, d: str) -> DataFrame:
    """first_seen and last_seen as arrival numbers."""
    return extraction.upsert(extraction.entities(msg_events(spark, d)).withColumn("ts", F.col("seq")))


_MESSAGE_SIGHTINGS = exploded_sql("coalesce(timestamp, '') AS ts, seq", _WITH_TEXT, T.ENTITIES, "entity")


@query(sql=f"""SELECT entity AS id, 'extracted' AS type, entity AS value, arg_min(ts, (ts, seq, pos)) AS first_seen, arg_max(ts, (ts, seq, pos)) AS last_seen, count(*) AS reference_count
    FROM ({_MESSAGE_SIGHTINGS}) s GROUP BY entity""")
def entities_upsert_messages(spark: SparkSession, d: str) -> DataFrame:
    return extraction.upsert(extraction.entities(messages(spark, d)).withColumn("ts", F.col("ord")))


@query(sql=f"SELECT DISTINCT m.session_id, e.id FROM entities e JOIN (SELECT DISTINCT session_id, entity_ids FROM {FIRST} f) m ON m.entity_ids ILIKE '%' || e.id || '%'")
def session_entities_like(spark: SparkSession, d: str) -> DataFrame:
    return extraction.session_entities(messages(spark, d, "entity_ids"), read_table(spark, d, "entities"))


@query(sql=f"SELECT DISTINCT session_id, x.id FROM (SELECT session_id, unnest(from_json(entity_ids, '[\"VARCHAR\"]')) AS id FROM {FIRST} m) x JOIN (SELECT DISTINCT id FROM entities) e ON e.id = x.id")
def session_entities_exact(spark: SparkSession, d: str) -> DataFrame:
    return extraction.session_entities(messages(spark, d, "entity_ids"), read_table(spark, d, "entities"), exact=True)


@query(sql=f"SELECT id, value FROM entities WHERE contains('{QUERY}', lower(value))")
def query_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.query_entities(read_table(spark, d, "entities"), QUERY).select("id", "value")


# --- frames, tokens ----------------------------------------------------------------------------------------------


def frame_sql(budget: int) -> str:
    dec = exploded_sql("session_id, seq", EVENTS, T.DECISIONS, "description")
    ent = exploded_sql("session_id, seq", EVENTS, T.ENTITIES, "entity")
    ceil = lambda c: f"CAST(ceil(length({c}) / 4.0) AS BIGINT)"
    return f"""WITH m AS (SELECT session_id, seq, chr(10) || role || ': ' || substring(content, 1, 200) AS line FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM {EVENTS} e) x WHERE r <= 10),
      d AS (SELECT session_id, '## Decisions' || chr(10) || string_agg('- ' || description, chr(10) ORDER BY seq, pos) AS s FROM ({dec}) q GROUP BY 1),
      e AS (SELECT session_id, '## Entities' || chr(10) || string_agg('- ' || entity || ' (extracted)', chr(10) ORDER BY o) AS s FROM (SELECT session_id, entity, min(seq * 10 + pos) AS o FROM ({ent}) q GROUP BY 1, 2) z GROUP BY 1),
      s AS (SELECT m.session_id, seq, line, e.s AS es, d.s AS ds, {ceil("concat_ws(chr(10), e.s, d.s)")} + sum({ceil("line")}) OVER (PARTITION BY m.session_id ORDER BY seq) AS used FROM m LEFT JOIN d ON d.session_id = m.session_id LEFT JOIN e ON e.session_id = m.session_id)
      SELECT session_id, concat_ws(chr(10) || chr(10), any_value(es), any_value(ds), '## Recent Messages' || string_agg(line, '' ORDER BY seq DESC) FILTER (WHERE used <= {budget})) AS frame FROM s GROUP BY session_id"""


def _frames(spark: SparkSession, d: str, budget: int) -> DataFrame:
    m = msg_events(spark, d)
    ds = extraction.decisions(m).select("session_id", "ord", "seq", "pos", "description")
    es = extraction.entities(m).groupBy("session_id", F.col("entity").alias("value")).agg(F.min(F.struct("seq", "pos")).alias("o")).withColumn("type", F.lit("extracted"))
    return frame.context_frames(m, ds, es, budget)


@query(sql=frame_sql(2000))
def context_frame(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d, 2000)


@query(sql=frame_sql(300))
def context_frame_small(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d, 300)


_FRAME_ROWS = f"(SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(timestamp, ''), seq) AS place FROM {FIRST} g)"


def message_frame_sql(budget: int) -> str:
    dec = exploded_sql("session_id, seq, place", f"(SELECT * FROM {_FRAME_ROWS} h WHERE content IS NOT NULL)", T.DECISIONS, "description")
    ent = exploded_sql("session_id, seq, place", f"(SELECT * FROM {_FRAME_ROWS} h WHERE content IS NOT NULL)", T.ENTITIES, "entity")
    ceil = lambda c: f"coalesce(CAST(ceil({units(c)} / 4.0) AS BIGINT), 0)"
    return f"""WITH m AS (SELECT session_id, place, chr(10) || coalesce(role, '') || ': ' || substring(coalesce(content, ''), 1, 200) AS line
        FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place DESC) AS r FROM {_FRAME_ROWS} e) x WHERE r <= 10),
      d AS (SELECT session_id, '## Decisions' || chr(10) || string_agg('- ' || description, chr(10) ORDER BY place, pos) AS s FROM ({dec}) q GROUP BY 1),
      e AS (SELECT session_id, '## Entities' || chr(10) || string_agg('- ' || entity || ' (extracted)', chr(10) ORDER BY o) AS s FROM (SELECT session_id, entity, min(place * 10 + pos) AS o FROM ({ent}) q GROUP BY 1, 2) z GROUP BY 1),
      s AS (SELECT m.session_id, place, line, e.s AS es, d.s AS ds, {ceil("concat_ws(chr(10), e.s, d.s)")} + sum({ceil("line")}) OVER (PARTITION BY m.session_id ORDER BY place) AS used
        FROM m LEFT JOIN d ON d.session_id = m.session_id LEFT JOIN e ON e.session_id = m.session_id)
      SELECT session_id, concat_ws(chr(10) || chr(10), any_value(es), any_value(ds), '## Recent Messages' || string_agg(line, '' ORDER BY place DESC) FILTER (WHERE used <= {budget})) AS frame FROM s GROUP BY session_id"""


@query(sql=message_frame_sql(2000))
def context_frame_messages(spark: SparkSession, d: str) -> DataFrame:
    """Of every session of the message table, in the order of timestamps as written."""
    m = messages(spark, d)
    ds = extraction.decisions(m).select("session_id", "ord", "seq", "pos", "description")
    es = extraction.entities(m).groupBy("session_id", F.col("entity").alias("value")).agg(F.min(F.struct("ord", "seq", "pos")).alias("o")).withColumn("type", F.lit("extracted"))
    return frame.context_frames(m, ds, es, 2000)


@query(sql=f"SELECT doc_id, CAST(ceil({units('text')} / 4.0) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").filter("text is not null").select("doc_id", T.tokens(F.col("text")).alias("tokens"))


# --- vectors -----------------------------------------------------------------------------------------------------

_COS = "coalesce(CASE WHEN len(a.embedding) = len(b.embedding) THEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 0)"
_ONE = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return read_table(spark, d, "embeddings").filter("vec_id = 7").first()["embedding"]


@query(sql=f"SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, {_ONE} b")
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    v = F.array(*[F.lit(float(x)) for x in _query_vector(spark, d)])
    return read_table(spark, d, "embeddings").select("vec_id", F.round(vectors.cosine(F.col("embedding"), v), 6).alias("score"))


@query(sql=f"SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, {_ONE} b ORDER BY {_COS} DESC, a.vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k(read_table(spark, d, "embeddings"), _query_vector(spark, d), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(sql=f"""SELECT q, id, round(s, 6) AS score, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS r FROM
    (SELECT b.vec_id AS q, a.vec_id AS id, {_COS} AS s FROM embeddings a JOIN embeddings b ON b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) x) y WHERE r <= 10""")
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = vectors.top_k_batch(e, e.filter("id % 100 = 0").select(F.col("id").alias("q"), "v"), 10)
    return found.select("q", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(sql=f"""SELECT hit, seq, CAST(rank AS BIGINT) AS rank FROM (SELECT h.seq AS hit, m.seq AS seq, row_number() OVER (PARTITION BY h.seq ORDER BY m.seq) AS rank FROM {EVENTS} h JOIN {EVENTS} m
    ON abs(epoch_us(h.ts) - epoch_us(m.ts)) < 300000000 AND h.seq <> m.seq AND h.seq % 100 = 0) x WHERE rank <= 3""")
def message_neighbors(spark: SparkSession, d: str) -> DataFrame:
    m = msg_events(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    found = search.neighbours(m.filter("seq % 100 = 0").select(F.col("seq").alias("hit"), "us"), m)
    return found.select("hit", "seq", F.col("rank").cast("long").alias("rank"))


# --- graph -------------------------------------------------------------------------------------------------------

_START = "SELECT id FROM entities WHERE type = 'table'"
_BFS = f"""WITH RECURSIVE walk(id, d) AS (SELECT id, 0 FROM ({_START}) s UNION SELECT r.entity_to, w.d + 1 FROM walk w JOIN entities e ON e.id = w.id JOIN entity_relations r ON r.entity_from = w.id WHERE w.d < 2),
  seen AS (SELECT w.id, min(d) AS d FROM walk w JOIN entities e ON e.id = w.id GROUP BY 1)"""


def _reached(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e, r = read_table(spark, d, "entities"), read_table(spark, d, "entity_relations")
    starts = e.filter("type = 'table'").select("id", F.col("id").alias("ord"))
    return e, r, graph.bfs(e, r, starts, 2)


@query(sql=f"{_BFS} SELECT id, CAST(d AS INTEGER) AS d FROM seen")
def graph_bfs(spark: SparkSession, d: str) -> DataFrame:
    return _reached(spark, d)[2].select("id", "d")


@query(sql=f"""{_BFS} SELECT s.id AS id, e.type || ': ' || e.value AS content, round(1.0::DOUBLE - 0.3::DOUBLE * d, 6) AS score, 'entity' AS type FROM seen s JOIN entities e ON e.id = s.id UNION ALL
    SELECT s.id || '->' || r.entity_to, e.value || ' --[' || r.relation || ']--> ' || r.entity_to, round(0.8::DOUBLE - 0.2::DOUBLE * d, 6), 'path' FROM seen s JOIN entities e ON e.id = s.id JOIN entity_relations r ON r.entity_from = s.id""")
def graph_chunks(spark: SparkSession, d: str) -> DataFrame:
    e, r, reached = _reached(spark, d)
    return graph.chunks(e, r, reached).select("id", "content", F.round("score", 6).alias("score"), "type")


@query(sql=f"""WITH both_ AS (SELECT entity_from AS a, entity_to AS b, id AS e FROM entity_relations UNION ALL SELECT entity_to, entity_from, id FROM entity_relations WHERE entity_from <> entity_to),
    one AS (SELECT s.id AS st, b AS en, [e] AS edges FROM ({_START}) s JOIN both_ ON a = s.id), two AS (SELECT st, b AS en, list_append(edges, e) AS edges FROM one JOIN both_ ON a = en WHERE NOT list_contains(edges, e))
    SELECT st AS start, en AS "end", len(edges) AS hops, count(*) AS ways FROM (SELECT * FROM one UNION ALL SELECT * FROM two) x GROUP BY 1, 2, 3""")
def graph_undirected_paths(spark: SparkSession, d: str) -> DataFrame:
    e, r = read_table(spark, d, "entities"), read_table(spark, d, "entity_relations")
    found = graph.undirected_paths(r, e.filter("type = 'table'").select("id"), 2, None)
    return found.groupBy("start", "end", F.col("hops").cast("long").alias("hops")).agg(F.count("*").alias("ways"))


@query(sql=f"""WITH both_ AS (SELECT entity_from AS a, entity_to AS b, id AS e FROM entity_relations UNION ALL SELECT entity_to, entity_from, id FROM entity_relations WHERE entity_from <> entity_to),
    one AS (SELECT s.id AS st, b AS en, [e] AS edges FROM ({_START}) s JOIN both_ ON a = s.id), two AS (SELECT st, b AS en, list_append(edges, e) AS edges FROM one JOIN both_ ON a = en WHERE NOT list_contains(edges, e))
    SELECT st AS start, en AS "end", len(edges) AS hops, array_to_string(edges, '-') AS edges FROM (SELECT * FROM one UNION ALL SELECT * FROM two) x ORDER BY len(x.edges), st, x.edges LIMIT 20""")
def graph_first_paths(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty, as the text for a graph database asks for; the limit is part of the query."""
    e, r = read_table(spark, d, "entities"), read_table(spark, d, "entity_relations")
    found = graph.undirected_paths(r, e.filter("type = 'table'").select("id"), 2)
    return found.select("start", "end", F.col("hops").cast("long").alias("hops"), F.array_join(F.col("edges").cast("array<string>"), "-").alias("edges"))


@query(sql=f"""WITH RECURSIVE walk(id, d, rk) AS (SELECT id, 0, [id] FROM ({_START}) s UNION SELECT r.entity_to, w.d + 1, list_append(w.rk, lpad(r.id::VARCHAR, 20, '0')) FROM walk w JOIN entities e ON e.id = w.id
      JOIN entity_relations r ON r.entity_from = w.id WHERE w.d < 2)
    SELECT id, min(d)::INTEGER AS d, array_to_string(arg_min(rk, (d, rk)), '/') AS place FROM walk WHERE id IN (SELECT id FROM entities) GROUP BY id""")
def graph_bfs_order(spark: SparkSession, d: str) -> DataFrame:
    """Where each reached entity stands in the queue."""
    return _reached(spark, d)[2].select("id", "d", F.array_join("rk", "/").alias("place"))


@query(sql="""SELECT r.* FROM entity_relations r WHERE entity_from IN (SELECT entity_from FROM entity_relations WHERE id = 1) OR entity_to IN (SELECT entity_from FROM entity_relations WHERE id = 1)""")
def relations_of_entity(spark: SparkSession, d: str) -> DataFrame:
    """All relations of one entity, in either direction."""
    r = read_table(spark, d, "entity_relations")
    one = [x[0] for x in r.filter("id = 1").select("entity_from").collect()]  # id is unique
    return r.filter(F.col("entity_from").isin(one) | F.col("entity_to").isin(one))


@query(sql="SELECT replace('" + graph.traversal_text(["@"], 2).replace("'@'", "@").replace("'", "''") + "', '@', string_agg(chr(39) || id || chr(39), ', ' ORDER BY id)) AS text FROM (SELECT id FROM entities WHERE type = 'table') x")
def graph_query_text(spark: SparkSession, d: str) -> DataFrame:
    """The text that asks a graph database for the ways from these entities."""
    ids = read_table(spark, d, "entities").filter("type = 'table'").select("id")
    before, after = graph.traversal_text(["@"], 2).split("'@'")
    quoted = F.concat(F.lit("'"), "id", F.lit("'"))
    return ids.agg(F.concat(F.lit(before), F.array_join(F.sort_array(F.collect_list(quoted)), ", "), F.lit(after)).alias("text"))  # the text names each entity of one type


@query(sql=f"""SELECT seq, round(c, 5) AS score FROM (SELECT seq, CASE WHEN isnan({_COS}) THEN 0 ELSE {_COS} END AS c FROM (SELECT seq, embedding FROM {FIRST} m
    WHERE session_id = 'ses_live_main' AND embedding IS NOT NULL) a, {_ONE} b) x ORDER BY c DESC, seq LIMIT 10""")
def search_similar(spark: SparkSession, d: str) -> DataFrame:
    """Messages of one session nearest to a vector."""
    m = messages(spark, d, "embedding").filter("session_id = 'ses_live_main' and embedding is not null")
    return vectors.top_k(m, _query_vector(spark, d), 10, "seq").select("seq", F.round("score", 5).alias("score"))


@query(sql="""WITH f AS (SELECT event_type AS id, event_id AS ord, value / 1000 AS s, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT id, round(sum(s * CASE WHEN k = 1 THEN pow(0.7::DOUBLE, n - 1) ELSE 0.3::DOUBLE * pow(0.7::DOUBLE, n - k) END), 6) AS score FROM f WHERE k <= n GROUP BY id""")
def merge_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Events as chunks, folded by type in arrival order."""
    found = read_table(spark, d, "events").select(F.col("event_type").alias("id"), F.lit("").alias("content"), (F.col("value") / 1000).alias("score"), F.lit("entity").alias("type"), F.struct("event_id").alias("ord"))
    return search.merge(found, 100).select("id", F.round("score", 6).alias("score"))


_ASKED = "(SELECT 'tell me about ' || string_agg(value, ' and ' ORDER BY id) AS q FROM entities WHERE id IN (SELECT entity_from FROM entity_relations ORDER BY id LIMIT 3))"
_HYBRID = f"""WITH RECURSIVE m AS (SELECT *, epoch_us(received_at) AS us FROM {FIRST} f), asked AS {_ASKED},
  v AS (SELECT embedding::DOUBLE[] AS v FROM m WHERE len(embedding) = 64 ORDER BY seq LIMIT 1),
  scored AS (SELECT seq, id, content, us, coalesce(CASE WHEN len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 THEN list_cosine_similarity(embedding::DOUBLE[], v) END, 0) AS score FROM m, v WHERE embedding IS NOT NULL),
  hits AS (SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS r FROM scored ORDER BY score DESC, seq LIMIT 10),
  starts AS (SELECT id FROM entities, asked WHERE contains(lower(q), lower(value))),
  walk(id, d, rk) AS (SELECT id, 0, [id] FROM starts UNION SELECT r.entity_to, w.d + 1, list_append(w.rk, lpad(r.id::VARCHAR, 20, '0')) FROM walk w JOIN entities e ON e.id = w.id JOIN entity_relations r ON r.entity_from = w.id WHERE w.d < 2),
  seen AS (SELECT w.id, min(d) AS d, arg_min(rk, (d, rk)) AS rk, any_value(e.type) AS t, any_value(e.value) AS v FROM walk w JOIN entities e ON e.id = w.id GROUP BY 1),
  parts AS (SELECT id, content, score, 'message' AS type, 0 AS source, 0 AS d, [lpad(r::VARCHAR, 20, '0')] AS rk, 0 AS kind, 0 AS edge FROM hits
    UNION ALL SELECT id, t || ': ' || v, 1.0::DOUBLE - 0.3::DOUBLE * d, 'entity', 1, d, rk, 0, 0 FROM seen
    UNION ALL SELECT s.id || '->' || r.entity_to, s.v || ' --[' || r.relation || ']--> ' || r.entity_to, 0.8::DOUBLE - 0.2::DOUBLE * d, 'path', 1, d, rk, 1, r.id FROM seen s JOIN entity_relations r ON r.entity_from = s.id),
  merged AS (SELECT id, content, score, type, source, d, rk, kind, edge FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source, d, rk, kind, edge) AS k FROM parts) x WHERE k = 1),
  best AS (SELECT * FROM merged ORDER BY round(score, 9) DESC, source, d, rk, kind, edge LIMIT 5),
  near AS (SELECT h.id, m.seq, m.role, m.content, row_number() OVER (PARTITION BY h.id ORDER BY m.seq) AS k FROM hits h JOIN m ON abs(h.us - m.us) < 300000000 AND h.seq <> m.seq),
  context AS (SELECT id, string_agg(coalesce(role, '') || ': ' || substring(coalesce(content, ''), 1, 100) || '...', chr(10) ORDER BY k) AS c FROM near WHERE k <= 3 GROUP BY 1)
  SELECT b.id, CASE WHEN type = 'message' THEN content || coalesce(chr(10) || chr(10) || 'Context: ' || c, '') ELSE content END AS content, round(score, 6) AS score, type FROM best b LEFT JOIN context c ON c.id = b.id"""


@query(sql=_HYBRID)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """For the first vector and a text that names three entities; equal-path chunks have equal scores here, so the twin needs no fold."""
    m = messages(spark, d, "embedding", "received_at").withColumn("us", F.unix_micros(F.col("received_at").cast("timestamp")))
    e, r = read_table(spark, d, "entities"), read_table(spark, d, "entity_relations")
    vector = m.filter("size(embedding) = 64").orderBy("seq").first()["embedding"]
    some = r.orderBy("id").limit(3).select(F.col("entity_from").alias("id"))
    asked = "tell me about " + " and ".join(x["value"] for x in e.join(F.broadcast(some), "id", "left_semi").orderBy("id").collect())  # three at most
    return search.hybrid(m, e, r, asked, vector, 5, 2).select("id", "content", F.round("score", 6).alias("score"), "type")


# --- sources -----------------------------------------------------------------------------------------------------


_OPTIONAL_TEXT = " AND ".join(f"coalesce(json_type(j, '$.{k}') = 'VARCHAR', TRUE)" for k in ("model", "sessionId"))
_CALL = "json_type({x}, '$.name') = 'VARCHAR' AND json_type({x}, '$.input') = 'OBJECT'"


@query(
    sql=f"""SELECT line_id, j->>'$.id' AS id, j->>'$.role' AS role, j->>'$.content' AS content, j->>'$.timestamp' AS timestamp
    FROM (SELECT line_id, CASE WHEN json_valid(raw) AND NOT regexp_matches(regexp_replace(raw, '"([^"\\\\]|\\\\.)*"', '""', 'g'), ',\\s*[}}\\]]') THEN raw::JSON END AS j FROM raw_lines WHERE fmt = 'jsonl') x
    WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.id') = 'VARCHAR' AND json_type(j, '$.content') = 'VARCHAR' AND json_type(j, '$.timestamp') = 'VARCHAR'
      AND json_type(j, '$.role') = 'VARCHAR' AND j->>'$.role' IN ('system', 'user', 'assistant', 'tool') AND {_OPTIONAL_TEXT}
      AND (json_type(j, '$.toolCall') IS NULL OR coalesce({_CALL.format(x="j->'$.toolCall'")}, FALSE))
      AND (json_type(j, '$.toolCalls') IS NULL OR (json_type(j, '$.toolCalls') = 'ARRAY'
        AND len(list_filter(CAST(j->'$.toolCalls' AS JSON[]), lambda c: NOT coalesce({_CALL.format(x="c")}, FALSE))) = 0))"""
)
def validate_jsonl(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "raw_lines").filter("fmt = 'jsonl'").select("line_id", F.col("raw").alias("value"))
    return jsonl.validate(lines).select("line_id", "id", "role", "content", "timestamp")


@query
def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.embedding import hashed

    return read_table(spark, d, "documents").select("doc_id", hashed(F.col("text"), 64).alias("embedding"))
