"""Queries of the llm operators: name -> (spark, folder) -> DataFrame, and their SQL twins where SQL can keep up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import read_table
from ..plans.registry import instants_sql
from . import conversations, leakage, neighbours, packing, pii, spans


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(read_table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(read_table(spark, d, "messages"), read_table(spark, d, "sessions"))


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversations.with_turns(read_table(spark, d, "messages"), p2_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(neighbours.message_vectors(read_table(spark, d, "messages")))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose seq is divisible by 100, asked against all rows."""
    found = neighbours.top_neighbours(neighbours.message_vectors(read_table(spark, d, "messages")), queries=lambda n: n % 100 == 0)
    return found.select(F.col("q").alias("seq"), F.col("rank").cast("long").alias("rank"), F.col("s").alias("neighbour"), F.round(F.col("similarity").cast("double"), 3).alias("similarity"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_details(read_table(spark, d, "messages"), read_table(spark, d, "person_names")).select("seq", "kind", "value").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(read_table(spark, d, "messages"), read_table(spark, d, "person_names"))


def p7_frames(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read_table(spark, d, "documents"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.frame_report(packing.pack(read_table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_turns, p4_found, p4_neighbours, p6_found, p6_redacted, p7_frames, p7_report, p8_found, p9_found)}

FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM messages) x WHERE id IS NULL OR id = '' OR k = 1)"

_KEPT = f"""WITH r AS (SELECT session_id, seq, utc_us, role, content, role IN ('system', 'user', 'assistant', 'tool') AND utc_us IS NOT NULL AS good,
        coalesce(regexp_replace(content, '[\\s\\x{{85}}\\p{{Z}}\\x{{1c}}-\\x{{1f}}]+', '', 'g') <> '', FALSE) AS said
      FROM ({instants_sql(f"(SELECT * FROM {FIRST} f WHERE session_id <> '')")}) z),
      a AS (SELECT session_id FROM (SELECT session_id, seq, role, lead(role) OVER (PARTITION BY session_id ORDER BY utc_us, seq) AS nxt FROM r WHERE role = 'user' OR (role = 'assistant' AND said)) x
        WHERE role = 'user' AND coalesce(nxt, 'user') = 'user'),
      k AS (SELECT session_id FROM r GROUP BY 1 HAVING bool_and(coalesce(good, FALSE)) AND arg_min(role, (utc_us, seq)) FILTER (WHERE role <> 'system') = 'user' AND bool_or(role = 'user' AND said))
      SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY utc_us, seq) AS turn_no, seq, role, content FROM r
      WHERE session_id IN (SELECT session_id FROM k) AND session_id NOT IN (SELECT session_id FROM a)"""

SQL: dict[str, str] = {
    "p2_found": f"SELECT session_id, turn_no, seq FROM ({_KEPT}) w",
    "p2_turns": _KEPT,
    "p4_neighbours": f"""WITH v AS (SELECT seq, embedding::DOUBLE[] AS e FROM {FIRST} m WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
      s AS (SELECT a.seq AS a, b.seq AS b, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM v a JOIN v b ON a.seq % 100 = 0 AND a.seq <> b.seq)
      SELECT a AS seq, k AS rank, b AS neighbour, round(c, 3) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s) t WHERE k <= 10""",
    "p4_found": f"""WITH v AS (SELECT seq, embedding::DOUBLE[] AS e FROM {FIRST} m WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
      s AS (SELECT a.seq AS a, b.seq AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.seq <> b.seq WHERE list_cosine_similarity(a.e, b.e) >= 0.87),
      t AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)
      SELECT DISTINCT least(a, b) AS seq_a, greatest(a, b) AS seq_b FROM t WHERE k <= 10""",
    "p8_found": """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
      g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM w) x),
      q AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
      h AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM q) x)
      SELECT DISTINCT doc_id, item_id FROM g JOIN h ON g.g = h.g""",
    "p9_found": """WITH w AS (SELECT doc_id, i, md5_number(substring(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300) x),
      s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
      m AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM w JOIN s ON s.h = w.h)
      SELECT doc_id, CAST(sum(least(300, coalesce(n - i, 300))) AS BIGINT) AS shared_chars FROM m GROUP BY doc_id""",
}
