"""Message views that the queries share: the message table without repeated deliveries, and messages templated from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import read_table
from ..operators.deliveries import single_deliveries

# The test view's sentences; the same text runs on other engines.
MSG_EVENTS = """
SELECT concat('e', CAST(event_id AS STRING)) AS id, user_id AS session_id, event_id AS seq, ts,
  CASE event_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN 'tool' ELSE 'system' END AS role,
  (event_id % 10 = 0) AS has_tool,
  CASE event_id % 24
    WHEN 0 THEN concat('We decided to adopt ', t, ' for storage')
    WHEN 1 THEN concat('Let''s use ', t, ' next')
    WHEN 2 THEN concat('I''ll implement ', t, ' today')
    WHEN 3 THEN concat('The plan is ', t, ' first')
    WHEN 4 THEN concat('Actually, ', t, ' it should be')
    WHEN 5 THEN 'no, wait'
    WHEN 6 THEN concat('I mean ', t)
    WHEN 7 THEN concat('Instead, ', t)
    WHEN 8 THEN concat('not ', t, ', but ', u)
    WHEN 9 THEN concat('Correction: ', t)
    WHEN 10 THEN concat('We''re using ', t, ' for queues')
    WHEN 11 THEN concat('The ', t, ' is slow')
    WHEN 12 THEN concat('Set up ', t, ' with defaults')
    WHEN 13 THEN concat('Connected to ', t)
    WHEN 14 THEN concat('Moving on to ', t)
    WHEN 15 THEN concat('By the way ', t, ' rocks')
    WHEN 16 THEN 'On a different note'
    WHEN 17 THEN 'Switching topics'
    WHEN 18 THEN concat('Also, check ', t)
    WHEN 19 THEN concat('New question about ', t)
    WHEN 20 THEN repeat(concat(t, ' lorem ipsum '), 20)
    WHEN 21 THEN 'ok'
    WHEN 22 THEN concat('We agreed on ', t, '. Actually, the ', u, ' is fine')
    ELSE concat('note the ', t, chr(10), ' is it fine')
  END AS content
FROM (SELECT *,
  CASE (event_id * 7 + user_id) % 5 WHEN 0 THEN 'postgres' WHEN 1 THEN 'redis' WHEN 2 THEN 'kafka' WHEN 3 THEN 'spark' ELSE 'duckdb' END AS t,
  CASE (event_id * 3 + user_id) % 4 WHEN 0 THEN 'mysql' WHEN 1 THEN 'sqlite' WHEN 2 THEN 'flink' ELSE 'pulsar' END AS u
  FROM {events}) x"""

FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM messages) x WHERE (id IS NULL OR id = '' OR k = 1) AND session_id IS NOT NULL)"


def msg_events(spark: SparkSession, d: str) -> DataFrame:
    """ord is the arrival number, in the order of ts."""
    return spark.sql(MSG_EVENTS, events=read_table(spark, d, "events")).withColumn("ord", F.col("seq"))


def messages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """First deliveries with a session; ord is the timestamp as written, by which the model sorts."""
    df = read_table(spark, d, "messages").select(*dict.fromkeys(["seq", "id", "session_id", "role", "content", "timestamp", *columns]))
    return single_deliveries(df).filter("session_id is not null").withColumn("ord", F.coalesce("timestamp", F.lit("")))
