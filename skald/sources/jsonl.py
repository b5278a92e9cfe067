"""Message lines: strict validation in the JVM, adapters, batch reading.

A line is a message if it is a JSON object with strings id, content and timestamp and a known role; optional fields must have their type where they
stand, null being no type; other keys are dropped. Blank lines are skipped, other lines dropped. Of repeated keys the last counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim
from ..operators.rejects import ROLES, judge_json


def _type(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _allow_repeats(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def validate(lines: DataFrame) -> DataFrame:
    """Rows of `lines` (value STRING and anything else) that hold a message, with its fields added."""
    _allow_repeats(lines.sparkSession)
    # the parser stops after the first value; a second one of ours shows whether anything stood between
    pair = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("\n,0]")))
    rows = lines.filter(F.length(trim(F.col("value"))) > 0).withColumn("_p", pair)
    p = F.col("_p")
    alone = F.coalesce(F.try_variant_get(p, "$[1]", "int") == 0, F.lit(False)) & F.schema_of_variant(F.try_variant_get(p, "$[2]", "variant")).isNull()
    rows = rows.filter(alone).withColumn("_v", F.try_variant_get(p, "$[0]", "variant")).drop("_p")
    v = F.col("_v")
    text = lambda k: F.coalesce(_type(v, f"$.{k}") == "STRING", F.lit(False))
    absent_or = lambda k, ok: F.coalesce(ok, _type(v, f"$.{k}").isNull())
    call = lambda x: F.coalesce((_type(x, "$.name") == "STRING") & _type(x, "$.input").startswith("OBJECT"), F.lit(False))
    calls = F.try_variant_get(v, "$.toolCalls", "array<variant>")
    good = (
        F.schema_of_variant(v).startswith("OBJECT")
        & text("id") & text("content") & text("timestamp") & text("role")
        & F.coalesce(F.try_variant_get(v, "$.role", "string").isin(*ROLES), F.lit(False))
        & absent_or("model", _type(v, "$.model") == "STRING")
        & absent_or("sessionId", _type(v, "$.sessionId") == "STRING")
        & (_type(v, "$.toolCall").isNull() | call(F.try_variant_get(v, "$.toolCall", "variant")))
        & (_type(v, "$.toolCalls").isNull() | F.coalesce(_type(v, "$.toolCalls").startswith("ARRAY") & F.forall(calls, call), F.lit(False)))
    )
    rows = rows.filter(F.coalesce(good, F.lit(False)))
    fields = {"id": "id", "role": "role", "content": "content", "timestamp": "timestamp", "model": "model", "log_session": "sessionId"}
    tools = F.coalesce(F.size(calls), F.lit(0)) > 0
    rows = rows.withColumns({k: F.try_variant_get(v, f"$.{p}", "string") for k, p in fields.items()})
    return rows.withColumn("has_tool", _type(v, "$.toolCall").isNotNull() | tools).drop("_v", "value")


def parse_line(line: str) -> dict | None:
    """One line, on the driver."""
    if not line.strip():
        return None
    reason, _, _, row = judge_json(line)
    return row if reason is None else None


def detect(lines: list[str]) -> bool:
    """Whether the first line is a message."""
    return bool(lines) and parse_line(lines[0]) is not None


#: name -> lines to messages
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"jsonl": validate}


def detect_adapter(spark: SparkSession, path: str) -> str:
    """Looks at the first lines; there is one adapter, which is also what is taken where nothing fits."""
    first = [r[0] for r in spark.read.text(path).limit(5).collect()]
    return next((name for name in ADAPTERS if detect([x for x in first if x.strip()])), "jsonl")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(offset, value) of a text file on any file system, read in the JVM. offset grows with the place in the file: the first byte of the line's split plus the number
    of lines before it in the split, which is smaller than the split."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_mid"))
    first = rows.groupBy("_at").agg(F.min("_mid").alias("_first"))  # a row per split
    return rows.join(first, "_at").select((F.col("_at") + F.col("_mid") - F.col("_first")).alias("offset"), "value")


def read_log(spark: SparkSession, path: str, session_id: str, adapter: str = "jsonl") -> DataFrame:
    """All messages of a log, first seen first; seq is ordered like the lines, the first of a repeated id counts."""
    rows = ADAPTERS[adapter](numbered_lines(spark, path).withColumnRenamed("offset", "seq")).withColumn("session_id", F.lit(session_id))
    first = rows.groupBy("id").agg(F.min("seq").alias("seq"))
    return rows.join(first, ["id", "seq"], "left_semi")
