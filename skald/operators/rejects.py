r"""Problem 3: rows that fail to parse, with the first reason.

A schema gives one anchored regular expression for a whole row. Rows that match it are loaded in the JVM as they stand. The others
go through field-prefix patterns, generated from the same schema, one more field at a time, which find the first field that breaks the row; what no
pattern can decide (escaped and repeated keys, values nested deeper than DEPTH) is settled along the row with an explicit stack instead of recursion.

Reasons, in order: broken_text, column_count, bad_value. Defined results: null rows and rows of white space only are
skipped; of repeated JSON keys the last counts; an unknown or null format is taken as JSON where the first character is {, else
as CSV; repeated rows each get their own result; extra columns are ignored. One line end may close a CSV record. Works row by row, without any shuffle; only rows
that don't match as a whole reach Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import ship

ROLES = ("system", "user", "assistant", "tool")
CSV_FIELDS = ("id", "role", "content", "timestamp", "model", "session_id")
JSON_REQUIRED = {"id": "string", "role": "role", "content": "string", "timestamp": "string"}
JSON_OPTIONAL = {"model": "string", "sessionId": "string", "toolCall": "call", "toolCalls": "calls"}
OUTPUT = "line_id bigint, loaded boolean, reason string, field string, position int, id string, role string, content string, timestamp string, model string, session_id string"

_WS = r"[ \t\n\r]*+"
_STR = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_NUM = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_PLAIN = rf"(?:{_STR}|{_NUM}|true|false|null)"


DEPTH = 3


def json_row_pattern(required: dict[str, str] = JSON_REQUIRED, optional: dict[str, str] = JSON_OPTIONAL) -> str:
    """A whole loadable record: known keys with values of their types, any other key with a plain value. Keys of nested kinds match in no such row."""
    role = "|".join(ROLES)
    known = {**required, **optional}
    members = [rf'"{k}"{_WS}:{_WS}(?P<{k}>{f'"(?:{role})"' if kind == "role" else _STR})' for k, kind in known.items() if kind in ("string", "role")]
    other = rf'"(?!(?:{"|".join(known)})")(?:[^"\\\x00-\x1f]++)*+"{_WS}:{_WS}{_PLAIN}'
    member = f"(?:{'|'.join([*members, other])})"
    # the list is one repetition, so that each named group stands once: a comma must be followed by a key, no comma by the end
    return rf"{_WS}\{{{_WS}(?:{member}{_WS}(?:,{_WS}(?=\")|(?=\}})))++\}}{_WS}\Z"


def json_field_pattern(depth: int = DEPTH) -> str:
    """One more field of a record, with what may follow it: the step by which a prefix of n fields becomes one of n + 1. Values are nested up to `depth`."""
    value = _PLAIN
    for _ in range(depth):
        pair = rf"{_STR}{_WS}:{_WS}{value}{_WS}(?:,{_WS}(?=\")|(?=\}}))"
        element = rf"{value}{_WS}(?:,{_WS}(?!\])|(?=\]))"
        value = rf"(?:{_PLAIN}|\{{{_WS}(?:{pair})*+\}}|\[{_WS}(?:{element})*+\])"
    return rf"({_STR}){_WS}:{_WS}({value}){_WS}(?=[,}}])"


_CSV_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",\r\n]*+)'
_CSV_END = r"(?:\r\n|\r|\n)?"


def csv_row_pattern(fields: tuple = CSV_FIELDS, allowed: dict[str, tuple] = {"role": ROLES}) -> str:  # noqa: B006
    """A whole loadable record, one group a field."""
    kinds = [f'(?:"(?:{"|".join(allowed[f])})"|(?:{"|".join(allowed[f])}))' if f in allowed else _CSV_FIELD for f in fields]
    return ",".join(f"({k})" for k in kinds) + _CSV_END + r"\Z"


def csv_prefix_patterns(fields: tuple = CSV_FIELDS) -> list[re.Pattern]:
    return [re.compile(_CSV_FIELD + rf"(?:,{_CSV_FIELD}){{{n}}}(?=,|{_CSV_END}\Z)") for n in range(len(fields))]


def _java(pattern: str) -> str:
    return r"\A" + pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")


_CSV_ROW = re.compile(rf"{_CSV_FIELD}(?:,{_CSV_FIELD})*+{_CSV_END}\Z")
_CSV_ONE = re.compile(rf"({_CSV_FIELD})(,|{_CSV_END}\Z)")
CSV_PREFIXES = csv_prefix_patterns()
CSV_LOADABLE = re.compile(csv_row_pattern())
_JSON_ROW = re.compile(json_row_pattern())
_JSON_FIELD = re.compile(json_field_pattern())
_KEY = re.compile(rf"({_STR}){_WS}:{_WS}")
_TOKEN = re.compile(rf"{_WS}({_STR}|{_NUM}|true|false|null|[\[\]{{}},:])")
_SPACE = re.compile(_WS)


def scan_value(s: str, pos: int) -> int:
    """The end of the JSON value at pos, or -1. Any depth of nesting, no recursion."""
    stack: list[str] = []
    expect = "value"  # value, value or ], key or }, key, colon, after
    while True:
        m = _TOKEN.match(s, pos)
        if not m:
            return -1
        t, pos = m[1], m.end()
        c = t[0]
        if expect in ("value", "value or ]"):
            if c == "]" and expect == "value or ]":
                stack.pop()
                expect = "after"
            elif c == "{":
                stack.append("{")
                expect = "key or }"
                continue
            elif c == "[":
                stack.append("[")
                expect = "value or ]"
                continue
            elif c in ",:]}":
                return -1
            else:
                expect = "after"
        elif expect in ("key", "key or }"):
            if c == "}" and expect == "key or }":
                stack.pop()
                expect = "after"
            elif c == '"':
                expect = "colon"
                continue
            else:
                return -1
        elif expect == "colon":
            if c != ":":
                return -1
            expect = "value"
            continue
        elif c == "," and stack:
            expect = "key" if stack[-1] == "{" else "value"
            continue
        elif c == {"{": "}", "[": "]"}.get(stack[-1] if stack else "", ""):
            stack.pop()
        else:
            return -1
        if not stack:
            return pos


def scan_object(s: str, pos: int, end_needed: bool) -> tuple[dict[str, str] | None, str, int]:
    """(key -> text of its last value, first broken field, where). The fields before the broken one are whole."""
    fields: dict[str, str] = {}
    pos = _SPACE.match(s, pos + 1).end()
    if s[pos : pos + 1] == "}":
        pos += 1
    else:
        while True:
            step = _JSON_FIELD.match(s, pos)
            if step:
                name = json.loads(step[1])
                fields[name] = step[2]
                pos = step.end()
            else:
                key = _KEY.match(s, pos)
                if not key:
                    return None, "(key)", pos
                name = json.loads(key[1])
                end = scan_value(s, key.end())
                if end < 0:
                    return None, name, key.end()
                fields[name] = s[key.end() : end].strip(" \t\n\r")
                pos = _SPACE.match(s, end).end()
            mark = s[pos : pos + 1]
            pos = _SPACE.match(s, pos + 1).end() if mark == "," else pos + 1
            if mark == "}":
                break
            if mark != ",":
                return None, name, pos - 1
    if end_needed and not re.compile(_WS + r"\Z").match(s, pos):
        return None, "(end)", pos
    return fields, "", pos


def _fits(kind: str, text: str) -> bool:
    if kind == "string":
        return text[0] == '"'
    if kind == "role":
        return text[0] == '"' and json.loads(text) in ROLES
    if kind == "call":
        if text[0] != "{":
            return False
        call, _, _ = scan_object(text, 0, True)
        return call is not None and call.get("name", " ")[0] == '"' and call.get("input", " ")[0] == "{"
    if text[0] != "[":
        return False
    pos = _SPACE.match(text, 1).end()
    while text[pos] != "]":
        end = scan_value(text, pos)
        if not _fits("call", text[pos:end].strip(" \t\n\r")):
            return False
        pos = _SPACE.match(text, end).end()
        if text[pos] == ",":
            pos = _SPACE.match(text, pos + 1).end()
    return True


def judge_json(s: str) -> tuple:
    """(reason, field, position, fields)"""
    m = _JSON_ROW.match(s)
    if m and all(m[k] is not None for k in JSON_REQUIRED):
        keys = [k for k in (*JSON_REQUIRED, *JSON_OPTIONAL) if s.count(f'"{k}"') > 1]
        if not keys and "\\u" not in s:
            return None, None, None, {k: json.loads(v) for k, v in m.groupdict().items() if v is not None}
    start = _SPACE.match(s).end()
    if s[start : start + 1] != "{":
        end = scan_value(s, start)
        whole = end >= 0 and re.compile(_WS + r"\Z").match(s, end)
        return ("column_count" if whole else "broken_text"), "(record)", start, None
    fields, broken, pos = scan_object(s, start, True)
    if fields is None:
        return "broken_text", broken, pos, None
    for k in JSON_REQUIRED:
        if k not in fields:
            return "column_count", k, None, None
    for k, kind in {**JSON_REQUIRED, **JSON_OPTIONAL}.items():
        if k in fields and not _fits(kind, fields[k]):
            return "bad_value", k, None, None
    return None, None, None, {k: json.loads(fields[k]) for k in (*JSON_REQUIRED, "model", "sessionId") if k in fields}


def _unquote(f: str) -> str:
    return f[1:-1].replace('""', '"') if f[:1] == '"' else f


def judge_csv(s: str) -> tuple:
    if not CSV_LOADABLE.match(s):
        if not _CSV_ROW.match(s):
            done = 0
            for n, p in enumerate(CSV_PREFIXES):
                m = p.match(s)
                if not m:
                    return "broken_text", CSV_FIELDS[n], done, None
                done = m.end()
            return "broken_text", "(end)", done, None
    values, pos = [], 0
    while True:
        m = _CSV_ONE.match(s, pos)
        values.append(_unquote(m[1]))
        pos = m.end()
        if m[2] != ",":
            break
    if len(values) != len(CSV_FIELDS):
        return "column_count", CSV_FIELDS[len(values)] if len(values) < len(CSV_FIELDS) else "(extra)", None, None
    row = dict(zip(CSV_FIELDS, values))
    if row["role"] not in ROLES:
        return "bad_value", "role", None, None
    return None, None, None, row


def judge(fmt: str | None, raw: str | None) -> tuple | None:
    if raw is None or not raw.strip():
        return None
    if fmt not in ("jsonl", "csv"):
        fmt = "jsonl" if raw.lstrip()[0] == "{" else "csv"
    return judge_json(raw) if fmt == "jsonl" else judge_csv(raw)


def _clean(v: str | None) -> str | None:
    """Lone surrogates, which JSON escapes may hold, can't be stored."""
    return v if v is None or v.isascii() else v.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _whole(lines: DataFrame) -> DataFrame:
    """line_id, raw, fmt and whether the row matches its format's pattern as a whole (`_csv`, `_json` with its fields in `_j`)."""
    raw = F.col("raw")
    known = {**JSON_REQUIRED, **JSON_OPTIONAL}
    once = lambda k: F.length(raw) - F.length(F.replace(raw, F.lit(f'"{k}"'), F.lit(""))) <= len(k) + 2
    plain = (F.col("fmt") == "jsonl") & raw.rlike(_java(json_row_pattern())) & ~F.contains(raw, F.lit("\\u"))
    for k in known:
        plain = plain & once(k)
    names = [k for k, kind in known.items() if kind in ("string", "role")]
    # a key may be missing and stand as a value, so the fields are looked at
    rows = lines.select("line_id", "fmt", "raw").withColumn("_j", F.when(plain, F.from_json(raw, ", ".join(f"{k} string" for k in names))))
    there = F.col("_j").isNotNull()
    for k in JSON_REQUIRED:
        there = there & F.col(f"_j.{k}").isNotNull()
    csv = (F.col("fmt") == "csv") & raw.rlike(_java(csv_row_pattern()))
    return rows.withColumns({"_json": F.coalesce(there, F.lit(False)), "_csv": F.coalesce(csv, F.lit(False))})


def _loaded(rows: DataFrame) -> DataFrame:
    def cell(i: int) -> Column:
        f = F.regexp_extract("raw", _java(csv_row_pattern()), i + 1)
        return F.when(F.startswith(f, F.lit('"')), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)

    cells = [cell(i) for i in range(len(CSV_FIELDS))]
    own = {"model": "model", "session_id": "sessionId"}
    fields = [F.when(F.col("_json"), F.col(f"_j.{own.get(name, name)}")).otherwise(c).alias(name) for name, c in zip(CSV_FIELDS, cells)]
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("reason", "string"), ("field", "string"), ("position", "int"))]
    return rows.select("line_id", F.lit(True).alias("loaded"), *nothing, *fields)


def _judged(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            out = []
            for line, fmt, raw in zip(b["line_id"], b["fmt"], b["raw"]):
                found = judge(fmt if isinstance(fmt, str) else None, raw if isinstance(raw, str) else None)
                if found is None:
                    continue
                reason, field, pos, row = found
                row = row or {}
                out.append((line, reason is None, reason, field, pos, *[_clean(row.get(k)) for k in ("id", "role", "content", "timestamp", "model")], _clean(row.get("sessionId", row.get("session_id")))))
            frame = pd.DataFrame(out, columns=["line_id", "loaded", "reason", "field", "position", "id", "role", "content", "timestamp", "model", "session_id"])
            frame["position"] = frame["position"].astype("Int32")
            yield frame

    ship(rows.sparkSession)
    return rows.select("line_id", "fmt", "raw").mapInPandas(run, OUTPUT)


def split_lines(lines: DataFrame) -> DataFrame:
    """One row per line that isn't blank: either loaded with its fields, or with reason, first broken field and position."""
    rows = _whole(lines)
    return _loaded(rows.filter("_json or _csv")).unionByName(_judged(rows.filter("not (_json or _csv)")))


def rejected_lines(lines: DataFrame) -> DataFrame:
    return _judged(_whole(lines).filter("not (_json or _csv)")).filter("not loaded")
