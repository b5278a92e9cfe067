import csv
import io
import json
import random

import pytest

from skald.operators.rejects import ROLES, _clean, judge, judge_json, rejected_lines, split_lines
from skald.sources.jsonl import validate

GOOD = '{"id":"m1","role":"user","content":"c","timestamp":"t"}'
CASES = [
    (GOOD, None),
    ('{"id":"m2","role":"tool","content":"","timestamp":"x","toolCall":{"name":"t","input":{"a":1}},"extra":1}', None),
    ('{"id":5,"role":"user","content":"c","timestamp":"t"}', "bad_value"),
    ('{"id":"m3","role":"bot","content":"c","timestamp":"t"}', "bad_value"),
    ('{"id":"m4","role":"user","content":"c","timestamp":"t","model":null}', "bad_value"),
    ('{"id":"m5","role":"user","content":"c"}', "column_count"),
    ('{"id":"m6","role":"user","content":"c","timestamp":"t","toolCall":{"name":"t","input":[1]}}', "bad_value"),
    ('{"id":"m6","role":"user","content":"c","timestamp":"t","toolCalls":[{"name":"t","input":{}},{"name":1,"input":{}}]}', "bad_value"),
    ('{"id":"m6","role":"user","content":"c","timestamp":"t","toolCalls":[]}', None),
    ('{"id":"m6","role":"user","content":"c","timestamp":"t","toolCalls":{}}', "bad_value"),
    ("[1]", "column_count"),
    ("{bad", "broken_text"),
    (GOOD + "]", "broken_text"),
    (GOOD[:-1] + ",}", "broken_text"),
    (GOOD[:-1] + ',"n":NaN}', "broken_text"),
    (GOOD[:-1] + ',"n":01}', "broken_text"),
    (GOOD[:-1] + ',"role":"bot"}', "bad_value"),
    ('{"\\u0069d":"m","role":"\\u0075ser","content":"c","timestamp":"t"}', None),
    ('{"id":"m","role":"user","content":"a\tb","timestamp":"t"}', "broken_text"),
]


@pytest.mark.parametrize("raw,reason", CASES)
def test_json(raw, reason):
    assert judge("jsonl", raw)[0] == reason


@pytest.mark.parametrize(
    "raw,reason,field",
    [
        ("a,user,c,t,m,s", None, None),
        ('"a","user","x ""y""\nz","t","","s"\r\n', None, None),
        ("a,user,c,t,m", "column_count", "session_id"),
        ("a,user,c,t,m,s,", "column_count", "(extra)"),
        ("a,User,c,t,m,s", "bad_value", "role"),
        ('a,user,x "y" z,t,m,s', "broken_text", "content"),
        ('a,user,"x,t,m,s', "broken_text", "content"),
        ("a,user,x\ny,t,m,s", "broken_text", "content"),
    ],
)
def test_csv(raw, reason, field):
    assert judge("csv", raw)[:2] == (reason, field)


@pytest.mark.parametrize("raw", ['m1,"user,hi,2025,m,s', 'm1,user",hi,2025,m,s', 'm1,"tool,hi,2025,m,s\r\n'])
def test_stray_quote_at_the_role(spark, raw):
    assert judge("csv", raw)[:2] == ("broken_text", "role")
    df = spark.createDataFrame([(1, "csv", raw), (2, "csv", 'm2,"user",hi,2025,m,s')], "line_id bigint, fmt string, raw string")
    assert [(r.line_id, r.reason) for r in rejected_lines(df).collect()] == [(1, "broken_text")]
    assert [r.line_id for r in split_lines(df).filter("loaded").collect()] == [2]


def test_first_broken_field_and_depth():
    assert judge_json('{"id":"a","role":"user","content":"x"y","timestamp":"t"}')[:2] == ("broken_text", "content")
    assert judge_json("[" * 100_000)[0] == "broken_text"
    assert judge_json(GOOD[:-1] + ',"d":' + "[" * 50_000 + "]" * 50_000 + "}")[0] is None


def brute(fmt, s):
    if not s.strip():
        return "skip"
    if fmt == "csv":
        return None
    try:
        v = json.loads(s, parse_constant=lambda x: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return "broken_text"
    if not isinstance(v, dict) or any(k not in v for k in ("id", "role", "content", "timestamp")):
        return "column_count"
    if any(k in v and not isinstance(v[k], str) for k in ("id", "content", "timestamp", "model", "sessionId")) or v["role"] not in ROLES:
        return "bad_value"
    return None


def test_against_a_parser_on_damaged_records():
    r = random.Random(3)
    for _ in range(3000):
        s = json.dumps({"id": "a", "role": r.choice(ROLES), "content": r.choice(["", "é\n", 'q"', 5]), "timestamp": "t", **({"model": r.choice(["m", None])} if r.random() < 0.5 else {}), "x": r.choice([1, [1, {"y": []}], -0.5e3])}, ensure_ascii=r.random() < 0.5)
        for _ in range(r.randrange(3)):
            i = r.randrange(len(s))
            s = s[:i] + r.choice(["", '"', ",", "\\", "{", "x"]) + s[i + 1 :]
        found = judge("jsonl", s)
        assert ("skip" if found is None else found[0]) == brute("jsonl", s), s


def test_round_trip_of_csv():
    r = random.Random(4)
    for _ in range(500):
        row = ["".join(r.choice('a,"\n é') for _ in range(r.randrange(6))) for _ in range(6)]
        row[1] = r.choice(ROLES)
        out = io.StringIO()
        csv.writer(out).writerow(row)
        reason, _, _, fields = judge("csv", out.getvalue())
        assert reason is None and list(fields.values()) == row


def test_frames_nulls_empty_and_extra_columns(spark):
    data = [(i, "jsonl", c[0], 1) for i, c in enumerate(CASES)] + [(100, "csv", None, 1), (101, "jsonl", " \t", 1), (102, None, GOOD, 1), (103, "csv", "x" * 200_000, 1), (0, "jsonl", GOOD, 1)]
    df = spark.createDataFrame(data, "line_id bigint, fmt string, raw string, reason int")
    found = {r.line_id: r.reason for r in rejected_lines(df).collect()}
    assert found == {i: c[1] for i, c in enumerate(CASES) if c[1]} | {103: "column_count"}
    assert split_lines(df).filter("loaded").count() == sum(c[1] is None for c in CASES) + 2
    assert split_lines(df.limit(0)).count() == 0
    ours = {r.line_id for r in validate(df.filter("fmt = 'jsonl'").select("line_id", F_raw())).collect()}
    assert ours == {i for i, c in enumerate(CASES) if c[1] is None}


def F_raw():
    from pyspark.sql import functions as F

    return F.col("raw").alias("value")


def test_rows_loaded_in_the_jvm_are_those_that_judging_loads(spark):
    r = random.Random(8)
    long = "\\\\n\\\"" * 60_000
    texts = [json.dumps({"id": "m", "role": "user", "content": c, "timestamp": "t"}) for c in ("id", "role", "x\\ny", 'say "id"', "\u00e9", "😀", "")]
    texts += ['{"id":"a","role":"user","content":"' + long + '","timestamp":"t"}', '{"content":"id","role":"user","timestamp":"role","model":"id"}', '{"id":"a","id":"b","role":"user","content":"c","timestamp":"t"}']
    texts += ['{"id":"a","role":"user","content":"c","timestamp":"t","toolCall":{"name":"n","input":{"a":[1,{"b":[]}]}}}', '{"id":"a","role":"user","content":"c","timestamp":"t","x":[[[[[[1]]]]]]}', '{"id":"a","role":"user","content":"c","timestamp":"t","x":[[[[[[1]]]],]]}']
    base = list(texts)
    for _ in range(400):
        t = list(r.choice(base[:7] + base[8:]))
        for _ in range(r.randrange(1, 3)):
            t[r.randrange(len(t))] = r.choice(['"', ",", "}", "\\\\", "x", "", " ", "null"])
        texts.append("".join(t))
    cells = ['user', '"user"', "a,b", '"a,b"', '"a""b"', "", '"' + "x,\n" * 50_000 + '"', 'a"b', "é"]
    csv_texts = [",".join(r.choice(cells) for _ in range(r.choice([5, 6, 6, 6, 7]))) + r.choice(["", "\n", "\r\n"]) for _ in range(200)]
    rows = [(i, "jsonl", t, "x") for i, t in enumerate(texts)] + [(10_000 + i, "csv", t, "x") for i, t in enumerate(csv_texts)] + [(20_000, None, texts[0], "x"), (20_001, "csv", None, "x")]
    found = {x.line_id: x for x in split_lines(spark.createDataFrame(rows, "line_id bigint, fmt string, raw string, reason string")).collect()}
    for i, fmt, t, _ in rows:
        expected = judge(fmt, t)
        assert (expected is None) == (i not in found), t
        if expected:
            assert found[i].reason == expected[0], t[:200]
            if expected[3]:
                values = {k: _clean(expected[3].get("sessionId", expected[3].get(k)) if k == "session_id" else expected[3].get(k)) for k in ("id", "role", "content", "timestamp", "model", "session_id")}
                assert {k: found[i][k] for k in values} == values
