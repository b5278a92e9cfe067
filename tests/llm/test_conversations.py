import random

import pytest

from skald.llm.conversations import assemble, conversations, with_turns

SCHEMA = "seq bigint, id string, session_id string, role string, content string, timestamp string, frag string, h string"


def make(seed, n=60):
    r = random.Random(seed)
    rows = []
    for s in range(n):
        length = r.choice([0, 1, 2, 3, 5, 40])
        turn = 0
        t = r.randrange(10**6)
        for i in range(length):
            role = ["user", "assistant"][turn % 2] if r.random() < 0.93 else r.choice(["system", "tool", "user", "assistant", "bot", None])
            turn += role in ("user", "assistant")
            content = r.choice(["hi", "ok"]) if r.random() < 0.97 else r.choice([None, "", "  \n"])
            t += r.randrange(3)
            stamp = f"{1_700_000_000 + t}" if r.random() < 0.995 else r.choice([None, "never"])
            rows.append([f"m{s}-{i}" if r.random() < 0.9 else r.choice([None, ""]), f"s{s}", role, content, stamp])
        if r.random() < 0.6 and length > 1:
            rows.append(list(rows[-1]))
    rows += [["x", None, "user", "a", "1700000000"], ["y", "", "user", "a", "1700000000"]]
    r.shuffle(rows)
    return [(i, *x, "f", "h") for i, x in enumerate(rows)]


def brute(rows):
    first = {}
    for q, i, *_ in sorted(rows):
        if i:
            first.setdefault(i, q)
    sessions = {}
    for q, i, s, role, content, stamp, *_ in rows:
        if s and not (i and first[i] != q):
            us = int(stamp) if stamp and stamp.isdigit() else None
            sessions.setdefault(s, []).append((us, q, role, content))
    out = []
    for s, v in sessions.items():
        if any(us is None or role not in ("system", "user", "assistant", "tool") for us, _, role, _ in v):
            continue
        v.sort()
        blank = lambda c: c is None or not c.strip()
        spoken = [x for x in v if x[2] != "system"]
        if not spoken or spoken[0][2] != "user" or not any(x[2] == "user" and not blank(x[3]) for x in v):
            continue
        waiting = ok = True
        waiting = False
        for _, _, role, content in v:
            if role == "user":
                ok &= not waiting
                waiting = True
            elif role == "assistant" and not blank(content):
                waiting = False
        if ok and not waiting:
            out += [(s, k + 1, x[1]) for k, x in enumerate(v)]
    return sorted(out)


@pytest.mark.parametrize("most", [2000, 3])
def test_against_brute_force(spark, most):
    rows = make(1, 150)
    expected = brute(rows)
    assert len({x[0] for x in expected}) > 10
    df = spark.createDataFrame(rows, SCHEMA)
    zones = spark.createDataFrame([(f"s{i}", None if i % 3 else "Asia/Tokyo") for i in range(200)], "id string, client_tz string")
    assert sorted(map(tuple, conversations(df, zones, most).collect())) == expected


def test_first_fragment_of_one_row(spark):
    rows = make(1, 150)
    zones = spark.createDataFrame([(f"s{i}", None if i % 3 else "Asia/Tokyo") for i in range(200)], "id string, client_tz string")
    assert sorted(map(tuple, conversations(spark.createDataFrame(rows, SCHEMA), zones, 1).collect())) == brute(rows)
    said = {"kept": ["user", "assistant", "user", "assistant"], "asked_twice": ["user", "user", "assistant"], "led": ["system", "user", "assistant"]}
    rows = [(10 * j + i, f"{s}{i}", s, role, "x", str(1_700_000_000 + i), "f", "h") for j, (s, v) in enumerate(said.items()) for i, role in enumerate(v)]
    found = conversations(spark.createDataFrame(rows, SCHEMA), None, 1).collect()
    assert sorted(map(tuple, found)) == [("kept", i + 1, i) for i in range(4)] + [("led", i + 1, 20 + i) for i in range(3)]


def test_sessions_of_one_fragment_are_assembled(spark, monkeypatch):
    import skald.llm.conversations as module

    seen = set()
    monkeypatch.setattr(module, "assemble", lambda pieces: seen.update(r.session_id for r in pieces.collect()) or assemble(pieces))
    rows = make(1, 150)
    found = conversations(spark.createDataFrame(rows, SCHEMA), None).collect()
    assert found and {r.session_id for r in found} <= seen


def test_one_long_session_over_many_tasks(spark):
    rows = [(i, f"m{i}", "hot", ["user", "assistant"][i % 2], "x", str(1_700_000_000 + i // 7), "f", "h") for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = conversations(df, None, 100).collect()
    assert sorted(map(tuple, found)) == [("hot", i + 1, i) for i in range(5000)]
    broken = df.filter("seq <> 2501")
    assert conversations(broken, None, 100).count() == 0
    assert with_turns(df, conversations(df.filter("seq < 2"), None)).select("role").count() == 2


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations(df, None).count() == 0


def frags(spark, rows):
    return spark.createDataFrame(rows, "session_id string, frag bigint, hashes array<bigint>")


def test_assembly(spark):
    rows = [
        ("a", 1, [5, 6, 7]), ("a", 2, [1, 2, 3]), ("a", 3, [3, 4, 5]),  # a path, in any order
        ("b", 10, [1, 2]), ("b", 11, [3, 4]),  # a gap
        ("c", 20, [1, 2]), ("c", 21, [2, 3]), ("c", 22, [2, 4]),  # ambiguous
        ("d", 30, [1, 2, 3, 4]), ("d", 31, [2, 3]), ("d", 32, [4, 9]),  # one inside another
        ("e", 40, [1, 2, 1]), ("e", 41, [1, 2, 1, 7]),  # equal beginnings
        ("f", 50, [1, 2]), ("f", 51, [2, 1]),  # a ring
        ("g", 60, [8]),
        ("h", 70, [1, 2]), ("h", 71, [1, 2]),  # the same twice
    ]
    found = {(r.session_id, r.frag): (r.skip, r["at"]) for r in assemble(frags(spark, rows)).collect()}
    assert {k: v for k, v in found.items() if k[0] == "a"} == {("a", 2): (0, 0), ("a", 3): (1, 2), ("a", 1): (1, 4)}
    assert {k: v for k, v in found.items() if k[0] == "d"} == {("d", 30): (0, 0), ("d", 32): (1, 3)}
    assert found["g", 60] == (0, 0) and not {k for k in found if k[0] in "bcf"}
    assert [k for k in found if k[0] == "h"] == [("h", 71)] or [k for k in found if k[0] == "h"] == [("h", 70)]


def test_long_chain(spark):
    r = random.Random(3)
    rows = [("s", i, [i * 3, i * 3 + 1, i * 3 + 2, i * 3 + 3]) for i in range(130)]
    r.shuffle(rows)
    found = {x.frag: x["at"] for x in assemble(frags(spark, rows)).collect()}
    assert found == {i: 3 * i for i in range(130)}
    assert assemble(frags(spark, rows).limit(0)).count() == 0


def test_repeats_without_id_across_fragments(spark):
    roles = ["user", "assistant"] * 6
    rows = [(i, None, "s", r, "same", "1700000000", "f", "h") for i, r in enumerate(roles)]
    rows += [(20 + i, "", "s", r, "same", "1700000001", "f", "h") for i, r in enumerate(["user", "assistant", "assistant", "assistant"])]
    for most in (1, 2, 5, 100):
        found = conversations(spark.createDataFrame(rows, SCHEMA), None, most).collect()
        assert sorted((r.turn_no, r.seq) for r in found) == [(i + 1, r[0]) for i, r in enumerate(rows)]


def test_ambiguous_repeats_are_dropped(spark):
    rows = [("x", 1, [1, 2, 3]), ("x", 2, [3, 2, 3, 4]), ("x", 3, [3, 5]), ("y", 4, [7, 8, 7]), ("y", 5, [7, 9])]
    found = {r.session_id for r in assemble(frags(spark, rows)).collect()}
    assert found == {"y"}
