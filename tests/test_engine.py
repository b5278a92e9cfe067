"""The engine's own operators against plain-Python readings of their rules, and their edges."""

import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from skald.functions import text as T
from skald.functions.embedding import EmbeddingCache, embed, hashed
from skald.operators import extraction, frame, graph, importance, search, vectors
from skald.operators.history import number_rows

DOT = "[^\n\r  ]"
PY = lambda p: re.compile("(?i)" + p.replace(".+", DOT + "+"), re.ASCII)
SPACE = "\t\n\x0b\f\r   " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"


def caught(patterns, text):
    return [m[1].strip(SPACE) for p in patterns if "(.+" in p and (m := PY(p).search(text))]


def units(s):
    return len(s.encode("utf-16-le")) // 2


def scores(rows):
    """rows (session, seq, content, tool)"""
    past, out = {}, {}
    for s, q, c, tool in sorted(rows, key=lambda r: r[1]):
        c = c or ""
        h = past.setdefault(s, [])
        sd = min(1, 0.5 * any(PY(p).search(c) for p in T.DECISIONS) + 0.7 * any(PY(p).search(c) for p in T.CORRECTIONS) + 0.3 * tool)
        rf = min(1, sum(e.lower() in x.lower() for e in caught(T.ENTITIES, c) for x in h[-20:]) / 5)
        if len(h) < 3:
            td = 0
        elif any(PY(p).search(c) for p in T.SHIFTS):
            td = 0.8
        else:
            a = sum(map(units, h[-5:])) / 5
            td = (0.5 if units(c) else 0) if a == 0 else 0.5 if units(c) / a > 2 or units(c) / a < 0.3 else 0
        out[q] = (sd, rf, td, min(1, 0.45 * sd + 0.25 * rf + 0.3 * td))
        h.append(c)
    return out


PIECES = ["We decided to use redis", "let's go with kafka", "I'll use x", "the plan is y", "actually, z", "no, wait", "not a, but b", "correction: q", "we're using redis for queues", "the   is x", "the redis is slow",
          "set up kafka with y", "connected to 　redis", "moving on", "also check", "ok", "", "\U0001f600\U0001f600\U0001f600", "the a  is b", "the a\u0085b is c", "bathe x is y", "Redis and KAFKA again " * 5]


def conversation(seed, n=400):
    r = random.Random(seed)
    return [(r.choice(["a", "a", "a", "b", "c"]), i, r.choice(["", None]) if r.random() < 0.1 else " ".join(r.choice(PIECES) for _ in range(r.randrange(1, 3))), r.random() < 0.2) for i in range(n)]


@pytest.mark.parametrize("hot", [10**6, 60])
def test_scores(spark, hot):
    rows = conversation(1)
    df = spark.createDataFrame(rows, "session_id string, seq bigint, content string, has_tool boolean")
    found = importance.score(df.repartition(3), hot_rows=hot).collect()
    expected = scores(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.state_delta, r.reference_frequency, r.trajectory_discontinuity, r.total) == pytest.approx(expected[r.seq]), r


def test_few_and_empty_rows(spark):
    texts = ["", "", "", "", "", "", "x", "abc", "abc", "abc", "abc", "abc", "abcdefg", "a"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "session_id string, seq bigint, content string")
    found = {r.seq: r.trajectory_discontinuity for r in importance.score(df).collect()}
    assert found[2] == 0 and found[5] == 0 and found[6] == 0.5 and found[12] == 0.5
    assert importance.score(df.limit(0)).count() == 0


def test_numbering_across_tasks(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), (F.col("id") * 7919 % 3000).alias("o"))
    rows = number_rows(df, "k", ["o"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.k, []).append((r.o, r._n))
    for v in by.values():
        assert [n for _, n in sorted(v)] == list(range(len(v)))


@pytest.mark.parametrize(
    "text,patterns,found",
    [
        ("we decided on  Postgres ", T.DECISIONS, ["Postgres"]),
        ("lets use a\nb", T.DECISIONS, ["a"]),
        ("not A, but B", T.CORRECTIONS, ["A,"]),
        ("no, wait", T.CORRECTIONS, []),
        ("piano, wait; i mean c", T.CORRECTIONS, ["c"]),
        ("we're using a as b, the q is r", T.ENTITIES, ["a", "q"]),
        ("the   is x", T.ENTITIES, [""]),
        ("the a b is c", T.ENTITIES, []),
        ("the a\u0085b is c", T.ENTITIES, ["a\u0085b"]),
        (None, T.ENTITIES, []),
    ],
)
def test_captures(spark, text, patterns, found):
    df = spark.createDataFrame([(text,)], "t string")
    assert (df.select(T.captures(F.col("t"), patterns)).first()[0] or []) == found
    if text is not None:
        assert caught(patterns, text) == found


def test_lengths_and_prefixes(spark):
    df = spark.createDataFrame([("a\U0001f600b",), ("",), ("  x﻿",)], "t string")
    rows = df.select(T.units(F.col("t")), T.tokens(F.col("t")), T.prefix(F.col("t"), 2), T.prefix(F.col("t"), 3), T.trim(F.col("t"))).collect()
    assert tuple(rows[0]) == (4, 1, "a", "a\U0001f600", "a\U0001f600b") and tuple(rows[1])[:2] == (0, 0) and rows[2][4] == "x"


def test_upsert_and_session_entities(spark):
    s = spark.createDataFrame([("a", "t1", 1, 0), ("a", "t0", 9, 0), ("b", "t5", 2, 1), ("a", "t1", 1, 2)], "entity string, ts string, seq bigint, pos int")
    table = {r.id: (r.first_seen, r.last_seen, r.reference_count) for r in extraction.upsert(s).collect()}
    assert table == {"a": ("t0", "t1", 3), "b": ("t5", "t5", 1)}
    again = {r.id: (r.first_seen, r.last_seen, r.reference_count) for r in extraction.upsert(s.filter("entity = 'b'"), extraction.upsert(s)).collect()}
    assert again == {"a": ("t0", "t1", 3), "b": ("t5", "t5", 2)}
    ids = ["x%y", "a_c", 'q"t', "b\\s", "Abc", "%", "", "nope", "é"]
    texts = ['["x1y"]', '["abc"]', '["q\\"t"]', '["b\\\\s"]', '["É"]', None, "[]"]
    m = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)] + [(None, '["Abc"]')], "session_id string, entity_ids string")
    e = spark.createDataFrame([(i,) for i in ids], "id string")
    fold = lambda v: "".join(c.lower() if c.isascii() else c for c in v)
    like = lambda i, t: re.search("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in fold(i)), fold(t), re.S)
    expected = sorted((f"s{k}", i) for k, t in enumerate(texts) if t is not None for i in ids if like(i, t))
    assert sorted(map(tuple, extraction.session_entities(m, e).collect())) == expected
    assert sorted(map(tuple, extraction.session_entities(m, e, block=2).collect())) == expected
    assert sorted(map(tuple, extraction.session_entities(m, e, exact=True).collect())) == [("s2", 'q"t'), ("s3", "b\\s")]


def queue_bfs(nodes, edges, starts, depth):
    """edges (id, from, to, relation) in order; chunks in emission order"""
    seen, out, queue = set(), [], deque((s, 0) for s in starts)
    while queue:
        n, d = queue.popleft()
        if n in seen or d > depth:
            continue
        seen.add(n)
        if n not in nodes:
            continue
        out.append((n, f"{nodes[n][0]}: {nodes[n][1]}", 1 - 0.3 * d, "entity"))
        for _, a, b, r in sorted(edges):
            if a == n:
                out.append((f"{a}->{b}", f"{nodes[n][1]} --[{r}]--> {b}", 0.8 - 0.2 * d, "path"))
                if b not in seen:
                    queue.append((b, d + 1))
    return out


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_bfs_order(spark, depth):
    r = random.Random(depth)
    names = [f"n{i}" for i in range(25)]
    nodes = {n: (r.choice("xy"), n.upper()) for n in names[:20]}
    edges = [(i, r.choice(names), r.choice(names), r.choice(["p", "q"])) for i in range(60)] + [(99, "n1", "n1", "self")]
    starts = ["n3", "n24", "n5", "unknown"]
    e = spark.createDataFrame([(n, *v) for n, v in nodes.items()], "id string, type string, value string")
    rel = spark.createDataFrame(edges, "id bigint, entity_from string, entity_to string, relation string")
    s = spark.createDataFrame([(n, i) for i, n in enumerate(starts)], "id string, ord int")
    found = graph.chunks(e, rel, graph.bfs(e, rel, s, depth)).orderBy("ord").collect()
    expected = queue_bfs(nodes, edges, starts, depth)
    assert [(x.id, x.content, x.type) for x in found] == [(a, b, d) for a, b, _, d in expected]
    assert [x.score for x in found] == pytest.approx([c for _, _, c, _ in expected])
    # merging folds repeated ids in that order
    merged, order = {}, []
    for a, _, c, _ in expected:
        if a in merged:
            merged[a] = merged[a] * 0.7 + c * 0.3
        else:
            merged[a] = c
            order.append(a)
    best = sorted(order, key=lambda a: -round(merged[a], 12))[:7]
    got = [x.id for x in search.merge(graph.chunks(e, rel, graph.bfs(e, rel, s, depth)), 7).collect()]
    assert sorted(merged[a] for a in got) == pytest.approx(sorted(merged[a] for a in best))


def test_undirected_paths_and_texts(spark):
    rel = spark.createDataFrame([(1, "a", "b", "x"), (2, "b", "c", "x"), (3, "a", "b", "y"), (4, "c", "c", "z")], "id bigint, entity_from string, entity_to string, relation string")
    s = spark.createDataFrame([("a",)], "id string")
    ways = {tuple(x.edges) for x in graph.undirected_paths(rel, s, 2, None).collect()}
    assert ways == {(1,), (3,), (1, 3), (3, 1), (1, 2), (3, 2)}
    assert graph.undirected_paths(rel, s, 3, 2).count() == 2
    assert "WHERE e.id IN ['a', 'b']" in graph.traversal_text(["a", "b"]) and "[r*1..3]" in graph.traversal_text([], 3)
    assert "[1,-0.5]" in graph.vector_text([1.0, -0.5]) and "LIMIT 5" in graph.vector_text([])


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [-1.0, 0.0]), (5, None), (6, [2.0, 0.0])], "id bigint, v array<double>")
    got = {r.id: r.s for r in df.select("id", vectors.cosine(F.col("v"), F.array(F.lit(3.0), F.lit(0.0))).alias("s")).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: -1, 5: 0, 6: 1}
    assert [r.id for r in vectors.top_k(df, [3.0, 0.0], 3, "id", "v").collect()] == [1, 6, 2]
    batch = vectors.top_k_batch(df, df.filter("id in (1, 3)").select(F.col("id").alias("q"), "v"), 2, block=1).collect()
    assert {(r.q, r.id, round(r.score, 6)) for r in batch} == {(1, 6, 1.0), (1, 2, 0.0), (3, 1, 0.0), (3, 2, 0.0)}


def test_neighbours_at_the_border(spark):
    m = spark.createDataFrame([(1, 0, "user", "a"), (2, 300_000_000, "user", "b"), (3, 299_999_000, "tool", "c"), (4, None, "user", "d"), (5, -299_999_999, None, None), (6, 1, "user", "e"), (7, 2, "user", "f")], "seq bigint, us bigint, role string, content string")
    found = {(r.hit, r.seq) for r in search.neighbours(m.filter("seq in (1, 4)").select(F.col("seq").alias("hit"), "us"), m).collect()}
    assert found == {(1, 3), (1, 5), (1, 6)}


def plain_frame(messages, decisions, entities, budget):
    tokens = lambda s: -(-units(s) // 4)
    parts = []
    if entities:
        parts.append("## Entities\n" + "\n".join(f"- {v} ({t})" for t, v in entities))
    if decisions:
        parts.append("## Decisions\n" + "\n".join(f"- {d}" for d in decisions))
    used, lines = tokens("\n".join(parts)), []
    for role, c in messages[-10:]:
        line = f"\n{role}: {c[:200]}"
        if used + tokens(line) > budget:
            break
        lines.insert(0, line)
        used += tokens(line)
    if lines:
        parts.append("## Recent Messages" + "".join(lines))
    return "\n\n".join(parts)


@pytest.mark.parametrize("budget", [1, 20, 60, 200, 2000])
def test_frames(spark, budget):
    r = random.Random(budget)
    m, d, e, expected = [], [], [], {}
    for s in range(12):
        ms = [(r.choice(["user", "tool"]), "x" * r.choice([0, 5, 60, 300])) for _ in range(r.randrange(1, 15))]
        ds = [f"d{i}" for i in range(r.randrange(3))]
        es = [("t", f"e{i}") for i in range(r.randrange(3))]
        m += [(f"s{s}", i, i, a, b) for i, (a, b) in enumerate(ms)]
        d += [(f"s{s}", i, i, 0, x) for i, x in enumerate(ds)]
        e += [(f"s{s}", i, t, v) for i, (t, v) in enumerate(es)]
        expected[f"s{s}"] = plain_frame(ms, ds, es, budget)
    found = frame.context_frames(
        spark.createDataFrame(m, "session_id string, ord int, seq int, role string, content string"),
        spark.createDataFrame(d, "session_id string, ord int, seq int, pos int, description string"),
        spark.createDataFrame(e, "session_id string, o int, type string, value string"),
        budget,
    )
    assert {x.session_id: x.frame for x in found.collect()} == expected


def test_embedding(spark):
    df = spark.createDataFrame([("spark and redis",), ("redis and spark",), ("",), (None,), ("other words",)], "text string")
    rows = [r.embedding for r in embed(df, "text", lambda c: hashed(c, 32)).collect()]
    assert len(rows) == 5 and all(len(v) == 32 for v in rows)
    one = spark.createDataFrame([("spark and redis", "redis and spark")], "a string, b string").select(hashed(F.col("a")).alias("a"), hashed(F.col("b")).alias("b")).first()
    assert one.a == one.b and len(one.a) == 384 and sum(x * x for x in one.a) == pytest.approx(1)


def test_index_and_cache(spark):
    make = lambda x: spark.createDataFrame(x, "id bigint, v array<double>")
    index = vectors.VectorIndex(make([(1, [1.0, 0.0]), (2, [0.0, 1.0])]))
    index.add(make([(2, [9.0, 9.0]), (3, [1.0, 1.0])]))
    assert index.size() == 3 and index.get(2) == [0.0, 1.0] and index.get(7) is None
    assert [r.id for r in index.search([1.0, 0.1], 2).collect()] == [1, 3]
    index.clear()
    assert index.size() == 0
    cache = EmbeddingCache(4)
    for i in range(5):
        cache.set(str(i), [i])
    assert cache.size() == 3 and cache.get("0") == [0] and cache.get("3") is None and cache.get("4") == [4]
    cache.clear()
    assert cache.size() == 0
