import numpy as np
from pyspark.sql import functions as F

from skald.llm.neighbours import Router, Tree, _best, balanced_parts, close_pairs, compare, message_vectors, neighbour_graph, top_neighbours

DIMS = 16


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, rows):
    return spark.createDataFrame([(int(n), None if v is None else [None if a is None else float(a) for a in v], 1) for n, v in rows], "n bigint, v array<float>, rank int")


def brute_pairs(ids, x, k, floor):
    s = x @ x.T
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= floor), key=lambda j: (-round(float(s[i, j]), 6), ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order}
    return out


def clustered(n, seed):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, DIMS))
    for i in range(0, n - 3, 9):
        for j in (1, 2):
            x[i + j] = x[i] + 0.2 * r.standard_normal(DIMS)
    return x * r.uniform(0.1, 5, (n, 1))


def dense(n, group, seed):
    """Groups of near vectors that aren't copies."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, DIMS))
    for i in range(0, n // 2, group):
        x[i : i + group] = x[i] + 0.25 * r.standard_normal((group, DIMS))
    return x.astype(np.float32)


def top_close(df):
    return {(min(r.q, r.s), max(r.q, r.s)) for r in top_neighbours(df, 10, DIMS, 0.87, part_rows=300).collect()}


def test_close_pairs_over_several_parts(spark):
    x = clustered(3000, 1).astype(np.float32)
    df = frame(spark, enumerate(x.tolist()))
    expected = brute_pairs(list(range(len(x))), unit(x.astype(np.float64)), 10, 0.9)
    found = set()
    rows = top_neighbours(df, 10, DIMS, 0.9, part_rows=300).collect()
    for r in rows:
        found.add((min(r.q, r.s), max(r.q, r.s)))
    assert len(expected) > 500
    assert len(found & expected) >= 0.97 * len(expected) and not found - expected


def test_askers_of_a_row_are_kept_beyond_their_own_lists():
    s = np.array([[0.99, 0.98, 0.9], [0.97, 0.96, 0.8]], np.float32)
    r, c = _best(s, np.array([10, 11]), np.array([1, 2, 3]), 2, 0.87)
    assert set(zip(r.tolist(), c.tolist())) == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)}


def test_dense_groups_over_several_parts(spark):
    x = dense(3000, 300, 5)
    df = frame(spark, enumerate(x.tolist()))
    expected = brute_pairs(list(range(len(x))), unit(x.astype(np.float64)), 10, 0.87)
    found = set(map(tuple, top_close(df)))
    assert len(found & expected) >= 0.97 * len(expected)


def test_recall_without_floor(spark):
    x = clustered(2500, 2)
    df = frame(spark, enumerate(x.tolist()))
    rows = top_neighbours(df, 10, DIMS, queries=lambda n: n % 25 == 0, part_rows=250).collect()
    s = unit(x) @ unit(x).T
    np.fill_diagonal(s, -2)
    got = {}
    for r in rows:
        got.setdefault(r.q, set()).add(r.s)
    assert set(got) == set(range(0, 2500, 25)) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(v & set(np.argsort(-s[q])[:10].tolist())) / 10 for q, v in got.items()]) >= 0.9


def test_hot_copies_unusable_vectors_and_repeats(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((200, DIMS)).astype(np.float32)
    x[50:120] = x[50]
    x[130] = x[50] + 0.05
    x[140:143] = x[7]
    rows = [*enumerate(x.tolist()), (50, x[50].tolist())]
    odd = [(900, None), (901, []), (902, [1.0] * 5), (903, [0.0] * DIMS), (904, [0.0] * DIMS), (905, [float("nan")] * DIMS), (906, [None] + [1.0] * (DIMS - 1)), (907, [float("inf")] * DIMS), (908, [float("nan")] * DIMS)]
    df = frame(spark, rows + odd)
    expected = brute_pairs(list(range(200)), unit(x.astype(np.float64)), 10, 0.9)
    assert set(map(tuple, close_pairs(df, 10, DIMS, 0.9).collect())) == expected
    per = {}
    for r_ in top_neighbours(df, 10, DIMS, 0.9).collect():
        per.setdefault(r_.q, []).append(r_.s)
    assert all(len(v) == len(set(v)) <= 10 and q not in v for q, v in per.items())
    assert per[119][:10] == list(range(50, 60)) and set(per[50]) == set(range(51, 61))
    assert close_pairs(df.limit(0), 10, DIMS).count() == 0
    assert close_pairs(frame(spark, odd), 10, DIMS).count() == 0


def test_parts_are_balanced():
    x = unit(clustered(2000, 4)).astype(np.float32)
    labels = balanced_parts(x, neighbour_graph(x, 10), 16, np.random.default_rng(1))
    assert np.bincount(labels, minlength=16).max() <= 1.05 * 2000 / 16 + 1


def test_message_vectors_are_first_deliveries(spark):
    df = spark.createDataFrame([(1, "a", [1.0] * DIMS), (2, "a", [1.0] * DIMS), (3, None, [2.0] * DIMS), (4, "", [2.0] * 3)], "seq bigint, id string, embedding array<float>")
    assert sorted(r.n for r in message_vectors(df, DIMS).select(F.col("n")).collect()) == [1, 3]


def test_groups_of_parts_below_one_router(spark):
    x = clustered(4000, 3).astype(np.float32)
    df = frame(spark, enumerate(x.tolist()))
    expected = brute_pairs(list(range(len(x))), unit(x.astype(np.float64)), 10, 0.9)
    rows = top_neighbours(df, 10, DIMS, 0.9, part_rows=150, max_parts=3).collect()
    found = {(min(r.q, r.s), max(r.q, r.s)) for r in rows}
    assert len(found & expected) >= 0.97 * len(expected) and not found - expected


def test_tree_routes_by_the_same_order_as_it_counts_places():
    r = np.random.default_rng(4)
    x = unit(r.standard_normal((1500, DIMS))).astype(np.float32)
    root = Router(x, 3, 10, 0.87, 0.9, epochs=2)
    home = root.route(x, 1)[:, 0]
    tree = Tree(root, {g: Router(x[home == g], 4, 10, 0.87, 0.9, hidden=16, epochs=2) for g in range(2)}, 4)
    to = tree.route(x[:200], 9)
    for i in range(9):
        assert (tree.places(x[:200], to[:, i]) == i).all()
    assert set(to.ravel().tolist()) <= set(range(9))


def test_leaves_of_a_cell_against_the_whole_cell():
    x = unit(clustered(6000, 6)).astype(np.float32)
    ids = np.arange(len(x))
    for floor in (0.9, None):
        whole = set(zip(*(v.tolist() for v in compare(x, ids, x[:3000], ids[:3000], 10, floor, 10**6)[:2])))
        parted = set(zip(*(v.tolist() for v in compare(x, ids, x[:3000], ids[:3000], 10, floor, 300)[:2])))
        assert len(whole & parted) >= 0.98 * len(whole)
