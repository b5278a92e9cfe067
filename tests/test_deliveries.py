import random

from pyspark.sql import functions as F

from skald.common import fresh_dir, list_names
from skald.operators.deliveries import DeliveryStore, losing_deliveries, single_deliveries, stored_messages, superseded_deliveries
from skald.plans import registry

SCHEMA = "seq bigint, id string, batch_id bigint, received_at timestamp_ntz, kept string, p string, row string"


def rows(n=400, seed=1):
    import datetime

    r = random.Random(seed)
    out = []
    for i in range(n):
        key = r.choice(["hot"] * 40 + [f"k{r.randrange(60)}" for _ in range(60)] + [None, ""])
        out.append((i, key, r.randrange(8) if r.random() > 0.02 else None, datetime.datetime(2025, r.randrange(1, 5), 1) if r.random() > 0.05 else None, "x", "y", "z"))
    return out


def losers(data):
    first = {}
    for s, k, *_ in sorted(data, key=lambda x: (x[0] is None, x[0])):
        if k:
            first.setdefault(k, s)
    return sorted((k, s) for s, k, *_ in data if k and s is not None and s > first[k])


def test_whole_messages_through_the_store(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    kept = stored_messages(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, single_deliveries(df).collect()))
    assert stored_messages(df.limit(0)).count() == 0
    loaded, merge = [], DeliveryStore.merge
    monkeypatch.setattr(DeliveryStore, "merge", lambda self, batch: loaded.append(batch.columns) or merge(self, batch))
    monkeypatch.setattr(registry, "read_table", lambda *_: df.selectExpr("*", "'s' AS session_id"))
    found = registry.QUERIES["p1_messages"](spark, "").collect()
    assert loaded and all(c == [*df.columns, "session_id"] for c in loaded)
    assert [(r.session_id, r.messages) for r in found] == [("s", 400 - len(losers(rows())))]


def test_superseded_rows_and_clashing_names(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    assert sorted(map(tuple, superseded_deliveries(df).collect())) == losers(data)
    assert sorted(map(tuple, losing_deliveries(df).collect())) == losers(data)
    assert single_deliveries(df).count() == len(data) - len(losers(data))


def test_store_in_any_order_of_batches(spark):
    data = rows(300, 2)
    df = spark.createDataFrame(data, SCHEMA)
    month = F.month("received_at")
    for order in ([0, 1, 2], [2, 0, 1]):
        store = DeliveryStore(spark, fresh_dir(spark, "t"), partition=month)
        for b in order:
            store.merge(df.filter(F.coalesce("batch_id", F.lit(0)) % 3 == b))
        before = sorted((r.k, r.p) for r in store.index().collect())
        state = store.compact()
        assert len(state["index"]) == 1 and sorted((r.k, r.p) for r in store.index().collect()) == before
        assert store.compact() == state
        kept = store.winners()
        assert kept.columns == df.columns
        lost = sorted((r.id, r.seq) for r in store.superseded().collect())
        assert lost == losers(data)
        assert sorted(r.seq for r in kept.collect()) == sorted({x[0] for x in data} - {s for _, s in lost})


def test_only_affected_partitions_are_rewritten(spark):
    store = DeliveryStore(spark, fresh_dir(spark, "t"), partition=F.col("p"))
    make = lambda x: spark.createDataFrame(x, "seq bigint, id string, p string")
    store.merge(make([(1, "a", "one"), (2, "b", "two"), (3, "c", "th/ree")]))
    state = store.merge(make([(9, "b", "four"), (4, "d", "four")]))
    assert state["rows"] == {"one": 1, "th/ree": 1, "two": 2, "four": 2}
    assert sorted(r.seq for r in store.winners().collect()) == [1, 2, 3, 4]
    assert list_names(spark, f"{store.path}/_manifest") and not [n for n in list_names(spark, f"{store.path}/_manifest") if n.endswith(".tmp")]
    before = store.manifest()
    store.merge(make([]))
    assert store.manifest()["rows"] == before["rows"] and sorted(r.seq for r in store.winners().collect()) == [1, 2, 3, 4]


def test_repeats_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(5, "a"), (5, "a"), (None, "a"), (7, "a"), (1, None), (2, ""), (2, "")], "seq bigint, id string")
    store = DeliveryStore(spark, fresh_dir(spark, "t"))
    store.merge(df)
    assert sorted((r.id or "", r.seq) for r in store.winners().collect()) == [("", 1), ("", 2), ("", 2), ("a", 5)]
    assert sorted((r.seq or 0) for r in store.superseded().collect()) == [0, 7]
    empty = spark.createDataFrame([], SCHEMA)
    assert superseded_deliveries(empty).count() == 0 and single_deliveries(empty).count() == 0


def test_redelivered_batches_change_nothing(spark):
    make = lambda x: spark.createDataFrame(x, "seq bigint, id string, p string")
    store = DeliveryStore(spark, fresh_dir(spark, "t"), partition=F.col("p"))
    batch = make([(1, "a", "x"), (2, "a", "y"), (3, "b", "x")])
    for _ in range(3):
        store.merge(batch)
    assert sorted(r.seq for r in store.winners().collect()) == [1, 3]
    assert [r.seq for r in store.superseded().collect()] == [2]
    store.merge(make([(0, "a", "y")]))
    store.merge(batch)
    assert sorted(r.seq for r in store.winners().collect()) == [0, 3]
    assert sorted(r.seq for r in store.superseded().collect()) == [1, 2]


def test_a_merge_reads_touched_index_buckets_only(spark, monkeypatch):
    make = lambda ids: spark.createDataFrame([(i, f"k{i}") for i in ids], "seq bigint, id string")
    store = DeliveryStore(spark, fresh_dir(spark, "t"))
    store.merge(make(range(500)))
    asked, index = [], DeliveryStore.index
    monkeypatch.setattr(DeliveryStore, "index", lambda self, buckets=None: asked.append(buckets) or index(self, buckets))
    store.merge(spark.createDataFrame([(900, "k7"), (901, None)], "seq bigint, id string"))
    assert [len(b) for b in asked] == [1] and [r.seq for r in store.superseded().collect()] == [900]


def test_two_writers_of_one_version(spark):
    import pytest

    from skald.common import read_text, write_text_atomically

    path = f"{fresh_dir(spark, 't')}/_manifest/1.json"
    write_text_atomically(spark, path, "one")
    with pytest.raises(RuntimeError):
        write_text_atomically(spark, path, "two")
    assert read_text(spark, path) == "one"
