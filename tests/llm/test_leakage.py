import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from skald.common import fresh_dir
from skald.llm.leakage import FMIndex, Shard, build_index, find_leaks, search_index, suffix_array

WORD = re.compile(r"[^\W_]+")


def brute(docs, items, n):
    grams = {}
    for i, p in items:
        w = [x.lower() for x in WORD.findall(p or "")]
        for j in range(len(w) - n + 1):
            grams.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = [x.lower() for x in WORD.findall(t or "")]
        for j in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[j : j + n]), ())}
    return out


def data():
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)] + ["É9", "ß"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(5, 40)))) for i in range(30)]
    items += [(50, None), (51, ""), (52, items[3][1]), (53, "a a a a a a a a a a a a a a a a")]
    docs = []
    for d in range(150):
        t = [r.choice(vocabulary + ["other", "words"]) for _ in range(r.randrange(0, 60))]
        if r.random() < 0.6:
            p = WORD.findall(r.choice(items[:30])[1])
            a = r.randrange(max(1, len(p) - 12))
            t[r.randrange(len(t) + 1) : 0] = [r.choice([str.upper, str])(x) for x in p[a : a + r.choice([11, 12, 13, 40])]]
        docs.append((d, r.choice([" ", ", ", "_", "\n--"]).join(t)))
    docs += [(900, None), (901, " "), (902, "a " * 5000), (903, docs[0][1]), (904, docs[1][1])]
    return docs, items


def test_leaks(spark):
    docs, items = data()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame([(i, p, "x") for i, p in items], "item_id bigint, passage string, text string")
    expected = brute(docs, items, 12)
    assert len(expected) > 30
    for options in ({}, {"shard_words": 50}, {"block_chars": 500}):
        found = {(r.doc_id, r.item_id) for r in find_leaks(df, it, **options).collect()}
        assert found == expected, options
    assert find_leaks(df.limit(0), it).count() == 0 and find_leaks(df, it.limit(0)).count() == 0


def test_spans_are_merged_and_in_code_points(spark):
    p = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, "😀 intro " + p + " end")], "doc_id bigint, text string")
    row = find_leaks(df, spark.createDataFrame([(7, p)], "item_id bigint, passage string")).collect()
    assert len(row) == 1 and [(s.begin, s.end) for s in row[0].spans] == [(8, 8 + len(p))]


def test_index_against_plain_search():
    r = np.random.default_rng(2)
    stretches = [r.integers(1, 4, r.integers(1, 60)) for _ in range(30)] + [np.ones(80, np.int64)]
    index = FMIndex.of(stretches, 4)
    phrases = r.integers(1, 4, (200, 5))
    live, lo, hi = index.search(phrases)
    found = {}
    for q, a, b in zip(live, lo, hi):
        found[int(q)] = sorted(index.locate(np.arange(a, b)).tolist())
    for q, phrase in enumerate(phrases):
        where = [int(index.starts[k]) + i for k, s in enumerate(stretches) for i in range(len(s) - 4) if (s[i : i + 5] == phrase).all()]
        assert found.get(q, []) == sorted(where)


def test_suffix_array():
    s = np.array([3, 1, 3, 1, 3, 1, 0])
    assert suffix_array(s).tolist() == sorted(range(7), key=lambda i: s[i:].tolist())


def test_two_test_sets_against_one_index(spark):
    docs, items = data()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    source = fresh_dir(spark, "texts")
    df.write.parquet(source)
    path = build_index(spark.read.parquet(source), shard_words=200)
    spark._jvm.org.apache.hadoop.fs.Path(source).getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(source), True)
    for some in (items[:15], items[15:]):
        for n in (12, 8):
            found = search_index(spark, path, spark.createDataFrame(some, "item_id bigint, passage string"), n, block_chars=800)
            assert {(r.doc_id, r.item_id) for r in found.collect()} == brute(docs, some, n)


def test_shards_as_bytes():
    words = {"b": 1, "a": 2}
    shard = Shard.of([5, 6], [np.array([[0, 1], [2, 1]]), np.array([[3, 1]])], [np.array([1, 2]), np.array([2])], words)
    again = Shard.from_bytes(shard.to_bytes())
    assert again.vocabulary == ["a", "b"] and again.owners.tolist() == [5, 6] and (again.index.bwt == shard.index.bwt).all() and (again.index.samples == shard.index.samples).all()


def test_row_groups_of_an_index_are_bounded_by_bytes(spark, tmp_path):
    """80 shards of 1 MB from one task: fewer than the 100 rows after which the writer looks at its buffers by default."""
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    r = np.random.default_rng(3)
    texts = [" ".join(x.tobytes().decode() for x in letters[r.integers(0, 36, (128, 8000))]) for _ in range(80)]
    pq.write_table(pa.table({"doc_id": range(80), "text": texts}), tmp_path / "texts.parquet")
    path = build_index(spark.read.parquet(str(tmp_path / "texts.parquet")), shard_words=128)
    groups = []
    for f in Path(path.removeprefix("file://")).glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        groups += [(meta.row_group(i).num_rows, meta.row_group(i).total_byte_size) for i in range(meta.num_row_groups)]
    assert sum(n for n, _ in groups) == 80 and max(b for _, b in groups) < 64 << 20, groups
    items = spark.createDataFrame([(1003, texts[3]), (1079, texts[79])], "item_id bigint, passage string")
    assert {(x.doc_id, x.item_id) for x in search_index(spark, path, items).collect()} == {(3, 1003), (79, 1079)}
