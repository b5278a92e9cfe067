import random

import pytest
from pyspark.sql import functions as F

from skald.llm.packing import TOKENIZER, fill, pack, token_counts, tokenizer

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(TOKENIZER), reason="no vocabulary files")


def test_plan_takes_everything_and_wastes_little():
    r = random.Random(1)
    for capacity in (7, 64, 2048):
        for _ in range(5):
            counts = {r.randrange(1, capacity + 1): r.randrange(1, 50) for _ in range(60)}
            plan = fill(counts, capacity)
            used = {}
            for times, taken in plan:
                assert times > 0 and sum(s * k for s, k in taken.items()) <= capacity
                for s, k in taken.items():
                    used[s] = used.get(s, 0) + k * times
            assert used == counts
            total, frames = sum(s * n for s, n in counts.items()), sum(t for t, _ in plan)
            assert frames <= 1.35 * total / capacity + 2
    assert fill({}, 10) == [] and fill({10: 3}, 10) == [(3, {10: 1})]


def test_closest_subset_is_found():
    assert fill({6: 1, 5: 1, 4: 1, 3: 2}, 12)[0] in [(1, {6: 1, 3: 2})]


def test_pack(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["alpha", "beta", "größe", "1234", "😀"]) for _ in range(r.randrange(0, 90))) for _ in range(400)]
    texts += ["same text here"] * 300 + [None, "", "word " * 3000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, frame int, tokens int")
    sizes = {r.doc_id: r.tokens for r in token_counts(df).collect()}
    assert sizes == {i: n for i, n in enumerate(tokenizer(TOKENIZER)([t or "" for t in texts]))}
    capacity = 128
    rows = pack(df, capacity).collect()
    parts, frames = {}, {}
    for x in rows:
        parts.setdefault(x.doc_id, []).append((x.part, x.tokens))
        if x.frame is None:
            assert x.tokens == 0
        else:
            frames[x.frame] = frames.get(x.frame, 0) + x.tokens
    assert {d: sum(n for _, n in p) for d, p in parts.items()} == sizes
    for d, p in parts.items():
        assert len(p) == max(1, -(-sizes[d] // capacity)) and sorted(i for i, _ in p) == list(range(len(p)))
    assert max(frames.values()) <= capacity and sorted(frames) == list(range(len(frames)))
    assert len(frames) <= -(-sum(sizes.values()) // capacity) * 1.02 + 1
    assert pack(df.limit(0)).count() == 0
    twice = df.filter("doc_id < 5").unionByName(df.filter("doc_id < 5"))
    assert pack(twice).agg(F.sum("tokens")).first()[0] == 2 * sum(sizes[i] for i in range(5))
