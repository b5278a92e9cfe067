import random

import pytest

from skald.llm.spans import cut_window, shared_spans


def brute(docs, n):
    first, both = {}, set()
    for d, t in docs:
        for w in {t[i : i + n] for i in range(len(t) - n + 1)} if t else ():
            if first.setdefault(w, d) != d:
                both.add(w)
    out = {}
    for d, t in docs:
        marked = set()
        for i in range(len(t or "") - n + 1):
            if t[i : i + n] in both:
                marked.update(range(i, i + n))
        if marked:
            out[d] = len(marked)
    return out


def words(r, n, alphabet="abcdefgh éß😀"):
    return "".join(r.choice(alphabet) for _ in range(n))


def corpus(seed, n):
    r = random.Random(seed)
    shared = [words(r, n + r.randrange(-3, 120)) for _ in range(6)] + ["a" * (n + 30), "ab" * n, words(r, n)]
    docs = []
    for d in range(60):
        parts = [words(r, r.randrange(0, 80), "abcd") for _ in range(3)]
        for s in r.sample(shared, r.randrange(3)):
            a = r.randrange(0, 4)
            parts.insert(r.randrange(len(parts)), s[a : len(s) - r.randrange(0, 4)])
        docs.append((d, "".join(parts)))
    docs += [(100, None), (101, ""), (102, docs[3][1]), (103, docs[3][1]), (104, "x" * 4 * n), (105, words(r, 30_000)), (106, shared[0] + shared[1]), (107, shared[1] + shared[0])]
    return docs


@pytest.mark.parametrize("n", [120, 300])
def test_against_all_windows(spark, n):
    docs = corpus(n, n)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id bigint, text string, d int, shared_chars int")
    expected = brute(docs, n)
    assert len(expected) > 10
    assert dict(map(tuple, shared_spans(df, n).collect())) == expected
    # the way beyond the broadcast limit
    assert dict(map(tuple, shared_spans(df, n, max_broadcast=0).collect())) == expected


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "q" * 500), (1, "q" * 500)], "doc_id bigint, text string")
    assert shared_spans(df).count() == 0 and shared_spans(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        cut_window(35)
