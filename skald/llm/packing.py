"""Problem 7: filling frames of fixed capacity with texts.

Texts are sized in tokens of a public tokenizer. Only the number of texts of each size goes to the driver, at most `capacity` counts whatever the number of texts. There, minimum bin
slack fills one frame after the other: a subset-sum dynamic program over bitsets finds which multiset of the remaining sizes,
with the largest size always in, comes closest to the capacity, backtracking gives how many of each size it takes, and the frame is repeated as often as the
remaining counts allow. Texts are then numbered within their size, and the numbers say which frame they go to.

Only texts larger than the capacity are divided: into full frames and a rest that is packed like a text.

Defined results: null texts and texts without tokens need no room and come out with frame null and no tokens; repeated rows each get room;
ties go to the larger size; an empty table gives no rows; extra columns are ignored. Scale: texts are numbered within (size, bucket), buckets by a hash, so that
a size that a third of all texts share spreads over BUCKETS tasks; the plan's size depends on the capacity only.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import cut, spread

CAPACITY = 2_048
BUCKETS = 64
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that the vocabulary's description gives for splitting text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def tokenizer(path: str):
    """One encoder per process; .tiktoken rank files, or JSON files of the tokenizers library."""
    if path not in _LOADED:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _LOADED[path] = lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
        else:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _LOADED[path] = lambda texts: [len(e.encode_ordinary(t)) for t in texts]
    return _LOADED[path]


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens)"""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            count = tokenizer(path)
            yield b[["doc_id"]].assign(tokens=count([t if isinstance(t, str) else "" for t in b["text"]]))

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id bigint, tokens bigint")


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Frames as (how often, size -> how many); together they take exactly the counts."""
    left = {s: n for s, n in counts.items() if n > 0}
    plan = []
    everything = (1 << (capacity + 1)) - 1
    while left:
        largest = max(left)
        room = capacity - largest
        # reach[j]: sums that sizes up to the j-th can make; binary multiples keep repeated sizes few
        items = []
        for s in sorted((s for s in left if s <= room), reverse=True):
            n, k = min(left[s] - (s == largest), room // s), 1
            while n > 0:
                k = min(k, n)
                items.append((s, k))
                n -= k
                k *= 2
        reach = [1]
        for s, k in items:
            nxt = (reach[-1] | (reach[-1] << (s * k))) & everything & ((1 << (room + 1)) - 1)
            reach.append(nxt)
            if nxt >> room & 1:
                break
        best = reach[-1].bit_length() - 1
        taken = {largest: 1}
        for j in range(len(reach) - 1, 0, -1):
            if not reach[j - 1] >> best & 1:
                s, k = items[j - 1]
                taken[s] = taken.get(s, 0) + k
                best -= s * k
        times = min(left[s] // k for s, k in taken.items())
        plan.append((times, taken))
        for s, k in taken.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return plan


def pack(documents: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, part, tokens, frame): part numbers the pieces of a divided text from 0."""
    import numpy as np

    sized = cut(token_counts(documents, path))
    pieces = F.when(F.col("tokens") > capacity, F.expr(f"transform(sequence(0L, (tokens - 1) div {capacity}), i -> struct(i as part, least({capacity}L, tokens - i * {capacity}) as size))"))
    pieces = F.coalesce(pieces, F.array(F.struct(F.lit(0).cast("long").alias("part"), F.col("tokens").alias("size"))))
    rows = sized.select("doc_id", "tokens", F.inline(pieces))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), F.lit(BUCKETS)))
    cells = cut(rows.filter("size > 0").groupBy("size", "bucket").agg(F.count("*").alias("n")))  # at most capacity * BUCKETS rows
    table = cells.groupBy("size").agg(F.sum("n").alias("n")).collect()  # at most capacity rows
    plan = fill({r["size"]: r["n"] for r in table}, capacity)
    # slots of each size, in order: from which number on they belong to which run of frames
    slots: dict[int, list] = {}
    frame, used = 0, {}
    for times, taken in plan:
        for s, k in taken.items():
            begin = used.get(s, 0)
            slots.setdefault(s, []).append((begin, frame, k))
            used[s] = begin + k * times
        frame += times
    ways = documents.sparkSession.sparkContext.broadcast({s: tuple(np.array(c, np.int64) for c in zip(*v)) for s, v in slots.items()})

    def frames(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            size, number = b["tokens"].to_numpy(), b["number"].to_numpy()
            out = np.zeros(len(b), np.int64)
            for s in np.unique(size):
                at = size == s
                begin, base, k = ways.value[int(s)]
                run = np.searchsorted(begin, number[at], side="right") - 1
                out[at] = base[run] + (number[at] - begin[run]) // k[run]
            yield pd.DataFrame({"doc_id": b["doc_id"], "part": b["part"], "tokens": size, "frame": out})

    place = F.row_number().over(W.partitionBy("size", "bucket").orderBy("doc_id", "part")) - 1
    earlier = F.sum("n").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = cells.select("size", "bucket", F.coalesce(earlier, F.lit(0)).alias("first"))
    # at most capacity * BUCKETS rows
    numbered = rows.filter("size > 0").join(F.broadcast(offsets), ["size", "bucket"]).select("doc_id", "part", F.col("size").alias("tokens"), (place + F.col("first")).alias("number"))
    packed = numbered.mapInPandas(frames, "doc_id bigint, part bigint, tokens bigint, frame bigint")
    empty = rows.filter("size = 0").select("doc_id", "part", F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("long").alias("frame"))
    return packed.unionByName(empty)


def frame_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    frames = packed.filter("frame is not null").groupBy("frame").agg(F.sum("tokens").alias("tokens"))
    return frames.agg(F.count("*").alias("frames"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), (F.count("*") * capacity - F.sum("tokens")).alias("unused"))
