"""Problem 8: evaluation texts leaking into training text.

`build_index` turns the training text, once, into FM-indexes over words, one per shard of about SHARD_WORDS words: vocabulary of the shard, suffix array by
prefix doubling, Burrows-Wheeler transform, suffix positions sampled at every SAMPLE-th word, and where each word stands in its text. They are rows
of a table in the shared folder that `search_index` reads for any test set, without the training text. Every run of min_words words of a passage is
a phrase; all phrases of a block are searched backwards at once over the ranks of a wavelet matrix, hits are located by walking to the next
sampled position, and overlapping hits are merged to removal spans.

Words are maximal runs of letters and digits, compared in lower case. Defined results: null or blank texts and passages, and
passages shorter than min_words, give nothing; repeated documents or items each count; a text longer than a shard is indexed in
pieces that overlap by OVERLAP - 1 words, OVERLAP being the longest phrase an index answers; extra columns are ignored. Scale: one pass over the text, without a
shuffle; a task writes row groups of about 32 MB and reads shards back some MB at a time, so its memory doesn't follow the number of shards; passages become blocks of at most about BLOCK_CHARS on the executors, and the driver holds one block, as arrays of word numbers, at a
time to broadcast it; a block costs one pass over the index.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import fresh_dir, spread

MIN_WORDS = 12
OVERLAP = 64
SHARD_WORDS = 400_000
SAMPLE = 8
BLOCK_CHARS = 16_000_000
WORD = re.compile(r"[^\W_]+")
SPANS = "doc_id bigint, item_id bigint, spans array<struct<begin: int, end: int>>"
SHARD = "words bigint, shard binary"
# A shard has some MB: the writer looks at its buffers after each row, instead of after the first 100, so that a task holds one row group whatever its number of shards.
WRITING = {"compression": "zstd", "parquet.block.size": 32 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


class Passages:
    """Passages as runs of word numbers (from 1) over their own vocabulary."""

    def __init__(self, items: list, passages: list):
        import numpy as np

        numbers: dict[str, int] = {}
        runs = [[numbers.setdefault(w, len(numbers) + 1) for w in map(str.lower, WORD.findall(p or ""))] for p in passages]
        self.items, self.words = np.array(items, np.int64), list(numbers)
        self.ends = np.cumsum([len(r) for r in runs]).astype(np.int64)
        self.ids = np.fromiter((x for r in runs for x in r), np.int32, int(self.ends[-1]) if len(runs) else 0)

    def phrases(self, known: dict[str, int], min_words: int):
        """(numbers in another vocabulary, item) of all runs of min_words words that this vocabulary has; equal runs once per item."""
        import numpy as np

        there = np.array([0] + [known.get(w, 0) for w in self.words], np.int64)
        n = len(self.ids) - min_words + 1
        if n < 1:
            return np.zeros((0, min_words), np.int64), self.items[:0]
        ids = there[self.ids]
        owner = np.searchsorted(self.ends, np.arange(len(self.ids)), side="right")
        missing = np.concatenate([[0], np.cumsum(ids == 0)])
        start = np.flatnonzero((owner[:n] == owner[min_words - 1 :]) & (missing[min_words:] == missing[:n]))
        return ids[start[:, None] + np.arange(min_words)], self.items[owner[start]]


def suffix_array(s):
    """Order of all suffixes of s, whose stretches end in marks that are all different, so that no comparison runs past one."""
    import numpy as np

    n = len(s)
    sa = np.argsort(s, kind="stable")
    slots = np.arange(n)
    first = np.empty(n, bool)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    key = s[sa]
    k = 1
    while True:
        first = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.maximum.accumulate(np.where(first, slots, 0))
        rank[sa[slots]] = group
        alone = first & np.concatenate([first[1:], [True]])
        slots = slots[~alone]
        if not len(slots):
            return sa
        u = sa[slots]
        key = rank[u] * (n + 2) + rank[np.minimum(u + k, n)] + 1
        order = np.argsort(key, kind="stable")
        sa[slots] = u[order]
        key = key[order]
        k *= 2


class WaveletMatrix:
    def __init__(self, values, size: int):
        import numpy as np

        self.levels = []
        for bit in reversed(range(max(1, (size - 1).bit_length()))):
            b = (values >> bit) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            self.levels.append((bit, ones, len(values) - int(ones[-1])))
            values = np.concatenate([values[b == 0], values[b == 1]])

    def rank(self, c, i):
        """How many of the first i values are c."""
        import numpy as np

        low = np.zeros_like(i)
        for bit, ones, zeros in self.levels:
            up = ((c >> bit) & 1).astype(bool)
            a, b = ones[i], ones[low]
            i = np.where(up, zeros + a, i - a)
            low = np.where(up, zeros + b, low - b)
        return i - low


class FMIndex:
    """Over stretches of word numbers 1..size-1, each ended by a mark of its own that sorts before all words."""

    def __init__(self, bwt, sampled, samples, starts, size: int):
        import numpy as np

        self.bwt, self.sampled, self.samples, self.starts, self.size = bwt, sampled, samples, starts, size
        self.before = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=size + 1))])
        self.sample_rank = np.cumsum(sampled) - 1

    @classmethod
    def of(cls, stretches: list, size: int) -> FMIndex:
        import numpy as np

        marks = len(stretches)
        ends = np.cumsum([len(x) + 1 for x in stretches]) - 1
        s = np.empty(int(ends[-1]) + 1, np.int64)
        starts = np.concatenate([[0], ends[:-1] + 1])
        for x, a, e in zip(stretches, starts, ends):
            s[a:e] = x
        plain = s.copy()
        plain[ends] = 0
        s += marks
        s[ends] = np.arange(marks)
        sa = suffix_array(s)
        bwt = plain[sa - 1]
        sampled = (sa % SAMPLE == 0) | (bwt == 0)
        return cls(bwt, sampled, sa[sampled], starts, size)

    def search(self, phrases):
        """Rows (from, to) of the suffixes that begin with each phrase."""
        import numpy as np

        lo, hi = self.before[phrases[:, -1]], self.before[phrases[:, -1] + 1]
        live = np.flatnonzero(lo < hi)
        if len(live):
            self.tree = WaveletMatrix(self.bwt, self.size + 1)
        for j in range(phrases.shape[1] - 2, -1, -1):
            if not len(live):
                break
            c = phrases[live, j]
            lo[live], hi[live] = self.before[c] + self.tree.rank(c, lo[live]), self.before[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return live, lo[live], hi[live]

    def locate(self, rows):
        """Text positions of suffix rows."""
        import numpy as np

        at, steps = rows.copy(), np.zeros_like(rows)
        walking = np.flatnonzero(~self.sampled[at])
        while len(walking):
            c = self.bwt[at[walking]]
            at[walking] = self.before[c] + self.tree.rank(c, at[walking])
            steps[walking] += 1
            walking = walking[~self.sampled[at[walking]]]
        return self.samples[self.sample_rank[at]] + steps


class Shard:
    """The index of some texts, as bytes and back. Words are numbered from 1 in the order of their spelling."""

    def __init__(self, vocabulary: list[str], owners, begins, lengths, index: FMIndex):
        self.vocabulary, self.owners, self.begins, self.lengths, self.index = vocabulary, owners, begins, lengths, index

    @classmethod
    def of(cls, docs: list, places: list, ids: list, vocabulary: dict[str, int]) -> Shard:
        """docs, first code point and length of each word, and number of each word in `vocabulary`, stretch by stretch."""
        import numpy as np

        words = sorted(vocabulary)
        order = np.zeros(len(words) + 1, np.int64)
        order[[vocabulary[w] for w in words]] = np.arange(1, len(words) + 1)
        gap = np.zeros((1, 2), np.int64)  # the mark after each stretch
        where = np.concatenate([x for p in places for x in (p, gap)])
        return cls(words, np.array(docs, np.int64), where[:, 0], where[:, 1], FMIndex.of([order[x] for x in ids], len(words) + 1))

    def to_bytes(self) -> bytes:
        import pickle

        import numpy as np

        i = self.index
        small = np.uint16 if i.size < 1 << 16 else np.int32
        wide = np.int32 if int(self.lengths.max(initial=0)) >= 1 << 16 else np.uint16
        return pickle.dumps(
            {
                "vocabulary": "\n".join(self.vocabulary), "owners": self.owners, "begins": self.begins.astype(np.int32), "lengths": self.lengths.astype(wide),
                "bwt": i.bwt.astype(small), "sampled": np.packbits(i.sampled), "samples": i.samples.astype(np.int32), "starts": i.starts.astype(np.int32),
            }
        )

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        import pickle

        import numpy as np

        d = pickle.loads(data)
        words = d["vocabulary"].split("\n")
        sampled = np.unpackbits(d["sampled"], count=len(d["bwt"])).astype(bool)
        index = FMIndex(d["bwt"].astype(np.int64), sampled, d["samples"].astype(np.int64), d["starts"].astype(np.int64), len(words) + 1)
        return cls(words, d["owners"], d["begins"], d["lengths"], index)

    def hits(self, passages: Passages, min_words: int) -> list[tuple[int, int, list]]:
        import numpy as np

        rows, items = passages.phrases({w: n for n, w in enumerate(self.vocabulary, 1)}, min_words)
        if not len(rows):
            return []
        live, lo, hi = self.index.search(rows)
        n = hi - lo
        at = self.index.locate(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        owner = self.owners[np.searchsorted(self.index.starts, at, side="right") - 1]
        last = at + min_words - 1
        found: dict[tuple[int, int], list] = defaultdict(list)
        ends = self.begins[last].astype(np.int64) + self.lengths[last]
        for doc, item, a, b, x, y in zip(owner.tolist(), items[np.repeat(live, n)].tolist(), self.begins[at].tolist(), ends.tolist(), at.tolist(), last.tolist()):
            found[doc, item].append((a, b, x, y))
        return [(doc, item, merge_spans(spans)) for (doc, item), spans in found.items()]


def merge_spans(spans: list[tuple]) -> list[dict]:
    """Spans (begin, end, first word, last word), merged where they share a word or stand beside each other."""
    out: list[list] = []
    for a, b, x, y in sorted(spans):
        if out and x <= out[-1][2] + 1:
            if y > out[-1][2]:
                out[-1][1:] = [b, y]
        else:
            out.append([a, b, y])
    return [{"begin": a, "end": b} for a, b, _ in out]


def build_index(documents: DataFrame, path: str | None = None, shard_words: int = SHARD_WORDS) -> str:
    """Writes the index of documents (doc_id, text) and gives its path, a new one in the shared folder by default."""
    path = path or fresh_dir(documents.sparkSession, "fm-index")
    texts = spread(documents.select("doc_id", "text").filter("doc_id is not null and text is not null"))
    texts.mapInPandas(lambda batches: _shards(batches, shard_words), SHARD).write.mode("overwrite").options(**WRITING).parquet(path)
    return path


def _shards(batches: Iterator, shard_words: int) -> Iterator:
    import numpy as np
    import pandas as pd

    shard_words = max(shard_words, 2 * OVERLAP)
    step = shard_words - OVERLAP + 1
    docs, places, ids, held = [], [], [], 0
    vocabulary: dict[str, int] = {}
    numbers: dict[str, int] = {}

    def close():
        nonlocal docs, places, ids, held
        out = pd.DataFrame([(held, Shard.of(docs, places, ids, vocabulary).to_bytes())], columns=["words", "shard"])
        docs, places, ids, held = [], [], [], 0
        vocabulary.clear()
        numbers.clear()
        return out

    def number(w: str) -> int:
        n = numbers.get(w)
        if n is None:
            n = numbers[w] = vocabulary.setdefault(w.lower(), len(vocabulary) + 1)
        return n

    for batch in batches:
        for doc, text in zip(batch["doc_id"], batch["text"]):
            words = WORD.findall(text)
            if not words:
                continue
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            begins = np.fromiter((m.start() for m in WORD.finditer(text)), np.int64, len(words))
            for i in range(0, max(1, len(words) - OVERLAP + 1), step):
                piece = words[i : i + shard_words]
                docs.append(doc)
                places.append(np.stack([begins[i : i + len(piece)], lengths[i : i + len(piece)]], 1))
                ids.append(np.fromiter(map(number, piece), np.int64, len(piece)))
                held += len(piece)
                if held >= shard_words:
                    yield close()
    if docs:
        yield close()


def passage_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, passages): items (item_id, passage) as blocks of at most about block_chars, made on the executors."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "passage").filter("item_id is not null and passage is not null")
    chars = items.agg(F.sum(F.char_length("passage"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))

    def block(key, rows):
        import pickle

        import pandas as pd

        return pd.DataFrame({"block": [key[0]], "passages": [pickle.dumps(Passages(rows["item_id"].tolist(), rows["passage"].tolist()))]})

    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks))).groupBy("block").applyInPandas(block, "block bigint, passages binary")


def search_index(spark: SparkSession, path: str, items: DataFrame, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, spans): the merged spans of the text, in code points, that hold runs of at least min_words words of the item, from a
    stored index. A text cut into pieces may give a row per piece."""
    import pickle

    if min_words > OVERLAP:
        raise ValueError(f"the index answers phrases of at most {OVERLAP} words")
    # as pickled rows, which go to Python some MB at a time: an Arrow batch of shards takes 64 MB and more outside the heap of each task
    shards = spark.read.schema(SHARD).parquet(path).select("shard").rdd
    found = spark.createDataFrame([], SPANS)
    for r in passage_blocks(items, block_chars).toLocalIterator():  # one block at a time
        shared = spark.sparkContext.broadcast(pickle.loads(r["passages"]))
        found = found.unionByName(spark.createDataFrame(shards.mapPartitions(lambda rows, shared=shared: _search(rows, shared.value, min_words)), SPANS))
    return found


def _search(rows: Iterator, passages: Passages, min_words: int) -> Iterator:
    for row in rows:
        yield from Shard.from_bytes(row.shard).hits(passages, min_words)


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """build_index and search_index in one."""
    return search_index(documents.sparkSession, build_index(documents, None, shard_words), items, min_words, block_chars)
