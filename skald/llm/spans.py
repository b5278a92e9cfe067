"""Problem 9: long exact spans shared between records.

Content-defined chunking with a gear rolling hash: every code point shifts the 32-bit hash by one, so a hash depends on the last 32
code points only, and a cut falls wherever a hash is the smallest of some CUT_WINDOW neighbours in a row. Insertions move cuts only near them.
With min_chars = 300 the two copies of a shared span agree on all cuts but those within 31 + CUT_WINDOW - 1 of its
start and CUT_WINDOW - 1 of its end, and no two cuts are further apart than CUT_WINDOW, so each shared span holds at least one
whole chunk that both copies cut alike: no span can be lost.

1. Chunks are deduplicated by a 64-bit digest: digests that two different texts have are candidates.
2. A window of min_chars code points is a candidate if all chunks well inside it (out of reach of its edges) are shared. Windows are told apart by their
   anchor, the first cut that no text before the window can move, and by how far before it they begin. All windows of one anchor lie within a context of
   LEFT + RIGHT code points and share a core around the anchor. Contexts (128-bit hash of the text) are counted per core: what two texts have as a whole context
   is shared in all its windows; only where one core has several contexts, at the ends of shared stretches, single windows are compared, each
   by 64 bits over its own text beside 64 bits of another hash over the core.
3. Per text the union of shared windows is counted.

Exact copies of a text are one text with several records until the end, where all of a copied text counts as shared.

Defined results: null texts and texts shorter than min_chars share nothing; repeats within one record don't count; rows of one doc_id
are one record; extra columns are ignored. Scale: a candidate stretch costs a row per chunk, not per character. Digests and contexts are
pre-aggregated per piece of PIECE code points before their shuffle, so boilerplate costs two rows per piece, and a core with many contexts is aggregated, never
collected; shared digests reach the tasks as a broadcast only while their number is within MAX_BROADCAST, else through a join.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import cut, spread

MIN_CHARS = 300
GEAR = 32
MAX_BROADCAST = 4_000_000
PIECE = 2_000_000
CONTEXT, PLACE = 0, 1


def cut_window(min_chars: int) -> int:
    """The widest window for which a span of min_chars holds two agreed cuts in a row."""
    w = (min_chars - GEAR + 1 + 2) // 4
    if w < 2:
        raise ValueError("min_chars is too small for the gear hash")
    return w


def _mix(x):
    """A table from a rule: splitmix64's finaliser."""
    import numpy as np

    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLES: dict = {}


def _tables(n: int):
    """Gear values of code points, and powers of the digest's base and of its inverse, up to n."""
    import numpy as np

    if _TABLES.get("n", 0) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, 1 << 16) + 1
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _TABLES.update(n=size - 1, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    if "gear" not in _TABLES:
        _TABLES["gear"] = _mix(np.arange(0x110000, dtype=np.uint64))
    return _TABLES["gear"], _TABLES["up"], _TABLES["down"]


def extremes(keys, owners):
    """Distinct keys, smallest and largest owner of each, and the place of each row's key among them."""
    import numpy as np

    values, place = np.unique(keys, return_inverse=True)
    low, high = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), np.iinfo(np.int64).min)
    np.minimum.at(low, place, owners)
    np.maximum.at(high, place, owners)
    return values, low, high, place


class Pieces:
    """Several texts end to end: cuts, chunks and window hashes."""

    def __init__(self, texts: list[str], window: int):
        import numpy as np

        from ..common import code_points

        arrays = [code_points(t) for t in texts]
        self.lengths = np.array([len(a) for a in arrays], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        codes = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
        self.codes = codes
        gear, self.up, self.down = _tables(len(codes) + 1)
        value = gear[codes]
        h = (value >> np.uint64(32)).astype(np.uint32)
        for k in (1, 2, 4, 8, 16):
            older = h[:-k] << np.uint32(k)
            h[k:] += older
        self.prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(value * self.up[: len(codes)], out=self.prefix[1:])
        n = len(codes)
        key = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
        size = 1
        while size < window:
            step = min(size, window - size)
            if len(key) <= step:
                key = key[:0]
                break
            key = np.minimum(key[:-step], key[step:])
            size += step
        at = (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)
        self.cuts = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        owner = np.searchsorted(self.starts, self.cuts, side="right") - 1
        same = owner[1:] == owner[:-1]
        self.begin, self.end, self.owner = self.cuts[:-1][same], self.cuts[1:][same], owner[:-1][same]

    def digests(self, begin, end):
        """Hash of what stands between begin and end, wherever that is; lengths are mixed in."""
        import numpy as np

        return _mix((self.prefix[end] - self.prefix[begin]) * self.down[begin] ^ (end - begin).astype(np.uint64))


def _grouped(batches: Iterator) -> Iterator:
    """(ids, texts) of about PIECE code points at a time; one longer text stays whole."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b["u"], b["text"]):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= PIECE:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def candidate_windows(p: Pieces, shared, min_chars: int, window: int):
    """Starts of windows all of whose inner chunks are shared, at least one of them; shared: a flag per chunk."""
    import numpy as np

    n = int(p.starts[-1])
    before, after = GEAR - 1 + window - 1, window - 1
    # of chunks in order: how many begin before a position, how many end by it
    good = np.concatenate([[0], np.cumsum(shared)])
    room = np.zeros(n + 1, bool)
    for k in np.flatnonzero(p.lengths >= min_chars):
        lo, hi = int(p.starts[k]), int(p.starts[k] + p.lengths[k] - min_chars)
        a, b = np.searchsorted(p.owner, [k, k + 1])
        if good[b] == good[a]:
            continue
        i = np.arange(lo, hi + 1)
        first = a + np.searchsorted(p.begin[a:b], i + before)
        last = a + np.searchsorted(p.end[a:b], i + min_chars - after - 1, side="right")
        count = last - first
        room[lo : hi + 1] = (count > 0) & (good[last.clip(min=0)] - good[first] == count)
    return np.flatnonzero(room)


_FOUND = "kind tinyint, core bigint, f1 bigint, f2 bigint, a bigint, b bigint, anchor bigint, near int, far int, digests array<bigint>"


def anchored(p: Pieces, ids, at, min_chars: int, window: int):
    """Candidate windows that begin at `at` as rows: each distinct context once, with the smallest and the largest record that has it, the distances from its
    windows' beginnings to the anchor, from `far` down to `near`, and their digests; and each place of a context."""
    import numpy as np
    import pandas as pd
    import xxhash

    before = GEAR - 1 + window - 1
    left, right = before + window - 1, min_chars - before
    anchor = p.cuts[np.searchsorted(p.cuts, at + before)]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    c, far = anchor[first], anchor[first] - at[first]
    last = np.concatenate([first[1:], [len(at)]])
    near = c - at[last - 1]
    k = np.searchsorted(p.starts, c, side="right") - 1
    lo, hi = np.maximum(p.starts[k], c - left), np.minimum(p.starts[k + 1], c + right)
    data = p.codes.view(np.uint8).data
    spots = list(zip(c.tolist(), lo.tolist(), hi.tolist()))
    # how much of a context a text's ends leave is part of its hash
    full = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[4 * a : 4 * b], seed=(x - a << 32) + b - x) for x, a, b in spots), dtype=np.int64).reshape(-1, 2)
    core = np.array([xxhash.xxh3_64_intdigest(data[4 * (x - before) : 4 * (x + min_chars - left)]) for x, _, _ in spots], dtype=np.uint64).view(np.int64)
    w = p.digests(at, at + min_chars).view(np.int64)
    u = ids[k]
    _, one, place = np.unique(full, axis=0, return_index=True, return_inverse=True)
    low, high = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
    np.minimum.at(low, place.ravel(), u)
    np.maximum.at(high, place.ravel(), u)
    contexts = pd.DataFrame({"kind": CONTEXT, "core": core[one], "f1": full[one, 0], "f2": full[one, 1], "a": low, "b": high, "anchor": 0, "near": near[one], "far": far[one], "digests": [w[first[i] : last[i]] for i in one]})
    places = pd.DataFrame({"kind": PLACE, "core": 0, "f1": full[:, 0], "f2": full[:, 1], "a": u, "b": u, "anchor": c - p.starts[k], "near": 0, "far": 0, "digests": None})
    return pd.concat([contexts, places], ignore_index=True)


def shared_spans(documents: DataFrame, min_chars: int = MIN_CHARS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, shared_chars) of each record that has any."""
    spark = documents.sparkSession
    window = cut_window(min_chars)
    records = documents.select("doc_id", "text").filter(F.char_length("text") >= min_chars)
    key = F.struct(F.xxhash64("text"), F.hash("text"), F.char_length("text"))
    # exact copies: a text is represented by its smallest doc_id
    keyed = records.select("doc_id", F.xxhash64(key).alias("h"), F.char_length("text").alias("n"))
    sizes = cut(keyed.distinct())
    copies = sizes.groupBy("h").agg(F.min("doc_id").alias("u"), F.count("*").alias("k")).filter("k > 1")
    later = sizes.join(copies, "h").select("doc_id", "n", "u")
    extra = cut(later.filter("doc_id <> u").select(F.col("doc_id").alias("u")))
    texts = spread(records).select(F.col("doc_id").alias("u"), "text")
    copied = extra.count()
    if copied:
        # its size is checked: at most MAX_BROADCAST numbers go to the tasks, so that no text is moved
        texts = texts.join(F.broadcast(extra) if copied <= min(MAX_BROADCAST, max_broadcast) else extra, "u", "left_anti")

    def chunks(batches: Iterator, every: bool = False) -> Iterator:
        import numpy as np
        import pandas as pd

        for ids, group in _grouped(batches):
            p = Pieces(group, window)
            d = p.digests(p.begin, p.end).view(np.int64)
            if every:
                yield pd.DataFrame({"d": d, "u": np.asarray(ids, np.int64)[p.owner]})
                continue
            # a text lies in one piece, so a digest of two pieces is one of two texts; those that two texts of a piece have are told twice
            values, low, high, _ = extremes(d, p.owner)
            yield pd.DataFrame({"d": np.concatenate([values, values[low != high]])})

    shared = cut(texts.mapInPandas(chunks, "d bigint").groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").select("d"))
    if shared.count() <= max_broadcast:
        # its size is checked just above: at most 8 bytes * max_broadcast
        import numpy as np

        known = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in shared.toLocalIterator()], dtype=np.int64)))
        flagged = texts

        def flags(p: Pieces, _marks):
            d = p.digests(p.begin, p.end).view(np.int64)
            at = np.searchsorted(known.value, d)
            at[at == len(known.value)] = 0
            return known.value[at] == d if len(known.value) else np.zeros(len(d), bool)
    else:
        every = texts.mapInPandas(lambda b: chunks(b, True), "d bigint, u bigint")
        marks = every.join(shared, "d", "left_semi").groupBy("u").agg(F.collect_set("d").alias("marks"))  # as many as the text has chunks
        flagged = texts.join(marks, "u")

        def flags(p: Pieces, marks):
            import numpy as np

            d = p.digests(p.begin, p.end).view(np.int64)
            out = np.zeros(len(d), bool)
            for k, m in enumerate(marks):
                a, b = np.searchsorted(p.owner, [k, k + 1])
                out[a:b] = np.isin(d[a:b], m)
            return out

    def windows(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        held: list = []

        def keep(it):
            for b in it:
                held.extend(b["marks"] if "marks" in b.columns else [])
                yield b

        for ids, group in _grouped(keep(batches)):
            p = Pieces(group, window)
            marks, held[:] = held[: len(ids)], held[len(ids) :]
            at = candidate_windows(p, flags(p, marks), min_chars, window)
            if len(at):
                yield anchored(p, np.asarray(ids, np.int64), at, min_chars, window)

    found = cut(flagged.mapInPandas(windows, _FOUND))
    contexts = found.filter(F.col("kind") == CONTEXT).groupBy("core", "f1", "f2").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("near").alias("near"), F.max("far").alias("far"), F.min("digests").alias("d"))
    contexts = cut(contexts)
    whole = contexts.filter("a <> b").select("f1", "f2", "near", "far")
    several = contexts.groupBy("core").agg(F.count("*").alias("n"), F.max((F.col("a") == F.col("b")).cast("int")).alias("open")).filter("n > 1 and open = 1").select("core")
    single = cut(contexts.join(several, "core").select("core", "f1", "f2", "a", "b", F.posexplode("d").alias("i", "w"), "far").withColumn("j", F.col("far") - F.col("i")).drop("i", "far"))
    met = single.groupBy("core", "j", "w").agg(F.min("a").alias("x"), F.max("b").alias("y")).filter("x <> y").select("core", "j", "w")
    ends = single.filter("a = b").join(met, ["core", "j", "w"], "left_semi").groupBy("f1", "f2").agg(F.min("j").alias("near"), F.max("j").alias("far"))
    # windows of one anchor overlap, so the nearest and the farthest shared one bound what they cover
    places = found.filter(F.col("kind") == PLACE).select("f1", "f2", F.col("a").alias("u"), "anchor")
    marked = places.join(whole.unionByName(ends), ["f1", "f2"]).select("u", (F.col("anchor") - F.col("far")).alias("begin"), (F.col("anchor") - F.col("near") + min_chars).alias("end"))
    before = F.max("end").over(W.partitionBy("u").orderBy("begin", "end").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce(before, F.lit(0))))
    counted = marked.select("u", fresh.alias("c")).groupBy("u").agg(F.sum("c").alias("c")).filter("c > 0")
    partly = counted.join(later.select("u").distinct(), "u", "left_anti").select(F.col("u").alias("doc_id"), F.col("c").cast("long").alias("shared_chars"))
    return partly.unionByName(later.select("doc_id", F.col("n").cast("long").alias("shared_chars")))
