"""Problem 4: the k most similar vectors of every vector, over learned partitions.

Fitting, on at most SAMPLE_ROWS vectors chosen by a hash of their number: the sample's neighbour graph is cut into
balanced parts (median splits along random directions, then label propagation that moves vectors to the part of most of their neighbours while
parts have room), and a classifier with one hidden layer learns which parts hold a vector's neighbours. How many of its most
probable parts a query visits is calibrated on the sample: the fewest for which TARGET_RECALL of the true neighbours lie in visited parts.
With a similarity floor, pairs that are just so similar are made up from the sample, and it is enough that one of the two visits the other, as
what one finds the other then knows as well; so each cell gives the k best of every row that asks and the k best askers of every row asked.

The number of parts grows with the rows, so that a part keeps about PART_ROWS of them. Beyond MAX_PARTS one classifier chooses among groups of parts, and each group
has a classifier of its own, fitted where its rows are, on at most SAMPLE_ROWS of them; their sizes are bounded by MAX_PARTS and SUB_PARTS.

Searching: every row is indexed in its most probable part, and sent as a query to its further probable parts. Parts are cut into
cells of bounded numbers of rows and of queries. Within its task a cell is parted again the same way, into leaves of about LEAF_ROWS, so that a query is
compared with a few leaves by matrix products, or with the whole cell where its calibration asks for more than half of the leaves; a query's results
from its cells are ranked together. Vectors in a query's own part are compared in single precision; what travels as a query to other parts is
rounded to half precision (similarities are then off by about 2e-5).

Exact copies of a vector are represented by the one with the smallest number and expanded afterwards, each copy meeting at most the k + 1
first others, so that a vector that a third of all rows share costs k links a row.

Defined results: null vectors, other lengths, null or not finite values and all-zero vectors take no part; ties of similarity go to the
smaller number; exact repeats of a row count once; fewer than k others give fewer rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import cut

SAMPLE_ROWS = 16_384
PART_ROWS = 16_384
MAX_PARTS = 512
SUB_PARTS = 256
LEAF_ROWS = 512
CELL_ROWS = 32_768
CELL_QUERIES = 65_536
TARGET_RECALL = 0.97
LEAF_RECALL = 0.97
MAX_BROADCAST = 2_000_000
HIDDEN = 128


class Router:
    """Which parts probably hold a vector's neighbours."""

    def __init__(self, sample, parts: int, k: int, floor: float | None, target: float, hidden: int = HIDDEN, epochs: int = 24, mutual: bool = True, seed: int = 7):
        import numpy as np

        self.parts, self.probes = parts, 1
        if parts == 1:
            return
        rng = np.random.default_rng(seed)
        graph = neighbour_graph(sample, k)
        labels = balanced_parts(sample, graph, parts, rng)
        self._fit(sample, graph, labels, rng, hidden, epochs)
        self.probes = _calibrate(self, sample, k, floor, target, mutual, rng)

    def _fit(self, x, graph, labels, rng, hidden: int, epochs: int, batch: int = 256) -> None:
        import numpy as np

        n, d = x.shape
        near = np.concatenate([labels[:, None], labels[graph]], axis=1)
        shapes = [(d, hidden), (hidden,), (hidden, self.parts), (self.parts,)]
        w = [(rng.standard_normal(s) * (math.sqrt(2 / s[0]) if len(s) > 1 else 0)).astype(np.float32) for s in shapes]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for epoch in range(epochs):
            rate = 0.004 * (1 - epoch / epochs) + 1e-4
            order = rng.permutation(n)
            for i in range(0, n, batch):
                rows = order[i : i + batch]
                a = x[rows]
                h = np.maximum(a @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                np.subtract.at(z, (np.arange(len(rows))[:, None], near[rows]), np.float32(1 / near.shape[1]))
                z /= len(rows)
                dh = (z @ w[2].T) * (h > 0)
                step += 1
                for j, g in enumerate((a.T @ dh, dh.sum(0), h.T @ z, z.sum(0))):
                    m[j] += (g - m[j]) * 0.1
                    v[j] += (g * g - v[j]) * 0.001
                    w[j] -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    def scores(self, x):
        import numpy as np

        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def route(self, x, probes: int):
        """The most probable parts, best first."""
        import numpy as np

        if self.parts == 1:
            return np.zeros((len(x), 1), np.int32)
        z = self.scores(x)
        if probes < self.parts:
            top = np.argpartition(-z, probes - 1, axis=1)[:, :probes]
        else:
            top = np.tile(np.arange(self.parts), (len(x), 1))
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(z, top, 1), axis=1, kind="stable"), 1).astype(np.int32)

    def places(self, x, parts):
        """How many parts are more probable than the given one of each row."""
        import numpy as np

        z = self.scores(x)
        return (z > np.take_along_axis(z, parts[:, None].astype(np.int64), 1)).sum(1)


class Tree:
    """Routers of groups of parts below one that chooses among the groups; part numbers are group * width + part."""

    def __init__(self, root: Router, leaves: dict[int, Router], width: int):
        self.root, self.leaves, self.width = root, leaves, width
        self.parts, self.probes = root.parts * width, 1

    @staticmethod
    def _log(z):
        import numpy as np

        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def _within(self, group: int, x):
        """Log probabilities of the group's parts; groups without a router of their own have one part."""
        import numpy as np

        leaf = self.leaves.get(group)
        return np.zeros((len(x), 1), np.float32) if leaf is None or leaf.parts == 1 else self._log(leaf.scores(x))

    def route(self, x, probes: int):
        import numpy as np

        top = self._log(self.root.scores(x))
        groups = self.root.route(x, min(self.root.parts, probes + 2))
        score = np.full((len(x), groups.shape[1] * self.width), -np.inf, np.float32)
        part = np.zeros(score.shape, np.int64)
        for g in np.unique(groups):
            r, j = np.nonzero(groups == g)
            z = self._within(int(g), x[r])
            at = j[:, None] * self.width + np.arange(z.shape[1])
            score[r[:, None], at] = z + top[r, g][:, None]
            part[r[:, None], at] = g * self.width + np.arange(z.shape[1])
        best = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        part, score = np.take_along_axis(part, best, 1), np.take_along_axis(score, best, 1)
        return np.where(np.isfinite(score), part, part[:, :1]).astype(np.int32)

    def places(self, x, parts):
        import numpy as np

        top, own = self._log(self.root.scores(x)), np.zeros(len(x), np.float32)
        inside = [self._within(g, x) + top[:, g : g + 1] for g in range(self.root.parts)]
        for i, p in enumerate(parts.tolist()):
            own[i] = inside[p // self.width][i, p % self.width]
        return sum((z > own[:, None]).sum(1) for z in inside)


def _calibrate(model, sample, k: int, floor: float | None, target: float, mutual: bool, rng, most: int = 2000) -> int:
    """How many parts are to be visited so that the share `target` of neighbours is found."""
    import numpy as np

    asked = sample[rng.permutation(len(sample))[: most if floor is not None else most // 4]]
    if floor is not None:
        noise = rng.standard_normal(asked.shape).astype(np.float32)
        noise -= (noise * asked).sum(1, keepdims=True) * asked
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        twins = floor * asked + math.sqrt(1 - floor * floor) * noise
    else:
        near = nearest(asked, sample, k + 1)[:, 1:]
        twins, asked = sample[near.ravel()], np.repeat(asked, near.shape[1], axis=0)
    needed = model.places(asked, model.route(twins, 1)[:, 0]) + 1
    if floor is not None and mutual:  # such a pair is found if either of the two visits the other
        needed = np.minimum(needed, model.places(twins, model.route(asked, 1)[:, 0]) + 1)
    needed = np.sort(needed)
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)])


def nearest(queries, x, k: int):
    import numpy as np

    out = []
    for i in range(0, len(queries), 1024):
        s = queries[i : i + 1024] @ x.T
        k_ = min(k, s.shape[1])
        top = np.argpartition(-s, k_ - 1, axis=1)[:, :k_]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1))
    return np.concatenate(out)


def neighbour_graph(x, k: int):
    """k nearest others; a row's own place is among the k + 1 nearest, copies aside."""
    import numpy as np

    near = nearest(x, x, k + 1)
    own = near == np.arange(len(x))[:, None]
    own[~own.any(1), -1] = True
    return near[~own].reshape(len(x), -1)


def balanced_parts(x, graph, parts: int, rng, rounds: int = 6, slack: float = 1.05):
    import numpy as np

    labels = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1:
            labels[rows] = first
            continue
        left = count // 2
        along = x[rows] @ (x[rng.choice(rows)] - x[rng.choice(rows)])
        order = rows[np.argsort(along, kind="stable")]
        split = len(rows) * left // count
        todo += [(order[:split], first, left), (order[split:], first + left, count - left)]
    room = math.ceil(slack * len(x) / parts)
    sizes = np.bincount(labels, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int16)
        np.add.at(votes, (np.arange(len(x))[:, None], labels[graph]), 1)
        best = votes.argmax(1)
        gain = votes.max(1) - votes[np.arange(len(x)), labels]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room:
                sizes[labels[i]] -= 1
                sizes[best[i]] += 1
                labels[i] = best[i]
                moved += 1
        if not moved:
            break
    return labels


def _vectors(batch, dims: int):
    """(numbers, unit vectors) of an Arrow batch (n, v), without the unusable ones."""
    import numpy as np
    import pyarrow.compute as pc

    flat = batch.column("v").flatten()
    if flat.null_count:
        flat = pc.fill_null(flat, float("nan"))
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    good = np.isfinite(x).all(axis=1)
    return batch.column("n").to_numpy()[good], x[good].astype(np.float32)


def _binary(rows):
    import numpy as np
    import pyarrow as pa

    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _matrix(column, dtype, dims: int):
    import numpy as np
    import pyarrow as pa

    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = []
    for c in chunks:
        if len(c):
            offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            out.append(np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(-1, dims))
    return np.concatenate(out).astype(np.float32) if out else np.zeros((0, dims), np.float32)


def top_neighbours(vectors: DataFrame, k: int = 10, dims: int = 64, floor: float | None = None, queries=None, target: float = TARGET_RECALL, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS) -> DataFrame:
    """(q, s, similarity, rank) for rows (n, v): of each vector q its k most similar others s.

    floor: only similarities of at least that. queries: a condition on n for the vectors to ask for; all by default."""
    rows = vectors.select(F.col("n").cast("long").alias("n"), F.col("v").cast("array<float>").alias("v")).filter((F.size("v") == dims) & F.col("n").isNotNull())
    high, low = F.array_max("v"), F.array_min("v")
    usable = ~F.isnan(high) & (F.abs(high) < float("inf")) & (F.abs(low) < float("inf")) & ((high != 0) | (low != 0))
    rows = rows.filter(usable & (F.size(F.array_compact("v")) == dims))
    # exact copies
    keys = rows.select("n", F.xxhash64("v").alias("h"))
    copies = cut(keys.groupBy("h").agg(F.min("n").alias("r"), F.count("*").alias("c")).filter("c > 1"))
    total = rows.count()

    def look(rows: DataFrame, queries) -> DataFrame:
        found = _search(rows, total, k, dims, floor, queries, target, part_rows, max_parts)
        if floor is not None and queries is None:  # what one of a pair finds, the other knows as well
            found = found.unionByName(found.select(F.col("s").alias("q"), F.col("q").alias("s"), "similarity")).groupBy("q", "s").agg(F.max("similarity").alias("similarity"))
        return _rank(found, k)

    if copies.isEmpty():
        return look(rows, queries)
    members = cut(keys.join(copies, "h").select("n", "r").distinct())
    distinct = rows.join(members.filter("n <> r").select("n"), "n", "left_anti")
    # queries may be later copies only, so their first copy asks for them; answers of others are dropped at the end
    found = cut(look(distinct, None))
    w = W.partitionBy("r").orderBy("n")
    firsts = cut(members.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k + 1).select("r", "n"))
    known = members.select("r").distinct()
    near = found.join(firsts.withColumnRenamed("n", "m"), found["s"] == firsts["r"], "left").select("q", F.coalesce("m", "s").alias("s"), "similarity")
    own = firsts.select(F.col("r").alias("q"), F.col("n").alias("s"), F.lit(1.0).cast("float").alias("similarity"))
    ranked = W.partitionBy("q").orderBy(F.desc("similarity"), "s")
    lists = near.unionByName(own).withColumn("i", F.row_number().over(ranked)).filter(F.col("i") <= k + 1).drop("i")
    single = lists.join(known, lists["q"] == known["r"], "left_anti")
    shared = lists.join(members, lists["q"] == members["r"]).select(F.col("n").alias("q"), "s", "similarity").filter("q <> s")
    out = _rank(single.unionByName(shared), k)
    return out.filter(queries(F.col("q"))) if queries is not None else out


def _rank(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("q").orderBy(F.desc("similarity"), "s")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _bounded_sample(rows: DataFrame, share: float) -> DataFrame:
    return rows.filter(F.pmod(F.xxhash64(F.col("n"), F.lit(11)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))


def _fit_model(rows: DataFrame, total: int, k: int, dims: int, floor: float | None, target: float, part_rows: int, max_parts: int):
    """A Router for at most max_parts parts, else a Tree."""
    import pickle

    import numpy as np
    import pyarrow as pa

    parts = max(1, total // part_rows)
    if parts == 1:
        return Router(None, 1, k, floor, target)
    groups = parts if parts <= max_parts else min(max_parts, max(2, math.ceil(parts / SUB_PARTS)))
    wanted = min(SAMPLE_ROWS, max(8192, 64 * groups))
    batches = _bounded_sample(rows, wanted / max(1, total)).toArrow().combine_chunks().to_batches()  # about SAMPLE_ROWS vectors
    x = _vectors(batches[0], dims)[1] if batches else np.zeros((0, dims), np.float32)
    if len(x) < 8 * groups:
        groups = max(1, len(x) // 8)
    root = Router(x, groups, k, floor, target)
    width = min(SUB_PARTS, math.ceil(parts / groups))
    if groups == parts or groups == 1 or width == 1:
        return root
    shared = rows.sparkSession.sparkContext.broadcast(root)

    def group(batches: Iterator) -> Iterator:
        for b in batches:
            if b.num_rows:
                n, v = _vectors(b, dims)
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array(shared.value.route(v, 1)[:, 0].astype(np.int32)), _binary(v)], ["part", "v"])

    def fit(key, table):
        v = _matrix(table.column("v"), np.float32, dims)
        count = min(width, len(v) // 8)
        made = pickle.dumps(Router(v, count, k, floor, target, hidden=64, epochs=12)) if count > 1 else b""
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([made], pa.binary())})

    some = _bounded_sample(rows, SAMPLE_ROWS * groups / max(1, total))  # about SAMPLE_ROWS of each group, as groups are balanced
    models = some.mapInArrow(group, "part int, v binary").groupBy("part").applyInArrow(fit, "part int, model binary").collect()  # one of at most 64 KB + 256 B * SUB_PARTS for each group
    tree = Tree(root, {r.part: pickle.loads(r.model) for r in models if r.model}, width)
    tree.probes = _calibrate(tree, x, k, floor, target, True, np.random.default_rng(7), 500)
    return tree


def _search(rows: DataFrame, total: int, k: int, dims: int, floor: float | None, queries, target: float, part_rows: int, max_parts: int) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    spark = rows.sparkSession
    model = _fit_model(rows, total, k, dims, floor, target, part_rows, max_parts)
    shared = spark.sparkContext.broadcast(model)
    some = queries is not None
    asked = queries(F.col("n")) if some else F.lit(True)
    rows = rows.select("n", "v", asked.alias("ask"))

    def counts(batches: Iterator) -> Iterator:
        model = shared.value
        seen = np.zeros((model.parts, 2), np.int64)
        for b in batches:
            if b.num_rows:
                n, x = _vectors(b, dims)
                to = model.route(x, model.probes)
                ask = np.isin(n, b.column("n").filter(b.column("ask")).to_numpy()) if some else np.ones(len(n), bool)
                seen[:, 0] += np.bincount(to[:, 0], minlength=model.parts)
                seen[:, 1] += np.bincount(to[ask].ravel(), minlength=model.parts)
        part = np.flatnonzero(seen.any(1)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"part": part, "rows": seen[part, 0], "asked": seen[part, 1]})

    per_part = rows.mapInArrow(counts, "part int, rows bigint, asked bigint").groupBy("part").agg(F.sum("rows").alias("rows"), F.sum("asked").alias("asked")).collect()  # one row per part
    blocks = np.ones((model.parts, 2), np.int64)
    for r in per_part:
        blocks[r.part] = max(1, math.ceil(r.rows / CELL_ROWS)), max(1, math.ceil(r.asked / CELL_QUERIES))

    def place(batches: Iterator) -> Iterator:
        """Index rows (single precision, with whether they ask in their own part) and query rows (half precision, from the second part on)."""
        model = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            n, x = _vectors(b, dims)
            if not len(n):
                continue
            to = model.route(x, model.probes)
            ask = np.isin(n, b.column("n").filter(b.column("ask")).to_numpy()) if some else np.ones(len(n), bool)
            salt = (n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            home = to[:, 0]
            own_block, lanes = salt % blocks[home, 0], salt % blocks[home, 1]
            for lane in range(int(blocks[home, 1].max())):
                pick = blocks[home, 1] > lane
                yield _rows(home[pick], own_block[pick], lane, np.where(ask[pick] & (lanes[pick] == lane), 1, 0), n[pick], _binary(x[pick]))
            half = x.astype(np.float16)
            for j in range(to.shape[1]):
                part = to[:, j]
                for block in range(int(blocks[part, 0].max())):
                    # in its own part and block a query row isn't needed: the index row asks
                    pick = ask & (blocks[part, 0] > block) & ((j > 0) | (own_block != block))
                    if pick.any():
                        yield _rows(part[pick], np.full(pick.sum(), block), salt[pick] % blocks[part[pick], 1], 2, n[pick], _binary(half[pick]))

    def cell(key, table):
        kind = table.column("kind").to_numpy()
        own = table.filter(pa.array(kind < 2))
        sent = table.filter(pa.array(kind == 2))
        index_n, first = np.unique(own.column("n").to_numpy(), return_index=True)  # exact repeats of a row count once
        index = _matrix(own.column("v"), np.float32, dims)[first]
        asking = (own.column("kind").to_numpy() == 1)[first]
        q = np.concatenate([index[asking], _matrix(sent.column("v"), np.float16, dims)])
        q_n = np.concatenate([index_n[asking], sent.column("n").to_numpy()])
        a, b, s = compare(index, index_n, q, q_n, k, floor)
        return pa.table({"q": a.astype(np.int64), "s": b.astype(np.int64), "similarity": s.astype(np.float32)})

    placed = rows.mapInArrow(place, "part int, block int, lane int, kind int, n bigint, v binary")
    return placed.groupBy("part", "block", "lane").applyInArrow(cell, "q bigint, s bigint, similarity float")


def compare(index, index_n, q, q_n, k: int, floor: float | None, leaf_rows: int = LEAF_ROWS):
    """(query, row, similarity) of a cell: each query with its k best rows, with a floor also each row with its k best queries."""
    import numpy as np

    leaves = len(index) // leaf_rows
    if leaves < 8 or len(q) < 8:
        pieces = [(np.arange(len(q)), np.arange(len(index)))]
    else:
        rng = np.random.default_rng(5)
        model = Router(index[rng.permutation(len(index))[: max(4096, 64 * leaves)]], leaves, k, floor, LEAF_RECALL, hidden=64, epochs=12, mutual=False)
        if 2 * model.probes > leaves:
            pieces = [(np.arange(len(q)), np.arange(len(index)))]
        else:
            home, to = model.route(index, 1)[:, 0], model.route(q, model.probes)
            pieces = [(np.flatnonzero((to == p).any(1)), np.flatnonzero(home == p)) for p in range(leaves)]
    out = []
    for asking, there in pieces:
        for i in range(0, len(asking) if len(there) else 0, 2048):
            some = asking[i : i + 2048]
            s = q[some] @ index[there].T
            r, c = _best(s, q_n[some], index_n[there], k, floor)
            out.append((q_n[some][r], index_n[there[c]], s[r, c]))
    a, b, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    if len(out) > 1:  # the blocks and leaves together
        keep = _near(a, b, s, k, floor is not None)
        a, b, s = a[keep], b[keep], s[keep]
    return a, b, s


def _rows(part, block, lane, kind, n, v):
    import numpy as np
    import pyarrow as pa

    as_int = lambda a: pa.array(np.broadcast_to(a, len(n)).astype(np.int32))
    return pa.RecordBatch.from_arrays([as_int(part), as_int(block), as_int(lane), as_int(kind), pa.array(n.astype(np.int64)), v], ["part", "block", "lane", "kind", "n", "v"])


def _best(s, q_n, index_n, k: int, floor: float | None):
    """Of each row of s at most k columns, not itself; with a floor also of each column at most k rows: (rows, columns)."""
    import numpy as np

    if floor is None:
        s[q_n[:, None] == index_n[None, :]] = -2
        keep = min(k, s.shape[1])
        c = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
        r = np.repeat(np.arange(len(s)), keep)
        c = c.ravel()
        real = s[r, c] > -1.5
        return r[real], c[real]
    r, c = np.divmod(np.flatnonzero((s >= floor).ravel()), s.shape[1])
    other = q_n[r] != index_n[c]
    r, c = r[other], c[other]
    keep = _near(q_n[r], index_n[c], s[r, c], k)
    return r[keep], c[keep]


def _near(q, s, similarity, k: int, both: bool = True):
    """Which pairs are among the k best of the one that asks or, with both, of the one that is met."""
    import numpy as np

    keep = np.zeros(len(q), bool)
    for one, other in ((q, s), (s, q))[: 1 + both]:
        order = np.lexsort((other, -similarity, one))
        sorted_ = one[order]
        keep[order] |= np.arange(len(q)) - np.searchsorted(sorted_, sorted_) < k
    return keep


def close_pairs(vectors: DataFrame, k: int = 10, dims: int = 64, floor: float = 0.87) -> DataFrame:
    """(seq_a, seq_b), seq_a < seq_b: pairs of at least that similarity of which one is among the other's k most similar."""
    found = top_neighbours(vectors, k, dims, floor)
    return found.select(F.least("q", "s").alias("seq_a"), F.greatest("q", "s").alias("seq_b")).distinct()


def message_vectors(messages: DataFrame, dims: int = 64) -> DataFrame:
    """(n, v) of messages delivered for the first time, with vectors of the right length."""
    from ..operators.deliveries import losing_deliveries

    lost = cut(losing_deliveries(messages).select(F.col("seq").alias("n")))
    rows = messages.select(F.col("seq").alias("n"), F.col("embedding").alias("v")).filter(F.size("v") == dims)
    # the losers' size is checked before they are broadcast
    return rows.join(F.broadcast(lost) if lost.count() <= MAX_BROADCAST else lost, "n", "left_anti")
