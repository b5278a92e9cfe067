"""Exact vector search: cosine similarity, the k most similar to one vector, and the batch form.

Different lengths, zero vectors and nulls give similarity 0. Ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import ship


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(norms, F.lit(0.0))), F.lit(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int, id_: str = "id", vector: str = "embedding") -> DataFrame:
    """TakeOrderedAndProject: each task keeps k rows."""
    scored = vectors.withColumn("score", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    return scored.orderBy(F.desc("score"), id_).limit(k)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4_096) -> DataFrame:
    """(q, id, score, rank): for each of the queries (q, v) the k most similar of vectors (id, v), itself left out.

    Queries are sent to the tasks in blocks of at most about `block`; each task keeps k candidates per query with a matrix product."""
    spark = vectors.sparkSession
    ship(spark)
    many = queries.count()
    blocks = max(1, -(-many // block))
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).filter("id is not null and v is not null")
    found = None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", F.col("v").cast("array<double>").alias("v")).collect()
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in part if r[1] is not None])
        here = rows.mapInPandas(lambda batches, shared=shared: _best(batches, shared.value, k), "q bigint, id bigint, score double")
        found = here if found is None else found.unionByName(here)
    w = W.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _best(batches: Iterator, queries: list, k: int) -> Iterator:
    import numpy as np
    import pandas as pd

    def unit(rows):
        x = np.array(rows, dtype=np.float64).reshape(len(rows), -1)
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    by_size: dict[int, list] = {}
    for q, v in queries:
        by_size.setdefault(len(v), []).append((q, v))
    sides = {n: (np.array([q for q, _ in v], np.int64), unit([x for _, x in v])) for n, v in by_size.items()}
    for b in batches:
        sizes = np.array([len(v) for v in b["v"]])
        ids = b["id"].to_numpy()
        for n, (q, x) in sides.items():
            s = np.zeros((len(q), len(ids)))
            same = np.flatnonzero(sizes == n)
            if len(same):
                s[:, same] = x @ unit([b["v"].iloc[i] for i in same]).T
            s[q[:, None] == ids[None, :]] = -2
            order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
            r = np.repeat(np.arange(len(q)), order.shape[1])
            c = order.ravel()
            real = s[r, c] > -1.5
            yield pd.DataFrame({"q": q[r][real], "id": ids[c][real], "score": s[r, c][real]})


class VectorIndex:
    """An index over rows (id, v): add, get, size, clear, search. Of a repeated id the vector added first counts, of those added at once the smallest."""

    def __init__(self, rows: DataFrame):
        self._schema, self.rows = rows.select("id", "v").schema, self._single(rows)

    @staticmethod
    def _single(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.min("v").alias("v"))

    def add(self, rows: DataFrame) -> None:
        self.rows = self.rows.unionByName(self._single(rows).join(self.rows, "id", "left_anti"))

    def get(self, id_) -> list[float] | None:
        row = self.rows.filter(F.col("id") == id_).first()
        return row["v"] if row else None

    def size(self) -> int:
        return self.rows.count()

    def clear(self) -> None:
        self.rows = self.rows.sparkSession.createDataFrame([], self._schema)

    def search(self, query: list[float], k: int = 5) -> DataFrame:
        return top_k(self.rows, query, k, "id", "v")
