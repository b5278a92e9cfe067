"""Problem 1: messages delivered more than once.

`DeliveryStore` keeps one row per identifier in versioned partitions, with an index identifier -> (partition, order) beside
them. `merge` takes a batch of deliveries, looks up through the index which historical partitions hold any of its
identifiers, reads only those, recomputes the single winners of history and batch together, writes new versions of just
those partitions, and commits by renaming one manifest file: readers see all of a merge or nothing.

The row with the smallest order value wins; rows of one identifier and order are one delivery, so a batch that is delivered again
changes neither winners nor losers. Defined results: a null or empty identifier identifies nothing, each such row stays (and comes again
with a batch that is taken in twice); a null order loses to any other; an empty batch changes nothing; extra columns pass through, whatever
their names: a row is stored as one struct beside the store's own columns.

Scale: the index lies in INDEX_BUCKETS folders by a hash of the identifier, and a merge reads those that its batch touches. The winners' table is
pre-aggregated before its shuffle, and rows meet it on (identifier, order), so a hot identifier spreads over all tasks. The driver holds names
of partitions and buckets only, whose numbers the partition expression and INDEX_BUCKETS bound.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import delete, fresh_dir, list_names, read_text, write_text_atomically

_LAST = 2**63 - 1
INDEX_BUCKETS = 32


class DeliveryStore:
    def __init__(self, spark: SparkSession, path: str, key: str = "id", order: str = "seq", partition: Column | None = None):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order
        self.partition = F.coalesce(F.nullif((partition if partition is not None else F.lit("all")).cast("string"), F.lit("")), F.lit("none"))

    def manifest(self) -> dict:
        names = [int(n[:-5]) for n in list_names(self.spark, f"{self.path}/_manifest") if n.endswith(".json")]
        if not names:
            return {"version": 0, "rows": {}, "superseded": [], "index": []}
        return json.loads(read_text(self.spark, f"{self.path}/_manifest/{max(names)}.json"))

    def _version(self, n: int) -> str:
        return f"{self.path}/rows/v={n}"

    def winners(self, partitions: list[str] | None = None) -> DataFrame | None:
        """The current rows, of all or of the named partitions."""
        state = self.manifest()["rows"]
        paths = [f"{self._version(v)}/kept=true/p={_escape(p)}" for p, v in sorted(state.items()) if partitions is None or p in partitions]
        return self.spark.read.parquet(*paths).select("row.*") if paths else None

    def superseded(self) -> DataFrame | None:
        """Every delivery that lost, once, however often its batch came."""
        paths = [f"{self._version(v)}/kept=false/*" for v in self.manifest()["superseded"]]
        if not paths:
            return None
        lost = self.spark.read.parquet(*paths).select("row", F.col(f"row.`{self.key}`").alias("k"), F.col(f"row.`{self.order}`").alias("o"))
        return lost.dropDuplicates(["k", "o"]).select("row.*")

    def index(self, buckets: list[int] | None = None) -> DataFrame | None:
        """(k, p): the partition that holds the key's winner, of all or of the given buckets; later versions replace earlier ones."""
        parts = []
        for v in self.manifest()["index"]:
            entries = self.spark.read.schema("k string, p string, b int").parquet(f"{self.path}/index/v={v}")
            entries = entries if buckets is None else entries.filter(F.col("b").isin(buckets))  # folders are pruned
            parts.append(entries.select("k", "p", F.lit(v).alias("_v")))
        if not parts:
            return None
        entries = reduce(DataFrame.unionByName, parts)
        return entries.drop("_v") if len(parts) == 1 else entries.groupBy("k").agg(F.max_by("p", "_v").alias("p"))

    def _write_index(self, entries: DataFrame, version: int) -> None:
        entries.select("k", "p", _bucket().alias("b")).repartition("b").write.partitionBy("b").parquet(f"{self.path}/index/v={version}")

    def merge(self, batch: DataFrame) -> dict:
        """Takes in a batch of deliveries; gives the new manifest."""
        spark, old = self.spark, self.manifest()
        version = old["version"] + 1
        key = F.when(F.col(self.key) != "", F.col(self.key).cast("string"))
        rank = F.coalesce(F.col(self.order).cast("long"), F.lit(_LAST))

        def opened(rows: DataFrame) -> DataFrame:
            return rows.select(F.struct("*").alias("row"), self.partition.alias("p"), key.alias("k"), rank.alias("o"))

        arriving = opened(batch)
        # 1. which historical partitions hold identifiers of this batch
        came = arriving.agg(F.collect_set("p"), F.collect_set(F.when(F.col("k").isNotNull(), _bucket()))).first()  # bounded: partitions and buckets
        gains = set(came[0])
        hit: list[str] = []
        index = self.index(came[1]) if old["index"] else None
        if index is not None:
            ids = arriving.select("k").filter("k is not null").distinct()
            hit = [r[0] for r in index.join(ids, "k", "left_semi").select("p").distinct().collect()]  # bounded by the number of partitions
        # 2. history of those partitions and the batch together, each row with whether it wins
        history = self.winners(hit) if hit else None
        rows = arriving if history is None else arriving.unionByName(opened(history))
        best = rows.filter("k is not null").groupBy("k").agg(F.min("o").alias("o")).withColumn("best", F.lit(True))
        named = rows.filter("k is not null").join(best, ["k", "o"], "left")
        kept = named.filter("best").dropDuplicates(["k", "o"]).select("row", "p", F.lit(True).alias("kept"))
        lost = named.filter("best is null").select("row", "p", F.lit(False).alias("kept"))
        flagged = kept.unionByName(lost).unionByName(rows.filter("k is null").select("row", "p", F.lit(True).alias("kept")))
        # 3. partitions that only gain rows take their old ones along
        extra = sorted((gains - set(hit)) & set(old["rows"]))
        if extra:
            flagged = flagged.unionByName(opened(self.winners(extra)).select("row", "p", F.lit(True).alias("kept")))
        flagged.write.partitionBy("kept", "p").parquet(self._version(version))
        written = _partitions(spark, f"{self._version(version)}/kept=true")
        # 4. the index learns where this version's winners are
        if written:
            now = opened(spark.read.parquet(*[f"{self._version(version)}/kept=true/p={_escape(p)}" for p in written]).select("row.*"))
            self._write_index(now.filter("k is not null"), version)
        touched = set(hit) | gains
        state = {
            "version": version,
            "rows": {p: v for p, v in old["rows"].items() if p not in touched} | {p: version for p in written},
            "superseded": old["superseded"] + [version] * bool(list_names(spark, f"{self._version(version)}/kept=false")),
            "index": old["index"] + [version] * bool(written),
        }
        write_text_atomically(spark, f"{self.path}/_manifest/{version}.json", json.dumps(state))
        return state

    def compact(self) -> dict:
        """One index version instead of many, in a new manifest; then removes row versions of partitions that were replaced."""
        old = self.manifest()
        if len(old["index"]) > 1:
            version = old["version"] + 1
            self._write_index(self.index(), version)
            state = old | {"version": version, "index": [version]}
            write_text_atomically(self.spark, f"{self.path}/_manifest/{version}.json", json.dumps(state))
        else:
            state = old
        used = {f"{v}/kept=true/p={_escape(p)}" for p, v in state["rows"].items()}
        for v in list_names(self.spark, f"{self.path}/rows"):
            for p in list_names(self.spark, f"{self.path}/rows/{v}/kept=true"):
                if p.startswith("p=") and f"{v[2:]}/kept=true/{p}" not in used:
                    delete(self.spark, f"{self.path}/rows/{v}/kept=true/{p}")
        for v in list_names(self.spark, f"{self.path}/index"):
            if int(v[2:]) not in state["index"]:
                delete(self.spark, f"{self.path}/index/{v}")
        return state


def _bucket() -> Column:
    return F.pmod(F.xxhash64("k"), F.lit(INDEX_BUCKETS)).cast("int")


def _escape(p: str) -> str:
    """As Spark writes a partition's folder."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in p)


def _partitions(spark: SparkSession, path: str) -> list[str]:
    from urllib.parse import unquote

    return [unquote(n[2:]) for n in list_names(spark, path) if n.startswith("p=")]


def replay(messages: DataFrame, key: str = "id", order: str = "seq", partition: Column | None = None, batch: str = "batch_id", history_share: float = 0.8) -> DeliveryStore:
    """Loads deliveries as they came: those up to history_share of the batch numbers first, the rest as an incoming batch."""
    store = DeliveryStore(messages.sparkSession, fresh_dir(messages.sparkSession, "deliveries"), key, order, partition)
    low, high = messages.agg(F.min(batch), F.max(batch)).first()
    if low is None:
        store.merge(messages)
        return store
    border = low + (high - low) * history_share
    early = F.coalesce(F.col(batch) <= border, F.lit(True))
    store.merge(messages.filter(early))
    if high > border:
        store.merge(messages.filter(~early))
    return store


def _month() -> Column:
    return F.date_format(F.col("received_at").cast("timestamp"), "yyyyMM")


def stored_messages(messages: DataFrame) -> DataFrame:
    """The winners of a store that whole message rows were loaded into, those without id among them."""
    kept = replay(messages, partition=_month()).winners()
    return messages.limit(0) if kept is None else kept


def superseded_deliveries(messages: DataFrame) -> DataFrame:
    """(id, seq) of every row whose id stands in a row with a smaller seq: the losers of a store that whole message rows were loaded into."""
    lost = replay(messages, partition=_month()).superseded()
    if lost is None:
        return messages.select("id", "seq").limit(0)
    return lost.select("id", "seq")


def losing_deliveries(messages: DataFrame) -> DataFrame:
    """(id, seq) of the rows that lost, taken in one pass over id and seq: the same rows as the store's, for queries that need them as a filter."""
    named = messages.select("id", "seq").filter("id != ''")
    best = named.groupBy("id").agg(F.min("seq").alias("_best"), F.count("*").alias("_n")).filter("_n > 1")
    return named.join(best, "id").filter("seq > _best").select("id", "seq")


def single_deliveries(messages: DataFrame) -> DataFrame:
    """messages without the rows that lost against an earlier delivery of the same id. Rows without id stay."""
    return messages.join(losing_deliveries(messages).select("seq"), "seq", "left_anti")
