"""Keyed state that outlives a run: a session's handles with export and import, and a store of values by namespace. Both over transformWithState, a row of state for each key, read back through
the state-store reader.

State lies in RocksDB, so the session that starts a stream must name its provider; ready() gives such a session and leaves the caller's as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ready(spark: SparkSession) -> SparkSession:
    """A session beside this one whose streams keep state in RocksDB."""
    beside = spark.newSession()
    beside.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        beside.conf.set(name, spark.conf.get(name))
    return beside


class _Counter(StatefulProcessor):
    """Values of a session, numbered by first appearance. State: a row for each value, and how many there are."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("counter", "key string", "kind string, tier int, index long", self.ttl_ms)
        self.size = handle.getValueState("size", "n long")

    def _count(self) -> int:
        return self.size.get()[0] if self.size.exists() else 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, out = self._count(), []
        # the state is asked once for a value of a batch, and not at all where it is empty
        met, empty = set(), n == 0
        every = pd.concat(list(rows)).sort_values(["ord", "key"], na_position="first")
        for k, value, kind, tier, reset in zip(*[every[c].tolist() for c in ("ord", "key", "type", "tier", "reset")], strict=True):
            if reset:
                self.seen.clear()
                n, met, empty = 0, set(), True
            if value is not None and value not in met:
                met.add(value)
                if empty or not self.seen.containsKey((value,)):
                    n += 1
                    self.seen.updateValue((value,), (kind, int(tier), n))
                    out.append((key[0], k, value, kind, int(tier), n))
        self.size.update((n,))
        yield pd.DataFrame(out, columns=["session", "ord", "key", "kind", "tier", "index"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            self.seen.updateValue((r.key,), (r.kind, int(r.tier), int(r.index)))
        self.size.update((int(initialState["index"].max()),))

    def close(self) -> None:
        """Nothing is held beside the state."""


def counters(values: DataFrame, imported: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """(session, ord, key, kind, tier, index) of a stream of values(session string, ord long, key string, type string, tier int, reset boolean): each value of a session once, when it first
    appears, with its number. A row with reset forgets the session's values first; its own key may be null. imported: what export() gave for an earlier run, whose numbers go on. ttl_ms: how
    long a value is remembered; numbers aren't used again.

    Rows of a micro-batch are taken by ord, then key.
    """
    rows = values.select("session", F.col("ord").cast("long").alias("ord"), "key", "type", F.col("tier").cast("int").alias("tier"), F.coalesce("reset", F.lit(False)).alias("reset"))
    start = imported.select("session", "key", "kind", "tier", "index").groupBy("session") if imported is not None else None
    return rows.groupBy("session").transformWithStateInPandas(_Counter(ttl_ms), "session string, ord long, key string, kind string, tier int, index long", "append", "processingTime" if ttl_ms else "none", start)


def export(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session, key, kind, tier, index): the counters of a stream as its last batch left them."""
    rows = spark.read.format("statestore").option("stateVarName", "counter").load(checkpoint)
    return rows.select("key.session", F.col("user_map_key.key").alias("key"), "user_map_value.kind", "user_map_value.tier", "user_map_value.index")


def distinct_values(exported: DataFrame) -> DataFrame:
    """(session, n): how many values each session knows. The values themselves aren't shown."""
    return exported.groupBy("session").agg(F.count("*").alias("n"))


class _Store(StatefulProcessor):
    """Values of a namespace by key."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "key string", "value string, ord long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values("ord").itertuples():
            if r.op == "clear":
                self.held.clear()
            elif r.op == "put":
                self.held.updateValue((r.key,), (r.value, r.ord))
            elif r.op == "delete" and self.held.containsKey((r.key,)):
                self.held.removeKey((r.key,))
            elif r.op == "get":
                found = self.held.getValue((r.key,)) if self.held.containsKey((r.key,)) else None
                out.append((key[0], r.ord, r.key, None if found is None else found[0], found is not None))
        yield pd.DataFrame(out, columns=["namespace", "ord", "key", "value", "found"])

    def close(self) -> None:
        """Nothing is held beside the state."""


def store(ops: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(namespace, ord, key, value, found): answers to the gets of a stream of ops(namespace string, ord long, op string, key string, value string); op is put, get, delete or clear, which forgets the
    namespace. Ops of a namespace are taken by ord; namespaces don't see each other. What is put is in the state when the batch ends, which is what contents() reads. Unknown ops do nothing."""
    rows = ops.select("namespace", F.col("ord").cast("long").alias("ord"), "op", "key", "value")
    return rows.groupBy("namespace").transformWithStateInPandas(_Store(ttl_ms), "namespace string, ord long, key string, value string, found boolean", "append", "processingTime" if ttl_ms else "none")


def contents(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(namespace, key, value, ord): what a store holds, and the op that put it there."""
    rows = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    return rows.select("key.namespace", F.col("user_map_key.key").alias("key"), "user_map_value.value", "user_map_value.ord")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that a stream's source has, into a table."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
