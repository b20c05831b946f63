"""Streams with state over the driver's events, run to their end, and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.sources import auditlog
from siftwork.streaming import stores
from siftwork.tables import new_path

QUERIES, ORACLES = {}, {}
_KEY = "event_type || ':' || (props ->> '$.k')"


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def _values(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("ord"), F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("key"), F.upper("event_type").alias("type"), F.when(F.col("event_type") == "error", 1).otherwise(2).alias("tier"), F.lit(False).alias("reset"), F.hour("ts").alias("hour"))


def _streamed(spark, rows: DataFrame, name: str) -> DataFrame:
    """Rows as a stream of files."""
    path = new_path(spark, name)
    rows.write.parquet(path)
    return stores.ready(spark).readStream.schema(rows.schema).parquet(path)


@query(f"""WITH v AS (SELECT user_id::VARCHAR AS session, {_KEY} AS key, arg_min(upper(event_type), event_id) AS kind, (CASE WHEN arg_min(event_type, event_id) = 'error' THEN 1 ELSE 2 END)::INTEGER AS tier, min(CASE WHEN hour(ts) < 12 THEN 0 ELSE 1000000000000 END + event_id) AS o FROM events GROUP BY 1, 2)
SELECT session, key, kind, tier, row_number() OVER (PARTITION BY session ORDER BY o) AS index FROM v""")
def tokenizer_io(spark, sf_dir):
    """Counters of the mornings' events, exported, imported into a second stream of the afternoons' events, whose numbers go on, and exported again."""
    values = _values(spark, sf_dir)
    exported = None
    for half, name in ((values.where("hour < 12"), "morning"), (values.where("hour >= 12"), "afternoon")):
        mark = new_path(spark, f"counter-{name}")
        stores.run_to_end(stores.counters(_streamed(spark, half.drop("hour"), f"values-{name}"), exported), new_path(spark, f"handles-{name}"), mark)
        exported = stores.export(spark, mark)
    return exported.select("session", "key", "kind", "tier", "index")


@query(f"SELECT user_id::VARCHAR AS session, count(DISTINCT {_KEY})::BIGINT AS n FROM events GROUP BY 1")
def tokenizer_sizes(spark, sf_dir):
    """How many values each session knows at the end."""
    mark = new_path(spark, "counter")
    stores.run_to_end(stores.counters(_streamed(spark, _values(spark, sf_dir).drop("hour"), "values")), new_path(spark, "handles"), mark)
    return stores.distinct_values(stores.export(spark, mark))


def _ops(spark, sf_dir: str) -> DataFrame:
    """Views put, clicks get, purchases delete, signups clear; an event's property is the key."""
    op = F.create_map(*[F.lit(x) for pair in (("view", "put"), ("click", "get"), ("error", "delete")) for x in pair])
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("namespace"), F.col("event_id").alias("ord"), F.when((F.col("event_type") == "error") & (F.col("value") > 20), "clear").otherwise(F.coalesce(F.try_element_at(op, "event_type"), F.lit("other"))).alias("op"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string").alias("key"), F.col("value").cast("string").alias("value"))


_OPS = "o AS (SELECT user_id::VARCHAR AS namespace, event_id AS ord, CASE WHEN event_type = 'error' AND value > 20 THEN 'clear' WHEN event_type = 'view' THEN 'put' WHEN event_type = 'click' THEN 'get' WHEN event_type = 'error' THEN 'delete' ELSE 'other' END AS op, ((props ->> '$.k')::INTEGER % 5)::VARCHAR AS key, value::VARCHAR AS value FROM events)"
_CHANGES = f"""WITH {_OPS}, c AS (SELECT namespace, ord, max(CASE WHEN op = 'clear' THEN ord END) OVER (PARTITION BY namespace ORDER BY ord) AS cleared, op, key, value,
  max(CASE WHEN op IN ('put', 'delete') THEN ord END) OVER (PARTITION BY namespace, key ORDER BY ord) AS changed FROM o)"""


@query(f"""{_CHANGES} SELECT c.namespace, c.ord, c.key, CASE WHEN p.op = 'put' THEN p.value END AS value, coalesce(p.op = 'put', false) AS found
FROM c LEFT JOIN c p ON p.namespace = c.namespace AND p.ord = c.changed AND c.changed > coalesce(c.cleared, -1) WHERE c.op = 'get'""")
def src_kv(spark, sf_dir):
    """What each get of a namespaced store answers."""
    path = new_path(spark, "kv-answers")
    stores.run_to_end(stores.store(_streamed(spark, _ops(spark, sf_dir), "kv-ops")), path, new_path(spark, "kv"))
    return spark.read.schema("namespace string, ord long, key string, value string, found boolean").parquet(path)


@query(f"""{_CHANGES}, l AS (SELECT namespace, max(CASE WHEN op = 'clear' THEN ord END) AS cleared FROM o GROUP BY 1), k AS (SELECT namespace, key, max(ord) AS ord FROM o WHERE op IN ('put', 'delete') GROUP BY 1, 2)
SELECT k.namespace, k.key, o.value, k.ord FROM k JOIN l USING (namespace) JOIN o ON o.ord = k.ord AND o.op = 'put' WHERE k.ord > coalesce(l.cleared, -1)""")
def src_kv_contents(spark, sf_dir):
    """What the store holds in the end, by the state-store reader."""
    mark = new_path(spark, "kv")
    stores.run_to_end(stores.store(_streamed(spark, _ops(spark, sf_dir), "kv-ops")), new_path(spark, "kv-answers"), mark)
    return stores.contents(spark, mark)


@query("SELECT event_id, event_type, value FROM events")
def snk_audit(spark, sf_dir):
    """Events written to the audit log in two batches, of which the second is written twice, as after a failure, and read back."""
    auditlog.register(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    path = new_path(spark, "audit")
    for batch, rows in (("0", e.where("event_id % 2 = 0")), ("1", e.where("event_id % 2 = 1")), ("1", e.where("event_id % 2 = 1"))):
        rows.write.format("audit").option("writer", "events").option("batchId", batch).mode("append").save(path)
    return spark.read.format("audit").schema(e.schema).load(path)
