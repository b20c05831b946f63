"""Truth by step, elements of the current observation and hidden rectangles over the driver's tables. Views are observations and snapshots, other events ask about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.operators import asof as A, hits
from siftwork.plans.relational import R, read, rects

QUERIES, ORACLES = {}, {}
VIEW = "event_type = 'view'"


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def _events(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


_V = f"v AS (SELECT user_id, ts, max(struct_pack(value := value, k := (props ->> '$.k')::INTEGER)) AS s FROM events WHERE {VIEW} GROUP BY ALL)"


@query(f"WITH {_V} SELECT e.event_id, v.ts AS taken, v.s.value AS value, coalesce(v.s.k, -1) AS k FROM (SELECT * FROM events WHERE NOT {VIEW}) e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts")
def truth_snapshot(spark, sf_dir):
    """The snapshot that was taken last before each step."""
    e = _events(spark, sf_dir)
    return A.snapshots(e.where(f"NOT {VIEW}").select("event_id", "user_id", "ts"), e.where(VIEW), "user_id", "ts", ["value", "k"]).select("event_id", "taken", "value", F.coalesce("k", F.lit(-1)).alias("k"))


@query(f"WITH {_V} SELECT e.event_id, CASE WHEN e.ts - v.ts <= INTERVAL 6 HOUR THEN v.ts END AS taken, CASE WHEN e.ts - v.ts <= INTERVAL 6 HOUR THEN v.s.k ELSE -1 END AS k FROM (SELECT * FROM events WHERE NOT {VIEW}) e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts")
def truth_snapshot_fresh(spark, sf_dir):
    """The same, snapshots of six hours or more being too old."""
    e = _events(spark, sf_dir)
    return A.snapshots(e.where(f"NOT {VIEW}").select("event_id", "user_id", "ts"), e.where(VIEW), "user_id", "ts", ["k"], F.expr("INTERVAL 6 HOURS")).select("event_id", "taken", F.coalesce("k", F.lit(-1)).alias("k"))


@query(f"""WITH o AS (SELECT user_id AS session, ts AS at, max(event_id) AS observation FROM events WHERE {VIEW} GROUP BY ALL), k AS (SELECT event_id AS observation, (props ->> '$.k')::INTEGER AS n FROM events WHERE {VIEW}),
p AS (SELECT event_id, user_id AS session, ts AS at, floor(value)::INTEGER AS id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen, event_type FROM events),
q AS (SELECT p.*, o.observation FROM p ASOF LEFT JOIN o ON p.session = o.session AND p.seen >= o.at), r AS (SELECT q.*, o.observation AS current FROM q ASOF LEFT JOIN o ON q.session = o.session AND q.at >= o.at)
SELECT event_id, coalesce(r.observation, -1) AS observation, coalesce(current, -1) AS current, CASE WHEN current IS NULL THEN 'none' WHEN r.observation IS NOT NULL AND r.observation <> current THEN 'stale' WHEN id < k.n THEN 'ok' ELSE 'unknown' END AS status FROM r LEFT JOIN k ON k.observation = current WHERE event_type <> 'view'""")
def element_registry(spark, sf_dir):
    """Each event but a view asks for an element of the observation that the user's event before it saw; an observation has as many elements as its property says."""
    e = _events(spark, sf_dir)
    views = e.where(VIEW).groupBy(F.col("user_id").alias("session"), F.col("ts").alias("at")).agg(F.max("event_id").alias("observation"))
    elements = e.where(VIEW).where("k > 0").select(F.col("event_id").alias("observation"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("id"))
    seen = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    asks = e.select("event_id", F.col("user_id").alias("session"), F.col("ts").alias("now"), F.floor("value").cast("int").alias("id"), seen.alias("at"), "event_type").where(f"NOT {VIEW}")
    asks = A.asof(asks, views, "session", "at", ["observation"]).select("event_id", "session", F.col("now").alias("at"), "observation", "id")
    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return A.resolve(asks, views, elements).select("event_id", none("observation"), none("current"), "status")


@query(f"WITH o AS (SELECT user_id AS session, ts AS m, max(event_id) AS observation FROM events WHERE {VIEW} GROUP BY ALL) SELECT session, observation, m AS since, lead(m) OVER (PARTITION BY session ORDER BY m, observation) AS until FROM o")
def observation_spans(spark, sf_dir):
    """From when until when each observation is the current one."""
    e = _events(spark, sf_dir).where(VIEW)
    return A.current(e.groupBy(F.col("user_id").alias("session"), F.col("ts").alias("at")).agg(F.max("event_id").alias("observation")))


@query(f"""WITH {R}, e AS (SELECT *, CASE WHEN id % 10 = 1 THEN id // 1000 * 1000 ELSE id END AS o, CASE WHEN id % 10 = 1 THEN id // 1000 * 1000 + 999 ELSE id END AS z FROM r),
p AS (SELECT obs, id, o, z, unnest([{{'x': x + w / 2, 'y': y + h / 2}}, {{'x': x + 2, 'y': y + 2}}, {{'x': x + w - 2, 'y': y + 2}}, {{'x': x + 2, 'y': y + h - 2}}, {{'x': x + w - 2, 'y': y + h - 2}}]) AS p, generate_subscripts([1, 2, 3, 4, 5], 1) AS n FROM e),
t AS (SELECT p.obs, p.id, p.n, p.o, p.z, arg_max(struct_pack(o := e.o, z := e.z), e.o) AS hit FROM p JOIN e ON e.obs = p.obs AND p.p.x >= e.x AND p.p.x < e.x + e.w AND p.p.y >= e.y AND p.p.y < e.y + e.h GROUP BY ALL)
SELECT obs, id, NOT bool_or((hit.o <= o AND o <= hit.z) OR (o <= hit.o AND hit.o <= z)) AS occluded FROM t GROUP BY 1, 2""")
def is_occluded(spark, sf_dir):
    """Rectangles of a page, later ones over earlier ones; the first line of an order holds the others."""
    first = F.col("id") % 10 == 1
    base = (F.floor(F.col("id") / 1000) * 1000).cast("long")
    e = rects(spark, sf_dir, once=False).select("obs", "id", F.when(first, base).otherwise(F.col("id")).alias("ord"), F.when(first, base + 999).otherwise(F.col("id")).alias("end"), "rect")
    return hits.occluded(e)
