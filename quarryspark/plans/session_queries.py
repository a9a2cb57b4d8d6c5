"""The registered query of stateful sessions: the events as a stream of some files in order of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.tables import table
from ..streaming import sessions

IDLE, LATE_S, PARTS = 6 * 3600, 3600, 3


def stream_sessions(spark, root):
    """Views tell a product, clicks offer a choice, signups answer it: yes for an even whole value."""
    at = scratch.folder(spark, "stream")
    kind = F.when(F.col("event_type") == "view", "product").when(F.col("event_type") == "click", "offer").when(F.col("event_type") == "signup", "answer").otherwise("other")
    told = F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k")).when(F.col("event_type") == "signup", F.when(F.floor("value") % 2 == 0, "yes").otherwise("no"))
    rows = table(spark, root, "events").where("user_id is not null and ts is not null").select("user_id", F.col("ts"), kind.alias("kind"), told.alias("told"), F.floor(F.dayofmonth("ts") * PARTS / 32).cast("int").alias("part"))
    for k in range(PARTS):  # files of later parts are written later, so the stream reads them in order
        rows.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{at}/events")
    return sessions.drained(spark, f"{at}/events", "user_id long, ts timestamp_ntz, kind string, told string", f"{at}/out", IDLE, f"{LATE_S} seconds")


QUERIES = {"stream_sessions": stream_sessions}

ORACLE_SQL = {
    "stream_sessions": f"""WITH e AS (SELECT user_id, ts, event_id, event_type, value, props, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= {IDLE * 1_000_000}, true)::INT AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM e),
c AS (SELECT user_id, session, event_type, value, lag(event_type) OVER (PARTITION BY user_id, session ORDER BY ts) AS before FROM s WHERE event_type IN ('click', 'signup')),
a AS (SELECT user_id, session, count(*) FILTER (floor(value)::BIGINT % 2 = 0) AS n_yes, count(*) FILTER (floor(value)::BIGINT % 2 <> 0) AS n_no FROM c WHERE event_type = 'signup' AND before = 'click' GROUP BY 1, 2),
g AS (SELECT user_id, session::BIGINT AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events, arg_max(json_extract_string(props, '$.k'), ts) FILTER (event_type = 'view') AS product FROM s GROUP BY 1, 2)
SELECT g.user_id, g.session, first_ts, last_ts, n_events, product, coalesce(n_yes, 0) AS n_yes, coalesce(n_no, 0) AS n_no FROM g LEFT JOIN a ON a.user_id = g.user_id AND a.session = g.session
WHERE g.session < (SELECT max(session) FROM g h WHERE h.user_id = g.user_id) OR epoch_us(last_ts) + {IDLE * 1_000_000} < (SELECT epoch_us(max(ts)) FROM events) - {LATE_S * 1_000_000}""",
}
