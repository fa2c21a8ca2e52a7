"""Queries by time and over trees of digests, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlore.operators import merkle, temporal
from graphlore.plans.catalogue_queries import _BASE, _DELTA, _delta
from graphlore.plans.registry import query
from graphlore.streaming import cache
from graphlore.streaming import events as streams

_SEEN = "seen AS (SELECT event_id, user_id, ts, value, event_type FROM events)"


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value", "event_type")


@query(f"""WITH {_SEEN} SELECT l.event_id, r.event_id AS last_click, r.value AS last_value
FROM (FROM seen WHERE event_type = 'error') l ASOF LEFT JOIN (FROM seen WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_last_click(spark, sf_dir):
    """For every error the last click of the same user."""
    e = _events(spark, sf_dir)
    found = temporal.asof(e.filter("event_type = 'error'"), e.filter("event_type = 'click'"), ["user_id"], "ts", "event_id")
    return found.select("event_id", F.col("found.event_id").alias("last_click"), F.col("found.value").alias("last_value"))


@query(f"""WITH {_SEEN} SELECT l.event_id, count(*) AS near, round(sum(r.value), 6) AS total FROM seen l JOIN seen r
ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 2 HOUR AND l.ts WHERE l.event_type = 'error' GROUP BY l.event_id""")
def interval_before_error(spark, sf_dir):
    """For every error the same user's events of the two hours before it, itself included."""
    e = _events(spark, sf_dir)
    pairs = temporal.within(e.filter("event_type = 'error'"), e, ["user_id"], "ts", 7200)
    return pairs.groupBy(F.col("l.event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("near"), F.round(F.sum("r.value"), 6).alias("total"))


_SESSIONS = f"""WITH {_SEEN}, cut AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true)::INT AS new FROM seen WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM cut),
whole AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events, round(sum(value), 6) AS total FROM numbered GROUP BY user_id, k)
SELECT * FROM whole"""


@query(_SESSIONS)
def event_sessions(spark, sf_dir):
    return streams.sessions(_events(spark, sf_dir))


@query(_SESSIONS + """ WHERE "end" <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM seen)""")
def event_sessions_stream(spark, sf_dir):
    """The stream gives out the sessions that its watermark has passed."""
    return streams.drain(streams.sessions(streams.events_stream(spark, sf_dir)), "sessions")


@query(f"""WITH {_BASE}, {_DELTA} SELECT coalesce(b.key, d.key)::VARCHAR AS key, CASE WHEN d.key IS NULL THEN 'missing' WHEN b.key IS NULL THEN 'unexpected' ELSE 'changed' END AS problem
FROM base b FULL JOIN delta d ON b.key = d.key WHERE b.payload IS DISTINCT FROM d.payload""")
def merkle_difference(spark, sf_dir):
    """Where base and delta differ, found by descending both trees."""
    base, delta = _delta(spark, sf_dir)
    return merkle.differing(merkle.digested(base, "key", "payload"), merkle.digested(delta, "key", "payload"))


@query("""WITH RECURSIVE miss AS (
  SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL SELECT miss.user_id, min(e.ts) FROM miss JOIN events e ON e.user_id = miss.user_id AND e.ts >= miss.ts + INTERVAL 6 HOUR GROUP BY miss.user_id),
ends AS (SELECT user_id, ts + INTERVAL 6 HOUR AS "over", lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM miss)
SELECT e.user_id::VARCHAR AS key, e.ts AS "at", CASE WHEN miss.ts IS NULL THEN 'hit' ELSE 'miss' END AS outcome FROM events e LEFT JOIN miss ON miss.user_id = e.user_id AND miss.ts = e.ts
UNION ALL SELECT user_id::VARCHAR, "over", 'expired' FROM ends WHERE following IS NOT NULL OR "over" <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def cache_outcomes(spark, sf_dir):
    """Events as requests to a cache of one value a user that lives six hours."""
    return cache.replay(streams.events_stream(spark, sf_dir), "user_id", 21_600)
