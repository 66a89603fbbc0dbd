"""Sessions of activity out of the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.operators.sessions import incremental_sessions
from larkspur.plans.registry import query
from larkspur.session import read_table

_SQL = """
WITH r AS (SELECT coalesce('r' || run_id, 'n' || md5(CAST(to_json(runs) AS VARCHAR))) AS run_id, lower(regexp_replace(session_key, '^\\s+|\\s+$', '', 'g')) AS session_key, epoch_us(started_at) AS s, greatest(epoch_us(started_at), coalesce(epoch_us(finished_at), epoch_us(started_at))) AS e
           FROM runs WHERE session_key IS NOT NULL AND started_at IS NOT NULL),
i AS (SELECT run_id, min(session_key) AS session_key, min(s) AS s, max(e) AS e FROM r WHERE session_key <> '' GROUP BY 1),
w AS (SELECT *, max(e) OVER (PARTITION BY session_key ORDER BY s, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR s >= before + 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY s, run_id ROWS UNBOUNDED PRECEDING) AS nth FROM w)
SELECT session_key, min(s) AS start_us, max(e) AS end_us{more} FROM n GROUP BY session_key, nth
"""


@query(_SQL.replace("{more}", ""))
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental_sessions(read_table(spark, sf_dir, "runs")).select("session_key", "start_us", "end_us")


@query(_SQL.replace("{more}", ", count(*) AS n_runs, max(e) - min(s) AS duration_us"))
def p1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental_sessions(read_table(spark, sf_dir, "runs"))
