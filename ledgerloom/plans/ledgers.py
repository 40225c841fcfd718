"""Two ledgers derived from the events table, as SQL that Spark and DuckDB both run.

``{secs}`` makes an interval of seconds, ``{ep}`` the seconds of a time since 1970.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CTE = """
base AS (
  SELECT event_id AS k, ts, user_id AS u, CAST(greatest(1, floor(value / 5)) * 500 AS DOUBLE) AS m,
         CASE WHEN event_type IN ('purchase', 'click') THEN 'COLLECT' WHEN event_type IN ('error', 'view') THEN 'PAYOUT' ELSE 'BONUS' END AS type,
         CASE CAST(user_id % 6 AS INT) WHEN 0 THEN 'lucas' WHEN 1 THEN 'martina' WHEN 2 THEN 'sergio' WHEN 3 THEN 'brenda' WHEN 4 THEN 'claudio' ELSE 'xq' END AS nm,
         CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'Prueba' WHEN 1 THEN 'Ejemplo' WHEN 2 THEN 'Ficticia' ELSE 'Muestra' END AS sn
  FROM {events}
),
panel AS (
  SELECT concat('p', k) AS id, k, ts, type, concat(nm, u) AS party, concat('agent', u % 5) AS account,
         CASE WHEN type = 'COLLECT' AND k % 9 = 0 THEN floor(m * 1.1 * 100 + 0.5) / 100 WHEN type = 'COLLECT' AND k % 9 = 1 THEN floor(m * 1.2 * 100 + 0.5) / 100 ELSE m END AS amount
  FROM base
  UNION ALL SELECT concat('n', k), k, ts + {s30}, 'COLLECT', concat(nm, u), concat('agent', u % 5), m * 0.2 FROM base WHERE type = 'PAYOUT' AND k % 31 = 0
  UNION ALL SELECT concat('v', k), k, ts + {s60}, 'PAYOUT', concat(nm, u), concat('agent', u % 5), m FROM base WHERE type = 'COLLECT' AND k % 29 = 0 AND k % 9 > 1
),
s AS (SELECT *, CASE WHEN type = 'COLLECT' THEN -1 ELSE 1 END AS sg, CASE WHEN k % 5 = 0 THEN '' ELSE concat(upper(nm), ' ', sn) END AS holder FROM base WHERE type <> 'BONUS'),
wallet AS (
  SELECT concat('w', k) AS id, k, ts + {secs_main} AS ts, type, holder AS party, concat('box', k % 3) AS account,
         CASE WHEN type = 'PAYOUT' AND k % 31 = 0 THEN m * 0.8 ELSE m END AS amount, k % 23 = 0 AS no_time
  FROM s WHERE k % 11 <> 0 AND k % 13 <> 0 AND NOT (type = 'COLLECT' AND k % 29 = 0)
  UNION ALL SELECT concat('d', k), k, ts + {secs_dup}, type, holder, concat('box', k % 3), m, false FROM s WHERE type = 'PAYOUT' AND k % 17 = 0
  UNION ALL SELECT concat('a', k), k, ts + {secs_a}, type, holder, concat('box', k % 3), m * 0.6, false FROM s WHERE k % 13 = 0
  UNION ALL SELECT concat('b', k), k, ts + {secs_b}, type, holder, concat('box', k % 3), m * 0.4, false FROM s WHERE k % 13 = 0
)
"""


def _fill(secs, events: str) -> str:
    parts = {"s30": secs("30"), "s60": secs("60"), "secs_main": secs("(sg * (CASE WHEN k % 19 = 0 THEN -60 ELSE (k * 37) % 2400 END))"), "secs_dup": secs("((k * 37) % 2400 + 300)"), "secs_a": secs("(sg * 120)"), "secs_b": secs("(sg * 180)")}
    return CTE.format(events=events, **parts)


#: The same tables for DuckDB; ``ms`` of a time is epoch_ms(ts).
DUCKDB = "WITH " + _fill(lambda x: f"to_seconds({x})", "events")


def _spark(spark: SparkSession, sf_dir: str, name: str, more: str = "") -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql("WITH " + _fill(lambda x: f"make_dt_interval(0, 0, 0, {x})", "{events}") + more + f" SELECT * FROM {name}", events=events)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, k, ts, type, party, account, amount of the panel's rows."""
    return _spark(spark, sf_dir, "panel")


def wallet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wallet's rows, with ``no_time`` for those whose time is to be passed over."""
    return _spark(spark, sf_dir, "wallet")
