"""Registered queries over the derived ledgers and the driver's tables, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, numbers, times
from ..operators import dataset, dedup, diagnosis, matching, report
from ..operators.joins import band_join, nearest
from . import ledgers
from .params import MINUTE, Params

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:  # whole milliseconds, cut off as in the engine
            ORACLES[f.__name__] = re.sub(r"epoch_ms\(((?:\w\.)?\w+)\)", r"(epoch_us(\1) // 1000)", sql)
        return f

    return register


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return matching.movements(ledgers.panel(spark, sf_dir), "panel"), matching.movements(ledgers.wallet(spark, sf_dir), "wallet")


_MOVES = ledgers.DUCKDB + """, both_sides AS (
  SELECT id, 'panel' AS side, ts, type, party, account, floor(abs(amount) * 100 + 0.5) / 100 AS amount, false AS no_time FROM panel
  UNION ALL SELECT id, 'wallet', ts, type, party, account, floor(abs(amount) * 100 + 0.5) / 100, no_time FROM wallet)
"""
_CAND = _MOVES + """, p AS (SELECT *, epoch_ms(ts) AS e, epoch_ms(ts) // 3600000 AS h FROM both_sides WHERE side = 'panel' AND type <> 'BONUS'),
px AS (SELECT p.*, h + o AS b FROM p, (VALUES (-2), (-1), (0), (1), (2)) AS d(o)),
w AS (SELECT *, epoch_ms(ts) AS e, epoch_ms(ts) // 3600000 AS b FROM both_sides WHERE side = 'wallet' AND NOT no_time),
j AS (SELECT px.id AS pid, w.id AS wid, px.type, px.amount AS pa, w.amount AS wa, px.party AS pp, w.party AS wp, px.e AS pe, w.e AS we, CASE WHEN px.type = 'COLLECT' THEN px.e - w.e ELSE w.e - px.e END AS lag FROM px JOIN w ON px.type = w.type AND px.b = w.b),
c AS (SELECT *, CASE WHEN abs(pa - wa) <= 0.5 THEN 0
   WHEN type = 'COLLECT' AND abs(pa - floor(wa * 1.1 * 100 + 0.5) / 100) <= 0.5 + wa * 0.001 THEN 10
   WHEN type = 'COLLECT' AND abs(pa - floor(wa * 1.2 * 100 + 0.5) / 100) <= 0.5 + wa * 0.001 THEN 20 END AS bonus FROM j)
"""
_MOST = "CASE WHEN type = 'COLLECT' THEN 1800000 ELSE 3600000 END"


@query(_CAND + f"SELECT pid, wid, type, CAST(lag AS BIGINT) AS lag, bonus FROM c WHERE bonus IS NOT NULL AND lag BETWEEN 0 AND {_MOST}")
def candidate_pairs(spark, sf_dir):
    """Band join of panel and wallet with its amount rule."""
    return matching.candidates(*_sides(spark, sf_dir), Params()).select(F.col("p_id").alias("pid"), F.col("w_id").alias("wid"), "type", "lag", "bonus")


@query(_CAND + "SELECT pid, wid, type, CAST(lag AS BIGINT) AS lag, bonus FROM c WHERE bonus IS NOT NULL AND lag BETWEEN -120000 AND -1")
def inverted_pairs(spark, sf_dir):
    """Pairs in the wrong order, within the clocks' tolerance."""
    return matching.candidates(*_sides(spark, sf_dir), Params(), inverted=True).select(F.col("p_id").alias("pid"), F.col("w_id").alias("wid"), "type", "lag", "bonus")


@query(_CAND + f", x AS (SELECT pid, wid FROM c WHERE bonus IS NOT NULL AND lag BETWEEN 0 AND {_MOST}) SELECT pid, count(*) AS n_wallet, CAST(sum(n) AS BIGINT) AS n_rivals FROM (SELECT pid, count(*) OVER (PARTITION BY wid) AS n FROM x) GROUP BY pid")
def candidate_counts(spark, sf_dir):
    """How many wallet rows each panel row could take, and how many panel rows want those."""
    counts, _ = matching.candidate_totals(*_sides(spark, sf_dir), Params())
    return counts.select(F.col("id").alias("pid"), F.col("n").alias("n_wallet"), F.col("total").alias("n_rivals"))


_TOTALS = """round(sum(CASE WHEN type = 'COLLECT' THEN amount ELSE 0 END), 2) AS collects, round(sum(CASE WHEN type = 'PAYOUT' THEN amount ELSE 0 END), 2) AS payouts,
 round(sum(CASE WHEN type = 'BONUS' THEN amount ELSE 0 END), 2) AS bonuses, CAST(count(*) FILTER (type = 'COLLECT') AS BIGINT) AS n_collects, CAST(count(*) FILTER (type = 'PAYOUT') AS BIGINT) AS n_payouts"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in ("collects", "payouts", "bonuses")}).drop("internals", "fees", "net")


@query(_MOVES + f"SELECT side, {_TOTALS} FROM both_sides GROUP BY side")
def totals_by_side(spark, sf_dir):
    p, w = _sides(spark, sf_dir)
    return _rounded(report.totals(p.unionByName(w), "side"))


@query(_MOVES + f"SELECT side, account, {_TOTALS} FROM both_sides GROUP BY side, account")
def totals_by_account(spark, sf_dir):
    p, w = _sides(spark, sf_dir)
    return _rounded(report.totals(p.unionByName(w), "side", "account"))


@query(_MOVES + f"SELECT CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) AS VARCHAR) AS op_day, side, {_TOTALS} FROM both_sides GROUP BY ALL")
def totals_by_operational_day(spark, sf_dir):
    p, w = _sides(spark, sf_dir)
    own = p.unionByName(w).withColumn("op_day", times.operational_day(F.col("ts")).cast("string"))
    return _rounded(report.totals(own, "op_day", "side"))


@query(_MOVES + f"SELECT CASE WHEN hour(ts) BETWEEN 6 AND 13 THEN 'Shift 1' WHEN hour(ts) BETWEEN 14 AND 21 THEN 'Shift 2' ELSE 'Shift 3' END AS shift, {_TOTALS} FROM both_sides GROUP BY ALL")
def totals_by_shift(spark, sf_dir):
    p, w = _sides(spark, sf_dir)
    return _rounded(report.totals(p.unionByName(w).withColumn("shift", times.shift_of(F.col("ts"))), "shift"))


@query(_MOVES + "SELECT CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) AS VARCHAR) AS op_day, count(*) AS n FROM both_sides GROUP BY ALL ORDER BY n DESC, op_day LIMIT 1")
def busiest_day(spark, sf_dir):
    p, w = _sides(spark, sf_dir)
    return report.suggested_day(p.unionByName(w)).withColumn("op_day", F.col("op_day").cast("string"))


# the pairs that stem from one event, as matches whose lags can be told in SQL too
_PAIRS = _CAND + ", m AS (SELECT p.id || '=' || w.id AS match_id, p.type, p.account AS agent, ' ' || w.account AS wallet_account, p.ts AS panel_ts, CAST(CASE WHEN p.type = 'COLLECT' THEN epoch_ms(p.ts) - epoch_ms(w.ts) ELSE epoch_ms(w.ts) - epoch_ms(p.ts) END AS BIGINT) AS lag_ms FROM panel p JOIN wallet w USING (k) WHERE p.id[1] = 'p' AND w.id[1] = 'w' AND NOT w.no_time)\n"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ledgers.panel(spark, sf_dir).filter("id like 'p%'").select("k", "id", "type", F.col("ts").alias("panel_ts"), F.col("account").alias("agent"))
    w = ledgers.wallet(spark, sf_dir).filter("id like 'w%' and not no_time").select("k", F.col("id").alias("wid"), F.col("ts").alias("wts"), F.concat(F.lit(" "), "account").alias("wallet_account"))
    lag = matching.lag(F.col("type"), times.to_ms(F.col("panel_ts")), times.to_ms(F.col("wts")))
    return p.join(w, "k").select(F.concat("id", F.lit("="), "wid").alias("match_id"), "type", "agent", "wallet_account", "panel_ts", lag.alias("lag_ms"))


_STATS = "count(*) AS n, round(avg(lag_ms), 3) AS mean, CAST(median(lag_ms) AS DOUBLE) AS median, CAST(quantile_disc(lag_ms, 0.9) AS BIGINT) AS p90, max(lag_ms) AS longest, min(lag_ms) AS shortest"


@query(_PAIRS + f"SELECT type, {_STATS} FROM m GROUP BY type")
def lag_statistics(spark, sf_dir):
    return report.lag_stats(_pairs(spark, sf_dir), "type").withColumn("mean", F.round("mean", 3))


@query(_PAIRS + f", g AS (SELECT *, CASE WHEN hour(panel_ts) BETWEEN 6 AND 13 THEN 'Shift 1' WHEN hour(panel_ts) BETWEEN 14 AND 21 THEN 'Shift 2' ELSE 'Shift 3' END AS shift FROM m) SELECT type, CASE grouping(shift, agent, wallet_account) WHEN 7 THEN 'all' WHEN 3 THEN 'shift' WHEN 5 THEN 'agent' ELSE 'account' END AS \"grouping\", coalesce(shift, agent, wallet_account, '') AS group_key, {_STATS} FROM g GROUP BY GROUPING SETS ((type), (type, shift), (type, agent), (type, wallet_account))")
def lag_by_group(spark, sf_dir):
    """Overall, by shift, by agent and by wallet account in one pass."""
    return report.lag_report(_pairs(spark, sf_dir)).withColumn("mean", F.round("mean", 3))


@query(_PAIRS + ", f AS (SELECT t AS type, i AS place, n AS lag_class, lo, hi FROM (VALUES ('COLLECT'), ('PAYOUT')) a(t), (VALUES (0, 'under 1 min', -1, 60000), (1, '1 to 5 min', 60000, 300000), (2, '5 to 15 min', 300000, 900000), (3, '15 to 30 min', 900000, 1800000), (4, 'over 30 min', 1800000, 9000000000)) b(i, n, lo, hi)) SELECT f.type, place, lag_class, count(m.lag_ms) AS n FROM f LEFT JOIN m ON m.type = f.type AND greatest(0, lag_ms) >= lo AND greatest(0, lag_ms) < hi GROUP BY ALL")
def lag_histogram(spark, sf_dir):
    return report.lag_histogram(_pairs(spark, sf_dir))


@query(_PAIRS + "SELECT match_id, type, lag_ms FROM m ORDER BY lag_ms DESC, match_id LIMIT 20")
def slowest_matches(spark, sf_dir):
    return report.slowest(_pairs(spark, sf_dir)).select("match_id", "type", "lag_ms")


_VOID = """, o AS (SELECT id, ts, epoch_ms(ts) AS e, type, amount, regexp_replace(lower(party), '[^a-z0-9]+', '', 'g') AS u, account FROM both_sides WHERE side = 'panel' AND type <> 'BONUS')
SELECT a.id AS a_id, b.id AS b_id, CAST(b.e - a.e AS BIGINT) AS gap FROM o a JOIN o b ON a.u = b.u AND a.account = b.account AND a.type <> b.type AND abs(a.amount - b.amount) <= 0.5 AND b.e - a.e BETWEEN 0 AND 1800000 AND a.id <> b.id"""


@query(_MOVES + _VOID)
def void_candidates(spark, sf_dir):
    """Panel rows of one user that may undo each other."""
    p, _ = _sides(spark, sf_dir)
    own = p.filter("type <> 'BONUS'").withColumns({"user": names.norm(F.col("party")), "agent": F.col("account")})
    side = lambda x: own.select("user", "agent", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "ms", "amount", "type")))
    pairs = band_join(side("a"), side("b"), ["user", "agent"], "a_ms", "b_ms", 0, 30 * MINUTE)
    return pairs.filter((F.col("a_id") != F.col("b_id")) & (F.col("a_type") != F.col("b_type")) & (F.abs(F.col("a_amount") - F.col("b_amount")) <= 0.5)).select("a_id", "b_id", (F.col("b_ms") - F.col("a_ms")).alias("gap"))


@query(_MOVES + """, q AS (SELECT id, epoch_ms(ts) AS e, amount, array_to_string(list_filter(regexp_split_to_array(lower(party), '[^a-z]+'), lambda t: len(t) >= 2), ' ') AS name FROM both_sides WHERE side = 'wallet' AND type = 'PAYOUT' AND party <> '')
SELECT DISTINCT a.id FROM q a JOIN q b ON a.name = b.name AND a.id <> b.id AND abs(a.amount - b.amount) <= 0.5 AND abs(a.e - b.e) <= 3600000 AND (b.id[1] = 'w' OR b.e < a.e) WHERE a.id[1] <> 'w'""")
def duplicate_payouts(spark, sf_dir):
    """Payouts beside the main ones that have a twin of the same holder within the hour: a main one, or an earlier one of their own."""
    _, w = _sides(spark, sf_dir)
    main = F.col("id").startswith("w")
    return matching.duplicates(w.filter(~main), w.filter(main), Params())


@query(_MOVES + """, u AS (SELECT DISTINCT p.party AS user_name, w.party AS holder FROM panel p JOIN wallet w USING (k)),
rs AS (SELECT user_name, regexp_extract_all(lower(user_name), '[a-z]+') AS rs FROM (SELECT DISTINCT user_name FROM u)),
r AS (SELECT user_name, unnest(CASE WHEN len(rs) > 1 THEN list_append(rs, array_to_string(rs, '')) ELSE rs END) AS r FROM rs),
w2 AS (SELECT holder, unnest(regexp_split_to_array(lower(holder), '[^a-z]+')) AS w FROM (SELECT DISTINCT holder FROM u)),
h AS (SELECT DISTINCT u.user_name, u.holder FROM u JOIN r USING (user_name) JOIN w2 USING (holder) WHERE len(r) >= 4 AND len(w) >= 3 AND (starts_with(w, r) OR starts_with(r, w) OR (len(r) >= 5 AND contains(w, r))
  OR (len(r) >= 5 AND least(levenshtein(r, w[:len(r)]), levenshtein(r, w[:len(r) + 1])) <= 1) OR (len(w) >= 5 AND len(r) > len(w) AND contains(r, w)) OR (len(r) = 4 AND len(w) >= 5 AND levenshtein(r, w[:5]) = 1 AND r[1] = w[1])))
SELECT u.user_name, u.holder, h.user_name IS NOT NULL AS hint FROM u LEFT JOIN h USING (user_name, holder)""")
def name_hints(spark, sf_dir):
    """Which user names resemble the holders they meet."""
    p = ledgers.panel(spark, sf_dir).select("k", F.col("party").alias("user_name"))
    w = ledgers.wallet(spark, sf_dir).select("k", F.col("party").alias("holder"))
    pairs = p.join(w, "k").select("user_name", "holder").distinct()
    return pairs.withColumn("hint", names.name_hint(F.col("user_name"), F.col("holder")))


@query("""SELECT event_id, replace(replace(replace(format('{:,.2f}', value), ',', '#'), '.', ','), '#', '.') AS money, value AS rounded,
 lpad(CAST(day(ts) AS VARCHAR), 2, '0') || '/' || lpad(CAST(month(ts) AS VARCHAR), 2, '0') || '/' || year(ts) || ' ' || strftime(ts, '%H:%M:%S') AS written, epoch_ms(date_trunc('second', ts)) AS read_ms FROM events""".replace("value AS rounded", "floor(value * 100 + 0.5) / 100 AS rounded").replace("format('{:,.2f}', value)", "format('{:,.2f}', floor(value * 100 + 0.5) / 100)"))
def parsing(spark, sf_dir):
    """Money and times written the local way, and read back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", numbers.round2(F.col("value")).alias("v"))
    out = e.withColumns({"money": numbers.format_money(F.col("v")), "written": F.date_format("ts", "dd/MM/yyyy HH:mm:ss")})
    return out.select("event_id", "money", numbers.parse_number(F.col("money")).alias("rounded"), "written", times.to_ms(times.parse_datetime(F.col("written"))).alias("read_ms"))


@query("""WITH d AS (SELECT event_id, abs(epoch_ms(ts) % 20000000) AS ms FROM events), s AS (SELECT event_id, ms, CAST(floor(ms / 1000.0 + 0.5) AS BIGINT) AS s FROM d)
SELECT event_id, concat_ws(' ', CASE WHEN s >= 3600 THEN (s // 3600) || ' h' END, CASE WHEN s % 3600 >= 60 THEN (s % 3600 // 60) || ' min' END, CASE WHEN s < 3600 AND (s % 60 > 0 OR s < 60) THEN (s % 60) || ' s' END) AS duration FROM s""")
def durations(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.abs(times.to_ms(F.col("ts")) % 20_000_000)
    return e.select("event_id", times.format_duration(ms).alias("duration"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events WHERE event_id % 3 <> 0)
SELECT event_id FROM e WHERE r = 1 UNION ALL SELECT event_id FROM events WHERE event_id % 3 = 0""")
def first_of_reference(spark, sf_dir):
    """Rows with a reference stay once for each origin, reference and type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = e.select("event_id", F.lit("x").alias("origin"), F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string")).alias("ref"), F.col("event_type").alias("type"))
    return dedup.keep_first(own, "event_id").select("event_id")


@query("""WITH b AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) || '|' || event_type AS base FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY event_id) AS n FROM b)
SELECT event_id, 'x|' || base || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS id FROM r""")
def stable_movement_ids(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = e.select("event_id", F.lit("x").alias("origin"), F.col("user_id").cast("string").alias("ref"), F.col("event_type").alias("type"), times.to_ms(F.col("ts")).alias("ms"), F.col("value").alias("amount"), F.lit("").alias("party"))
    return dedup.stable_ids(own, "event_id").select("event_id", "id")


@query(_MOVES + """, a AS (SELECT id, type, amount, epoch_ms(ts) AS e FROM both_sides WHERE side = 'panel' AND type = 'PAYOUT'), b AS (SELECT id, type, amount, epoch_ms(ts) AS e FROM both_sides WHERE side = 'wallet' AND type = 'PAYOUT'),
r AS (SELECT a.id, b.id AS near_id, CAST(b.e - a.e AS BIGINT) AS apart, row_number() OVER (PARTITION BY a.id ORDER BY abs(b.e - a.e), b.id) AS n FROM a JOIN b ON a.amount = b.amount AND abs(a.e - b.e) <= 10800000) SELECT id, near_id, apart FROM r WHERE n = 1""")
def nearest_payout(spark, sf_dir):
    """For each withdrawal the closest payout of the same amount within three hours."""
    p, w = _sides(spark, sf_dir)
    side = lambda d, x: d.filter("type = 'PAYOUT'").select("amount", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "ms")))
    got = nearest(side(p, "a"), side(w, "b"), ["amount"], "a_id", "a_ms", "b_ms", 180 * MINUTE, "b_id")
    return got.select(F.col("a_id").alias("id"), F.col("b_id").alias("near_id"), (F.col("b_ms") - F.col("a_ms")).alias("apart"))


@query(_MOVES + """, w AS (SELECT account, epoch_ms(ts) AS e FROM both_sides WHERE side = 'wallet' AND NOT no_time), c AS (SELECT account, e // 86400000 AS day, min(e) - 1800000 AS lo, max(e) + 1800000 AS hi FROM w GROUP BY ALL)
SELECT account, CAST(day AS BIGINT) AS day, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM c""")
def wallet_coverage(spark, sf_dir):
    """The spans of time that each wallet account covers, by day."""
    _, w = _sides(spark, sf_dir)
    return diagnosis.coverage(w.filter(~F.col("no_time"))).select("account", "day", "lo", "hi")


_LINES = {"North": ("agent0", "agent1"), "South": ("agent3",)}


@query(_MOVES + """SELECT min(CASE WHEN epoch_ms(ts) % 2 = 0 THEN account ELSE 'AGENT-' || account[6:] END) FILTER (rn = 1) AS account, count(*) AS n, CASE WHEN key IN ('agent0', 'agent1') THEN 'North' WHEN key = 'agent3' THEN 'South' END AS line
FROM (SELECT *, account AS key, row_number() OVER (PARTITION BY account ORDER BY ts, CASE WHEN epoch_ms(ts) % 2 = 0 THEN account ELSE 'AGENT-' || account[6:] END) AS rn FROM both_sides WHERE side = 'panel') GROUP BY key""")
def agent_inventory(spark, sf_dir):
    """Movements and line of each agent, written in two ways."""
    p, _ = _sides(spark, sf_dir)
    p = p.withColumn("account", F.when(F.col("ms") % 2 == 0, F.col("account")).otherwise(F.concat(F.lit("AGENT-"), F.substring("account", 6, 9)))).drop("load_seq")
    return dataset.agent_inventory(p, _LINES).select("account", "n", "line")


@query(_MOVES + "SELECT account, count(*) AS n FROM both_sides WHERE side = 'panel' AND account NOT IN ('agent0', 'agent1') GROUP BY account")
def excluded_agents(spark, sf_dir):
    """Rows left out when one line's agents are chosen."""
    p, _ = _sides(spark, sf_dir)
    return dataset.excluded_counts(dataset.choose_agents(p, _LINES, line="North")[1])


@query(_MOVES + "SELECT account AS source, count(*) AS n, (epoch_us(min(ts)) // 1000) AS first_ms, (epoch_us(max(ts)) // 1000) AS last_ms FROM both_sides WHERE side = 'wallet' GROUP BY account")
def source_coverage(spark, sf_dir):
    """Number, first and last time of each wallet account's rows, as of a source's."""
    _, w = _sides(spark, sf_dir)
    got = dataset.source_coverage(w.withColumn("source", F.col("account")))
    return got.select("source", "n", times.to_ms(F.col("first_ts")).alias("first_ms"), times.to_ms(F.col("last_ts")).alias("last_ms"))


@query(_MOVES + "SELECT DISTINCT CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) AS VARCHAR) AS op_day FROM both_sides")
def operational_days(spark, sf_dir):
    p, w = _sides(spark, sf_dir)
    return report.days(p.unionByName(w)).select(F.col("op_day").cast("string").alias("op_day"))


@query(_MOVES + """, h AS (SELECT party AS user_name, account, count(*) AS n FROM both_sides WHERE side = 'panel' AND type = 'COLLECT' GROUP BY ALL UNION ALL SELECT party, account, 2 * count(*) FROM both_sides WHERE side = 'panel' AND type = 'PAYOUT' GROUP BY ALL)
SELECT user_name, account, CAST(max(n) AS BIGINT) AS n FROM h GROUP BY ALL""")
def merged_aliases(spark, sf_dir):
    """Two alias tables (users with the agents of their collects, and of their payouts, these counted twice) as one, with the larger number of each."""
    p, _ = _sides(spark, sf_dir)
    of = lambda kind, times: p.filter(F.col("type") == kind).groupBy("party", "account").agg((F.count("*") * times).alias("n")).select(F.col("party").alias("user_key"), F.col("party").alias("user"), F.col("account").alias("id_key"), F.col("account").alias("label"), "n")
    return dataset.merge_aliases(of("COLLECT", 1), of("PAYOUT", 2)).select(F.col("user").alias("user_name"), F.col("label").alias("account"), "n")


def _run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return matching.reconcile(ledgers.panel(spark, sf_dir), ledgers.wallet(spark, sf_dir))


@query()
def reconciled(spark, sf_dir):
    """The whole run's matches."""
    m = _run(spark, sf_dir)["matches"]
    return m.select("match_id", "type", "status", "note", "panel_amount", "wallet_amount", "difference", "lag_ms", "confidence")


@query()
def pending_with_reasons(spark, sf_dir):
    """What stays alone in the whole run, and why."""
    r = _run(spark, sf_dir)
    full = diagnosis.diagnose(r["pending"], r["panel"], r["wallet"], tolerance=Params().amount_tolerance)
    return full.select("id", "side", "type", "amount", "status", "reason", "near_id")


@query()
def daily_consolidation(spark, sf_dir):
    """One row for each operational day and one for all."""
    r = _run(spark, sf_dir)
    return report.daily(r["panel"], r["wallet"], r["matches"], r["pending"])
