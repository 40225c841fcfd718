"""Totals, progress, latency statistics and daily consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round2
from ..functions.times import DAY_START_HOUR, SHIFTS, operational_day, shift_of
from ..plans import params as P

#: Upper ends in ms (not included) and names of the latency classes; the last has none.
LAG_CLASSES = ((60_000, "under 1 min"), (300_000, "1 to 5 min"), (900_000, "5 to 15 min"), (1_800_000, "15 to 30 min"), (None, "over 30 min"))


def totals(moves: DataFrame, *by: str) -> DataFrame:
    """Sums and counts by type, and net = collects - payouts, for each group of ``by``."""
    total = lambda kind: round2(F.sum(F.when(F.col("type") == kind, F.col("amount")).otherwise(0.0)))
    got = moves.groupBy(*by).agg(
        total("COLLECT").alias("collects"), total("PAYOUT").alias("payouts"), total("BONUS").alias("bonuses"), total("INTERNAL").alias("internals"), total("FEE").alias("fees"),
        F.count_if(F.col("type") == "COLLECT").alias("n_collects"), F.count_if(F.col("type") == "PAYOUT").alias("n_payouts"),
    )
    return got.withColumn("net", round2(F.col("collects") - F.col("payouts")))


def by_status(matches: DataFrame, pending: DataFrame) -> DataFrame:
    """Count and signed sums of every status, matched ones first, then by count."""
    sign = F.when(F.col("type") == "PAYOUT", -1).otherwise(1)
    m = matches.groupBy("status").agg(F.count("*").alias("n"), round2(F.sum(F.col("panel_amount") * sign)).alias("panel_amount"), round2(F.sum(F.col("wallet_amount") * sign)).alias("wallet_amount")).withColumn("kind", F.lit("matched"))
    own = F.when(F.col("type") == "COLLECT", 1).when(F.col("type") == "PAYOUT", -1).otherwise(0)
    p = pending.groupBy("status").agg(
        F.count("*").alias("n"), round2(F.sum(F.when(F.col("side") == "panel", own * F.col("amount")).otherwise(0.0))).alias("panel_amount"),
        round2(F.sum(F.when(F.col("side") != "panel", F.when(own == 0, -1).otherwise(own) * F.col("amount")).otherwise(0.0))).alias("wallet_amount"),
    ).withColumn("kind", F.lit("pending"))
    return m.unionByName(p).orderBy("kind", F.desc("n"), "status")


def progress(panel: DataFrame, matches: DataFrame, pending: DataFrame) -> DataFrame:
    """How many of the panel's matchable rows are matched or voided."""
    able = panel.agg(F.count_if(F.col("type").isin(*P.MATCHABLE)).alias("n_operable"))
    done = matches.agg(F.coalesce(F.sum(F.size("panel_ids")), F.lit(0)).alias("n_matched"))
    void = pending.agg(F.count_if(F.col("status") == P.PANEL_VOID).alias("n_void"))
    one = able.select("n_operable", done.scalar().alias("n_matched"), void.scalar().alias("n_void"))
    return one.select("n_operable", (F.col("n_matched") + F.col("n_void")).alias("n_resolved"), F.when(F.col("n_operable") > 0, (F.col("n_matched") + F.col("n_void")) / F.col("n_operable")).otherwise(0.0).alias("progress"))


def lag_stats(matches: DataFrame, *by: str, lag: str = "lag_ms") -> DataFrame:
    """Count, mean, median, nearest-rank 90th percentile, maximum and minimum of the lags that are known."""
    known = matches.filter(F.col(lag).isNotNull())
    return known.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(lag).alias("mean"), F.median(lag).alias("median"), F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY {lag})").cast("long").alias("p90"), F.max(lag).alias("longest"), F.min(lag).alias("shortest")
    )


def lag_class(lag: Column) -> Column:
    """The latency class; negative lags count as none."""
    out = F.lit(LAG_CLASSES[-1][1])
    for end, name in reversed(LAG_CLASSES[:-1]):
        out = F.when(F.greatest(lag, F.lit(0)) < end, name).otherwise(out)
    return out


def lag_histogram(matches: DataFrame, lag: str = "lag_ms") -> DataFrame:
    """Number of matches of each type and latency class; empty classes stay with 0."""
    spark = matches.sparkSession
    frame = spark.createDataFrame([(t, i, n) for t in P.MATCHABLE for i, (_, n) in enumerate(LAG_CLASSES)], "type string, place int, lag_class string")
    counts = matches.filter(F.col(lag).isNotNull()).groupBy("type", lag_class(F.col(lag)).alias("lag_class")).agg(F.count("*").alias("n"))
    return frame.join(counts, ["type", "lag_class"], "left").select("type", "place", "lag_class", F.coalesce("n", F.lit(0)).alias("n"))


def lag_report(matches: DataFrame, shifts=SHIFTS, lag: str = "lag_ms") -> DataFrame:
    """Lag statistics by type: overall, by shift, by agent and by wallet account, in one pass of grouping sets."""
    own = matches.filter(F.col(lag).isNotNull()).withColumns({"shift": shift_of(F.col("panel_ts"), shifts), "agent": F.coalesce("agent", F.lit("(no agent)")), "wallet_account": F.coalesce("wallet_account", F.lit(""))})
    return own.sparkSession.sql(
        f"""SELECT type, CASE grouping_id() WHEN 7 THEN 'all' WHEN 3 THEN 'shift' WHEN 5 THEN 'agent' ELSE 'account' END AS grouping,
        coalesce(shift, agent, wallet_account, '') AS group_key, count(*) AS n, avg({lag}) AS mean, median({lag}) AS median,
        CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY {lag}) AS BIGINT) AS p90, max({lag}) AS longest, min({lag}) AS shortest
        FROM {{own}} GROUP BY GROUPING SETS ((type), (type, shift), (type, agent), (type, wallet_account))""", own=own)  # fmt: skip


def slowest(matches: DataFrame, n: int = 20, lag: str = "lag_ms") -> DataFrame:
    """The n matches of the longest lag."""
    return matches.filter(F.col(lag).isNotNull()).orderBy(F.desc(lag), "match_id").limit(n)


def days(moves: DataFrame, start_hour: int = DAY_START_HOUR) -> DataFrame:
    """The operational days that have movements."""
    return moves.select(operational_day(F.col("ts"), start_hour).alias("op_day")).distinct()


def suggested_day(moves: DataFrame, start_hour: int = DAY_START_HOUR) -> DataFrame:
    """The operational day with most movements, the earliest of equals."""
    return moves.groupBy(operational_day(F.col("ts"), start_hour).alias("op_day")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "op_day").limit(1)


def in_window(df: DataFrame, ts: str, first_day, last_day, start_hour: int = DAY_START_HOUR) -> DataFrame:
    """Rows from the start of the first operational day to the end of the last, whichever is given first."""
    day = operational_day(F.col(ts), start_hour)
    a, b = F.to_date(F.lit(first_day)), F.to_date(F.lit(last_day))
    return df.filter((day >= F.least(a, b)) & (day <= F.greatest(a, b)))


def daily(panel: DataFrame, wallet: DataFrame, matches: DataFrame, pending: DataFrame, start_hour: int = DAY_START_HOUR) -> DataFrame:
    """One row for each operational day, and one with a null day for all of them.

    A match counts for the day of its first panel row (else of itself), with all its members.
    """
    day = lambda c: operational_day(c, start_hour)
    own = matches.withColumn("op_day", day(F.coalesce("panel_ts", "ts")))
    of_match = own.select("op_day", F.explode(F.concat("panel_ids", "wallet_ids")).alias("id"))
    both = panel.unionByName(wallet).select("id", "side", "type", "amount", "ts")
    placed = both.join(of_match, "id", "left").withColumn("op_day", F.coalesce("op_day", day(F.col("ts"))))
    amount = lambda side, kind: F.sum(F.when((F.col("side") == side) & (F.col("type") == kind), F.col("amount")).otherwise(0.0))
    sums = placed.rollup("op_day").agg(
        *(round2(amount(s, k)).alias(f"{s}_{n}") for s in ("panel", "wallet") for k, n in (("COLLECT", "collects"), ("PAYOUT", "payouts"))),
        F.count_if((F.col("side") == "panel") & F.col("type").isin(*P.MATCHABLE)).alias("n_operable"), F.grouping("op_day").alias("g"),
    )
    left = pending.withColumn("op_day", day(F.col("ts"))).rollup("op_day").agg(
        F.count_if((F.col("side") == "panel") & (F.col("status") != P.PANEL_VOID)).alias("pending_panel"), F.count_if(F.col("side") != "panel").alias("pending_wallet"),
        F.count_if(F.col("status") == P.PANEL_VOID).alias("n_void"), F.grouping("op_day").alias("g"),
    )
    done = own.rollup("op_day").agg(F.sum(F.size("panel_ids")).alias("n_done"), F.grouping("op_day").alias("g"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    on = lambda other: sums["op_day"].eqNullSafe(other["op_day"]) & (sums["g"] == other["g"])
    full = sums.join(left, on(left), "left").join(done, on(done), "left")
    resolved = zero(F.col("n_done")) + zero(F.col("n_void"))
    net = round2(F.col("panel_collects") - F.col("panel_payouts") - F.col("wallet_collects") + F.col("wallet_payouts"))
    return full.select(
        sums["op_day"], "panel_collects", "panel_payouts", "wallet_collects", "wallet_payouts", net.alias("net_difference"), "n_operable", resolved.alias("n_resolved"),
        zero(F.col("pending_panel")).alias("pending_panel"), zero(F.col("pending_wallet")).alias("pending_wallet"),
        F.when(F.col("n_operable") > 0, resolved / F.col("n_operable")).otherwise(0.0).alias("progress"),
    )
