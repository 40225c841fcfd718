"""Why a movement stayed alone: the first reason that applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import format_money
from ..functions.times import DAY_MS, from_ms, to_ms
from ..plans import params as P
from .joins import nearest

ACTIONABLE = (P.COLLECT_NO_CHIPS, P.CHIPS_NO_COLLECT, P.WITHDRAWAL_NO_PAYOUT, P.PAYOUT_NO_WITHDRAWAL)
POSSIBLE_PAIR, OTHER_AGENT, NO_PANEL_COVERAGE, NO_WALLET_COVERAGE, NO_SUCH_AMOUNT = "POSSIBLE_PAIR", "OTHER_AGENT", "NO_PANEL_COVERAGE", "NO_WALLET_COVERAGE", "NO_SUCH_AMOUNT"
_NEAR, _MARGIN = 3 * 3_600_000, 30 * P.MINUTE


def coverage(moves: DataFrame) -> DataFrame:
    """From 30 minutes before the first to 30 after the last movement of each origin, account and day;
    rows without a time cover their slots, or else their whole day."""
    day = F.floor(F.col("ms") / DAY_MS)
    start = F.col("ms") - F.pmod(F.col("ms"), F.lit(DAY_MS))
    slots = F.transform("slots", lambda s: F.struct(to_ms(s["from_ts"]).alias("lo"), to_ms(s["to_ts"]).alias("hi")))
    whole = F.array(F.struct(start.alias("lo"), (start + DAY_MS).alias("hi")))
    loose = moves.filter("no_time").select("side", "origin", "account", day.alias("day"), F.inline(F.coalesce(slots, whole)))
    return loose.unionByName(_timed(moves.filter("not no_time"), day))


def _timed(moves: DataFrame, day) -> DataFrame:
    return moves.groupBy("side", "origin", "account", day.alias("day")).agg((F.min("ms") - _MARGIN).alias("lo"), (F.max("ms") + _MARGIN).alias("hi"))


def _closest(rows: DataFrame, others: DataFrame, tolerance: float) -> DataFrame:
    """For each row the nearest other of equal type and amount, within three hours (a day if either has no time); of equally near ones the smallest id.

    Rows meet the amounts that suit theirs, and of each amount the rows next to them in time, so no pairs are made.
    """
    a = rows.select("type", F.col("id").alias("a_id"), F.col("ms").alias("a_ms"), F.col("amount").alias("a_amount"), F.col("no_time").alias("a_no"))
    b = others.select("type", F.col("id").alias("b_id"), F.col("ms").alias("b_ms"), F.col("amount").alias("b_amount"), F.col("no_time").alias("b_no"))
    unit = max(0.01, tolerance)
    own = a.select("type", "a_amount").distinct().withColumn("unit", F.explode(F.array(*(F.floor(F.col("a_amount") / unit) + i for i in (-1, 0, 1)))))
    other = b.select("type", "b_amount").distinct().withColumn("unit", F.floor(F.col("b_amount") / unit))
    suit = own.join(other, ["type", "unit"]).filter(F.abs(F.col("a_amount") - F.col("b_amount")) <= tolerance).drop("unit")
    a = a.join(suit, ["type", "a_amount"])
    near = lambda x, y, reach: nearest(x.drop("a_no"), y.drop("b_no"), ["type", "b_amount"], "a_id", "a_ms", "b_ms", reach, "b_id").select("a_id", "b_id", "a_ms", "b_ms")
    found = near(a.filter("not a_no"), b.filter("not b_no"), _NEAR).unionByName(near(a.filter("a_no"), b, DAY_MS - 1)).unionByName(near(a.filter("not a_no"), b.filter("b_no"), DAY_MS - 1))
    best = found.groupBy(F.col("a_id").alias("id")).agg(F.min(F.struct(F.abs(F.col("a_ms") - F.col("b_ms")).alias("apart"), F.col("b_id").alias("near_id"), (F.col("b_ms") - F.col("a_ms")).alias("near_ms"))).alias("n"))
    return best.select("id", "n.near_id", "n.near_ms")


def _who(party: Column, account: Column) -> Column:
    return F.array_join(F.filter(F.array(party, account), lambda x: F.coalesce(x, F.lit("")) != ""), " · ")


def _when(ms: Column, no_time: Column) -> Column:
    ts = from_ms(ms)
    return F.concat(F.date_format(ts, "dd/MM/yyyy "), F.when(no_time, "n/t").otherwise(F.date_format(ts, "HH:mm")))


def why_apart(kind: Column, p_ms: Column, w_ms: Column, timeless: Column, params: P.Params) -> Column:
    """Why a possible pair was not joined by itself, from the clocks of its panel and wallet rows."""
    apart = F.floor(F.abs(p_ms - w_ms) / P.MINUTE + 0.5).cast("long")
    text = apart.cast("string")
    tol, most = params.clock_tolerance * P.MINUTE, F.when(kind == "COLLECT", params.max_collect_lag).otherwise(params.max_payout_lag)
    return (
        F.when(timeless, "no time, and more than one candidate")
        .when((kind == "COLLECT") & (w_ms > p_ms + tol), F.concat(F.lit("the money shows "), text, F.lit(" min after the load")))
        .when((kind == "PAYOUT") & (w_ms < p_ms - tol), F.concat(F.lit("the payment shows "), text, F.lit(" min before the withdrawal")))
        .when(apart > most, F.concat(text, F.lit(" min apart (at most "), most.cast("string"), F.lit(")")))
        .otherwise("another equal movement competes for the pair")
    )


def diagnose(pending: DataFrame, panel: DataFrame, wallet: DataFrame, excluded: DataFrame | None = None, tolerance: float = 0.01, params: P.Params | None = None) -> DataFrame:
    """Add ``reason``, ``detail_text`` (the reason in words), ``near_id`` and ``near_ms`` to the actionable rows of ``pending``; null for all others.

    ``panel`` and ``wallet`` are all loaded movements (for coverage), ``excluded`` the panel rows of filtered agents; ``params`` has the lags that the words name.
    """
    params = params or P.Params()
    own = pending.filter(F.col("status").isin(*ACTIONABLE))
    p, w = own.filter("side = 'panel'"), own.filter("side <> 'panel'")
    near = _closest(p, w, tolerance).unionByName(_closest(w, p, tolerance))
    other = _closest(w, excluded, tolerance) if excluded is not None else None
    hour = 3_600_000
    bands = coverage(panel.filter("not no_time").unionByName(wallet)).select("side", F.explode(F.sequence(F.floor(F.col("lo") / hour), F.floor(F.col("hi") / hour))).alias("h"), "lo", "hi")
    facing = own.select("id", "ms", F.when(F.col("side") == "panel", "wallet").otherwise("panel").alias("side"), F.floor(F.col("ms") / hour).alias("h"))
    seen = facing.join(bands, ["side", "h"]).filter((F.col("ms") >= F.col("lo")) & (F.col("ms") < F.col("hi"))).select("id").distinct().withColumn("covered", F.lit(True))
    full = own.select("id", "side", "type", "ms", "amount", "no_time").join(near, "id", "left").join(seen, "id", "left")
    full = full.withColumn("o_id", F.lit(None).cast("string")) if other is None else full.join(other.select("id", F.col("near_id").alias("o_id")), "id", "left")
    mine = F.col("side") == "panel"
    reason = (
        F.when(F.col("near_id").isNotNull(), POSSIBLE_PAIR).when(F.col("o_id").isNotNull(), OTHER_AGENT)
        .when(~mine & ~F.col("no_time") & F.col("covered").isNull(), NO_PANEL_COVERAGE)
        .when(mine & F.col("covered").isNull(), NO_WALLET_COVERAGE).otherwise(NO_SUCH_AMOUNT)
    )
    full = full.withColumns({"reason": reason, "near_id": F.coalesce("near_id", "o_id")})
    shape = lambda d: d.select(F.col("id").alias("n_id"), F.col("party").alias("n_party"), F.col("account").alias("n_account"), F.col("ms").alias("n_ms"), F.col("no_time").alias("n_no"), F.col("amount").alias("n_amount"))
    met = shape(own) if excluded is None else shape(own).unionByName(shape(excluded))
    full = full.join(met, F.col("near_id") == F.col("n_id"), "left")
    at = _when(F.col("n_ms"), F.col("n_no"))
    p_ms, w_ms = F.when(mine, F.col("ms")).otherwise(F.col("n_ms")), F.when(mine, F.col("n_ms")).otherwise(F.col("ms"))
    money = F.concat(F.lit("$"), format_money(F.col("amount")))
    unknown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))
    collect = F.col("type") == "COLLECT"
    detail = (
        F.when(reason_is(POSSIBLE_PAIR), F.concat(_who(F.col("n_party"), F.col("n_account")), F.lit(" "), at, F.lit(": "), why_apart(F.col("type"), p_ms, w_ms, F.col("no_time") | F.col("n_no"), params)))
        .when(reason_is(OTHER_AGENT), F.concat(unknown(F.col("n_party")), F.lit(" of "), unknown(F.col("n_account")), F.lit(" "), at, F.lit(", $"), format_money(F.col("n_amount"))))
        .when(reason_is(NO_PANEL_COVERAGE), "no panel movements are loaded at that time")
        .when(reason_is(NO_WALLET_COVERAGE), "no loaded wallet covers that time: the report or the captures of that shift are missing")
        .when(mine, F.concat(F.lit("wallets of that time are loaded, but none with a "), F.when(collect, "deposit").otherwise("payment"), F.lit(" of "), money, F.lit(": a wallet or a capture may be missing")))
        .otherwise(F.concat(F.lit("the panel has no "), F.when(collect, "collect").otherwise("payout"), F.lit(" of "), money, F.lit(" near that time")))
    )
    found = full.select("id", "reason", detail.alias("detail_text"), "near_id", "near_ms")
    return pending.join(found, "id", "left")


def reason_is(reason: str) -> Column:
    return F.col("reason") == reason


def reason_counts(diagnosed: DataFrame) -> DataFrame:
    """Rows and money of each reason, by side."""
    return diagnosed.filter("reason is not null").groupBy("reason").pivot("side", ["panel", "wallet"]).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
