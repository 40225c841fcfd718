"""One call from sources to reports: assembly, agents, matching, reasons, the days shown, and every table that is shown or exported."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import norm
from ..functions.numbers import round2
from ..functions.order import by_name
from ..functions.times import DAY_START_HOUR, format_duration, operational_day, shift_of
from ..plans import params as P
from ..sources.detection import Imports
from ..storage import materialize
from . import report
from .dataset import Config, assemble_records, by_side, choose_agents, excluded_counts
from .diagnosis import diagnose
from .matching import movements, reconcile

#: What a user calls the types.
TYPE_NAMES = {"COLLECT": "Collect", "PAYOUT": "Payout", "BONUS": "Bonus", "INTERNAL": "Internal", "FEE": "Fee", "REVERSED": "Reversed"}


@dataclass(frozen=True)
class Decisions:
    """What the user decided: forced (panel_ids, wallet_ids, note, ordinal), states (id, status, note), rejected (pid, wid)."""

    forced: DataFrame | None = None
    states: DataFrame | None = None
    rejected: DataFrame | None = None


@dataclass(frozen=True)
class Result:
    """Tables of a run. ``matches`` and ``pending`` are those of the chosen days, ``all_matches`` and ``all_pending`` of all."""

    panel: DataFrame
    wallet: DataFrame
    excluded: DataFrame
    all_matches: DataFrame
    all_pending: DataFrame
    matches: DataFrame
    pending: DataFrame
    aliases: DataFrame
    n_loaded: int
    n_kept: int
    config: Config
    start_hour: int = DAY_START_HOUR
    days: tuple | None = None
    extras: dict = field(default_factory=dict)

    @property
    def n_discarded(self) -> int:
        """Rows that were loaded twice."""
        return self.n_loaded - self.n_kept


def run_records(
    records: DataFrame, holders: DataFrame | None = None, config: Config | None = None, params: P.Params | None = None, aliases: DataFrame | None = None, decisions: Decisions | None = None,
    day=None, last_day=None, line: str | None = None, agents: list[str] | None = None, start_hour: int = DAY_START_HOUR,
) -> Result:
    """Movements of all sources, matched, explained, and cut to operational days.

    ``agents`` (or else those of ``line``) choose the panel's rows; the others only explain what stays alone. ``day`` and ``last_day`` (either way
    round; one alone: that day) choose what is shown: matches by their first panel row, else by their first row. Everything is matched first, so a
    pair that crosses a day's edge is a pair.
    """
    config, params, decisions = config or Config(), params or P.Params(), decisions or Decisions()
    whole = materialize(assemble_records(records, holders, config), "movements")
    panel, wallet = by_side(whole)
    kept, excluded = choose_agents(panel, config.lines, line, agents)
    out = reconcile(kept, wallet, params, aliases, decisions.forced, decisions.states, decisions.rejected)
    left = movements(excluded, "panel")
    pending = materialize(diagnose(out["pending"], out["panel"], out["wallet"], left, params.amount_tolerance, params), "diagnosed")
    matches = out["matches"]
    days = None if day is None else (day, last_day or day)
    shown_m, shown_p = matches, pending
    if days:
        shown_m = report.in_window(matches.withColumn("__at", F.coalesce("panel_ts", "ts")), "__at", *days, start_hour).drop("__at")
        shown_p = report.in_window(pending, "ts", *days, start_hour)
    return Result(out["panel"], out["wallet"], left, matches, pending, shown_m, shown_p, out["aliases"], records.count(), whole.count(), config, start_hour, days)


def run_sources(imports: Imports, inactive: list[str] = (), **options) -> Result:
    """A run over imported sources; ``inactive``: names of sources to leave out."""
    records = imports.records.filter(~F.col("source").isin(*inactive)) if inactive else imports.records
    return run_records(records, imports.holders, **options)


# --- reports -----------------------------------------------------------------


def _members(r: Result) -> tuple[DataFrame, DataFrame]:
    """The panel's and the wallets' rows that the shown tables hold."""
    ids = lambda c: r.matches.select(F.explode(c).alias("id"))
    at = lambda side, c: r.panel.join(ids(c).unionByName(r.pending.filter(F.col("side") == side).select("id")).distinct(), "id", "left_semi") if side == "panel" else r.wallet.join(ids(c).unionByName(r.pending.filter(F.col("side") != "panel").select("id")).distinct(), "id", "left_semi")
    return at("panel", "panel_ids"), at("wallet", "wallet_ids")


def summary(r: Result) -> DataFrame:
    """place, concept, panel, wallet, difference: sums and counts of the shown rows of both sides."""
    panel, wallet = _members(r)
    one = report.totals(panel.unionByName(wallet), "side")
    rows = (("Collects", "collects", True, True), ("Payouts", "payouts", True, True), ("Net", "net", True, True), ("Number of collects", "n_collects", True, True), ("Number of payouts", "n_payouts", True, True), ("Bonuses", "bonuses", True, False), ("Internal", "internals", False, True), ("Fees", "fees", False, True))
    long = one.select("side", F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("concept"), F.col(c).cast("double").alias("v"), F.lit(p).alias("on_panel"), F.lit(w).alias("on_wallet")) for i, (n, c, p, w) in enumerate(rows)))).alias("x")).select("side", "x.*")
    frame = r.panel.sparkSession.createDataFrame([(i, n, p, w) for i, (n, _, p, w) in enumerate(rows)], "place int, concept string, on_panel boolean, on_wallet boolean")
    sums = long.groupBy("place").agg(F.sum(F.when(F.col("side") == "panel", F.col("v"))).alias("p"), F.sum(F.when(F.col("side") != "panel", F.col("v"))).alias("w"))
    full = frame.join(sums, "place", "left").select("place", "concept", F.when(F.col("on_panel"), F.coalesce("p", F.lit(0.0))).alias("panel"), F.when(F.col("on_wallet"), F.coalesce("w", F.lit(0.0))).alias("wallet"))
    return full.withColumn("difference", round2(F.col("panel") - F.col("wallet"))).orderBy("place")


def by_account(r: Result) -> DataFrame:
    """Totals of the shown rows by side, origin and account, in the order of their names."""
    panel, wallet = _members(r)
    return report.totals(panel.unionByName(wallet), "side", "origin", "account").orderBy(F.col("side") != "panel", by_name(F.col("origin")), by_name(F.col("account")))


def reasons(r: Result) -> DataFrame:
    """reason, panel, wallet: how many shown rows of each side stay alone for each reason."""
    return r.pending.filter("reason is not null").groupBy("reason").agg(F.count_if(F.col("side") == "panel").alias("panel"), F.count_if(F.col("side") != "panel").alias("wallet")).orderBy(F.desc(F.col("panel") + F.col("wallet")), "reason")


def _named(kind: Column) -> Column:
    out = kind
    for k, v in TYPE_NAMES.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def _shift(ts: Column, no_time: Column, shift: Column, r: Result) -> Column:
    return F.when(no_time, F.coalesce(shift, F.lit(""))).otherwise(shift_of(ts, r.config.shifts))


def _joined(matches: DataFrame, moves: DataFrame, ids: str, prefix: str) -> DataFrame:
    """For each match its members' accounts, parties, references joined by `` + ``, and the first one's time and origin."""
    long = matches.select("match_id", F.posexplode(ids).alias("k", "id")).join(moves.select("id", "account", "party", "ref", "origin", "ts", "no_time"), "id")
    packed = long.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("k", *(F.coalesce(c, F.lit("")).alias(c) for c in ("account", "party", "ref", "origin")), "ts", "no_time"))).alias("m"))
    first = F.get("m", F.lit(0))
    return packed.select("match_id", *(F.array_join(F.col(f"m.{c}"), " + ").alias(f"{prefix}_{c}") for c in ("account", "party", "ref")), first["origin"].alias(f"{prefix}_origin"), first["ts"].alias(f"{prefix}_time"), first["no_time"].alias(f"{prefix}_no_time"))


def matched_sheet(r: Result) -> DataFrame:
    """Shown matches with both sides' members, lag and shift; by the first panel row's time."""
    full = r.matches.drop("agent", "wallet_account").join(_joined(r.matches, r.panel, "panel_ids", "panel"), "match_id", "left").join(_joined(r.matches, r.wallet, "wallet_ids", "wallet"), "match_id", "left")
    at = F.coalesce("panel_time", "ts")
    return full.select(
        operational_day(at, r.start_hour).alias("op_day"), "status", "confidence", _named(F.col("type")).alias("operation"), shift_of(at, r.config.shifts).alias("shift"), "panel_time", "panel_origin", F.col("panel_account").alias("agent"), F.col("panel_party").alias("user"), "panel_amount",
        "wallet_time", "wallet_no_time", "wallet_origin", F.col("wallet_account").alias("account"), F.col("wallet_party").alias("holder"), "wallet_amount", "difference", format_duration(F.col("lag_ms")).alias("lag"), round2(F.col("lag_ms") / P.MINUTE).alias("lag_min"), "note", "panel_ref", "wallet_ref",
    ).orderBy(F.coalesce("panel_time", "wallet_time"), "user", "holder")


def base_sheet(moves: DataFrame, r: Result) -> DataFrame:
    """Movements as they are exported: payouts negative, the shift empty for rows without a time unless one was given."""
    return moves.select(
        "ts", "no_time", "origin", "account", "party", _named(F.col("type")).alias("operation"), F.when(F.col("type") == "PAYOUT", -F.col("amount")).otherwise(F.col("amount")).alias("amount"), "ref", _shift(F.col("ts"), F.col("no_time"), F.col("shift"), r).alias("shift"), "source",
    ).orderBy("ts", "party", "amount")


def pending_sheet(r: Result) -> DataFrame:
    """Shown rows that stay alone, with status, reason and its words; by time."""
    return r.pending.select(
        operational_day(F.col("ts"), r.start_hour).alias("op_day"), "status", "side", _shift(F.col("ts"), F.col("no_time"), F.col("shift"), r).alias("shift"), "ts", "no_time", "origin", "account", "party", _named(F.col("type")).alias("operation"),
        F.when(F.col("type") == "PAYOUT", -F.col("amount")).otherwise(F.col("amount")).alias("amount"), "ref", "note", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("detail_text", F.lit("")).alias("reason_detail"),
    ).orderBy("ts", "party", "amount")


def unified_sheet(r: Result) -> DataFrame:
    """Matches (both sides in one row) and rows that stay alone, together by time."""
    m = matched_sheet(r).select(F.lit("Matched").alias("situation"), "op_day", "status", "confidence", "operation", "shift", "panel_time", "agent", "user", "panel_amount", "wallet_time", "account", "holder", "wallet_amount", "difference", "lag", "note", F.lit("").alias("reason"), F.lit("").alias("reason_detail"))
    p = pending_sheet(r)
    on = lambda side, c: F.when((F.col("side") == "panel") == F.lit(side), F.col(c))
    alone = p.select(
        F.lit("Pending").alias("situation"), "op_day", "status", F.lit(None).cast("string").alias("confidence"), "operation", "shift", on(True, "ts").alias("panel_time"), on(True, "account").alias("agent"), on(True, "party").alias("user"), on(True, "amount").alias("panel_amount"),
        on(False, "ts").alias("wallet_time"), on(False, "account").alias("account"), on(False, "party").alias("holder"), on(False, "amount").alias("wallet_amount"), F.lit(None).cast("double").alias("difference"), F.lit("").alias("lag"), "note", "reason", "reason_detail",
    )
    return m.unionByName(alone).orderBy(F.coalesce("panel_time", "wallet_time"), "situation", "user", "holder")


def times_sheet(r: Result) -> DataFrame:
    """type, grouping, group_key, n and durations in words: overall, by shift, agent and wallet account, and the classes of lags."""
    words = lambda c: format_duration(F.col(c).cast("double")).alias(c)
    stats = report.lag_report(r.matches, r.config.shifts).select("type", "grouping", "group_key", "n", words("mean"), words("median"), words("p90"), words("longest"))
    classes = report.lag_histogram(r.matches).select("type", F.lit("class").alias("grouping"), F.concat_ws(" ", F.col("place").cast("string"), "lag_class").alias("group_key"), "n", *(F.lit(None).cast("string").alias(c) for c in ("mean", "median", "p90", "longest")))
    place = F.when(F.col("grouping") == "all", 0).when(F.col("grouping") == "shift", 1).when(F.col("grouping") == "agent", 2).when(F.col("grouping") == "account", 3).otherwise(4)
    return stats.unionByName(classes).orderBy("type", place, by_name(F.col("group_key")))


def sheets(r: Result, aliases: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every exported table by its name; days come as a table of their own where more than one is shown."""
    known = r.aliases if aliases is None else aliases
    out = {
        "summary": summary(r), "by_status": report.by_status(r.matches, r.pending), "by_account": by_account(r), "reasons": reasons(r), "matched_and_pending": unified_sheet(r), "matched": matched_sheet(r), "pending": pending_sheet(r), "times": times_sheet(r),
        "panel_base": base_sheet(r.panel, r), "wallet_base": base_sheet(r.wallet, r), "users_and_holders": known.select("user", F.col("label").alias("holder"), F.col("n").alias("times")).orderBy(by_name(F.col("user")), by_name(F.col("holder"))),
        "excluded": excluded_counts(r.excluded),
    }
    if r.days is None or r.days[0] != r.days[1]:
        panel, wallet = _members(r)
        out["per_day"] = report.daily(panel, wallet, r.matches, r.pending, r.start_hour).orderBy(F.col("op_day").asc_nulls_last())
    return out


def write_sheets(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Each table in a folder of its name under ``path`` (``parquet``, ``csv`` with a header, ``json``), by Spark's writers."""
    for name, df in tables.items():
        df.write.mode("overwrite").options(**({"header": True} if form == "csv" else {})).format(form).save(f"{path.rstrip('/')}/{name}")


# --- decisions ---------------------------------------------------------------


def undo(r: Result, decisions: Decisions, match_ids: list[str], aliases: DataFrame | None = None) -> tuple[Decisions, DataFrame | None]:
    """Decisions (and aliases) after matches are taken apart: a forced one is forced no more; of any other every pair
    of members is rejected, and what its one user and holder taught is forgotten, unless its confidence is high."""
    spark = r.panel.sparkSession
    ids = spark.createDataFrame([(m,) for m in match_ids], "match_id string")
    gone = materialize(r.all_matches.join(ids, "match_id", "left_semi").select("match_id", "panel_ids", "wallet_ids", "status", "confidence"), "undone")
    forced, rejected = decisions.forced, decisions.rejected
    if forced is not None:
        same = gone.filter(F.col("status") == P.MANUAL).select(F.array_sort("panel_ids").alias("__p"), F.array_sort("wallet_ids").alias("__w"))
        forced = forced.join(same, (F.array_sort("panel_ids") == F.col("__p")) & (F.array_sort("wallet_ids") == F.col("__w")), "left_anti")
    auto = gone.filter(F.col("status") != P.MANUAL)
    pairs = auto.select(F.explode("panel_ids").alias("pid"), "wallet_ids").select("pid", F.explode("wallet_ids").alias("wid"))
    rejected = pairs if rejected is None else rejected.select("pid", "wid").unionByName(pairs).distinct()
    if aliases is not None:
        from ..functions.names import name_key

        one = auto.filter((F.size("panel_ids") == 1) & (F.size("wallet_ids") == 1) & (F.col("confidence") != "high")).select(F.col("panel_ids")[0].alias("pid"), F.col("wallet_ids")[0].alias("wid"))
        learnt = one.join(r.panel.select(F.col("id").alias("pid"), norm(F.col("party")).alias("user_key")), "pid").join(r.wallet.select(F.col("id").alias("wid"), name_key(F.col("party")).alias("id_key")), "wid").select("user_key", "id_key").distinct()
        aliases = aliases.join(learnt, ["user_key", "id_key"], "left_anti")
    return Decisions(forced, decisions.states, rejected), aliases


def force(r: Result, decisions: Decisions, ids: list[str], note: str = "") -> Decisions:
    """Decisions after pending rows are matched by hand: those of ``ids`` that still stand alone; their states go."""
    spark = r.panel.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], "id string")
    rows = r.all_pending.join(wanted, "id", "left_semi").select("id", "side")
    one = rows.agg(F.array_sort(F.collect_list(F.when(F.col("side") == "panel", F.col("id")))).alias("panel_ids"), F.array_sort(F.collect_list(F.when(F.col("side") != "panel", F.col("id")))).alias("wallet_ids"))
    last = F.lit(-1).cast("long") if decisions.forced is None else decisions.forced.agg(F.max("ordinal").alias("m")).select(F.coalesce("m", F.lit(-1)).alias("m")).scalar()
    new = one.filter((F.size("panel_ids") > 0) | (F.size("wallet_ids") > 0)).select("panel_ids", "wallet_ids", F.lit(note).alias("note"), (last + 1).cast("long").alias("ordinal"))
    forced = new if decisions.forced is None else decisions.forced.select("panel_ids", "wallet_ids", "note", F.col("ordinal").cast("long").alias("ordinal")).unionByName(new)
    states = None if decisions.states is None else decisions.states.join(wanted, "id", "left_anti")
    return Decisions(materialize(forced, "forced"), states, decisions.rejected)


def mark(decisions: Decisions, spark, ids: list[str], status: str, note: str = "") -> Decisions:
    """Decisions after rows got a state; it replaces an earlier one."""
    new = spark.createDataFrame([(i, status, note) for i in ids], "id string, status string, note string")
    states = new if decisions.states is None else decisions.states.join(new.select("id"), "id", "left_anti").unionByName(new)
    return Decisions(decisions.forced, states, decisions.rejected)


def add_alias(aliases: DataFrame, user: str, holder: str) -> DataFrame:
    """The alias table with one entry more (counted once at least); a user or holder without letters adds none."""
    from ..functions.names import clean_text, name_key

    spark = aliases.sparkSession
    one = spark.createDataFrame([(user, holder)], "user string, holder string")
    own = one.select(norm(F.col("user")).alias("user_key"), clean_text(F.col("user")).alias("user"), name_key(F.col("holder")).alias("id_key"), clean_text(F.col("holder")).alias("label"), F.lit(1).cast("long").alias("n")).filter("user_key <> '' and id_key <> ''")
    whole = aliases.select("user_key", "user", "id_key", "label", F.col("n").cast("long").alias("n")).withColumn("o", F.lit(0)).unionByName(own.withColumn("o", F.lit(1)))
    # the name of a user that is known already stays, the holder is written as it came last
    name = F.min_by("user", "o").over(Window.partitionBy("user_key"))
    return whole.withColumn("user", name).groupBy("user_key", "id_key").agg(F.first("user").alias("user"), F.max_by("label", "o").alias("label"), F.max("n").alias("n")).select("user_key", "user", "id_key", "label", "n")
