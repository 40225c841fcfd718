"""From the records of all sources to the two ledgers that a run matches, and what a user looks up in them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import norm
from ..functions.order import by_name
from ..functions.times import DAY_MS, SHIFTS, from_ms, shift_bands, to_ms
from ..plans import params as P
from ..sources.importers import fill_holders
from .dedup import absorb_unreferenced, keep_first, stable_ids

#: The label of rows without an agent.
NO_AGENT = "(no agent)"
SLOTS = "array<struct<from_ts:timestamp_ntz,to_ts:timestamp_ntz>>"


@dataclass(frozen=True)
class Source:
    """One report's records (movement columns, load_seq), or its holders (ref, holder)."""

    name: str
    records: DataFrame
    holders: DataFrame | None = None
    sheet: str = ""
    active: bool = True


@dataclass(frozen=True)
class Config:
    """Account aliases (key: normalized account), shifts, and agents of each line (normalized)."""

    accounts: dict[str, str] = field(default_factory=dict)
    shifts: tuple = SHIFTS
    lines: dict[str, tuple[str, ...]] = field(default_factory=dict)


def with_slots(moves: DataFrame, shifts=SHIFTS) -> DataFrame:
    """Rows that have a shift but no time get the shift's bands of their day; a single band also moves the time to its middle."""
    start = to_ms(F.col("ts")) - F.pmod(to_ms(F.col("ts")), F.lit(DAY_MS))
    slots, middle = F.lit(None).cast(SLOTS), F.lit(None).cast("timestamp_ntz")
    for s in shifts:
        bands = shift_bands(s)
        if not bands:
            continue
        mine = F.col("no_time") & (F.col("shift") == s.name)
        slots = F.when(mine, F.array(*(F.struct(from_ms(start + a).alias("from_ts"), from_ms(start + b).alias("to_ts")) for a, b in bands))).otherwise(slots)
        if len(bands) == 1:
            middle = F.when(mine, from_ms(start + (bands[0][0] + bands[0][1] + 1) // 2)).otherwise(middle)
    return moves.withColumns({"slots": slots, "ts": F.coalesce(middle, F.col("ts"))})


def assemble(sources: list[Source], config: Config | None = None) -> DataFrame:
    """All active sources as one table of movements with stable ids: holders filled in, account aliases
    replaced, shifts as slots, rows that came twice left out. ``load_seq`` is the order of sources, then of rows."""
    config, active = config or Config(), [s for s in sources if s.active]
    parts = []
    for i, s in enumerate(active):
        name = f"{s.name} / {s.sheet}" if s.sheet else s.name
        parts.append(s.records.withColumns({"source": F.lit(name), "load_seq": F.lit(i << 40) + F.col("load_seq")}))
    moves = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # of two holders of one reference the last loaded counts
    at = lambda s, i: F.lit(i << 40) + (F.col("load_seq") if "load_seq" in s.holders.columns else F.lit(0))
    holders = [s.holders.select("ref", "holder", at(s, i).alias("load_seq")) for i, s in enumerate(active) if s.holders is not None]
    return assemble_records(moves, reduce(DataFrame.unionByName, holders) if holders else None, config)


def assemble_records(moves: DataFrame, holders: DataFrame | None = None, config: Config | None = None) -> DataFrame:
    """Records of all sources (movement columns, source, load_seq) and holders (ref, holder, load_seq) as movements with stable ids."""
    config = config or Config()
    if holders is not None:
        moves = fill_holders(moves, holders)
    if config.accounts:
        alias = moves.sparkSession.createDataFrame(list(config.accounts.items()), "account_key string, __alias string")
        moves = moves.withColumn("account_key", norm(F.col("account"))).join(alias, "account_key", "left").withColumn("account", F.coalesce("__alias", "account")).drop("account_key", "__alias")
    moves = with_slots(moves, config.shifts)
    moves = keep_first(moves).withColumns({"id": F.col("load_seq").cast("string"), "ms": to_ms(F.col("ts"))})
    moves = absorb_unreferenced(moves).withColumn("seq", F.struct("ms", (F.coalesce("ref", F.lit("")) == "").alias("bare"), "load_seq"))
    return stable_ids(moves).drop("seq", "ms")


def by_side(moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The panel's and the wallets' movements."""
    return moves.filter("side = 'panel'"), moves.filter("side = 'wallet'")


def line_of(agents: DataFrame, lines: dict[str, tuple[str, ...]], account: str = "account") -> DataFrame:
    """Add ``line``: the group that an agent belongs to, else null."""
    rows = [(a, name) for name, members in lines.items() for a in members]
    table = agents.sparkSession.createDataFrame(rows, "agent_key string, line string").dropDuplicates(["agent_key"])
    return agents.withColumn("agent_key", norm(F.col(account))).join(table, "agent_key", "left").drop("agent_key")


def choose_agents(panel: DataFrame, lines: dict[str, tuple[str, ...]], line: str | None = None, agents: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The panel's rows of the chosen agents (a list goes before a line; neither: all), and the rows left out."""
    wanted = agents if agents is not None else lines.get(line) if line else None
    if wanted is None:
        return panel, panel.filter("false")
    keys = panel.sparkSession.createDataFrame([(a,) for a in sorted(set(wanted))], "a string").select(norm(F.col("a")).alias("agent_key")).distinct()
    own = panel.withColumn("agent_key", norm(F.col("account")))
    return own.join(keys, "agent_key", "left_semi").drop("agent_key"), own.join(keys, "agent_key", "left_anti").drop("agent_key")


def excluded_counts(excluded: DataFrame) -> DataFrame:
    """How many rows of each agent were left out; rows without one have a label of their own."""
    name = F.coalesce(F.nullif("account", F.lit("")), F.lit(NO_AGENT))
    return excluded.groupBy(name.alias("account")).agg(F.count("*").alias("n"))


def agent_inventory(panel: DataFrame, lines: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Movements, origins and line of each agent; agents without a line first, then by line, then by number.

    Writings that are equal after ``norm`` are one agent, shown as first written (by time, then load order, then text).
    """
    order = F.struct(*(c for c in ("ts", "load_seq") if c in panel.columns), "account")
    own = panel.filter(F.coalesce("account", F.lit("")) != "").withColumns({"__key": norm(F.col("account")), "__order": order})
    seen = own.groupBy("__key").agg(F.min_by("account", "__order").alias("account"), F.count("*").alias("n"), F.sort_array(F.collect_set("origin")).alias("origins")).drop("__key")
    full = line_of(seen, lines) if lines else seen.withColumn("line", F.lit(None).cast("string"))
    return full.orderBy(by_name(F.coalesce("line", F.lit(""))), F.desc("n"), "account")


def source_coverage(moves: DataFrame) -> DataFrame:
    """Number and first and last time of each source's records."""
    return moves.groupBy("source").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def sources_outside(moves: DataFrame, start: Column, end: Column) -> DataFrame:
    """The sources without a movement from ``start`` until ``end``."""
    inside = moves.filter((F.col("ts") >= start) & (F.col("ts") < end)).select("source").distinct()
    return moves.select("source").distinct().join(inside, "source", "left_anti")


def _holds(text: Column, what: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(what.lower()))


def search_pending(pending: DataFrame, text: str = "", status: str | None = None, kind: str | None = None) -> DataFrame:
    """Pending rows by status and type whose party, account, reference, detail or note holds a text; statuses that only inform show if chosen."""
    out = pending.filter(F.col("status") == status) if status else pending.filter(~F.col("status").isin(*P.INFORMATIONAL))
    if kind:
        out = out.filter(F.col("type") == kind)
    fields = [c for c in ("party", "account", "ref", "detail", "note", "origin") if c in pending.columns]
    return out.filter(reduce(lambda a, b: a | b, (_holds(F.col(c), text) for c in fields))) if text else out


def search_matches(matches: DataFrame, moves: DataFrame, text: str = "", status: str | None = None, confidence: str | None = None, kind: str | None = None) -> DataFrame:
    """Matches by status, confidence and type of which a member or the note holds a text."""
    out = matches
    for column, value in (("status", status), ("confidence", confidence), ("type", kind)):
        if value:
            out = out.filter(F.col(column) == value)
    if not text:
        return out
    hit = moves.filter(reduce(lambda a, b: a | b, (_holds(F.col(c), text) for c in ("party", "account", "ref")))).select("id")
    found = out.select("match_id", F.explode(F.concat("panel_ids", "wallet_ids")).alias("id")).join(hit, "id", "left_semi").select("match_id").distinct()
    return out.join(found.withColumn("hit", F.lit(True)), "match_id", "left").filter(F.col("hit") | _holds(F.col("note"), text)).drop("hit")


def hints(pending: DataFrame) -> DataFrame:
    """Pairs of pending rows of both sides with equal type and cents: id, hint_id."""
    own = pending.filter(F.col("type").isin(*P.MATCHABLE)).select("id", "side", "type", F.round(F.col("amount") * 100).cast("long").alias("cents"))
    other = own.filter("side <> 'panel'").select(F.col("id").alias("hint_id"), "type", "cents")
    return own.filter("side = 'panel'").join(other, ["type", "cents"]).select("id", "hint_id")


def merge_aliases(*tables: DataFrame) -> DataFrame:
    """Union of alias tables (user_key, user, id_key, label, n) with the largest number of each."""
    whole = reduce(DataFrame.unionByName, tables)
    last = Window.partitionBy("user_key", "id_key").orderBy(F.desc("n"), "user", "label")
    return whole.withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r")


def without_alias(aliases: DataFrame, user_key: str, id_key: str) -> DataFrame:
    return aliases.filter(~((F.col("user_key") == user_key) & (F.col("id_key") == id_key)))


def aliases_of_cells(cells: DataFrame) -> DataFrame:
    """Aliases from a table of users and holders; header and blank rows are passed over."""
    from ..functions.names import clean_text, name_key

    own = cells.select(clean_text(F.get("cells", F.lit(0))).alias("user"), clean_text(F.get("cells", F.lit(1))).alias("label"))
    own = own.withColumns({"user_key": norm(F.col("user")), "id_key": name_key(F.col("label"))})
    kept = own.filter((F.col("user_key") != "") & (F.col("id_key") != "") & ~F.col("user_key").isin("usuario", "user"))
    return kept.groupBy("user_key", "id_key").agg(F.min("user").alias("user"), F.min("label").alias("label")).select("user_key", "user", "id_key", "label", F.lit(1).cast("long").alias("n"))


def alias_sheet(aliases: DataFrame) -> DataFrame:
    """The alias table as a user reads it: user, holder, times; by user."""
    return aliases.select("user", F.col("label").alias("holder"), F.col("n").alias("times")).orderBy("user", "holder")


def unified_sheet(matches: DataFrame, pending: DataFrame, panel: DataFrame, wallet: DataFrame) -> DataFrame:
    """Matched and pending rows in one table, by the first panel time, else the wallet's: payouts are negative, members are joined by `` + ``."""
    moves = panel.unionByName(wallet).select("id", "party", "account")
    ids = matches.select("match_id", F.posexplode(F.concat("panel_ids", "wallet_ids")).alias("k", "id"), F.size("panel_ids").alias("m")).join(moves, "id")
    joined = lambda test, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("k", c)))), lambda x: x[c]), " + ")
    names = ids.groupBy("match_id").agg(joined(F.col("k") < F.col("m"), "party").alias("user"), joined(F.col("k") >= F.col("m"), "party").alias("holder"))
    sign = F.when(F.col("type") == "PAYOUT", -1).otherwise(1)
    done = matches.join(names, "match_id").select(F.coalesce("panel_ts", "ts").alias("ts"), "type", "status", "user", "holder", (sign * F.col("panel_amount")).alias("panel_amount"), (sign * F.col("wallet_amount")).alias("wallet_amount"), "confidence", "note")
    on = lambda side, c: F.when(F.col("side") == side, c)
    alone = pending.select("ts", "type", "status", on("panel", F.col("party")).alias("user"), on("wallet", F.col("party")).alias("holder"), on("panel", sign * F.col("amount")).alias("panel_amount"), on("wallet", sign * F.col("amount")).alias("wallet_amount"), F.lit(None).cast("string").alias("confidence"), "note")
    return done.unionByName(alone).orderBy("ts", "type", "user", "holder")
