"""The passes that match a panel ledger with a wallet ledger.

Each pass enumerates candidate edges by a bucketed band join, scores them, and
gives them to ``greedy_match`` in a total order. What a pass uses is left out of the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import identity_keys, letter_runs, name_key, name_relation, name_tokens, norm
from ..functions.numbers import round2
from ..functions.times import DAY_MS, to_ms
from ..plans import params as P
from ..storage import materialize
from .joins import band_join, band_totals, greedy_match
from .spans import best_first, by_span, first_in_bands, first_pair, in_spans, lone_pairs, only_group

MOVE = ("id", "load_seq", "side", "origin", "account", "party", "ts", "type", "amount", "ref", "doc", "cbu", "no_time", "slots", "shift", "source")
_TYPES = {"load_seq": "long", "ts": "timestamp_ntz", "amount": "double", "no_time": "boolean", "slots": "array<struct<from_ts:timestamp_ntz,to_ts:timestamp_ntz>>"}


def movements(df: DataFrame, side: str) -> DataFrame:
    """The movement schema: missing columns are null, amounts are positive with two decimals,
    ``ms`` is the wall clock and ``seq`` the place by time, then rows with a reference, then by load order (rows without ``load_seq`` are equal, and go by id)."""
    have = set(df.columns)
    own = df.select(*((F.col(c) if c in have else F.lit(side) if c == "side" else F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in MOVE))
    own = own.withColumns({"amount": round2(F.abs("amount")), "no_time": F.coalesce("no_time", F.lit(False)), "ms": to_ms(F.col("ts"))})
    # an order, not a rank: the time, then the id; no single-partition window is needed
    return own.withColumn("seq", F.struct("ms", (F.coalesce("ref", F.lit("")) == "").alias("bare"), F.coalesce("load_seq", F.lit(0)).alias("loaded")))


def amount_bonus(p: Column, w: Column, kind: Column, params: P.Params) -> Column:
    """0 if the amounts agree, the first bonus percentage that explains them (collects only), else null."""
    out = F.when(F.abs(p - w) <= params.amount_tolerance, 0)
    for b in params.bonuses:
        out = out.when((kind == "COLLECT") & (F.abs(p - round2(w * (1 + b / 100))) <= params.amount_tolerance + w * 0.001), b)
    return out


def lag(kind: Column, p_ms: Column, w_ms: Column) -> Column:
    """Positive when the expected side comes first: money before chips, chips before payouts."""
    return F.when(kind == "COLLECT", p_ms - w_ms).otherwise(w_ms - p_ms)


def score(lag_ms: Column, bonus: Column, relation: Column) -> Column:
    base = 100 - F.abs(lag_ms) / P.MINUTE - F.when(lag_ms < 0, 5).otherwise(0) - F.when(bonus > 0, 15).otherwise(0)
    return base + F.when(relation == "known", 60).when(relation == "hint", 25).when(relation == "different", -45).otherwise(0)


def _side(df: DataFrame, letter: str) -> DataFrame:
    return df.select("type", *(F.col(c).alias(f"{letter}_{c}") for c in ("id", "ms", "amount", "party", "account", "doc", "cbu", "seq", "no_time", "slots", "shift")), *(c for c in ("known",) if c in df.columns))


def known_keys(aliases: DataFrame) -> DataFrame:
    """One row per user with all identity keys that are known of it."""
    return aliases.groupBy("user_key").agg(F.collect_set("id_key").alias("known"))


def _with_known(df: DataFrame, aliases: DataFrame, party: str = "party") -> DataFrame:
    """Rows with ``known``: the identity keys that are known of their user."""
    return df.withColumn("user_key", norm(F.col(party))).join(known_keys(aliases), "user_key", "left").drop("user_key")


def _related(pairs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs with their names' relation; those whose panel rows have brought ``known`` along are not shuffled for it."""
    with_keys = pairs if "known" in pairs.columns else _with_known(pairs, aliases, "p_party")
    return with_keys.withColumn("relation", name_relation(F.col("known"), F.col("p_party"), F.col("w_party"), F.col("w_doc"), F.col("w_cbu"))).drop("known")


def _amount_key(amount: Column, params: P.Params) -> Column:
    """A key that grows by one over two tolerances (fixed part and a thousandth), however large the amount."""
    tol = max(params.amount_tolerance, 0.005)
    return F.floor(F.log(1 + F.greatest(amount, F.lit(0.0)) * (0.001 / tol)) / 0.002).cast("long")


def _amount_keys(panel_amount: Column, kind: Column, params: P.Params) -> Column:
    """The keys of all wallet amounts that ``amount_bonus`` can accept for a panel amount: a few."""
    tol, edge = params.amount_tolerance, 0.006
    span = lambda low, high: F.sequence(_amount_key(low * (1 - 1e-9), params), _amount_key(high * (1 + 1e-9), params))
    exact = span(panel_amount - (tol + edge), panel_amount + (tol + edge))
    factors = [1 + b / 100 for b in params.bonuses]
    more = [span((panel_amount - (tol + edge)) / (f + 0.001), (panel_amount + (tol + edge)) / (f - 0.001)) for f in factors]
    return F.array_distinct(F.flatten(F.array(exact, *(F.when(kind == "COLLECT", m).otherwise(F.array().cast("array<bigint>")) for m in more))))


def candidates(panel: DataFrame, wallet: DataFrame, params: P.Params, inverted: bool = False) -> DataFrame:
    """Pairs of equal type within the lag's window whose amounts agree (or differ by a bonus).

    ``inverted``: the pairs in the wrong order by at most the clocks' tolerance.
    """
    p = _side(_kinds(panel), "p").withColumn("amount_key", F.explode(_amount_keys(F.col("p_amount"), F.col("type"), params))).withColumn("__up", _forward(F.col("type"), F.col("p_ms")))
    w = _side(_kinds(wallet).filter(~F.col("no_time")), "w").withColumn("amount_key", _amount_key(F.col("w_amount"), params)).withColumn("__uw", _forward(F.col("type"), F.col("w_ms")))
    tol = params.clock_tolerance * P.MINUTE
    # forward, a wallet row comes its lag behind the panel row
    before, after = (-1, tol) if inverted else (_most(params), 0)
    width = tol if inverted else max(params.max_collect_lag, params.max_payout_lag) * P.MINUTE // 4
    pairs = band_join(w, p, ["type", "amount_key"], "__uw", "__up", before, after, width).drop("amount_key", "__uw", "__up")
    pairs = pairs.withColumns({"lag": lag(F.col("type"), F.col("p_ms"), F.col("w_ms")), "bonus": amount_bonus(F.col("p_amount"), F.col("w_amount"), F.col("type"), params)})
    return pairs.filter(F.col("bonus").isNotNull())


def _kinds(df: DataFrame) -> DataFrame:
    return df.filter(F.col("type").isin(*P.MATCHABLE))


def _forward(kind: Column, ms: Column) -> Column:
    """Times on a line on which the lag is the wallet's time less the panel's: collects run backwards."""
    return F.when(kind == "COLLECT", -ms).otherwise(ms)


def _most(params: P.Params) -> Column:
    return F.when(F.col("type") == "COLLECT", params.max_collect_lag * P.MINUTE).otherwise(params.max_payout_lag * P.MINUTE)


def candidate_totals(panel: DataFrame, wallet: DataFrame, params: P.Params) -> tuple[DataFrame, DataFrame]:
    """How many candidates each panel row has and how many panel rows want those (id, n, total), and the number of each wallet row's (id, n); no pairs are made."""
    ahead = lambda d: d.select("id", "type", "amount", _forward(F.col("type"), F.col("ms")).alias("ms"))
    p, w = materialize(ahead(_kinds(panel)), "counted"), materialize(ahead(_kinds(wallet).filter(~F.col("no_time"))), "counted")  # each is read several times
    most, width = _most(params), max(1, 4 * max(params.max_collect_lag, params.max_payout_lag) * P.MINUTE)

    def suit(p_amounts: DataFrame, w_amounts: DataFrame) -> DataFrame:
        """Amounts of one bucket that agree: type, __b, p_amount, w_amount."""
        keyed = p_amounts.withColumn("amount_key", F.explode(_amount_keys(F.col("p_amount"), F.col("type"), params)))
        both = keyed.join(w_amounts.withColumn("amount_key", _amount_key(F.col("w_amount"), params)), ["type", "__b", "amount_key"])
        return both.filter(amount_bonus(F.col("p_amount"), F.col("w_amount"), F.col("type"), params).isNotNull())

    of_wallet = band_totals(
        w.select("id", "type", "amount", (F.col("ms") - most).alias("low"), F.col("ms").alias("high")), p.withColumn("weight", F.lit(1)),
        lambda mine, other: suit(other.withColumnRenamed("other", "p_amount"), mine.withColumnRenamed("amount", "w_amount")).withColumnsRenamed({"w_amount": "amount", "p_amount": "other"}), ["type"], width,
    )
    of_wallet = materialize(of_wallet.select("id", "n"), "counts")
    wanted = w.join(of_wallet.select("id", F.col("n").alias("weight")), "id")
    of_panel = band_totals(
        p.select("id", "type", "amount", F.col("ms").alias("low"), (F.col("ms") + most).alias("high")), wanted,
        lambda mine, other: suit(mine.withColumnRenamed("amount", "p_amount"), other.withColumnRenamed("other", "w_amount")).withColumnsRenamed({"p_amount": "amount", "w_amount": "other"}), ["type"], width,
    )
    return of_panel, of_wallet


def _edges(pairs: DataFrame, account_hint: DataFrame | None = None) -> DataFrame:
    own = pairs.select(F.col("p_id").alias("pid"), F.col("w_id").alias("wid"), "p_account", "w_account", "bonus", "relation", score(F.col("lag"), F.col("bonus"), F.col("relation")).alias("score"), "p_seq", "w_seq", "p_ms")
    if account_hint is not None:
        # accounts that are expected of an agent: (agent_key, account_key)
        own = own.withColumns({"agent_key": norm(F.col("p_account")), "account_key": norm(F.col("w_account"))}).join(account_hint.select("agent_key", "account_key", F.lit(10).alias("__plus")).distinct(), ["agent_key", "account_key"], "left")
        own = own.withColumn("score", F.col("score") + F.coalesce("__plus", F.lit(0))).drop("__plus", "agent_key", "account_key")
    return own.drop("p_account", "w_account")


def _counted(edges: DataFrame) -> DataFrame:
    """How many candidates each end has, before any is taken."""
    return edges.withColumns({"n_p": F.count("*").over(Window.partitionBy("pid")), "n_w": F.count("*").over(Window.partitionBy("wid"))})


def _order() -> list[Column]:
    return [-F.col("score"), F.col("p_seq"), F.col("pid"), F.col("w_seq"), F.col("wid")]


def confidence(relation: Column, bonus: Column, points: Column) -> Column:
    graded = F.when(points >= 85, "high").otherwise("medium")
    return F.when(relation == "known", "high").when(relation == "different", "low").when((relation == "hint") | (bonus == 0), graded).otherwise("medium")


def _status(bonus: Column) -> Column:
    return F.when(bonus > 0, P.MATCHED_BONUS).otherwise(P.MATCHED)


def _matches(taken: DataFrame, panel: list[str], wallet: list[str], status: Column, note: Column, conf: Column) -> DataFrame:
    return taken.select(
        F.array_compact(F.array(*(F.col(c) for c in panel))).alias("panel_ids"), F.array_compact(F.array(*(F.col(c) for c in wallet))).alias("wallet_ids"),
        status.alias("status"), note.alias("note"), conf.alias("confidence"),
    )


def _unused(df: DataFrame, matches: list[DataFrame], side: str) -> DataFrame:
    """Rows that no match has: one anti-join with the ids of all of them."""
    if not matches:
        return df
    used = reduce(DataFrame.unionByName, (m.select(F.explode(f"{side}_ids").alias("id")) for m in matches))
    return df.join(used, "id", "left_anti")


def learn(aliases: DataFrame, matches: list[DataFrame], panel: DataFrame, wallet: DataFrame) -> DataFrame:
    """Aliases and what one-to-one matches of high or manual confidence add: user_key, user, id_key, label, n."""
    rows = []
    for m in matches:
        one = m.filter((F.size("panel_ids") == 1) & (F.size("wallet_ids") == 1) & F.col("confidence").isin("high", "manual")).select(F.col("panel_ids")[0].alias("pid"), F.col("wallet_ids")[0].alias("wid"))
        full = one.join(panel.select(F.col("id").alias("pid"), F.col("party").alias("user")), "pid").join(wallet.select(F.col("id").alias("wid"), "party", "doc", "cbu"), "wid").filter(F.coalesce("user", F.lit("")) != "")
        has = F.coalesce("party", F.lit("")) != ""
        of = F.when(has, F.concat(F.lit(" ("), F.col("party"), F.lit(")"))).otherwise("")
        keys = F.array_compact(F.array(
            F.when(has & (name_key(F.col("party")) != ""), F.struct(name_key(F.col("party")).alias("id_key"), F.col("party").alias("label"))),
            F.when(F.coalesce("doc", F.lit("")) != "", F.struct(F.concat(F.lit("#"), "doc").alias("id_key"), F.concat(F.lit("ID "), F.col("doc"), of).alias("label"))),
            F.when(F.coalesce("cbu", F.lit("")) != "", F.struct(F.concat(F.lit("#cbu"), "cbu").alias("id_key"), F.concat(F.lit("Account "), F.col("cbu"), of).alias("label"))),
        ))
        rows.append(full.select(norm(F.col("user")).alias("user_key"), "user", F.explode(keys).alias("k")).select("user_key", "user", "k.id_key", "k.label", F.lit(1).cast("long").alias("n")))
    whole = reduce(DataFrame.unionByName, rows, aliases.select("user_key", "user", "id_key", "label", F.col("n").cast("long").alias("n")))
    return whole.groupBy("user_key", "id_key").agg(F.min("user").alias("user"), F.min("label").alias("label"), F.sum("n").alias("n")).select("user_key", "user", "id_key", "label", "n")


def _without(pairs: DataFrame, rejected: DataFrame | None) -> DataFrame:
    return pairs if rejected is None else pairs.join(rejected.select(F.col("pid").alias("p_id"), F.col("wid").alias("w_id")), ["p_id", "w_id"], "left_anti")


def _span_rows(df: DataFrame, lone: DataFrame | None) -> DataFrame:
    """Rows for a pass that is solved in spans: ``lone`` are those with one candidate (n of ``lone``)."""
    own = _kinds(df).filter(F.col("amount").isNotNull() & ~F.isnan("amount"))
    own = own.withColumn("lone", F.lit(False)) if lone is None else own.join(lone.filter("n = 1").select("id", F.lit(True).alias("lone")), "id", "left").withColumn("lone", F.coalesce("lone", F.lit(False)))
    return own.withColumns({"f": _forward(F.col("type"), F.col("ms")), "f_ms": F.col("ms"), "bare": F.col("seq.bare"), "loaded": F.col("seq.loaded"), "party": F.coalesce("party", F.lit(""))})


_ORDERED = ("id", "type", "f", "f_ms", "bare", "loaded", "amount", "lone")


def _span_panel(panel: DataFrame, lone: DataFrame | None = None, account_hint: DataFrame | None = None) -> DataFrame:
    own = _span_rows(panel, lone).withColumn("agent", norm(F.col("account")))
    if account_hint is None:
        own = own.withColumn("expected", F.lit(None).cast("array<string>"))
    else:
        own = own.join(account_hint.groupBy(F.col("agent_key").alias("agent")).agg(F.collect_set("account_key").alias("expected")), "agent", "left")
    return own.select(*_ORDERED, "party", "known", letter_runs(F.col("party")).alias("runs"), "agent", "expected")


def _span_wallet(wallet: DataFrame, lone: DataFrame | None = None) -> DataFrame:
    return _span_holders(_span_rows(wallet.filter(~F.col("no_time")), lone)).select(*_ORDERED, *_HOLDER, norm(F.col("account")).alias("account"))


_HOLDER = ("holder", "held", "name", "words", "keys")


def _span_holders(own: DataFrame) -> DataFrame:
    doc, cbu = F.coalesce("doc", F.lit("")), F.coalesce("cbu", F.lit(""))
    return own.withColumns({"holder": F.to_json(F.array("party", doc, cbu)), "held": F.col("party") != "", "name": name_key(F.col("party")), "words": name_tokens(F.col("party")), "keys": identity_keys(doc, cbu)})


def _span_slots(rows: DataFrame, params: P.Params, whole_day: bool) -> DataFrame:
    """Wallet rows without a time with their ``bands`` (of panel times, as in ``_slot_pairs``), and their class: rows of one class meet the same panel rows."""
    own = _span_holders(_span_rows(rows, None)).withColumns({"bands": _bands(params, whole_day), "f_ms": F.coalesce("f_ms", F.lit(-(2**63)))})
    own = own.withColumn("bands", F.filter("bands", lambda b: b["low"] < b["high"])).withColumn("f", F.array_min(F.transform("bands", lambda b: b["low"])))
    group = F.concat_ws("|", "name", "amount", "type", F.coalesce("shift", F.lit("")))
    own = own.withColumns({"group": group, "class": F.to_json(F.struct("bands", "amount", "holder", F.coalesce("shift", F.lit("")).alias("shift")))})
    return own.select(*_ORDERED, *_HOLDER, "bands", "group", "class")


def _bands(params: P.Params, whole_day: bool = False, x: str = "") -> Column:
    """The panel times (low, and high, which is out) that rows without a time may meet."""
    ms = F.col(f"{x}ms")
    start = ms - F.pmod(ms, F.lit(DAY_MS))
    day = F.array(F.struct(start.alias("a"), (start + DAY_MS).alias("b")))
    slots = F.transform(f"{x}slots", lambda s: F.struct(to_ms(s["from_ts"]).alias("a"), to_ms(s["to_ts"]).alias("b")))
    tol = params.clock_tolerance * P.MINUTE
    low = F.when(F.col("type") == "COLLECT", tol).otherwise(params.max_payout_lag * P.MINUTE)
    high = F.when(F.col("type") == "COLLECT", params.max_collect_lag * P.MINUTE).otherwise(tol)
    return F.transform(day if whole_day else F.coalesce(slots, day), lambda s: F.struct((s["a"] - low).alias("low"), (s["b"] + high).alias("high")))


def one_to_one(panel: DataFrame, wallet: DataFrame, aliases: DataFrame, params: P.Params, rejected=None, safe_only: bool = False, inverted: bool = False, account_hint=None) -> DataFrame:
    """One greedy pass. ``safe_only``: pairs whose identity is known or hinted, or that are
    each other's only candidate, and never a different identity."""
    panel = _with_known(panel, aliases)
    paired = lambda p, w: _related(_without(candidates(p, w, params, inverted), rejected), aliases)
    named, other = F.coalesce(F.col("relation").isin("known", "hint"), F.lit(False)), F.coalesce("relation", F.lit("")) != "different"
    if rejected is not None:
        pairs = paired(panel, wallet).filter(other) if inverted else paired(panel, wallet)
        edges = _edges(pairs, account_hint)
        if inverted or safe_only:
            edges = _counted(edges).filter((named | ((F.col("n_p") == 1) & (F.col("n_w") == 1))) & other).drop("n_p", "n_w")
        taken = greedy_match(edges, ["pid", "wid"], _order(), at="p_ms")
    else:
        # who has one candidate only is counted without pairs, or within spans, too
        reach = (params.clock_tolerance if inverted else max(params.max_collect_lag, params.max_payout_lag)) * P.MINUTE
        lone = candidate_totals(panel, wallet, params) if safe_only and not inverted else (None, None)
        w = _span_wallet(wallet, lone[1]).withColumn("f", F.col("f") + (reach if inverted else 0))
        p = _span_panel(panel, lone[0], account_hint)
        if inverted:
            p, w = materialize(p, "span-rows"), materialize(w, "span-rows")
            lone = materialize(by_span(p, w, reach, lone_pairs(params), "id string, n long", least=64).groupBy("id").agg(F.sum("n").alias("n")), "lone").filter("n = 1").select("id", F.lit(True).alias("lone"))
            p, w = (d.drop("lone").join(lone, "id", "left").withColumn("lone", F.coalesce("lone", F.lit(False))) for d in (p, w))
        taken = in_spans(p, w, reach, best_first(params, safe_only or inverted, inverted), least=64 if inverted else 8).withColumnsRenamed({"p_id": "pid", "w_id": "wid"})
    bonus = F.when(F.col("bonus") > 0, F.format_string("bonus %d%%", "bonus")).otherwise("")
    if inverted:
        return _matches(taken, ["pid"], ["wid"], _status(F.col("bonus")), F.lit("clock order reversed, review the time"), F.lit("low"))
    return _matches(taken, ["pid"], ["wid"], _status(F.col("bonus")), bonus, confidence(F.col("relation"), F.col("bonus"), F.col("score")))


def two_to_one(panel: DataFrame, wallet: DataFrame, aliases: DataFrame, params: P.Params) -> DataFrame:
    """One panel row for two wallet rows that add up to it, of one holder or unknown ones.

    Panel rows go in their order, each takes the first two free rows that suit; the pairs are made where they are decided.
    """
    most = max(params.max_collect_lag, params.max_payout_lag) * P.MINUTE
    taken = in_spans(_span_panel(_with_known(panel, aliases)), _span_wallet(wallet), most, first_pair(params))
    return _matches(taken.withColumnRenamed("w_id", "a_id"), ["p_id"], ["a_id", "b_id"], F.lit(P.GROUPED), F.lit("two wallet movements for one panel operation"), F.lit("medium"))


def _user_pairs(panel: DataFrame, most: int, opposite: bool, named: bool = False) -> DataFrame:
    """Pairs of one user's panel rows (a before b) at most ``most`` ms apart, of equal or of opposite types, with their signed sum."""
    own = panel.filter(F.col("type").isin(*P.MATCHABLE)).withColumn("user", norm(F.col("party")))
    own = own.filter("user <> ''") if named else own
    value = F.when(F.col("type") == "COLLECT", F.col("amount")).otherwise(-F.col("amount"))
    side = lambda x: own.select("user", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "ms", "seq", "type", "party")), value.alias(f"{x}_value"))
    pairs = band_join(side("a"), side("b"), ["user"], "a_ms", "b_ms", 0, most)
    before = (F.col("a_seq") < F.col("b_seq")) | ((F.col("a_seq") == F.col("b_seq")) & (F.col("a_id") < F.col("b_id")))
    kinds = F.col("a_type") != F.col("b_type") if opposite else F.col("a_type") == F.col("b_type")
    return pairs.filter(before & kinds).withColumn("value", F.col("a_value") + F.col("b_value"))


def _to_wallet(pairs: DataFrame, wallet: DataFrame, params: P.Params, reach: int) -> DataFrame:
    """Pairs with the wallet rows of their signed sum, within ``reach`` of the first of them."""
    unit = max(0.01, 2 * params.amount_tolerance)
    value = F.when(F.col("w_type") == "COLLECT", F.col("w_amount")).otherwise(-F.col("w_amount"))
    w = _side(wallet.filter(~F.col("no_time") & F.col("type").isin(*P.MATCHABLE)), "w").withColumnRenamed("type", "w_type").withColumn("w_value", value)
    keyed = pairs.withColumn("sum_key", F.explode(F.array(*(F.floor(F.col("value") / unit) + i for i in (-1, 0, 1)))))
    both = band_join(keyed, w.withColumn("sum_key", F.floor(F.col("w_value") / unit)), ["sum_key"], "a_ms", "w_ms", reach, reach)
    return both.filter(F.abs(F.col("value") - F.col("w_value")) <= params.amount_tolerance)


def _take_pairs(edges: DataFrame) -> DataFrame:
    return greedy_match(edges.select("w_id", "a_id", "b_id", "w_seq", "a_seq", "b_seq", "w_ms").distinct(), ["w_id", "a_id", "b_id"], [F.col(c) for c in ("w_seq", "w_id", "a_seq", "a_id", "b_seq", "b_id")], at="w_ms")


def one_to_two(panel: DataFrame, wallet: DataFrame, params: P.Params) -> DataFrame:
    """One wallet row for two panel rows of one user that add up to it."""
    most = F.when(F.col("w_type") == "COLLECT", params.max_collect_lag).otherwise(params.max_payout_lag) * P.MINUTE
    edges = _to_wallet(_user_pairs(panel, params.reach, False), wallet, params, params.reach).filter("a_type = w_type")
    for x in ("a", "b"):
        edges = edges.filter(lag(F.col("w_type"), F.col(f"{x}_ms"), F.col("w_ms")).between(F.lit(0), most))
    return _matches(_take_pairs(edges), ["a_id", "b_id"], ["w_id"], F.lit(P.GROUPED), F.lit("two panel operations for one wallet movement"), F.lit("medium"))


def netting(panel: DataFrame, wallet: DataFrame, aliases: DataFrame, params: P.Params) -> DataFrame:
    """A load and a withdrawal of one user whose net is one wallet movement of a known or hinted holder."""
    most = max(params.max_collect_lag, params.max_payout_lag) * P.MINUTE
    own = wallet.filter(F.coalesce("party", F.lit("")) != "")
    edges = _to_wallet(_user_pairs(panel, 2 * most, True, named=True), own, params, most).filter(F.abs(F.col("b_ms") - F.col("w_ms")) <= most)
    for x in ("a", "b"):
        edges = _related(edges.withColumn("p_party", F.col(f"{x}_party")), aliases).filter(F.col("relation").isin("known", "hint")).drop("relation", "p_party")
    return _matches(_take_pairs(edges), ["a_id", "b_id"], ["w_id"], F.lit(P.NETTED), F.lit("load and withdrawal net against one movement"), F.lit("medium"))


def _slot_pairs(panel: DataFrame, rows: DataFrame, params: P.Params, whole_day: bool = False) -> DataFrame:
    """Pairs of panel rows and wallet rows without a time: within their bands (or day), with amounts that agree (``bonus``)."""
    w = _side(rows, "w").withColumn("s", F.explode(_bands(params, whole_day, "w_"))).withColumns({"low": F.col("s.low"), "high": F.col("s.high")}).drop("s")
    hour = 3_600_000
    w = w.withColumn("__h", F.explode(F.sequence(F.floor(F.col("low") / hour), F.floor(F.col("high") / hour)))).withColumn("amount_key", _amount_key(F.col("w_amount"), params))
    p = _side(panel.filter(F.col("type").isin(*P.MATCHABLE)), "p").withColumn("__h", F.floor(F.col("p_ms") / hour)).withColumn("amount_key", F.explode(_amount_keys(F.col("p_amount"), F.col("type"), params)))
    pairs = w.join(p, ["type", "amount_key", "__h"]).filter((F.col("p_ms") >= F.col("low")) & (F.col("p_ms") < F.col("high"))).drop("__h", "amount_key", "low", "high").dropDuplicates(["p_id", "w_id"])
    return pairs.withColumn("bonus", amount_bonus(F.col("p_amount"), F.col("w_amount"), F.col("type"), params)).filter("bonus is not null")


def repeated_series(panel: DataFrame, wallet: DataFrame, aliases: DataFrame, params: P.Params) -> DataFrame:
    """Three or more equal transfers of one holder without a time, against the one user with a series like it.

    The user's rows must be as many (one may be missing), and the next user's at most a third. Both
    series are joined in order. Groups go by size; each round decides all groups of which no
    panel row is also wanted by an undecided group that goes before.
    """
    own = wallet.filter(F.col("no_time") & F.col("type").isin(*P.MATCHABLE) & (F.coalesce("party", F.lit("")) != ""))
    key = F.concat_ws("|", name_key(F.col("party")), F.col("amount"), F.col("type"), F.coalesce("shift", F.lit("")), F.floor(F.col("ms") / DAY_MS))
    group = Window.partitionBy("g")
    own = own.withColumn("g", key).withColumns({"size": F.count("*").over(group), "w_rank": F.row_number().over(group.orderBy("seq", "id"))}).filter("size >= 3")
    own = materialize(own, "series")
    heads = own.filter("w_rank = 1")
    pairs = _related(_slot_pairs(panel.filter(F.coalesce("party", F.lit("")) != ""), heads, params), aliases)
    pairs = pairs.filter((F.abs(F.col("p_amount") - F.col("w_amount")) <= params.amount_tolerance) & (F.coalesce("relation", F.lit("")) != "different"))
    # the order of groups: the largest first, then by their first rows
    rank = F.struct((-F.col("size")).alias("size"), F.col("seq").alias("seq"), F.col("id").alias("id"))
    left = pairs.join(heads.select(F.col("id").alias("w_id"), "g", "size", rank.alias("o")), "w_id").select("g", "size", "o", "p_id", "p_seq", "p_party", norm(F.col("p_party")).alias("user"))
    left, done = materialize(left, "series-pairs"), []
    while not left.isEmpty():
        first = left.groupBy("p_id").agg(F.min("o").alias("m"))
        ready = materialize(left.join(first, "p_id").groupBy("g").agg(F.every(F.col("o") == F.col("m")).alias("ok")).filter("ok").select("g"), "series-ready")
        mine = left.join(ready, "g", "left_semi")
        users = mine.groupBy("g", "size", "user").agg(F.count("*").alias("n"), F.min("p_seq").alias("s"))
        placed = users.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "s", "user")))
        best = placed.groupBy("g", "size").agg(F.max(F.when(F.col("r") == 1, F.col("n"))).alias("n1"), F.max(F.when(F.col("r") == 2, F.col("n"))).alias("n2"), F.max(F.when(F.col("r") == 1, F.col("user"))).alias("user"))
        fit = best.filter((F.col("n1") >= F.greatest(F.lit(3), F.col("size") - 1)) & (F.coalesce("n2", F.lit(0)) <= F.greatest(F.lit(1), F.floor(F.col("size") / 3))))
        rows = mine.join(fit.select("g", "user", "n1"), ["g", "user"]).withColumn("w_rank", F.row_number().over(Window.partitionBy("g").orderBy("p_seq", "p_id")))
        won = materialize(rows.join(own.select("g", "w_rank", F.col("id").alias("w_id"), "amount"), ["g", "w_rank"]).select("p_id", "w_id", "size", "n1", "amount", "p_party"), "series-won")
        done.append(won)
        left = materialize(left.join(ready, "g", "left_anti").join(won.select("p_id"), "p_id", "left_anti"), "series-pairs")
    if not done:
        return panel.sparkSession.createDataFrame([], "panel_ids array<string>, wallet_ids array<string>, status string, note string, confidence string")
    note = F.format_string("no time, one holder repeated (%d transfers of %.2f and %d rows of %s)", "size", "amount", "n1", "p_party")
    return _matches(reduce(DataFrame.unionByName, done), ["p_id"], ["w_id"], F.lit(P.MATCHED), note, F.lit("medium"))


def _no_time_in_spans(panel: DataFrame, rows: DataFrame, aliases: DataFrame, params: P.Params, whole_day: bool) -> DataFrame:
    """The pairs (pid, wid, bonus, relation) of ``no_time``: rows without a time, not panel rows, are dealt to spans, and meet the panel rows of their bands."""
    w = materialize(_span_slots(rows, params, whole_day).filter("f is not null"), "slots")
    reach = w.agg(F.max(F.array_max(F.transform("bands", lambda b: b["high"])) - F.col("f"))).first()[0] or 0
    p = _span_panel(_with_known(panel, aliases)).withColumns({"f": F.col("f_ms"), "group": F.concat_ws("|", norm(F.col("party")), "amount", "type")}).filter("f is not null")
    if not whole_day and reach:
        p = materialize(p, "span-rows")
        told = by_span(w, p, reach, only_group(params), "id string, low string, high string", least=2)
        lone = materialize(told.groupBy("id").agg((F.min("low") == F.max("high")).alias("lone")), "lone")
        w, p = (d.drop("lone").join(lone, "id", "left").withColumn("lone", F.coalesce("lone", F.lit(False))) for d in (w, p))
    return in_spans(w, p, reach, first_in_bands(params, whole_day), least=2).withColumnsRenamed({"p_id": "wid", "w_id": "pid"})


def no_time(panel: DataFrame, wallet: DataFrame, aliases: DataFrame, params: P.Params, rejected=None, whole_day: bool = False) -> DataFrame:
    """Wallet rows that have a day (or shift bands) but no time.

    ``whole_day``: passes over the bands, asks for a known or hinted identity, low confidence.
    """
    rows = wallet.filter(F.col("no_time") & F.col("type").isin(*P.MATCHABLE))
    if whole_day:
        rows = rows.filter(F.col("slots").isNotNull())
    if rejected is not None:
        pairs = _slot_pairs(panel, rows, params, whole_day)
        pairs = _related(_without(pairs, rejected), aliases)
        group_w = F.concat_ws("|", name_key(F.col("w_party")), F.col("w_amount"), F.col("type"), F.coalesce("w_shift", F.lit("")))
        group_p = F.concat_ws("|", norm(F.col("p_party")), F.col("p_amount"), F.col("type"))
        alone = (F.size(F.collect_set(group_w).over(Window.partitionBy("p_id"))) == 1) & (F.size(F.collect_set(group_p).over(Window.partitionBy("w_id"))) == 1)
        points = 100 + F.when(F.col("relation") == "known", 60).when(F.col("relation") == "hint", 25).when(F.col("relation") == "different", -45).otherwise(0) - F.when(F.col("bonus") > 0, 15).otherwise(0)
        sure = F.coalesce(F.col("relation").isin("known", "hint"), F.lit(False))
        edges = pairs.withColumns({"alone": alone, "score": points.cast("double")}).filter(sure if whole_day else sure | F.col("alone"))
        edges = edges.select(F.col("p_id").alias("pid"), F.col("w_id").alias("wid"), "bonus", "relation", "score", "p_seq", "w_seq", "w_ms")
        taken = greedy_match(edges, ["pid", "wid"], [-F.col("score"), F.col("w_seq"), F.col("wid"), F.col("p_seq"), F.col("pid")], at="w_ms")
    else:
        taken = _no_time_in_spans(panel, rows, aliases, params, whole_day)
    conf = F.lit("low") if whole_day else F.when(F.col("relation") == "known", "high").when(F.col("relation") == "hint", "medium").otherwise("low")
    note = F.concat_ws(", ", F.lit("no time"), F.lit("outside its shift") if whole_day else F.lit(None), F.when(F.col("bonus") > 0, F.format_string("bonus %d%%", "bonus")))
    return _matches(taken, ["pid"], ["wid"], _status(F.col("bonus")), note, conf)


def voids(panel: DataFrame, params: P.Params) -> DataFrame:
    """Unmatched panel rows that undo each other: id, note."""
    own = panel.filter(F.col("type").isin(*P.MATCHABLE) & (F.coalesce("party", F.lit("")) != "")).withColumns({"user": norm(F.col("party")), "agent": norm(F.col("account"))})
    side = lambda x: own.select("user", "agent", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "ms", "seq", "amount", "type")))
    pairs = band_join(side("a"), side("b"), ["user", "agent"], "a_ms", "b_ms", 0, params.void_window * P.MINUTE)
    pairs = pairs.filter((F.col("a_id") != F.col("b_id")) & (F.col("a_type") != F.col("b_type")) & (F.abs(F.col("a_amount") - F.col("b_amount")) <= params.amount_tolerance))
    taken = greedy_match(pairs.select("a_id", "b_id", "a_seq", "b_seq", "a_ms", "b_ms", "a_type", "b_type"), ["a_id", "b_id"], [F.col(c) for c in ("a_seq", "a_id", "b_seq", "b_id")], at="a_ms")
    sec = F.floor((F.col("b_ms") - F.col("a_ms")) / 1000 + 0.5)
    span = F.when(sec < 120, F.concat(sec.cast("string"), F.lit(" s"))).otherwise(F.concat(F.floor(sec / 60 + 0.5).cast("string"), F.lit(" min")))
    word = lambda c: F.when(F.col(c) == "COLLECT", "load").otherwise("withdrawal")
    note = F.concat(word("a_type"), F.lit(" and "), word("b_type"), F.lit(" of the same amount "), span, F.lit(" later"))
    return taken.select(F.explode(F.array("a_id", "b_id")).alias("id"), note.alias("note"))


def duplicates(loose: DataFrame, paid: DataFrame, params: P.Params, manual: DataFrame | None = None) -> DataFrame:
    """Ids of unmatched payouts with a matched twin in the window, or an earlier unmatched one. ``manual``:
    unmatched rows with a state of the user's, which are twins of others but none themselves."""
    pay = lambda d: d.filter((F.col("type") == "PAYOUT") & (F.coalesce("party", F.lit("")) != "")).withColumn("name", name_key(F.col("party")))
    unit = max(0.01, 2 * params.amount_tolerance)
    mine = pay(loose).filter(~F.col("no_time")).withColumn("unit", F.explode(F.array(*(F.floor(F.col("amount") / unit) + i for i in (-1, 0, 1))))).select("name", "unit", F.col("id").alias("a_id"), F.col("ms").alias("a_ms"), F.col("amount").alias("a_amount"))
    alone = loose if manual is None else loose.unionByName(manual)
    other = pay(alone).withColumn("matched", F.lit(False)).unionByName(pay(paid).withColumn("matched", F.lit(True))).withColumn("unit", F.floor(F.col("amount") / unit)).select("name", "unit", F.col("id").alias("b_id"), F.col("ms").alias("b_ms"), F.col("amount").alias("b_amount"), "matched")
    most = params.duplicate_window * P.MINUTE
    twins = band_join(mine, other, ["name", "unit"], "a_ms", "b_ms", most, most).filter((F.col("a_id") != F.col("b_id")) & (F.abs(F.col("a_amount") - F.col("b_amount")) <= params.amount_tolerance))
    return twins.filter(F.col("matched") | (F.col("b_ms") < F.col("a_ms"))).select(F.col("a_id").alias("id")).distinct()


def default_status(side: Column, kind: Column) -> Column:
    """The status of a movement that stays alone."""
    return (
        F.when(~kind.isin(*P.MATCHABLE), kind)
        .when((side == "panel") & (kind == "COLLECT"), P.CHIPS_NO_COLLECT).when(side == "panel", P.WITHDRAWAL_NO_PAYOUT)
        .when(kind == "COLLECT", P.COLLECT_NO_CHIPS).otherwise(P.PAYOUT_NO_WITHDRAWAL)
    )


def build_matches(rows: DataFrame, panel: DataFrame, wallet: DataFrame) -> DataFrame:
    """Sums, difference, first time and lag (null where a member has no time, but for forced matches) of each match (panel_ids, wallet_ids, status, note, confidence)."""
    keyed = rows.withColumn("match_id", F.concat(F.array_join("panel_ids", "+"), F.lit("="), F.array_join("wallet_ids", "+")))
    members = keyed.select("match_id", F.explode("panel_ids").alias("id"), F.lit("panel").alias("s")).unionByName(keyed.select("match_id", F.explode("wallet_ids").alias("id"), F.lit("wallet").alias("s")))
    shape = ("ms", "ts", "type", "amount", "account", "origin", "no_time")
    known = panel.select("id", F.lit("panel").alias("s"), *shape).unionByName(wallet.select("id", F.lit("wallet").alias("s"), *shape))
    full = members.join(known, ["id", "s"])
    on = lambda s, c: F.when(F.col("s") == s, F.col(c))
    signed = F.when(F.col("type") == "COLLECT", F.col("amount")).otherwise(-F.col("amount"))
    got = full.groupBy("match_id").agg(
        F.max("no_time").alias("no_time"), F.min("ts").alias("ts"), F.min(on("panel", "ts")).alias("panel_ts"), round2(F.sum(F.coalesce(on("panel", "amount"), F.lit(0.0)))).alias("panel_plain"), round2(F.sum(F.coalesce(on("wallet", "amount"), F.lit(0.0)))).alias("wallet_amount"),
        F.sum(F.when(F.col("s") == "panel", signed)).alias("panel_net"), F.min(on("wallet", "type")).alias("wallet_type"),
        F.min(on("panel", "ms")).alias("p_lo"), F.max(on("panel", "ms")).alias("p_hi"), F.min(on("wallet", "ms")).alias("w_lo"), F.max(on("wallet", "ms")).alias("w_hi"),
        F.min_by(on("panel", "type"), on("panel", "ms")).alias("panel_type"), F.min_by(on("panel", "account"), on("panel", "ms")).alias("agent"),
        F.min_by(F.concat_ws(" ", "origin", "account"), F.when(F.col("s") == "wallet", F.col("ms"))).alias("wallet_account"),
    )
    kind = F.coalesce("panel_type", "wallet_type")
    full = keyed.join(got, "match_id").withColumn("type", kind)
    netted = round2(F.col("panel_net") * F.when(F.col("wallet_type") == "COLLECT", 1).otherwise(-1))
    amount = F.when(F.col("status") == P.NETTED, netted).otherwise(F.col("panel_plain"))
    late = F.when(F.col("type") == "COLLECT", F.col("p_hi") - F.col("w_lo")).otherwise(F.col("w_hi") - F.col("p_lo"))
    return full.select(
        "match_id", "type", "panel_ids", "wallet_ids", "status", "note", "ts", "panel_ts", amount.alias("panel_amount"), "wallet_amount",
        round2(amount - F.col("wallet_amount")).alias("difference"), F.when(~F.col("no_time") | (F.col("status") == P.MANUAL), late).alias("lag_ms"), "confidence", "agent", "wallet_account",
    )


def forced_matches(forced: DataFrame, real: DataFrame) -> DataFrame:
    """The user's matches that stand: (panel_ids, wallet_ids, note), in their order, each id of ``real`` once at most."""
    order = F.col("ordinal").cast("long") if "ordinal" in forced.columns else F.monotonically_increasing_id()
    own = materialize(forced.select("panel_ids", "wallet_ids", F.coalesce("note", F.lit("")).alias("note"), order.alias("o")), "forced")
    ends = own.select("o", F.explode(F.array_distinct(F.concat("panel_ids", "wallet_ids"))).alias("id")).join(real, "id")
    here = ends.groupBy("o").agg(F.collect_set("id").alias("here"))
    kept = None
    left = materialize(ends, "forced-ends")
    while not left.isEmpty():
        first = left.groupBy("id").agg(F.min("o").alias("m"))
        won = materialize(left.join(first, "id").groupBy("o").agg(F.every(F.col("o") == F.col("m")).alias("ok")).filter("ok").select("o"), "forced-won")
        kept = won if kept is None else kept.unionByName(won)
        used = left.join(won, "o", "left_semi").select("id")
        out = left.join(used, "id", "left_semi").select("o").distinct()
        left = materialize(left.join(out, "o", "left_anti"), "forced-ends")
    full = own.join(here, "o") if kept is None else own.join(kept, "o", "left_semi").join(here, "o")
    ids = lambda c: F.filter(c, lambda x: F.array_contains("here", x)).alias(c)
    return full.select(ids("panel_ids"), ids("wallet_ids"), "note")


def reconcile(panel: DataFrame, wallet: DataFrame, params: P.Params | None = None, aliases: DataFrame | None = None, forced: DataFrame | None = None, states: DataFrame | None = None, rejected: DataFrame | None = None, account_hint: DataFrame | None = None) -> dict[str, DataFrame]:
    """All passes in their order. Returns matches, pending and aliases.

    forced: (panel_ids, wallet_ids, note); states: (id, status, note); rejected: (pid, wid);
    account_hint: (agent_key, account_key). Ids are unique over both sides. A forced match of which a
    member is missing keeps the others; one that shares a member with an earlier one that stands is passed over
    (``ordinal`` of forced, if it has one, is their order, else the order of its rows).
    """
    params = params or P.Params()
    spark = panel.sparkSession
    panel, wallet = materialize(movements(panel, "panel"), "panel"), materialize(movements(wallet, "wallet"), "wallet")
    aliases = spark.createDataFrame([], "user_key string, user string, id_key string, label string, n long") if aliases is None else aliases
    done: list[DataFrame] = []
    if forced is not None:
        done.append(materialize(_matches_of(forced_matches(forced, panel.select("id").unionByName(wallet.select("id")))), "forced"))
    free_p, free_w = _unused(panel, done, "panel"), _unused(wallet, done, "wallet")
    if states is not None:
        free_p, free_w = (d.join(states.select("id"), "id", "left_anti") for d in (free_p, free_w))

    def add(m: DataFrame) -> None:
        # what is left is written, as each pass leaves less of it and the next ones read it several times
        nonlocal free_p, free_w
        done.append(materialize(m, "pass"))
        free_p, free_w = (materialize(_unused(d, done[-1:], side), "free") for d, side in ((free_p, "panel"), (free_w, "wallet")))

    known = aliases
    for safe in (True, False):
        add(one_to_one(free_p, free_w, known, params, rejected, safe_only=safe, account_hint=account_hint))
        known = materialize(learn(known, done, panel, wallet), "aliases")
    if params.clock_tolerance > 0:
        add(one_to_one(free_p, free_w, known, params, rejected, inverted=True, account_hint=account_hint))
    if params.group:
        add(two_to_one(free_p, free_w, known, params))
        add(one_to_two(free_p, free_w, params))
        add(netting(free_p, free_w, known, params))
    add(no_time(free_p, free_w, known, params, rejected))
    add(repeated_series(free_p, free_w, known, params))
    add(no_time(free_p, free_w, known, params, rejected, whole_day=True))
    rows = reduce(DataFrame.unionByName, done)
    matches = materialize(build_matches(rows, panel, wallet), "matches")
    void = materialize(voids(free_p, params), "voids")
    paid = wallet.join(rows.select(F.explode("wallet_ids").alias("id")), "id", "left_semi")
    stated = None if states is None else wallet.join(states.select("id").distinct(), "id", "left_semi")
    twice = materialize(duplicates(free_w, paid, params, stated), "duplicates")
    loose = _unused(panel, done, "panel").unionByName(_unused(wallet, done, "wallet"))
    if states is not None:  # a row with a state of the user's is shown as such, though a forced match has it
        both = panel.unionByName(wallet).join(states.select("id").distinct(), "id", "left_semi")
        loose = loose.join(states.select("id"), "id", "left_anti").unionByName(both)
    manual = spark.createDataFrame([], "id string, status string, note string") if states is None else states
    pending = (
        loose.join(manual.select("id", F.col("status").alias("m_status"), F.col("note").alias("m_note")), "id", "left")
        .join(void.select("id", F.col("note").alias("v_note")), "id", "left")
        .join(twice.withColumn("twice", F.lit(True)), "id", "left")
    )
    status = F.when(F.col("m_status").isNotNull(), F.col("m_status")).when(F.col("v_note").isNotNull(), P.PANEL_VOID).when(F.col("twice"), P.DUPLICATE_PAYOUT).otherwise(default_status(F.col("side"), F.col("type")))
    pending = pending.select(*panel.columns, status.alias("status"), F.coalesce("m_note", "v_note", F.lit("")).alias("note"), F.col("m_status").isNull().alias("automatic"))
    return {"matches": matches, "pending": materialize(pending, "pending"), "aliases": known, "panel": panel, "wallet": wallet}


def _matches_of(forced: DataFrame) -> DataFrame:
    return forced.select("panel_ids", "wallet_ids", F.lit(P.MANUAL).alias("status"), "note", F.lit("manual").alias("confidence"))
