"""Headerless panels, dataset assembly, lookups, the repeated series and forced chains."""

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from ledgerloom.operators import dataset, matching
from ledgerloom.sources.cells import SCHEMA, pasted_cells, xlsx_tables
from ledgerloom.sources.importers import Mapping, column_letter, saved_mapping, signature
from ledgerloom.sources.panels import pasted_records, shifted_records, tokens

DAY = dt.datetime(2025, 5, 6)


def cells(spark, rows):
    return spark.createDataFrame([("s", "", i, r, None) for i, r in enumerate(rows)], SCHEMA)


def test_pasted_panel(spark):
    flat = ["70000001", "06/05/2025 10:00", "Retiro", "boss", "ana1", "boss", "1.500", "x", "70000002", "06/05/2025 10:05", "Depósito", "boss", "boss", "leo2", "300", "70000003", "bad", "Retiro"]
    got = pasted_records(cells(spark, [[t] for t in flat])).orderBy("load_seq").collect()
    assert [(r.ref, r.type, r.party, r.account, r.amount, str(r.ts)) for r in got] == [("70000001", "PAYOUT", "ana1", "boss", 1500.0, "2025-05-06 10:00:00"), ("70000002", "COLLECT", "leo2", "boss", 300.0, "2025-05-06 10:05:00")]
    # a record that begins inside another one is none; a counter column is passed over
    inside = ["80000001", "06/05/2025", "Bono", "80000002", "06/05/2025", "Bono", "5", "q", "r", "7"]
    assert [r.ref for r in pasted_records(cells(spark, [[t] for t in inside])).collect()] == ["80000001"]
    counted = [[str(i % 8 + 1), f"t{i}"] for i in range(20)]
    assert [r.token for r in tokens(cells(spark, counted)).orderBy("at").collect()] == [f"t{i}" for i in range(20)]
    assert pasted_records(cells(spark, [])).count() == 0


def test_shifted_panel(spark):
    rows = [
        ["1", "R77", "06/05/2025 11:00", "DEPOSITO (asked)", "ag", "", "ana1", "250", "0", "9"],
        ["", "R78", "06/05/2025 11:01", "", "Retiro", "leo2", "ag", "0", "40,5"],
        ["R79", "06/05/1999 11:01", "RETIRO", "leo2", "ag", "0", "40"],
        ["R80", "06/05/2025", "BONUS", "ag", "ana1", "0", "0"],
        ["x"],
    ]
    got = shifted_records(cells(spark, rows)).orderBy("load_seq").collect()
    assert [(r.ref, r.type, r.party, r.account, r.amount) for r in got] == [("R77", "COLLECT", "ana1", "ag", 250.0), ("R78", "PAYOUT", "leo2", "ag", 40.5)]


def test_workbook_numbers():
    cell = lambda ref, v, t="": f'<c r="{ref}" {t}><v>{v}</v></c>'
    body = cell("A1", "1.2E7") + cell("B1", "12.345") + cell("C1", "0.125") + cell("D1", "12.345", 't="str"')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<x:workbook xmlns:x="m" xmlns:r="r"><x:sheets><x:sheet name="S" r:id="r1"/></x:sheets></x:workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", "﻿" + f'<worksheet><sheetData><row r="1">{body}</row></sheetData></worksheet>')
    ((_, (row,)),) = xlsx_tables(out.getvalue())
    assert [getattr(c, "value", None) for c in row] == [1.2e7, 12.345, 0.125, None] and row[0] == "12000000" and row[3] == "12.345"


def test_mappings(spark):
    own = pasted_cells(spark, "Day\tSum\n06/05/2025\t5")
    assert saved_mapping(own, {signature(["day", "SUM"]): Mapping("wallet", 0, 1)}) == Mapping("wallet", 0, 1)
    assert saved_mapping(own, {}) is None and [column_letter(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


RECORD = "side string, origin string, account string, party string, ts timestamp_ntz, type string, amount double, ref string, detail string, doc string, cbu string, no_time boolean, shift string, load_seq long"


def records(spark, rows):
    full = [(s, "O", a, p, DAY + dt.timedelta(minutes=m), t, float(x), r, "", "", "", nt, sh, i) for i, (s, a, p, m, t, x, r, nt, sh) in enumerate(rows)]
    return spark.createDataFrame(full, RECORD)


def test_assembly(spark):
    a = records(spark, [("panel", "Box One", "ana", 0, "COLLECT", 5, "r1", False, ""), ("panel", "b", "ana", 1, "COLLECT", 5, "r1", False, ""), ("wallet", "w", "", 2, "PAYOUT", 7, "r2", False, ""), ("wallet", "w", "x", 0, "PAYOUT", 9, "", True, "Shift 1")])
    b = records(spark, [("panel", "b", "ANA", 0.5, "COLLECT", 5, "", False, ""), ("panel", "b", "leo", 0, "COLLECT", 6, "", False, "")])
    names = spark.createDataFrame([("r2", "RUTH PAZ")], "ref string, holder string")
    sources = [dataset.Source("a", a, sheet="S"), dataset.Source("b", b), dataset.Source("n", b.limit(0), names), dataset.Source("off", a, active=False)]
    got = dataset.assemble(sources, dataset.Config(accounts={"boxone": "Main"}))
    rows = {r.party: r for r in got.collect()}
    assert set(rows) == {"ana", "RUTH PAZ", "x", "leo"} and (rows["ana"].account, rows["ana"].id, rows["ana"].source) == ("Main", "O|r1|COLLECT", "a / S")
    assert str(rows["x"].ts) == "2025-05-06 10:00:00" and len(rows["x"].slots) == 1 and rows["leo"].slots is None
    panel, wallet = dataset.by_side(got)
    assert (panel.count(), wallet.count()) == (2, 2)
    lines = {"L": ("main",)}
    kept, out = dataset.choose_agents(panel, lines, line="L")
    assert [r.account for r in kept.collect()] == ["Main"] and [(r.account, r.n) for r in dataset.excluded_counts(out).collect()] == [("b", 1)]
    assert [(r.account, r.line, r.n) for r in dataset.agent_inventory(panel, lines).collect()] == [("b", None, 1), ("Main", "L", 1)]
    late = F.lit("2025-05-07").cast("timestamp_ntz")
    assert {r.source for r in dataset.sources_outside(got, F.lit("2025-05-06 09:00:00").cast("timestamp_ntz"), late).collect()} == {"b"}


def test_series_and_forced_chains(spark):
    move = "id string, ts timestamp_ntz, type string, party string, account string, amount double, no_time boolean"
    panel = [(f"p{i}", DAY + dt.timedelta(hours=i), "COLLECT", "zzq", "ag", 50.0, False) for i in range(3)] + [("q", DAY, "COLLECT", "other", "ag", 50.0, False)]
    wallet = [(f"w{i}", DAY, "COLLECT", "RUTH PAZ", "b", 50.0, True) for i in range(3)]
    p, w = (matching.movements(spark.createDataFrame(x, move), s) for x, s in ((panel, "panel"), (wallet, "wallet")))
    none = spark.createDataFrame([], "user_key string, user string, id_key string, label string, n long")
    got = matching.repeated_series(p, w, none, matching.P.Params()).collect()
    assert sorted((r.panel_ids[0], r.wallet_ids[0], r.confidence) for r in got) == [("p0", "w0", "medium"), ("p1", "w1", "medium"), ("p2", "w2", "medium")]
    forced = spark.createDataFrame([(["p0"], ["w0"], "", 0), (["p0"], ["w1"], "", 1), (["p1"], ["w1"], "", 2), (["p9", "p2"], ["w2"], None, 3)], "panel_ids array<string>, wallet_ids array<string>, note string, ordinal long")
    real = p.select("id").unionByName(w.select("id"))
    assert sorted((r.panel_ids, r.wallet_ids) for r in matching.forced_matches(forced, real).collect()) == [(["p0"], ["w0"]), (["p1"], ["w1"]), (["p2"], ["w2"])]
