"""The engine's operators on small tables, against goldens and plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import names, numbers, times
from ledgerloom.operators import dedup, diagnosis, matching, report
from ledgerloom.operators.joins import band_join, greedy_match
from ledgerloom.plans.params import Params

T0 = dt.datetime(2026, 3, 2, 12, 0, 0)
MOVE = "id string, ts timestamp_ntz, type string, party string, account string, amount double, no_time boolean, doc string, ref string"


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def moves(spark, rows):
    full = [(i, at(t), k, p, a, float(m), bool(x.get("no_time")), x.get("doc"), x.get("ref")) for i, t, k, p, a, m, x in ((*r, {})[:7] for r in rows)]
    return spark.createDataFrame(full, MOVE)


def one(spark, text, f, kind="string"):
    return spark.createDataFrame([(t,) for t in text], f"x {kind}").select(f(F.col("x")).alias("y")).toPandas()["y"].tolist()


def test_numbers(spark):
    texts = ["7.500", "EUR 81,05", "90125.0625", "-45.600 ", "(9.876,25)", "4,305,718", "6,125", "31-", "-(8)", "", "words", "4.5.6", "$ 9", None, "1.234.567,8", "1,234,567.8", "1,2,3", ".5", "12.", "1,2.3,4", "(-3)"]
    got = one(spark, texts, numbers.parse_number)
    want = [7500.0, 81.05, 90125.0625, -45600.0, -9876.25, 4305718.0, 6.125, -31.0, None, None, None, None, 9.0, None, 1234567.8, 1234567.8, None, 0.5, None, None, 3.0]
    assert [None if g is None or g != g else g for g in got] == want
    assert one(spark, [1234.5, -0.5, 1e6], numbers.format_money, "double") == ["1.234,50", "-0,50", "1.000.000,00"]
    assert one(spark, [1.005, -1.005, 2.675], numbers.round2, "double") == [1.0, -1.0, 2.68]


def test_times(spark):
    texts = ["2025-04-17 22:08:30", "2025-04-17T01:15:00,250-03:00", "2025-04-17T05:15Z", "2025-04-17 05:15:00+0200", "2025-04-17", "17.04.2025 07:09:11.5", "17/04/25 10:20 PM", "8-4-25 19:45 PM", "17/04/2025, 12:05 a.m.", "31/02/2025", "32/01/2025", "17/04/2025 10:99", "no date", "", "17/04/202"]
    got = one(spark, texts, lambda c: times.parse_datetime(c).cast("string"))
    assert got == ["2025-04-17 22:08:30", "2025-04-17 01:15:00.25", "2025-04-17 02:15:00", "2025-04-17 00:15:00", "2025-04-17 00:00:00", "2025-04-17 07:09:11.005", "2025-04-17 22:20:00", "2025-04-08 19:45:00", "2025-04-17 00:05:00", "2025-03-03 00:00:00", None, None, None, None, None]
    assert one(spark, [95_000, 3_725_000, 0, -60_000, 59_999], times.format_duration, "long") == ["1 min 35 s", "1 h 2 min", "0 s", "-1 min", "1 min"]
    edges = [dt.datetime(2026, 1, 2, *x) for x in ((5, 59, 59), (6, 0, 0), (14, 0, 0), (23, 0, 0))]
    assert one(spark, edges, times.shift_of, "timestamp_ntz") == ["Shift 3", "Shift 1", "Shift 2", "Shift 3"]
    assert [str(d) for d in one(spark, edges[:2], lambda c: times.operational_day(c).cast("string"), "timestamp_ntz")] == ["2026-01-01", "2026-01-02"]
    assert one(spark, ["6:05", "06:05:15", "6:05 PM", "12:00 am", "25"], times.parse_time_of_day)[:4] == [21_900_000, 21_915_000, 65_100_000, 0]
    assert one(spark, [46000.5], lambda c: times.from_excel_serial(c).cast("string"), "double") == ["2025-12-09 12:00:00"]


def test_names(spark):
    assert one(spark, ["Ñandú  S.A. 3", None, "DirecciÃ³n"], names.norm) == ["nandusa3", "", "direccion"]
    assert one(spark, ["LÓPEZ, Ana M. de"], names.name_key) == ["lopez ana de"]
    assert one(spark, ["20-30414243-3", "30.414.243", "12"], names.doc_of) == ["30414243", "30414243", ""]
    pairs = [("marta88", "MARTA GOMEZ", True), ("gomez77", "MARTA GOMEZ", True), ("mar30ta", "Marta Ruiz", True), ("brnda12", "BRENDA SOL", True), ("ineslopez", "RAUL LOPEZ", True), ("elna9", "ELENA X", True), ("xq12", "MARTA GOMEZ", False), ("ana", "ANA PAZ", False), ("pedro1", "", False), (None, "PEDRO", False)]
    df = spark.createDataFrame([p[:2] for p in pairs], "u string, h string").select(names.name_hint(F.col("u"), F.col("h")).alias("y"))
    assert df.toPandas()["y"].tolist() == [p[2] for p in pairs]


def test_band_join(spark):
    rnd = random.Random(3)
    a = [(i, rnd.choice("xy"), rnd.randint(-500, 500)) for i in range(80)]
    b = [(i, rnd.choice("xy"), rnd.randint(-500, 500)) for i in range(80)]
    got = band_join(spark.createDataFrame(a, "a int, k string, s long"), spark.createDataFrame(b, "b int, k string, t long"), ["k"], "s", "t", 7, 31)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((i, j) for i, k, s in a for j, m, t in b if k == m and -7 <= t - s <= 31)


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_match(spark, seed):
    rnd = random.Random(seed)
    edges = list({(f"p{rnd.randint(0, 12)}", f"w{rnd.randint(0, 12)}", None if rnd.random() < 0.5 else f"w{rnd.randint(13, 18)}", rnd.randint(0, 5)) for _ in range(60)})
    used, want = set(), set()
    for p, w, x, s in sorted(edges, key=lambda e: (-e[3], e[0], e[1], e[2] or "")):
        ends = {p, w} | ({x} if x else set())
        if not ends & used:
            used |= ends
            want.add((p, w, x, s))
    df = spark.createDataFrame(edges, "p string, w string, x string, s int")
    got = greedy_match(df, ["p", "w", "x"], [-F.col("s"), F.col("p"), F.col("w"), F.coalesce("x", F.lit(""))])
    assert {tuple(r) for r in got.collect()} == want


def run(spark, panel, wallet, **kw):
    r = matching.reconcile(moves(spark, panel), moves(spark, wallet), **kw)
    m = {x.match_id: x for x in r["matches"].collect()}
    return m, {x.id: x.status for x in r["pending"].collect()}, r


def test_order_and_window(spark):
    panel = [("p1", 1.5, "COLLECT", "ana1", "ag", 100), ("p2", 10, "PAYOUT", "leo2", "ag", 50), ("p3", 60, "COLLECT", "u", "ag", 7)]
    wallet = [("w1", 0, "COLLECT", "", "box", 100), ("w2", 13, "PAYOUT", "", "box", 50), ("w3", 0, "COLLECT", "", "box", 7)]
    m, pending, _ = run(spark, panel, wallet)
    assert {k: v.lag_ms for k, v in m.items()} == {"p1=w1": 90_000, "p2=w2": 180_000}
    assert pending == {"p3": "CHIPS_NO_COLLECT", "w3": "COLLECT_NO_CHIPS"}


def test_bonus_alias_and_learning(spark):
    m, _, _ = run(spark, [("p", 2, "COLLECT", "x1", "a", 110)], [("w", 0, "COLLECT", "", "b", 100)])
    assert (m["p=w"].status, m["p=w"].note, m["p=w"].difference) == ("MATCHED_BONUS", "bonus 10%", 10.0)
    aliases = spark.createDataFrame([("zz9", "zz9", "ruth paz", "RUTH PAZ", 1)], "user_key string, user string, id_key string, label string, n long")
    wallet = [("w1", 0, "COLLECT", "RUTH PAZ", "b", 100), ("w2", 9, "COLLECT", "IVO SOL", "b", 100)]
    m, _, r = run(spark, [("p", 10, "COLLECT", "zz9", "a", 100)], wallet, aliases=aliases)
    assert list(m) == ["p=w1"] and m["p=w1"].confidence == "high"
    assert {(x.id_key, x.n) for x in r["aliases"].collect()} == {("ruth paz", 3)}


def test_groups_netting_inverted(spark):
    m, _, _ = run(spark, [("p", 5, "COLLECT", "x", "a", 10_000)], [("w1", 0, "COLLECT", "", "b", 6000), ("w2", 1, "COLLECT", "", "b", 4000)])
    assert [(v.status, k) for k, v in m.items()] == [("GROUPED", "p=w1+w2")]
    m, _, _ = run(spark, [("p1", 5, "COLLECT", "x", "a", 6000), ("p2", 6, "COLLECT", "x", "a", 4000)], [("w", 0, "COLLECT", "", "b", 10_000)])
    assert list(m) == ["p1+p2=w"]
    m, _, _ = run(spark, [("p1", 0, "PAYOUT", "marta1", "a", 6000), ("p2", 1, "COLLECT", "marta1", "a", 1000)], [("w", 4, "PAYOUT", "MARTA RUIZ", "b", 5000)])
    assert [(v.status, v.panel_amount, v.difference) for v in m.values()] == [("NETTED", 5000.0, 0.0)]
    m, _, _ = run(spark, [("p", 0, "COLLECT", "x", "a", 70)], [("w", 1, "COLLECT", "", "b", 70)])
    assert [(v.confidence, v.lag_ms) for v in m.values()] == [("low", -60_000)]


def test_duplicates_voids_manual_no_time(spark):
    wallet = [("w1", 5, "PAYOUT", "LEO PAZ", "b", 80), ("w2", 9, "PAYOUT", "LEO PAZ", "b", 80)]
    m, pending, _ = run(spark, [("p", 0, "PAYOUT", "leo", "a", 80)], wallet)
    assert list(m) == ["p=w1"] and pending == {"w2": "DUPLICATE_PAYOUT"}
    _, pending, _ = run(spark, [("a", 0, "COLLECT", "u", "g", 10), ("b", 0.3, "PAYOUT", "u", "g", 10), ("c", 0, "COLLECT", "v", "g", 10), ("d", 120, "PAYOUT", "v", "g", 10)], [])
    assert pending == {"a": "PANEL_VOID", "b": "PANEL_VOID", "c": "CHIPS_NO_COLLECT", "d": "WITHDRAWAL_NO_PAYOUT"}
    forced = spark.createDataFrame([(["p"], ["w"], "by hand")], "panel_ids array<string>, wallet_ids array<string>, note string")
    m, _, _ = run(spark, [("p", 0, "COLLECT", "u", "g", 1)], [("w", 500, "COLLECT", "", "b", 500)], forced=forced)
    assert [(v.status, v.difference, v.confidence) for v in m.values()] == [("MANUAL", -499.0, "manual")]
    rejected = spark.createDataFrame([("p", "w")], "pid string, wid string")
    m, _, _ = run(spark, [("p", 1, "COLLECT", "u", "g", 1)], [("w", 0, "COLLECT", "", "b", 1)], rejected=rejected)
    assert not m
    m, _, _ = run(spark, [("p", 100, "COLLECT", "ruth5", "g", 33)], [("w", 0, "COLLECT", "RUTH SOL", "b", 33, {"no_time": True})])
    assert [(v.confidence, v.lag_ms) for v in m.values()] == [("medium", None)]


def test_reports_and_diagnosis(spark):
    panel = [("p1", 1, "COLLECT", "a", "g", 10), ("p2", 5, "COLLECT", "b", "g", 20), ("p3", 9, "PAYOUT", "c", "g", 5), ("p4", 30, "COLLECT", "d", "g", 99)]
    wallet = [("w1", 0, "COLLECT", "", "x", 10), ("w2", 2, "COLLECT", "", "x", 20), ("w3", 10, "PAYOUT", "", "x", 5), ("w4", 150, "COLLECT", "", "x", 99)]
    m, pending, r = run(spark, panel, wallet)
    assert len(m) == 3 and pending == {"p4": "CHIPS_NO_COLLECT", "w4": "COLLECT_NO_CHIPS"}
    stats = {x.type: x for x in report.lag_stats(r["matches"], "type").collect()}
    assert (stats["COLLECT"].n, stats["COLLECT"].mean, stats["COLLECT"].longest) == (2, 120_000.0, 180_000)
    p = report.progress(r["panel"], r["matches"], r["pending"]).first()
    assert (p.n_operable, p.n_resolved, p.progress) == (4, 3, 0.75)
    day = report.daily(r["panel"], r["wallet"], r["matches"], r["pending"]).collect()
    assert len(day) == 2 and {d.op_day is None for d in day} == {True, False} and all(d.panel_collects == 129.0 for d in day)
    found = {x.id: x.reason for x in diagnosis.diagnose(r["pending"], r["panel"], r["wallet"]).collect()}
    assert found == {"p4": "POSSIBLE_PAIR", "w4": "POSSIBLE_PAIR"}
    assert report.lag_histogram(r["matches"]).count() == 10
    assert {x.status: x.n for x in report.by_status(r["matches"], r["pending"]).collect()} == {"MATCHED": 3, "CHIPS_NO_COLLECT": 1, "COLLECT_NO_CHIPS": 1}


def test_dedup(spark):
    rows = [("a", "s1", None, 0, 5.0), ("b", "s2", "r1", 30_000, 5.0), ("c", "s3", None, 40_000, 5.0), ("d", "s1", None, 0, 7.0)]
    df = spark.createDataFrame([(i, "panel", "COLLECT", "U1", m, s, r, t, n) for n, (i, s, r, t, m) in enumerate(rows)], "id string, side string, type string, party string, amount double, source string, ref string, ms long, load_seq int")
    assert sorted(x.id for x in dedup.absorb_unreferenced(df).collect()) == ["b", "c", "d"]
    same = df.select("ms", "type", "amount", "party", F.lit("o").alias("origin"), F.lit("r").alias("ref"), F.col("load_seq").alias("seq"))
    assert sorted(x.id for x in dedup.stable_ids(same).collect()) == ["o|r|COLLECT", "o|r|COLLECT#2", "o|r|COLLECT#3", "o|r|COLLECT#4"]


def test_empty_ledgers(spark):
    m, pending, _ = run(spark, [], [])
    assert not m and not pending
