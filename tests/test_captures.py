"""Screen captures: overlaps, votes, layout, text, days and receipts, against plain loops and worked examples of our own."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.captures import batches, dates, layout, lists, receipts, stitching, text, voting
from ledgerloom.functions.order import by_name, natural_key
from ledgerloom.functions.times import Shift, shift_of_text

D = dt.date

# --- stitching ---------------------------------------------------------------

CAPTURE = "batch string, document string, image_no int, row_no int, day date, clock string, name string, type string, amount double, ref string, extra string"


def overlap(a, b):
    return next((k for k in range(min(len(a), len(b)), 0, -1) if a[-k:] == b[:k]), 0)


def plain_chains(images):
    """images: {number: keys}. One merge at a time, the largest overlap first, ties to the smaller numbers."""
    chains = [[i] for i in images]
    cut = dict.fromkeys(images, 0)
    pairs = sorted((-k, a, b) for a in images for b in images if a != b and (k := overlap(images[a], images[b])))
    for k, a, b in pairs:
        left, right = next(c for c in chains if a in c), next(c for c in chains if b in c)
        if left is not right and left[-1] == a and right[0] == b:
            chains.remove(right)
            left += right
            cut[b] = -k
    return {tuple(c) for c in chains}, cut


def scrolled(rnd, n, same=0.0):
    """Images of a list of n rows, some scrolled, some repeated, in any order."""
    keys = [f"{rnd.randrange(3 if rnd.random() < same else 10_000)}" for _ in range(n)]
    at, out = 0, []
    while at < n:
        size = rnd.randint(1, 6)
        out.append(keys[at : at + size])
        at += max(1, size - rnd.randint(0, 3))
    out += [list(rnd.choice(out)) for _ in range(rnd.randint(0, 2))]
    rnd.shuffle(out)
    return dict(enumerate(out))


def as_rows(batch, images, document=None):
    return [(batch, document, i, r, D(2026, 3, 1), f"{int(k) // 60 % 24:02d}:{int(k) % 60:02d}", f"n{k}", "COLLECT", float(k), None, "x") for i, keys in images.items() for r, k in enumerate(keys)]


def test_loose_images_are_chained_as_one_by_one(spark):
    rnd = random.Random(8)
    made = {f"b{j}": scrolled(rnd, rnd.randint(1, 25), rnd.choice([0, 0.5, 0.9])) for j in range(12)}
    made["same"] = {0: ["1"], 1: ["1"], 2: ["1"], 3: ["1", "1"]}
    made["one"] = {5: ["1", "1", "2"]}
    df = spark.createDataFrame([r for b, images in made.items() for r in as_rows(b, images)], CAPTURE).repartition(3)
    got = stitching.stitch(df).collect()
    keys = {r.batch: {} for r in got}
    for r in got:
        keys[r.batch].setdefault((r.chain, r.place, r.image_no), []).append(r.row_no)
    for b, images in made.items():
        chains, cut = plain_chains(images)
        want = {(c[0], p, i): list(range(cut[i], len(images[i]))) for c in chains for p, i in enumerate(c) if cut[i] < len(images[i])}
        assert {k: sorted(v) for k, v in keys[b].items()} == want, b
    sums = {r.batch: (r.n_rows, r.n_kept, r.n_removed) for r in stitching.removed(df, stitching.stitch(df)).collect()}
    assert sums["one"] == (3, 3, 0) and sums["same"][2] >= 3
    assert stitching.stitch(df.limit(0)).count() == 0


def test_pages_follow_each_other_down_or_up(spark):
    down, up, none = {0: ["1", "2", "3"], 1: ["2", "3", "4"], 2: ["9"]}, {0: ["5", "6"], 1: ["4", "5"]}, {0: ["1"], 1: ["2"]}
    df = spark.createDataFrame(as_rows("d", down, "pdf") + as_rows("u", up, "pdf") + as_rows("n", none, "pdf"), CAPTURE)
    got = {(r.batch, r.image_no): (r.head, r.tail) for r in stitching.page_cuts(stitching.images(df)).collect()}
    assert got == {("d", 0): (0, 0), ("d", 1): (2, 0), ("d", 2): (0, 0), ("u", 0): (0, 0), ("u", 1): (0, 1), ("n", 0): (0, 0), ("n", 1): (0, 0)}
    kept = Counter((r.batch, r.name) for r in stitching.stitch(df).collect())
    assert kept == Counter([("d", "n1"), ("d", "n2"), ("d", "n3"), ("d", "n4"), ("d", "n9"), ("u", "n4"), ("u", "n5"), ("u", "n6"), ("n", "n1"), ("n", "n2")])


def test_what_makes_rows_the_same(spark):
    rows = [("r1", None, None, None, None, None), (None, D(2026, 1, 1), "10:00", "A B", "COLLECT", 5.0), (None, D(2026, 1, 1), "10:00", "Zz", "COLLECT", 5.0), (None, D(2026, 1, 1), "", "José PEREZ", "PAYOUT", 5.0), ("", D(2026, 1, 1), None, "jose perez", "PAYOUT", 5.0)]
    df = spark.createDataFrame(rows, "ref string, day date, clock string, name string, type string, amount double")
    k = [r[0] for r in df.select(stitching.row_key()).collect()]
    assert k[0] == "ref|r1" and k[1] == k[2] and k[3] == k[4] and len(set(k)) == 3


# --- votes -------------------------------------------------------------------


def plain_votes(base, others):
    """One image: base and re-readings as (name letters, type, amount), rows in order."""

    def near(a, b):
        if a[1] != b[1] or bool(a[0]) != bool(b[0]):
            return False
        n = min(len(a[0]), len(b[0]), 6)
        return not a[0] or (n >= 4 and a[0][:n] == b[0][:n])

    used, to_base, out = [set() for _ in others], [{} for _ in others], []
    for i, f in enumerate(base):
        amounts = [f[2]]
        for k, rows in enumerate(others):
            free = [j for j, g in enumerate(rows) if j not in used[k] and near(f, g)]
            if free:
                j = min(free, key=lambda j: (abs(j - i), j))
                used[k].add(j)
                to_base[k][j] = i
                amounts.append(rows[j][2])
        amount, doubt = f[2], False
        if len(amounts) > 1:
            cast = [m for m in amounts if m]
            read = [next((u for u in cast if u != m and str(int(m)) in (f"5{int(u)}", f"8{int(u)}")), m) for m in cast]
            order = sorted(Counter(read).items(), key=lambda x: (-x[1], read.index(x[0])))
            top, votes = order[0] if order else (None, 0)
            if len(order) > 1 and order[1][1] == votes:
                doubt = True
            elif votes >= 2 and top != f[2]:
                amount, doubt = top, True
            elif votes < 2 and len(amounts) >= 3:
                doubt = True
        out.append((i, -1, f[0], f[1], amount, doubt))
    if len(others) >= 2:
        seen = set()
        for j, g in enumerate(others[0]):
            if j in used[0] or not g[2]:
                continue
            other = next((n for n, h in enumerate(others[1]) if n not in used[1] and n not in seen and near(g, h) and g[2] == h[2]), None)
            if other is None:
                continue
            seen.add(other)
            after = next((to_base[0][p] for p in range(j - 1, -1, -1) if p in to_base[0]), -1)
            if not any(0 <= x < len(base) and base[x][1:] == g[1:] for x in (after, after + 1)):
                out.append((after, j, g[0], g[1], g[2], True))
    return [x[2:] for x in sorted(out, key=lambda x: (x[0], x[1] >= 0, x[1]))]


def test_votes_equal_a_plain_loop(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for image in range(40):
        names = ["", "anab", "anabel", "brunoxyz", "carl", "dan", "anabelle"]
        real = [(rnd.choice(names), rnd.choice(["COLLECT", "PAYOUT"]), float(rnd.choice([100, 2500, 2500, 0, 30, 5100]))) for _ in range(rnd.randint(0, 7))]
        read = lambda: [(n, t, rnd.choice([m, m, m, float(f"5{int(m)}"), m + 1])) for n, t, m in real if rnd.random() > 0.2]  # noqa: E731, B023
        readings = [read() for _ in range(rnd.choice([1, 2, 3, 4]))]
        rows += [(f"i{image}", k, i, n, t, m) for k, one in enumerate(readings) for i, (n, t, m) in enumerate(one)]
        if any(readings):
            want[f"i{image}"] = plain_votes(readings[0], readings[1:])
    df = spark.createDataFrame(rows, "image string, reading int, row_no int, name string, type string, amount double").repartition(3)
    got = {}
    for r in sorted(voting.vote_readings(df).collect(), key=lambda r: (r.image, r.place)):
        got.setdefault(r.image, []).append((r.name, r.type, r.amount, r.doubtful))
    assert got == {i: w for i, w in want.items() if w}
    assert any(x[3] for w in want.values() for x in w)
    assert voting.vote_readings(df.limit(0)).count() == 0


def test_names_of_readings(spark):
    df = spark.createDataFrame([("José María",), (None,), ("Áb 12",)], "n string")
    assert [r[0] for r in df.select(voting.name_letters(F.col("n"))).collect()] == ["josemari", "", "ab"]


# --- text --------------------------------------------------------------------


def value(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column(F.col("t")).alias("v")).collect()]


def test_amounts_in_lines(spark):
    got = value(spark, text.find_amount, "Ana +$2.500,00", "Eva - $ 95.000,00", "Leo $1550.000,00", "x $ 12:14", "Bo +$1.234 56", "Bo $1.250%", "Cy +82.750,00", "Di 80.000,00", "no 12", None, "<- $ 6.000,00", "Flo 3.000 00", "$1223.000", "$ 7")
    short = [None if g is None else (g.sign, g.amount, g.doubtful, g.arrow) for g in got]
    assert short == [
        ("+", 2500.0, False, False), ("-", 95000.0, False, False), ("", 150000.0, True, False), None, ("+", 1234.56, True, False), ("", 1250.0, True, False), ("+", 2750.0, True, False),
        ("", 80000.0, True, False), None, None, ("-", 6000.0, False, True), ("", 3000.0, True, False), ("", 123000.0, True, False), ("", 7.0, False, False),
    ]
    assert got[0].at == 4 and got[7].at == 2


def test_names_and_captions(spark):
    assert value(spark, text.clean_name, "7 Lara Paz ...", "y ) Mia Sol", "Bas: Rita", "ta Noa Antonia Gil", "RP Ruth Perez", "NinaZoe Vega", "Ivo Luna y y", "Gil Mar < O", "» Kim", "Tom 07n0/2026", None, "Oscar L") == [
        "Lara Paz", "Mia Sol", "Bas, Rita", "Noa Antonia Gil", "Ruth Perez", "Nina Zoe Vega", "Ivo Luna", "Gil Mar", "Kim", "Tom", "", "Oscar L",
    ]
    assert value(spark, text.is_cut, "Lara Paz ...", "Lara Paz", "Lara… —") == [True, False, True]
    assert value(spark, text.is_usual_caption, "Transferencia recibida", "Iransferencia recibida", "ls Transferenciaenviada", "Te envlaron dinero", "Pago con QR", "") == [True, True, True, True, False, False]
    assert value(spark, text.caption_shown, "Transferencia recibida", "Pago con  QR", "Hoy", "12", None) == ["", "Pago con QR", "", "", ""]
    assert value(spark, text.without_state, "Nora O Aprobado", "G Dinero disponible", "Pendientes") == ["Nora", "", "Pendientes"]
    assert value(spark, text.clock_in, "a las 9:05 hs", "13.45", "25:00", "10:11:12") == ["09:05", "13:45", "", "10:11:12"]
    sure, loose = (lambda c, s=s: text.counterpart(c, F.lit(s)) for s in (True, False))
    assert value(spark, sure, "> de Ana Gil", "devirginia", "aMiriam", "Acreditación") == ["Ana Gil", "Virginia", "Miriam", None]
    assert value(spark, loose, "a Ana Gil", "devirginia", "aMiriam", "Acreditación", "para Leo", "De Eva") == ["Ana Gil", None, "Miriam", None, "Leo", "Eva"]


# --- days --------------------------------------------------------------------


def test_days(spark):
    today = F.to_date(F.lit("2026-10-01"))
    assert value(spark, lambda c: dates.day_in_text(c, today), "recibida 28/09", "28/12", "5/1/26", "Hoy 13:46", "ayer", "Lunes 28 de septiembre", "3 oct", "31/09/2026", "02/1", None) == [D(2026, 9, 28), None, D(2026, 1, 5), D(2026, 10, 1), D(2026, 9, 30), D(2026, 9, 28), D(2026, 10, 3), D(2026, 10, 1), None, None]
    assert value(spark, dates.is_heading, "Ayer", "Miércoles, 5 de octubre", "5 oct.", "05/10", "Hoy 13:46", "Ana 5 de octubre") == [True, True, True, True, False, False]
    assert value(spark, lambda c: dates.day_of_title(c, today), "mov 28-09.png", "v1.1", "DIA 7", "dia_2", "30.09.2026", "reporte", None, "día 1") == [D(2026, 9, 28), None, D(2026, 9, 7), D(2026, 10, 2), D(2026, 9, 30), None, None, D(2026, 10, 1)]
    assert value(spark, dates.month_of, "0ctubre", "ju1io", "setiembre", "xx", "Febreo", "zzzz") == [10, 7, 9, None, 2, None]
    assert value(spark, lambda c: dates.infer_day(F.lit(28), c.cast("int"), F.lit(None), today), "9", "12", "13") == [D(2026, 9, 28), D(2025, 12, 28), None]


def test_repaired_days(spark):
    rows = [
        ("a", 1, D(2026, 10, 20), D(2026, 10, 30), D(2026, 10, 30)),  # a 2 for a 3
        ("a", 2, D(2026, 10, 30), D(2026, 10, 30), D(2026, 10, 30)),
        ("a", 3, D(2026, 1, 14), D(2026, 10, 30), D(2026, 10, 30)),  # months away: the day above
        ("a", 4, None, D(2026, 10, 30), D(2026, 10, 30)),
        ("b", 1, D(2026, 2, 1), D(2026, 11, 2), None),  # far away, nothing to go by
        ("b", 2, D(2026, 9, 25), D(2026, 11, 2), None),  # near enough to be another day
        ("c", 1, D(2026, 1, 2), D(2026, 11, 2), D(2026, 11, 2)),  # the month's second 1 was lost
    ]
    df = spark.createDataFrame([(*r, False) for r in rows], "image string, row_no int, day date, today date, report_day date, doubtful boolean")
    got = {(r.image, r.row_no): (r.day, r.doubtful) for r in dates.repair_days(df).collect()}
    assert got == {
        ("a", 1): (D(2026, 10, 30), True), ("a", 2): (D(2026, 10, 30), False), ("a", 3): (D(2026, 10, 30), True), ("a", 4): (None, False),
        ("b", 1): (D(2026, 2, 1), True), ("b", 2): (D(2026, 9, 25), True), ("c", 1): (D(2026, 11, 2), True),
    }


# --- lists -------------------------------------------------------------------

HOY = D(2026, 10, 1)
LINES = "image string, line_no int, text string, confidence double, x0 double, words array<struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>>, today date, report_day date, extra string"


def read(spark, **images):
    rows = []
    for name, ls in images.items():
        for i, line in enumerate(ls):
            t, sure, x0, words = (line, 90.0, None, None) if isinstance(line, str) else (*line, None, None)[:4]
            rows.append((name, i, t, sure, x0, words, HOY, None, "x"))
    got = {}
    for r in sorted(lists.read_lists(spark.createDataFrame(rows, LINES).repartition(2)).collect(), key=lambda r: (r.image, r.line_no)):
        got.setdefault(r.image, []).append((r.day and f"{r.day:%d/%m}", r.clock, r.name, r.type, r.amount, r.cut, r.caption, r.doubtful))
    return got


def words(*parts):
    """A line of words, each at its x."""
    out = [(t, 90.0, float(x), 10.0, x + 9.0 * len(t), 30.0) for x, t in parts]
    return (" ".join(t for _, t in parts), 90.0, float(parts[0][0]), out)


def test_lists_of_every_form(spark):
    got = read(
        spark,
        a=["» Lara Paz ... +$2.500,00", "Transferencia recibida 28/09", "Mia Sol $760.000,00", "Transferencia enviada 27/09", "Ivo +82.750,00", "Pago con QR 27/09"],
        b=["Te enviaron dinero +$5.000,00", "de Nora Gil 28/09 10:15", "Enviaste dinero -$1.000,00", "a Leo Mar 28/09 09:02 hs"],
        c=["Ayer", "Transferencia recibida $ 3.000,00", "RUTH VEGA", "Hoy", "Transferencia enviada - $ 4.000,00", "EVA PAZ"],
        d=["29/09", "CARGA TRANSFERENCIA DE", "$ 8.000,00", "OSCAR LUNA", "TRANSFERENCIA", "- $ 9.000,00", "CVU/CBU"],
        e=["Lunes 28 de septiembre", "Nora Gil 13:45", "Transferencia recibida Aprobado +$6.000,00", "Leo Mar 12:01", "Transferencia enviada Aprobado -$7.000,00"],
        f=[words((71, "7"), (124, "Lara"), (180, "Paz"), (420, "+$2.500,00")), words((124, "Transferencia"), (260, "recibida"), (470, "28/09"))],
        g=["Kim Sol +$10,00", "13:46"],
        h=["Kim Sol +$0,00", "Rendimientos +$5,00"],
        i=[],
    )
    assert got == {
        "a": [("28/09", "", "Lara Paz", "COLLECT", 2500.0, True, "", False), ("27/09", "", "Mia Sol", "PAYOUT", 760000.0, False, "", False), ("27/09", "", "Ivo", "COLLECT", 2750.0, False, "Pago con QR", True)],
        "b": [("28/09", "10:15", "Nora Gil", "COLLECT", 5000.0, False, "", False), ("28/09", "09:02", "Leo Mar", "PAYOUT", 1000.0, False, "", False)],
        "c": [("30/09", "", "RUTH VEGA", "COLLECT", 3000.0, False, "", False), ("01/10", "", "EVA PAZ", "PAYOUT", 4000.0, False, "", False)],
        "d": [("29/09", "", "OSCAR LUNA", "COLLECT", 8000.0, False, "CARGA TRANSFERENCIA DE", False), ("29/09", "", "", "PAYOUT", 9000.0, False, "TRANSFERENCIA CVU/CBU", False)],
        "e": [("28/09", "13:45", "Nora Gil", "COLLECT", 6000.0, False, "", False), ("28/09", "12:01", "Leo Mar", "PAYOUT", 7000.0, False, "", False)],
        "f": [("28/09", "", "Lara Paz", "COLLECT", 2500.0, False, "", False)],
        "g": [("01/10", "13:46", "Kim Sol", "COLLECT", 10.0, False, "", True)],
    }


def test_english_amounts_and_cleaning(spark):
    got = read(
        spark,
        a=["Ayer", "Lara Paz", "Sol T +8,000.00 ARS", "Transferencia CVU", "Nora Gil -15,500.50 ARS", "Transferencia CVU", "Mal Pago -1,000.00 ARS", "Fallida", "Ivo Luna 50,000.00 ARS", "Eva Mar", "Transferencia CVU FOO RES"],
        b=["Lara Paz +$ 10,000", "Transferencia recibida 28/09", "Mia Sol +5 11.000", "Transferencia recibida 28/09", "Enviaste dinero -$2.000,00", "Oe Hector Vega Paz 28/09"],
    )
    assert [(r[0], r[2], r[3], r[4], r[7]) for r in got["a"]] == [
        ("30/09", "Lara Paz Sol T", "COLLECT", 8000.0, False), ("30/09", "Nora Gil", "PAYOUT", 15500.5, False), ("30/09", "Ivo Luna", "COLLECT", 50000.0, True), ("30/09", "Eva Mar", "COLLECT", 0.0, True),
    ]
    assert [(r[2], r[3], r[4], r[7]) for r in got["b"]] == [("Lara Paz", "COLLECT", 10000.0, False), ("Mia Sol", "COLLECT", 11000.0, True), ("Hector Vega Paz", "PAYOUT", 2000.0, False)]


def test_icons_left_of_amounts(spark):
    w = lambda t, x, y=10: (t, 90.0, float(x), float(y), x + 9.0 * len(t), y + 20.0)
    rows = [("a", 0, "- $ 50.000,00", 40.0, 0.0, [w("-", 10), w("$", 400), w("50.000,00", 420)], HOY, None, ""), ("a", 1, "- $ 50", 90.0, 0.0, [w("-", 380), w("$", 400), w("50", 420)], HOY, None, ""), ("a", 2, "Ana", 90.0, 0.0, None, HOY, None, "")]
    got = sorted(lists.without_icons(spark.createDataFrame(rows, LINES)).collect(), key=lambda r: r.line_no)
    assert [(r.text, r.confidence) for r in got] == [("$ 50.000,00", 90.0), ("- $ 50", 90.0), ("Ana", 90.0)]


# --- layout ------------------------------------------------------------------

WORDS = "image string, word_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def test_lines_from_words(spark):
    def block(i, y, name, money, caption, clock):
        out, x = [], 60
        for t in name.split():
            out.append((t, x, y - 24, x + 9 * len(t), y - 8))
            x += 9 * len(t) + 8
        out += [("Aprobado", 300, y - 8, 370, y + 8), (clock, 420, y - 8, 460, y + 8), (money, 600, y - 8, 680, y + 8)]
        out += [(caption, 60, y + 8, 200, y + 24), ("@", 5, y - 40, 50, y + 40)]
        return [("a", 100 * i + j, t, float(x0), float(y0), float(x1), float(y1), 91.0) for j, (t, x0, y0, x1, y1) in enumerate(out)]

    rows = [("a", 0, "Hoy", 60.0, 10.0, 90.0, 26.0, None)] + block(1, 120, "Nora Gil", "+$6.000,00", "Transferencia", "13:45") + block(2, 210, "Leo Mar", "-300", "Pago", "12:01") + [("b", 0, "+$5", 0.0, 0.0, 9.0, 9.0, 90.0), ("c", 1, None, 0.0, 0.0, 1.0, 1.0, 1.0), ("a", 999, "x", None, None, None, None, None)]
    df = spark.createDataFrame(rows, WORDS).repartition(3)
    got = [(r.text, r.confidence) for r in sorted(layout.lines_from_words(df).collect(), key=lambda r: r.line_no)]
    assert got == [("Hoy", 90.0), ("Nora Gil +$6.000,00", 91.0), ("Transferencia 13:45", 90.0), ("Leo Mar -$300", 91.0), ("Pago 12:01", 90.0)]
    assert layout.lines_from_words(df.limit(0)).count() == 0


# --- receipts ----------------------------------------------------------------


def test_receipts(spark):
    first = ["Comprobante de transferencia", "6/0ctubre/2026 a las 18:49.", "$ 22.500", "Motivo: Alquiler", "Origen y destino", "EG Nora Gil", "Mercado Pago", "CVU 0001", "Leo Mar", "N.º de operación", "181758083051"]
    other = ["Comprobante", "mala", "$ 9", "Motivo: Varios", "Origen y destino", "Uno", "operación"]
    second = ["7/10/2026", "Origen y destino", "Eva Paz", "Leo Mar", "de operación 123456789"]
    rows = [("r1", 1, i, t, HOY) for i, t in enumerate(first)] + [("r2", 1, i, t, HOY) for i, t in enumerate(other)] + [("r2", 2, i, t, HOY) for i, t in enumerate(second)] + [("x", 1, 0, "nada", HOY), ("y", 1, 0, None, HOY)]
    df = spark.createDataFrame(rows, "image string, reading int, line_no int, text string, today date").repartition(3)
    got = {r.image: tuple(r)[1:] for r in receipts.read_receipts(df).collect()}
    assert got == {"r1": (D(2026, 10, 6), "18:49", "Nora Gil", "Leo Mar", 22500.0, "Motivo: Alquiler", "181758083051", False), "r2": (D(2026, 10, 7), "", "Eva Paz", "Leo Mar", 9.0, "", "123456789", False)}
    assert {r[0] for r in receipts.receipts_among(df).collect()} == {"r1", "r2"}
    batch = [("b", "", 0, "Nora Gil", "Leo Mar"), ("b", "", 1, "Leo MAR", "Eva Paz"), ("c", "caja de Ana Sol", 0, "Ana Sol", "Rex Uno"), ("d", "", 0, "A Bb", "C Dd"), ("d", "", 1, "", "")]
    own = spark.createDataFrame([(*b, False) for b in batch], "batch string, account string, place int, origin string, target string, doubtful boolean")
    done = {(r.batch, r.place): (r.type, r.name, r.doubtful) for r in receipts.resolve_receipts(own).collect()}
    assert done == {("b", 0): ("COLLECT", "Nora Gil", False), ("b", 1): ("PAYOUT", "Eva Paz", False), ("c", 0): ("PAYOUT", "Rex Uno", False), ("d", 0): ("COLLECT", "A Bb", True), ("d", 1): ("COLLECT", "", False)}


# --- batches and orders ------------------------------------------------------


def test_contexts_scores_and_tables(spark):
    taken = dt.datetime(2026, 10, 31, 9)
    images = [("b", "i1", "mov 30-10 t.n.png", None, None, taken), ("b", "i2", "foto 2.png", None, None, taken), ("b", "i3", "foto 10.png", None, None, taken), ("b", "i4", "p1", "rep.pdf", "REPORTE TM CAJA", taken)]
    df = spark.createDataFrame(images, "batch string, image string, file string, document string, title string, taken timestamp_ntz")
    got = {r.image: (r.image_no, r.today, r.report_day, r.shift, r.account) for r in batches.contexts(df, default_shift="D").collect()}
    assert got == {"i1": (3, D(2026, 10, 31), D(2026, 10, 30), "Shift 3", ""), "i2": (1, D(2026, 10, 31), None, "D", ""), "i3": (2, D(2026, 10, 31), None, "D", ""), "i4": (1, D(2026, 10, 31), None, "Shift 1", "REPORTE TM CAJA")}
    row = "image string, line_no int, day date, clock string, name string, type string, amount double, cut boolean, caption string, doubtful boolean"
    one = spark.createDataFrame([("x", 1, D(2026, 1, 1), "", "Transferencia recibida", "COLLECT", 1.0, False, "", True), ("y", 1, None, "", "Ana", "COLLECT", 1.0, False, "", False)], row)
    two = spark.createDataFrame([("x", 1, D(2026, 1, 1), "10:00", "Ana Gil", "COLLECT", 2.0, True, "", False), ("y", 1, None, "", "Ana", "COLLECT", 3.0, False, "", False)], row)
    best = batches.better_reading(one, two)
    assert {(r.image, r.amount) for r in best.collect()} == {("x", 2.0), ("y", 1.0)}
    full = best.withColumns({"batch": F.lit("b"), "account": F.lit("Caja"), "shift": F.lit("Shift 1"), "ref": F.lit(None).cast("string"), "chain": F.lit(0), "place": F.lit(0)})
    assert [r.image for r in batches.valid_rows(full).collect()] == ["x"]
    cells = {r.row_no: r.cells for r in batches.as_cells(batches.valid_rows(full)).collect()}
    assert cells == {0: list(batches.HEADER), 1: ["01/01/2026", "Ana Gil...", "Cobro", "2.00", "Caja", "x", "", "10:00", "", "", ""]}
    assert tuple(batches.batch_totals(full).first()) == ("b", 2, 2, 3.0, 0, 0.0, 0)


def test_orders_and_shift_names(spark):
    names = ["foto 10.png", "Foto 2.png", "foto 2.png", "página 1", "pagina 03", "foto 00000000000000000000000000012", "foto 99999999999999999999999999"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(natural_key(F.col("n")), "n").collect()] == ["Foto 2.png", "foto 2.png", "foto 10.png", "foto 00000000000000000000000000012", "foto 99999999999999999999999999", "página 1", "pagina 03"]
    people = spark.createDataFrame([(n,) for n in ("Zoe", "ñandú", "ana", "Ana", "oso", "nube", "Álvaro", None)], "n string")
    assert [r.n for r in people.orderBy(by_name(F.col("n"))).collect()] == [None, "Álvaro", "ana", "Ana", "nube", "ñandú", "oso", "Zoe"]
    own = (Shift("Turno 2", "06:00", "14:00"), Shift("Turno 06 a 14", "14:00", "22:00"))
    got = [tuple(r) for r in spark.createDataFrame([("turno 2",), ("turno 1",), ("x tn y",), ("tm",), (None,)], "t string").select(shift_of_text(F.col("t"), own), shift_of_text(F.col("t"))).collect()]
    assert got == [("Turno 2", "Shift 2"), ("Turno 2", "Shift 1"), ("", "Shift 3"), ("Turno 2", "Shift 1"), ("", "")]


if __name__ == "__main__":
    pytest.main([__file__])
