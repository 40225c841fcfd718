"""Registered queries over captures derived from the ledgers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..captures import dates, layout, stitching, voting
from ..functions.order import natural_key
from ..functions.times import shift_of_text
from . import captures
from .queries import query

_NAME_KEY = "array_to_string(list_filter(regexp_split_to_array(lower(name), '[^a-z]+'), lambda t: len(t) >= 2), ' ')"
_IMAGES = captures.DUCKDB + f""", kx AS (SELECT batch, document, image_no, row_no, CASE WHEN clock <> '' THEN concat_ws('|', day, clock, type, amount) ELSE concat_ws('|', day, type, amount, {_NAME_KEY}) END AS key FROM captures),
im AS (SELECT batch, document, image_no, list(key ORDER BY row_no, key) AS keys FROM kx GROUP BY ALL)
"""
_OVERLAP = "coalesce(list_max(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[len({a}) - i + 1:] = {b}[:i])), 0)"


@query(_IMAGES + f""", pg AS (SELECT *, lag(keys) OVER (PARTITION BY batch ORDER BY image_no) AS prev FROM im WHERE document IS NOT NULL),
hd AS (SELECT *, CASE WHEN prev IS NULL THEN 0 ELSE {_OVERLAP.format(a='prev', b='keys')} END AS head FROM pg)
SELECT batch, image_no, CAST(head AS INTEGER) AS head, CAST(CASE WHEN head > 0 OR prev IS NULL THEN 0 ELSE {_OVERLAP.format(a='keys', b='prev')} END AS INTEGER) AS tail FROM hd""")
def page_overlaps(spark, sf_dir):
    """Rows that each page of a document repeats of the page before it."""
    rows = captures.derived(spark, sf_dir, "captures")
    return stitching.page_cuts(stitching.images(rows).filter("document is not null")).select("batch", "image_no", F.col("head").cast("int").alias("head"), F.col("tail").cast("int").alias("tail"))


@query(_IMAGES + f""", ps AS (SELECT a.batch AS batch, a.image_no AS a, b.image_no AS b, {_OVERLAP.format(a='a.keys', b='b.keys')} AS k FROM im a JOIN im b ON a.batch = b.batch AND a.image_no <> b.image_no WHERE a.document IS NULL AND b.document IS NULL AND list_contains(b.keys, a.keys[-1]))
SELECT batch, a, b, CAST(k AS INTEGER) AS k FROM ps WHERE k > 0""")
def image_overlaps(spark, sf_dir):
    """How many rows of a loose image's end are another one's beginning."""
    rows = captures.derived(spark, sf_dir, "captures")
    return stitching.image_overlaps(stitching.images(rows).filter("document is null")).select("batch", "a", "b", F.col("k").cast("int").alias("k"))


@query()
def stitched_captures(spark, sf_dir):
    """The rows that stay when overlapping images are put together."""
    rows = captures.derived(spark, sf_dir, "captures")
    return stitching.stitch(rows).select("batch", "document", "image_no", "row_no", "k", "chain", "place")


_VOTED = captures.DUCKDB + """, b AS (SELECT * FROM readings WHERE reading = 0), o1 AS (SELECT * FROM readings WHERE reading = 1), o2 AS (SELECT * FROM readings WHERE reading = 2),
ms AS (SELECT b.image, b.row_no, b.name, b.type, b.amount AS base, list_filter([b.amount, o1.amount, o2.amount], lambda x: x IS NOT NULL) AS ms FROM b LEFT JOIN o1 USING (image, name, type) LEFT JOIN o2 USING (image, name, type)),
cs AS (SELECT *, list_transform(ms, lambda m: coalesce(list_filter(ms, lambda u: u <> m AND CAST(m AS BIGINT)::VARCHAR IN ('5' || CAST(u AS BIGINT), '8' || CAST(u AS BIGINT)))[1], m)) AS cs FROM ms),
ex AS (SELECT image, row_no, c AS amount, count(*) AS n, min(place) AS place FROM (SELECT image, row_no, unnest(cs) AS c, generate_subscripts(cs, 1) AS place FROM cs) GROUP BY ALL),
tp AS (SELECT image, row_no, list({n: n, amount: amount} ORDER BY n DESC, place) AS t FROM ex GROUP BY ALL),
vt AS (SELECT cs.*, t[1].amount AS top, t[1].n AS votes, coalesce(t[2].n = t[1].n, false) AS tied FROM cs JOIN tp USING (image, row_no)),
kept AS (SELECT image, row_no AS aft, -1 AS own, name, type, CASE WHEN NOT tied AND votes >= 2 AND len(ms) >= 2 THEN top ELSE base END AS amount,
  len(ms) >= 2 AND (tied OR (votes >= 2 AND top <> base) OR (votes < 2 AND len(ms) >= 3)) AS doubtful, false AS added FROM vt),
gone AS (SELECT o1.*, b.row_no AS base_row FROM o1 LEFT JOIN b USING (image, name, type)),
spot AS (SELECT *, coalesce(last_value(base_row IGNORE NULLS) OVER (PARTITION BY image ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS aft FROM gone),
lost AS (SELECT s.image, s.aft, s.row_no AS own, s.name, s.type, s.amount, true AS doubtful, true AS added FROM spot s JOIN o2 ON o2.image = s.image AND o2.name = s.name AND o2.type = s.type AND o2.amount = s.amount WHERE s.base_row IS NULL AND s.amount <> 0
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.image = s.image AND b.row_no IN (s.aft, s.aft + 1) AND b.type = s.type AND b.amount = s.amount))
SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY aft, added, own) AS INTEGER) AS place, name, type, amount, doubtful, added FROM (SELECT * FROM kept UNION ALL SELECT * FROM lost)
"""


@query(_VOTED)
def voted_readings(spark, sf_dir):
    """Amounts by majority of three readings, and the rows that the first one lost."""
    return voting.vote_readings(captures.derived(spark, sf_dir, "readings"))


_LINES = captures.DUCKDB + """, ws AS (SELECT *, (y0 + y1) / 2 AS cy, y1 - y0 AS h FROM words WHERE text <> ''),
mn AS (SELECT *, CASE WHEN lag(text) OVER w IN ('+', '-') AND regexp_matches(text, '^[+-]?\\$[0-9.,]+$') AND abs(lag(cy) OVER w - cy) < 20 THEN lag(text) OVER w || text
  WHEN regexp_matches(text, '^[+-]?\\$[0-9.,]+$') THEN text WHEN regexp_matches(text, '^[+-][0-9]{1,3}$') THEN text[1] || '$' || text[2:] END AS money FROM ws WINDOW w AS (PARTITION BY image ORDER BY word_no)),
im AS (SELECT image, min(x0) FILTER (money IS NOT NULL) AS lft, list_sort(list(h))[len(list(h)) // 2 + 1] AS usual, arg_min(h, (cy, word_no)) FILTER (money IS NOT NULL) AS h1, min(cy) FILTER (money IS NOT NULL) AS first, count(money) AS n FROM mn GROUP BY image),
zn AS (SELECT image, money, confidence AS sure, cy AS y, row_number() OVER w AS zone, coalesce((lag(cy) OVER w + cy) / 2, first - 3 * h1) AS low, coalesce((lead(cy) OVER w + cy) / 2, cy + 3 * h1) AS high, usual, lft
  FROM mn JOIN im USING (image) WHERE money IS NOT NULL AND n >= 2 WINDOW w AS (PARTITION BY image ORDER BY cy, word_no)),
pl AS (SELECT w.*, z.zone, z.y, z.usual FROM mn w JOIN zn z ON w.image = z.image AND w.cy >= z.low AND w.cy < z.high AND w.x1 <= z.lft WHERE w.money IS NULL),
ck AS (SELECT image, zone, arg_min(text, word_no) AS clock, min(word_no) AS spot FROM pl WHERE regexp_matches(text, '^([01]?[0-9]|2[0-3]):[0-5][0-9]$') GROUP BY ALL),
tx AS (SELECT p.* FROM pl p LEFT JOIN ck USING (image, zone) WHERE p.word_no IS DISTINCT FROM ck.spot AND p.h <= 1.6 * p.usual AND lower(p.text) <> 'aprobado'),
gp AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY image, zone ORDER BY cy, word_no) < 0.5 * usual THEN 0 ELSE 1 END AS fresh FROM tx),
ln AS (SELECT *, sum(fresh) OVER (PARTITION BY image, zone ORDER BY cy, word_no) AS line FROM gp),
rw AS (SELECT image, zone, y, usual, line, list({t: text, a: x0, b: x1} ORDER BY x0, cy, word_no) AS ws, (min(y0) + max(y1)) / 2 AS middle, min(confidence) AS sure FROM ln GROUP BY ALL),
tp AS (SELECT image, zone, arg_max(ws, line) AS ws, arg_max(sure, line) AS sure FROM rw WHERE middle < y - 0.5 * usual AND regexp_matches(array_to_string(list_transform(ws, lambda w: w.t), ' '), '[A-Za-z]{3,}') GROUP BY ALL),
cp AS (SELECT image, zone, string_agg(array_to_string(list_transform(ws, lambda w: w.t), ' '), ' ' ORDER BY line) AS caption FROM rw WHERE middle > y + 0.5 * usual GROUP BY ALL),
fu AS (SELECT z.*, CASE WHEN len(tp.ws) > 2 AND regexp_matches(tp.ws[1].t, '^[A-Z]{1,3}$') AND tp.ws[2].a - tp.ws[1].b > 1.5 * z.usual THEN tp.ws[2:] ELSE tp.ws END AS shown, tp.sure AS name_sure, caption, clock
  FROM zn z LEFT JOIN tp USING (image, zone) LEFT JOIN cp USING (image, zone) LEFT JOIN ck USING (image, zone)),
hd AS (SELECT w.*, usual, CASE WHEN cy - lag(cy) OVER (PARTITION BY image ORDER BY cy, word_no) < 0.5 * usual THEN 0 ELSE 1 END AS fresh FROM mn w JOIN im USING (image) WHERE n >= 2 AND cy < first - 3 * h1 AND h <= 1.6 * usual AND money IS NULL),
hl AS (SELECT *, sum(fresh) OVER (PARTITION BY image ORDER BY cy, word_no) AS line FROM hd),
al AS (SELECT image, 0 AS zone, 0 AS part, line, string_agg(text, ' ' ORDER BY x0, cy, word_no) AS text, 90.0 AS confidence FROM hl GROUP BY image, line
  UNION ALL SELECT image, zone, 1, 0, trim(coalesce(array_to_string(list_transform(shown, lambda w: w.t), ' '), '') || ' ' || money), least(coalesce(name_sure, sure), sure) FROM fu
  UNION ALL SELECT image, zone, 2, 0, trim(concat_ws(' ', coalesce(caption, ''), clock)), 90.0 FROM fu)
SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY zone, part, line) AS INTEGER) AS line_no, text, CAST(confidence AS DOUBLE) AS confidence FROM al
"""


@query(_LINES)
def lines_of_words(spark, sf_dir):
    """Lines put together from loose words around their amounts."""
    return layout.lines_from_words(captures.derived(spark, sf_dir, "words"))


# --- days --------------------------------------------------------------------

_EVENT = "SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_id % 7 AS shape, CAST(event_id % 130 - 15 AS INTEGER) AS late FROM events"
_MONTH = "['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre']"


@query(f"""WITH e AS ({_EVENT}), t AS (SELECT *, day + late AS today FROM e), g AS (SELECT *, make_date(year(today) - CASE WHEN make_date(year(today), month(day), least(day(day), 28)) + CAST(day(day) - least(day(day), 28) AS INTEGER) > today + 2 THEN 1 ELSE 0 END, month(day), least(day(day), 28)) + CAST(day(day) - least(day(day), 28) AS INTEGER) AS guess FROM t)
SELECT event_id, CAST(CASE shape WHEN 0 THEN CASE WHEN guess - today BETWEEN -60 AND 3 THEN guess END WHEN 1 THEN day WHEN 2 THEN CASE WHEN guess - today BETWEEN -60 AND 3 THEN guess END WHEN 3 THEN today WHEN 4 THEN today - 1 WHEN 5 THEN day END AS VARCHAR) AS read_day, shape IN (2, 5) AS heading FROM g""")
def days_in_text(spark, sf_dir):
    """Days written in seven ways, read against a reference day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "cast(ts as date) day", "event_id % 7 shape", "cast(event_id % 130 as int) - 15 late")
    names = F.array(*map(F.lit, dates.MONTHS))
    month = F.get(names, F.month("day") - 1)
    text = (
        F.when(F.col("shape") == 0, F.concat(F.lit("Transferencia recibida "), F.date_format("day", "dd/MM"))).when(F.col("shape") == 1, F.concat(F.date_format("day", "d/M/yy"), F.lit(" 10:15 hs")))
        .when(F.col("shape") == 2, F.concat(F.lit("Miércoles, "), F.dayofmonth("day").cast("string"), F.lit(" de "), month)).when(F.col("shape") == 3, "Hoy 13:46").when(F.col("shape") == 4, "AYER - enviada")
        .when(F.col("shape") == 5, F.concat(F.dayofmonth("day").cast("string"), F.lit(" "), F.initcap(F.substring(month, 1, 3)), F.lit(". de "), F.year("day").cast("string"))).otherwise("Saldo 12345")
    )
    own = e.select("event_id", text.alias("text"), F.expr("date_add(day, late)").alias("today"))
    return own.select("event_id", dates.day_in_text(F.col("text"), F.col("today")).cast("string").alias("read_day"), dates.is_heading(F.col("text")).alias("heading"))


@query(f"""WITH m AS (SELECT event_id, {_MONTH}[event_id % 12 + 1] AS name, CAST(event_id // 12 % 6 AS INTEGER) AS how, CAST(event_id % 4 AS INTEGER) + 2 AS pos FROM events),
t AS (SELECT event_id, CASE how WHEN 0 THEN name WHEN 1 THEN name[:pos - 1] || name[pos + 1:] WHEN 2 THEN name[:pos - 1] || 'x' || name[pos:] WHEN 3 THEN name[:pos - 1] || 'zq' || name[pos + 2:] WHEN 4 THEN name[:3] || '.' ELSE 'zzz' || name END AS token FROM m),
c AS (SELECT event_id, translate(translate(token, '.', ''), '01', 'ol') AS t FROM t), n AS (SELECT unnest({_MONTH}) AS name, unnest(range(1, 13)) AS month),
d AS (SELECT event_id, t, min({{d: levenshtein(t, name), m: month}}) AS best, min(month) FILTER (name[:3] = t[:3]) AS short FROM c, n GROUP BY ALL)
SELECT event_id, CAST(CASE WHEN len(t) < 3 THEN NULL WHEN short IS NOT NULL AND (len(t) <= 4 OR best.d <= 2) THEN short WHEN best.d <= 2 THEN best.m END AS INTEGER) AS month FROM d""")
def months_read(spark, sf_dir):
    """Months' names with letters left out, put in or misread, found by the least distance."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    name = F.get(F.array(*map(F.lit, dates.MONTHS)), (F.col("event_id") % 12).cast("int"))
    how, at = F.floor(F.col("event_id") / 12) % 6, (F.col("event_id") % 4 + 2).cast("int")
    left, rest = F.substring(name, F.lit(1), at - 1), lambda k: F.substring(name, at + k, F.lit(99))
    token = F.when(how == 0, name).when(how == 1, F.concat(left, rest(1))).when(how == 2, F.concat(left, F.lit("x"), rest(0))).when(how == 3, F.concat(left, F.lit("zq"), rest(2))).when(how == 4, F.concat(F.substring(name, 1, 3), F.lit("."))).otherwise(F.concat(F.lit("zzz"), name))
    return e.select("event_id", dates.month_of(token).cast("int").alias("month"))


_CONFUSED = "(VALUES " + ", ".join(f"('{k}', '{c}', {i})" for k, v in dates.CONFUSED.items() for i, c in enumerate(v)) + ") AS confused(c, o, i)"

def _misread(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id", "cast(ts as date) d")
    n, day = F.col("event_id") % 5, F.col("d")
    first = F.date_add(F.trunc(day, "MM"), (F.dayofmonth(day) + 9) % 28)  # a day of the same month
    other = F.make_date(F.year(day), F.month(day) % 12 + 1, F.least(F.dayofmonth(day), F.lit(28)))
    read = F.when(n == 0, first).when(n == 1, day).when(n == 2, F.date_add(day, 200)).when(n == 3, other).when(F.col("event_id") % 10 == 4, F.lit(None)).otherwise(F.date_add(day, 30))
    return e.select("event_id", F.concat(F.lit("u"), "user_id").alias("image"), F.col("event_id").cast("int").alias("row_no"), day.alias("today"), F.when(F.col("user_id") % 3 == 0, day).alias("report_day"), (F.col("user_id") % 2 == 0).alias("doubtful"), read.alias("day"))


_MISREAD = """WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d FROM events),
r AS (SELECT event_id, 'u' || user_id AS image, d AS today, CASE WHEN user_id % 3 = 0 THEN d END AS report, user_id % 2 = 0 AS marked,
  CASE WHEN event_id % 5 = 0 THEN CAST(date_trunc('month', d) AS DATE) + CAST((day(d) + 9) % 28 AS INTEGER) WHEN event_id % 5 = 1 THEN d WHEN event_id % 5 = 2 THEN d + 200
       WHEN event_id % 5 = 3 THEN make_date(year(d), month(d) % 12 + 1, least(day(d), 28)) WHEN event_id % 10 = 4 THEN NULL ELSE d + 30 END AS day FROM e)
"""


@query(_MISREAD + f""", w AS (SELECT *, coalesce(report, today) AS centre, CASE WHEN report IS NULL THEN today - 20 ELSE report - 3 END AS low, CASE WHEN report IS NULL THEN today + 7 ELSE report + 2 END AS high FROM r),
p AS (SELECT DISTINCT day, strftime(day, '%d') AS dd, strftime(day, '%m') AS mm FROM w WHERE day IS NOT NULL),
dv AS (SELECT day, dd AS v, 0 AS o FROM p UNION ALL SELECT day, confused.o || dd[2], 10 + i FROM p JOIN {_CONFUSED} ON c = dd[1] UNION ALL SELECT day, dd[1] || confused.o, 20 + i FROM p JOIN {_CONFUSED} ON c = dd[2]),
mv AS (SELECT day, mm AS v, 0 AS o FROM p UNION ALL SELECT day, confused.o || mm[2], 10 + i FROM p JOIN {_CONFUSED} ON c = mm[1] UNION ALL SELECT day, mm[1] || confused.o, 20 + i FROM p JOIN {_CONFUSED} ON c = mm[2]
  UNION ALL SELECT day, x, 30 FROM p, (VALUES ('10'), ('11'), ('12')) t(x) WHERE mm = '01'),
v AS (SELECT dv.day, try_cast(year(dv.day) || '-' || mv.v || '-' || dv.v AS DATE) AS other, min((dv.o, mv.o)) AS o FROM dv JOIN mv USING (day) GROUP BY ALL),
b AS (SELECT event_id, arg_min(other, (abs(other - centre), o)) AS variant FROM w JOIN v USING (day) WHERE NOT (w.day BETWEEN low AND high) AND other <> w.day AND other BETWEEN low AND high GROUP BY event_id),
s AS (SELECT w.*, CASE WHEN day BETWEEN low AND high THEN day WHEN variant IS NOT NULL THEN variant WHEN abs(day - centre) <= 60 THEN day END AS settled FROM w LEFT JOIN b USING (event_id)),
a AS (SELECT *, last_value(settled IGNORE NULLS) OVER (PARTITION BY image ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM s)
SELECT event_id, CAST(CASE WHEN day IS NULL THEN NULL WHEN settled IS NOT NULL THEN settled ELSE coalesce(CASE WHEN above BETWEEN low AND high THEN above END, report, day) END AS VARCHAR) AS day, marked OR coalesce(NOT (day BETWEEN low AND high), false) AS doubtful FROM a""")
def repaired_days(spark, sf_dir):
    """Days out of reach, repaired by digits that are easily confused."""
    return dates.repair_days(_misread(spark, sf_dir)).select("event_id", F.col("day").cast("string").alias("day"), "doubtful")


@query("""WITH e AS (SELECT event_id, 'u' || user_id AS image, CAST(ts AS DATE) AS d, user_id % 4 = 0 AS has_report, event_id % 5 = 0 AS timed, event_id % 4 <> 1 AS is_row, CASE WHEN event_id % 3 = 0 AND user_id % 5 <> 0 THEN CAST(ts AS DATE) END AS own FROM events),
c AS (SELECT *, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY image ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CASE WHEN has_report THEN DATE '2024-01-15' END) AS c1 FROM e),
r AS (SELECT *, coalesce(c1, CASE WHEN timed THEN DATE '2024-02-01' END) AS c2 FROM c WHERE is_row),
n AS (SELECT *, coalesce(last_value(c2 IGNORE NULLS) OVER (PARTITION BY image ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(c2 IGNORE NULLS) OVER (PARTITION BY image ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS near FROM r)
SELECT event_id, CAST(coalesce(c2, near) AS VARCHAR) AS day, (c1 IS NULL AND timed) OR (c2 IS NULL AND near IS NOT NULL) AS doubtful FROM n""")
def carried_days(spark, sf_dir):
    """The last known day carried to rows without one, with restarts at headings."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.to_date("ts")
    own = e.select(
        "event_id", F.concat(F.lit("u"), "user_id").alias("image"), F.col("event_id").alias("line_no"), F.when((F.col("event_id") % 3 == 0) & (F.col("user_id") % 5 != 0), day).alias("own_day"), F.when(F.col("event_id") % 5 == 0, "10:00").otherwise("").alias("clock"),
        F.when(F.col("user_id") % 4 == 0, F.to_date(F.lit("2024-01-15"))).alias("report_day"), F.to_date(F.lit("2024-02-01")).alias("today"), (F.col("event_id") % 4 != 1).alias("is_row"), F.lit(False).alias("doubtful"),
    )
    return dates.carry_days(own).select("event_id", F.col("day").cast("string").alias("day"), "doubtful")


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events), m AS (SELECT user_id, list_sort(list(day) FILTER (day IS NOT NULL)) AS ds FROM e GROUP BY user_id)
SELECT event_id, coalesce(abs(day - ds[len(ds) // 2 + 1]) > 7, false) AS doubtful FROM e JOIN m USING (user_id)""")
def outlying_days(spark, sf_dir):
    """Rows more than a week from the upper median of their batch."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = e.select("event_id", F.col("user_id").alias("image"), F.when(F.col("event_id") % 6 != 0, F.to_date("ts")).alias("day"), F.lit(False).alias("doubtful"))
    return dates.flag_outliers(own).select("event_id", "doubtful")


@query("""WITH t AS (SELECT event_id, CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'mov 30-10 t.m Joni.png' WHEN 1 THEN 'REPORTE TT ' || user_id WHEN 2 THEN 'caja_tn_' || user_id WHEN 3 THEN 'Mañana ' || user_id WHEN 4 THEN 'turno ' || (user_id % 5) || ' x' WHEN 5 THEN 'la tarde-' || user_id WHEN 6 THEN 'noche' ELSE 'titan ' || user_id END AS title, user_id FROM events)
SELECT event_id, CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'Shift 1' WHEN 3 THEN 'Shift 1' WHEN 1 THEN 'Shift 2' WHEN 5 THEN 'Shift 2' WHEN 2 THEN 'Shift 3' WHEN 6 THEN 'Shift 3' WHEN 4 THEN CASE user_id % 5 WHEN 1 THEN 'Shift 1' WHEN 2 THEN 'Shift 2' WHEN 3 THEN 'Shift 3' ELSE '' END ELSE '' END AS shift FROM t""")
def shifts_of_titles(spark, sf_dir):
    """The shift that a file's name tells."""
    title = """CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'mov 30-10 t.m Joni.png' WHEN 1 THEN concat('REPORTE TT ', user_id) WHEN 2 THEN concat('caja_tn_', user_id) WHEN 3 THEN concat('Mañana ', user_id) WHEN 4 THEN concat('turno ', user_id % 5, ' x')
      WHEN 5 THEN concat('la tarde-', user_id) WHEN 6 THEN 'noche' ELSE concat('titan ', user_id) END"""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(title).alias("title"))
    return e.select("event_id", shift_of_text(F.col("title")).alias("shift"))


@query("""WITH f AS (SELECT DISTINCT user_id AS u, user_id % 7 AS g FROM events), n AS (SELECT CASE CAST(g % 3 AS INT) WHEN 0 THEN 'Página ' WHEN 1 THEN 'pagina ' ELSE 'foto' END || CASE WHEN u % 4 = 0 THEN '0' ELSE '' END || u || '.png' AS file,
  CASE CAST(g % 3 AS INT) WHEN 2 THEN 'foto' ELSE 'pagina ' END AS stem, u FROM f)
SELECT file, row_number() OVER (ORDER BY stem, u, file) AS place FROM n""")
def natural_order(spark, sf_dir):
    """File names in the order that people expect: numbers by value, capitals and marks aside."""
    name = "concat(CASE CAST(user_id % 7 % 3 AS INT) WHEN 0 THEN 'Página ' WHEN 1 THEN 'pagina ' ELSE 'foto' END, CASE WHEN user_id % 4 = 0 THEN '0' ELSE '' END, user_id, '.png')"
    files = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().select(F.expr(name).alias("file")).distinct()
    # few names: one order over all of them
    return files.select("file", F.row_number().over(Window.orderBy(natural_key(F.col("file")), "file")).cast("long").alias("place"))
