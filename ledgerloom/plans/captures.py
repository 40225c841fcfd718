"""Captures derived from the wallet's ledger, as SQL that Spark and DuckDB both run.

A batch is an account's day. Its rows fill pages of six, each with the first two of the next page below
(what scrolling shows twice). box0's pages are a document, in order; the others are loose images, numbered out of order, and some of
box2's were taken twice. ``{hm}`` writes a time's clock, ``{dmy}`` a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ledgers

CTE = """,
c0 AS (
  SELECT id, k, ts, type, party AS name, account, amount, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts, id) - 1 AS rn
  FROM wallet WHERE id LIKE 'w%'
),
c1 AS (
  {pages}
),
c2 AS (
  SELECT concat(account, '/', day) AS batch, CASE WHEN account = 'box0' THEN 'pages' END AS document, CASE WHEN account = 'box0' THEN page ELSE page * 7 % 1009 END AS image_no, row_no,
         k, ts, day, CASE WHEN k % 3 = 0 THEN '' ELSE {hm} END AS clock, name, type, amount, '' AS ref, page, account, false AS doubtful FROM c1
),
captures AS (
  SELECT * FROM c2 UNION ALL
  SELECT batch, document, image_no + 2000 AS image_no, row_no, k, ts, day, clock, name, type, amount, ref, page, account, doubtful FROM c2 WHERE account = 'box2' AND page % 5 = 0
),
r0 AS (
  SELECT concat(batch, '#', page) AS image, row_no AS spot, k, type, amount,
         concat(translate(reverse(lpad(CAST(k AS STRING), 6, '0')), '0123456789', 'abcdefghij'), ' ', name) AS name FROM c2 WHERE account = 'box1'
),
r1 AS (
  SELECT image, 0 AS reading, spot, name, type, CASE WHEN k % 7 = 0 THEN CAST(concat('5', CAST(CAST(amount AS BIGINT) AS STRING)) AS DOUBLE) ELSE amount END AS amount FROM r0 WHERE k % 11 <> 0
  UNION ALL SELECT image, 1, spot, name, type, CASE WHEN k % 5 = 0 THEN amount * 10 ELSE amount END FROM r0
  UNION ALL SELECT image, 2, spot, name, type, CASE WHEN k % 4 = 0 THEN amount + 100 ELSE amount END FROM r0 WHERE k % 13 <> 0
),
readings AS (SELECT image, reading, CAST(row_number() OVER (PARTITION BY image, reading ORDER BY spot) - 1 AS INT) AS row_no, name, type, amount FROM r1),
w0 AS (
  SELECT concat(batch, '#', page) AS image, row_no, k, upper(split_part(name, ' ', 1)) AS first, split_part(name, ' ', 2) AS second, type, CAST(amount AS BIGINT) AS amount, {hm} AS hm, 100.0 + 90 * row_no AS y
  FROM c2 WHERE account = 'box2' AND name <> ''
),
{words})
"""
#: The words of a row: number, text, place, confidence, and which rows have them.
_WORDS = (
    ("row_no * 10", "CASE WHEN k % 2 = 0 THEN 'AB' ELSE '' END", "5.0", "y - 22", "25.0", "y - 8", "80.0", ""),
    ("row_no * 10 + 1", "first", "60.0", "y - 24", "120.0", "y - 8", "91.0", ""),
    ("row_no * 10 + 2", "second", "130.0", "y - 22", "190.0", "y - 6", "92.0", ""),
    ("row_no * 10 + 3", "CASE WHEN k % 3 = 0 THEN 'O' ELSE 'Aprobado' END", "400.0", "y - 8", "450.0", "y + 8", "70.0", ""),
    ("row_no * 10 + 4", "hm", "500.0", "y - 8", "540.0", "y + 8", "90.0", ""),
    ("row_no * 10 + 5", "CASE WHEN type = 'COLLECT' THEN '+' ELSE '-' END", "600.0", "y - 8", "606.0", "y + 8", "90.0", "k % 4 = 0"),
    ("row_no * 10 + 6", "concat(CASE WHEN k % 4 = 0 THEN '' WHEN type = 'COLLECT' THEN '+' ELSE '-' END, CASE WHEN k % 4 = 1 THEN '' ELSE '$' END, CAST(amount AS STRING))", "610.0", "y - 8", "680.0", "y + 8", "CAST(60 + k % 40 AS DOUBLE)", "k % 4 <> 1 OR amount < 1000"),
    ("row_no * 10 + 7", "'Transferencia'", "60.0", "y + 8", "150.0", "y + 24", "93.0", ""),
    ("row_no * 10 + 8", "CASE WHEN type = 'COLLECT' THEN 'recibida' ELSE 'enviada' END", "155.0", "y + 10", "220.0", "y + 26", "94.0", ""),
    ("row_no * 10 + 9", "'Q'", "20.0", "y - 30", "50.0", "y + 30", "40.0", ""),
    ("-2", "'Actividad'", "60.0", "10.0", "140.0", "26.0", "95.0", "row_no = 0"),
)
_NAMES = ("word_no", "text", "x0", "y0", "x1", "y1", "confidence")


def _union() -> str:
    """The words as one pass over the rows for each word."""
    parts = [f"SELECT image, {', '.join(x if i or x == n else f'{x} AS {n}' for n, x in zip(_NAMES, w))} FROM w0" + (f" WHERE {w[7]}" if w[7] else "") for i, w in enumerate(_WORDS)]
    return "words AS (\n  " + "\n  UNION ALL ".join(parts) + "\n"


def _one_pass() -> str:
    """The words as one pass over the rows, for Spark, which would derive the rows again for each part of a union."""
    types = ("INT", "STRING", *["DOUBLE"] * 5)
    structs = [f"CASE WHEN {w[7] or 'true'} THEN named_struct({', '.join(f"'{n}', CAST({x} AS {t})" for n, x, t in zip(_NAMES, w, types))}) END" for w in _WORDS]
    return f"words AS (SELECT image, inline(filter(array({', '.join(structs)}), x -> x IS NOT NULL)) FROM w0"


#: A row stands on its page, and the first two of a page also below the page before.
_PAGES = """SELECT *, CAST(floor(rn / 6) AS INT) AS page, CAST(rn % 6 AS INT) AS row_no FROM c0
  UNION ALL SELECT *, CAST(floor(rn / 6) AS INT) - 1 AS page, CAST(rn % 6 AS INT) + 6 AS row_no FROM c0 WHERE rn % 6 < 2 AND rn >= 6"""
_PAGES_ONCE = """SELECT *, CAST(floor(rn / 6) AS INT) - up AS page, CAST(rn % 6 AS INT) + 6 * up AS row_no
  FROM (SELECT *, explode(CASE WHEN rn % 6 < 2 AND rn >= 6 THEN array(0, 1) ELSE array(0) END) AS up FROM c0)"""
_DUCKDB = CTE.replace("{pages}", _PAGES).replace("{words}", _union()).replace("AS STRING)", "AS VARCHAR)").replace("{hm}", "strftime(ts, '%H:%M')")
DUCKDB = ledgers.DUCKDB.rstrip() + _DUCKDB


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables above: captures, readings, words."""
    return ledgers._spark(spark, sf_dir, name, CTE.replace("{pages}", _PAGES_ONCE).replace("{words}", _one_pass()).replace("{hm}", "date_format(ts, 'HH:mm')"))
