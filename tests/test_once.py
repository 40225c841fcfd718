"""Expressions and derived tables whose steps are worked out once, not once for each use."""

import datetime

from pyspark.sql import functions as F

from ledgerloom.captures import dates
from ledgerloom.functions import numbers, times
from ledgerloom.plans import captures


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _patterns(df) -> int:
    return _plan(df).lower().count("regexp_") + _plan(df).count("RLIKE")


def test_parsing_names_each_pattern_a_few_times(spark):
    df = spark.createDataFrame([("28/09/24, 9:05 p. m", "$ (1.234,50)"), ("2024-02-03t10:20:30.500+02:00", "1,5-"), ("", ""), (None, None)], "t string, m string")
    got = df.select(times.parse_datetime(F.col("t")).cast("string").alias("at"), numbers.parse_number(F.col("m")).alias("v"))
    assert [tuple(r) for r in got.collect()] == [("2024-09-28 21:05:00", -1234.5), ("2024-02-03 05:20:30.5", -1.5), (None, None), (None, None)]
    assert _patterns(df.select(times.parse_datetime(F.col("t")))) < 150
    assert _patterns(df.select(numbers.parse_number(F.col("m")))) < 16


def test_days_name_each_pattern_a_few_times(spark):
    day = datetime.date
    df = spark.createDataFrame([("Miércoles, 3 de septiembre", day(2024, 10, 3)), ("28/9/26 x", day(2024, 1, 1)), ("AYER 5 oct", day(2024, 3, 1)), ("31/12", day(2024, 1, 2)), ("1/6", day(2024, 1, 2)), (None, day(2024, 1, 2))], "t string, d date")
    assert [r[0] for r in df.select(dates.day_in_text(F.col("t"), F.col("d"))).collect()] == [day(2024, 9, 3), day(2026, 9, 28), day(2024, 2, 29), day(2023, 12, 31), None, None]
    assert _patterns(df.select(dates.day_in_text(F.col("t"), F.col("d")))) < 30


def test_words_come_from_one_pass_over_the_rows(spark, tmp_path):
    events = spark.range(400).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 7 % 300) AS ts", "id % 40 AS user_id", "element_at(array('purchase', 'view', 'click', 'error'), cast(id % 4 as int) + 1) AS event_type", "cast(id % 90 AS double) * 7 AS value")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    words = captures.derived(spark, str(tmp_path), "words")
    assert _plan(words).count("Relation") <= 4  # the wallet's four kinds of rows
    union = captures.ledgers._spark(spark, str(tmp_path), "words", captures.CTE.replace("{pages}", captures._PAGES).replace("{words}", captures._union()).replace("{hm}", "date_format(ts, 'HH:mm')"))
    key = lambda df: sorted(map(str, df.selectExpr("image", "cast(word_no AS int) word_no", "text", *(f"cast({c} AS double) {c}" for c in ("x0", "y0", "x1", "y1", "confidence"))).collect()))
    assert key(words) == key(union) and words.count() > 300
    assert _plan(union).count("Relation") > 40
