"""Days read from captures: as written, from file names, repaired where digits were misread, and carried from row to row.

A reference day (when the capture was taken, or the day the file's name tells) settles missing years and what is plausible.
Days are dates; a day beyond its month rolls over, as everywhere in this engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import _MARKED, _PLAIN
from ..functions.numbers import bound, whole_number

#: The months' names, and the abbreviation of each (September has two).
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
SHORT_MONTHS = {"ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "sep": 9, "set": 9, "oct": 10, "nov": 11, "dic": 12}
WEEKDAYS = "lunes|martes|miercoles|jueves|viernes|sabado|domingo"
#: The digits that each digit may have been, if it was misread.
CONFUSED = {"0": "869", "1": "74", "2": "3", "3": "258", "4": "1", "5": "36", "6": "508", "7": "1", "8": "0365", "9": "0"}
#: Days before and after the reference that a day without a year may lie.
PLAUSIBLE = (-60, 3)
#: Days around a report's day, and around the capture's day, that a row may lie.
NEAR_REPORT, NEAR_CAPTURE = (-3, 2), (-20, 7)
#: Days from the reference beyond which a day makes no sense, and from the image's median beyond which it is doubtful.
ABSURD, APART = 60, 7

_SLASHED = r"\b(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?\b"
_NAMED = r"\b(\d{1,2})\s*(?:de\s+)?(" + "|".join(SHORT_MONTHS) + r")[a-z]*\.?(?:\s+(?:de\s+)?(\d{4}))?"
_HEADING = rf"^(hoy|ayer|((({WEEKDAYS}),?\s*)?\d{{1,2}}\s*(de\s+)?[a-z]{{3,10}}\.?(\s+(de\s+)?\d{{4}})?)|\d{{1,2}}/\d{{1,2}}(/\d{{2,4}})?)$"


def unmarked(text: Column) -> Column:
    """Lower case, marks taken off."""
    return F.lower(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _MARKED, _PLAIN), "[̀-ͯ]", ""))


def day_of(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts, null if they are out of range; the 31st of a shorter month rolls over."""
    fine = month.between(1, 12) & day.between(1, 31) & year.between(1, 9999)
    return F.when(fine, F.date_add(F.make_date(year, month, F.lit(1)), day - 1))


def infer_day(day: Column, month: Column, year: Column, today: Column) -> Column:
    """The date of a day and month; without a year (null) that of the reference, or the year before if it would lie over two days ahead."""
    now = F.year(today)
    guess = F.when(day_of(now, month, day) > F.date_add(today, 2), now - 1).otherwise(now)
    return bound(F.when(year.isNull(), guess).when(year < 100, year + 2000).otherwise(year), lambda y: day_of(y, month, day))


def plausible(day: Column, today: Column) -> Column:
    """The day, or null if it lies too far from the reference."""
    apart = F.datediff(day, today)
    return F.when(apart.between(*PLAUSIBLE), day)


def _part(text: Column, pattern: str, group: int) -> Column:
    return whole_number(F.regexp_extract(text, pattern, group))


def month_of(token: Column) -> Column:
    """The number of a month's name with up to two misread letters (0 for o, 1 for l), or its abbreviation; else null.

    The whole name decides by least distance; where a word begins as an abbreviation does, that month is taken if the word is no
    longer than four letters or some month's name is close to it.
    """
    t = F.regexp_replace(F.translate(F.lower(F.coalesce(token, F.lit(""))), "01", "ol"), "[^a-z]", "")
    names = F.array(*(F.struct(F.lit(i + 1).alias("month"), F.lit(n).alias("name")) for i, n in enumerate(MONTHS)))
    close = F.sort_array(F.filter(F.transform(names, lambda m: F.struct(F.levenshtein(t, m["name"]).alias("d"), m["month"].alias("month"))), lambda x: x["d"] <= 2))
    short = F.create_map(*(F.lit(x) for kv in SHORT_MONTHS.items() for x in kv))[F.substring(t, 1, 3)]
    by_short = F.when((F.length(t) <= 4) | (F.size(close) > 0), short)
    return F.when(F.length(t) >= 3, F.coalesce(by_short, F.get(close, F.lit(0))["month"]))


def day_in_text(text: Column, today: Column) -> Column:
    """The day that a line names: 28/09, 28/9/26, today, yesterday, "5 de octubre"; null if there is none.

    A day without a year must be plausible.
    """
    months = F.create_map(*(F.lit(x) for kv in SHORT_MONTHS.items() for x in kv))

    def parts(t: Column, pattern: str, month: Column) -> Column:
        return F.struct(_part(t, pattern, 1).alias("day"), month.alias("month"), _part(t, pattern, 3).alias("year"))

    def found(p: Column) -> Column:
        return bound(infer_day(p["day"], p["month"], p["year"], today), lambda read: F.when(p["year"].isNotNull() | F.datediff(read, today).between(*PLAUSIBLE), read))

    # every step is worked out once: the text, its parts, the day that they make
    def read(t: Column) -> Column:
        slashed = bound(parts(t, _SLASHED, _part(t, _SLASHED, 2)), found)
        named = bound(parts(t, _NAMED, months[F.regexp_extract(t, _NAMED, 2)]), found)
        return F.when(t.rlike(_SLASHED), slashed).when(t.rlike(r"\bhoy\b"), today).when(t.rlike(r"\bayer\b"), F.date_sub(today, 1)).when(t.rlike(_NAMED), named)

    return bound(unmarked(text), read)


def is_heading(text: Column) -> Column:
    """Whether a line is a day and nothing else."""
    return F.trim(unmarked(text)).rlike(_HEADING)


def day_of_title(title: Column, today: Column) -> Column:
    """The day in a file's name or a document's title: 07-10, 07.10, 7/10/2026, or DIA 7 (of this month, or the last one if it is still to come)."""
    t = F.coalesce(title, F.lit(""))
    dated, numbered = r"(?<!\d)(\d{1,2})[-./_](\d{1,2})(?:[-./_](\d{4}|\d{2}))?(?!\d)", r"(?i)(?<![A-Za-z])d[ií]a[\s_-]*(\d{1,2})(?!\d)"
    d, m, y = _part(t, dated, 1), _part(t, dated, 2), _part(t, dated, 3)
    read = infer_day(d, m, y, today)
    first = F.when(d.between(1, 31) & m.between(1, 12), F.when(y.isNull(), plausible(read, today)).otherwise(read))
    n = _part(t, numbered, 1)
    last_month = F.add_months(today, -1)
    of = F.when(n > F.dayofmonth(today) + 1, last_month).otherwise(today)
    second = F.when(n.between(1, 31), infer_day(n, F.month(of), F.year(of), today))
    return F.coalesce(first, second)


# --- repair ------------------------------------------------------------------


def _variants(digits: Column, width: int) -> Column:
    """A number's two digits, with each one exchanged for those it may have been; the number itself comes first."""
    confused = F.create_map(*(F.lit(x) for k, v in CONFUSED.items() for x in (k, v)))
    out = [F.array(digits)]

    def put(i: int):
        return lambda c: F.concat(F.substring(digits, 1, i - 1), c, F.substring(digits, i + 1, width))

    for i in range(1, width + 1):
        other = F.filter(F.split(confused[F.substring(digits, i, 1)], ""), lambda c: c != "")
        out.append(F.transform(other, put(i)))
    return F.array_distinct(F.flatten(F.array(*out)))


def day_variants(day: Column) -> Column:
    """The days that a misread day may have been: digits of day and month exchanged for similar ones (January also for 10, 11 and 12), within the calendar."""
    dd, mm = F.date_format(day, "dd"), F.date_format(day, "MM")
    months = F.array_distinct(F.concat(_variants(mm, 2), F.when(mm == "01", F.array(*map(F.lit, ("10", "11", "12")))).otherwise(F.array().cast("array<string>"))))
    year = F.year(day)
    pairs = F.flatten(F.transform(_variants(dd, 2), lambda d: F.transform(months, lambda m: F.struct(d.cast("int").alias("d"), m.cast("int").alias("m")))))
    real = F.transform(F.filter(pairs, lambda p: p["d"].between(1, 31) & p["m"].between(1, 12)), lambda p: F.struct(p["d"].alias("d"), day_of(year, p["m"], p["d"]).alias("day")))
    kept = F.filter(real, lambda x: (F.dayofmonth(x["day"]) == x["d"]) & (x["day"] != day))
    return F.transform(kept, lambda x: x["day"])


def repair_days(rows: DataFrame, by: tuple[str, ...] = ("image",), order: str = "row_no") -> DataFrame:
    """Columns day, doubtful: each row's day within reach of its image's reference, where digits can be misread.

    Rows need ``by``, ``order``, day, doubtful, today (when the capture was taken) and report_day (or null). The reach is some days around
    report_day, else around today. A day out of reach becomes its closest variant within reach (ties: the one
    whose day's, then month's digits come first); else, if it lies months away, the last day within reach above it, or report_day; else it
    stays. All three are doubtful. Rows without a day stay without. Any number of images at once.
    """
    centre = F.coalesce("report_day", "today")
    low = F.when(F.col("report_day").isNull(), F.date_add(centre, NEAR_CAPTURE[0])).otherwise(F.date_add(centre, NEAR_REPORT[0]))
    high = F.when(F.col("report_day").isNull(), F.date_add(centre, NEAR_CAPTURE[1])).otherwise(F.date_add(centre, NEAR_REPORT[1]))
    inside = lambda d: (d >= F.col("__low")) & (d <= F.col("__high"))
    own = rows.withColumns({"__low": low, "__high": high, "__centre": centre})
    own = own.withColumn("__in", inside(F.col("day")))
    ranked = F.transform(F.filter(F.when(~F.col("__in"), day_variants(F.col("day"))), inside), lambda d, i: F.struct(F.abs(F.datediff(d, F.col("__centre"))).alias("apart"), i.alias("i"), d.alias("day")))
    own = own.withColumn("__variant", F.array_min(ranked)["day"])
    # the row's own day, or its variant: what the rows below may take over if it is within reach
    own = own.withColumn("__far", F.abs(F.datediff("day", "__centre")) > ABSURD)
    settled = F.when(F.col("__in"), F.col("day")).when(F.col("__variant").isNotNull(), F.col("__variant")).when(~F.col("__far"), F.col("day"))
    own = own.withColumn("__settled", settled)
    # rows without a settled day take over that of the row above, so it hands on what it was given
    above = F.last("__settled", ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("__above", above)
    lost = F.coalesce(F.when(inside(F.col("__above")), F.col("__above")), F.col("report_day"), F.col("day"))
    day = F.when(F.col("day").isNull(), F.lit(None)).when(F.col("__settled").isNotNull(), F.col("__settled")).otherwise(lost)
    doubt = F.coalesce(F.col("doubtful"), F.lit(False)) | F.coalesce(~F.col("__in"), F.lit(False))
    return own.withColumns({"day": day, "doubtful": doubt}).select(*rows.columns)


# --- carrying and outliers ---------------------------------------------------


def carry_days(lines: DataFrame, by: tuple[str, ...] = ("image",), order: str = "line_no") -> DataFrame:
    """The lines that are rows (``is_row``), with day and doubtful.

    Lines need ``by``, ``order``, own_day (what a row or a heading says itself, or null), clock, report_day and today. A row without a day of its own
    takes the last one above it in its image, a row's or a heading's, else report_day. One that shows a clock but has no day at all is of today,
    and doubtful: wallets write today's rows so. What is still without takes the last row's above, else the first one's below, and is doubtful.
    """
    spread = Window.partitionBy(*by).orderBy(order)
    before, after = spread.rowsBetween(Window.unboundedPreceding, -1), spread.rowsBetween(1, Window.unboundedFollowing)
    own = lines.withColumn("__day", F.coalesce("own_day", F.last("own_day", ignorenulls=True).over(before), "report_day")).filter("is_row")
    today = F.col("__day").isNull() & (F.coalesce("clock", F.lit("")) != "")
    own = own.withColumns({"__day": F.when(today, F.col("today")).otherwise(F.col("__day")), "__late": today})
    own = own.withColumn("__near", F.coalesce(F.last("__day", ignorenulls=True).over(before), F.first("__day", ignorenulls=True).over(after)))
    late = F.col("__late") | (F.col("__day").isNull() & F.col("__near").isNotNull())
    return own.withColumns({"day": F.coalesce("__day", "__near"), "doubtful": F.coalesce("doubtful", F.lit(False)) | late}).drop("__day", "__near", "__late")


def flag_outliers(rows: DataFrame, by: tuple[str, ...] = ("image",)) -> DataFrame:
    """Rows more than a week from the upper median of their image's days become doubtful."""
    own = rows.withColumn("__at", F.unix_date("day"))
    middle = own.groupBy(*by).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY __at DESC)").alias("__middle")).withColumnsRenamed({c: f"__{c}" for c in by})
    same = own.join(middle, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left")
    far = F.abs(F.col("__at") - F.col("__middle")) > APART
    return same.withColumn("doubtful", F.coalesce("doubtful", F.lit(False)) | F.coalesce(far, F.lit(False))).select(*rows.columns)
