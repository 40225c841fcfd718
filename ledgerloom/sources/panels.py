"""Panel reports without a header: tokens pasted one below another, and rows whose cells have shifted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import clean_text
from ..functions.numbers import parse_number
from .importers import OPERATION, _by_word, _move, _time, player

#: The words that name an operation in the shifted report.
SHIFTED_OPERATION = r"(?i)^(DEPOSITO|RETIRO|BONUS|BONO)\b"
#: Tokens of a pasted record: id, time, operation, who began it, from, to, amount.
RECORD = 7


def with_counter(cells: DataFrame, sample: int = 60) -> DataFrame:
    """The sources whose first column is a counter: of at least 16 rows with two cells among the first ``sample``, 80 % begin with one digit."""
    rows = cells.filter((F.col("row_no") < sample) & (F.size("cells") >= 2))
    digit = F.trim(F.get("cells", F.lit(0))).rlike("^[1-9]$")
    seen = rows.groupBy("source_id", "sheet").agg(F.count("*").alias("n"), F.count_if(digit).alias("k"))
    return seen.filter("n >= 16 and k >= 0.8 * n").select("source_id", "sheet")


def tokens(cells: DataFrame) -> DataFrame:
    """source_id, sheet, at (from 0), row_no, token and number (a workbook's value): all cells in order, cut at tabs and line ends, without blank ones and counters."""
    counted = with_counter(cells).withColumn("counter", F.lit(True))
    own = cells.join(counted, ["source_id", "sheet"], "left")
    # each cell with its number; a cell of several tokens has none
    number = F.when(F.col("numbers").isNotNull(), F.col("numbers")).otherwise(F.array().cast("array<double>"))
    whole = F.transform("cells", lambda c, i: F.struct(c.alias("text"), F.get(number, i).alias("number")))
    body = F.when(F.col("counter"), F.slice(whole, 2, F.size("cells"))).otherwise(whole)
    parts = F.flatten(F.transform(body, lambda c: F.transform(F.split(F.coalesce(c["text"], F.lit("")), "[\t\n]"), lambda t: F.struct(clean_text(t).alias("token"), c["number"].alias("number")))))
    flat = own.select("source_id", "sheet", "row_no", F.posexplode(F.filter(parts, lambda t: t["token"] != "")).alias("k", "t"))
    order = Window.partitionBy("source_id", "sheet").orderBy("row_no", "k")
    return flat.select("source_id", "sheet", "row_no", (F.row_number().over(order) - 1).alias("at"), "t.token", "t.number")


def _apart(places: Column, length: int) -> Column:
    """Of ascending places those that a walk takes that goes on ``length`` places after each it takes."""
    far = lambda acc, x: (F.size(acc) == 0) | (x >= F.element_at(acc, -1) + length)
    return F.aggregate(places, F.array().cast("array<int>"), lambda acc, x: F.when((F.size(acc) > 0) & ~far(acc, x), acc).otherwise(F.concat(acc, F.array(x))))


def pasted_records(cells: DataFrame) -> DataFrame:
    """Movements of reports that were pasted token by token; a record that begins within an earlier one is none."""
    order = Window.partitionBy("source_id", "sheet").orderBy("at")
    look = tokens(cells).withColumns({f"t{i}": F.lead("token", i).over(order) for i in range(1, RECORD)})
    look = look.withColumn("n6", F.lead("number", RECORD - 1).over(order))
    amount, ts = F.coalesce("n6", parse_number(F.col("t6"))), _time(F.col("t1"))
    starts = look.filter(F.col("token").rlike(r"^\d{8,}$") & F.col("t2").rlike(OPERATION) & ts.isNotNull() & amount.isNotNull())
    # starts that lie close to one another make a run; the walk is over within each
    gap = F.col("at") - F.lag("at").over(order)
    runs = starts.withColumn("new", (F.coalesce(gap, F.lit(RECORD)) >= RECORD).cast("int")).withColumn("run", F.sum("new").over(order))
    taken = runs.groupBy("source_id", "sheet", "run").agg(F.sort_array(F.collect_list("at")).alias("places")).select("source_id", "sheet", F.explode(_apart(F.col("places"), RECORD)).alias("at"))
    own = runs.join(taken, ["source_id", "sheet", "at"])
    by, source, target = (F.col(c) for c in ("t3", "t4", "t5"))
    party = player(by, source, target)
    moved = _move("panel", origin=F.lit("PASTED"), account=by, party=party, ts=ts, type=_by_word(F.col("t2")), amount=amount, ref=F.col("token"), detail=F.col("t2"))
    return own.select(*moved, F.col("source_id").alias("source"), F.col("at").cast("long").alias("load_seq"))


def shifted_records(cells: DataFrame) -> DataFrame:
    """Movements of rows that are told by an operation's cell, wherever it stands: the nearest time left of it, the
    reference left of that, and of the filled cells right of it two names, the deposit and the withdrawal.
    Withdrawals name the player first. Rows without an amount, or of times before 2000, are left out."""
    text = F.transform("cells", clean_text)
    spot = F.array_position(F.transform(text, lambda c: c.rlike(SHIFTED_OPERATION)), True)
    own = cells.withColumns({"text": text, "spot": spot.cast("int")}).filter("spot > 0")
    left = F.slice("text", 1, F.col("spot") - 1)
    times = F.transform(left, lambda c, i: F.struct(_time(c).alias("ts"), i.alias("i")))
    own = own.withColumn("time", F.try_element_at(F.filter(times, lambda t: t["ts"].isNotNull()), F.lit(-1)))
    number = F.when(F.col("numbers").isNotNull(), F.col("numbers")).otherwise(F.array().cast("array<double>"))
    valued = F.transform("text", lambda c, i: F.struct(c.alias("text"), F.get(number, i).alias("number")))
    rest = F.filter(F.slice(valued, F.col("spot") + 1, F.size("text")), lambda c: c["text"] != "")
    own = own.filter(F.col("time.ts") >= F.lit("2000-01-01").cast("timestamp_ntz")).withColumns({"rest": rest, "op": F.get("text", F.col("spot") - 1)})
    at = lambda i: F.get("rest", F.lit(i))["text"]
    first, second = (F.abs(F.coalesce(F.get("rest", F.lit(i))["number"], parse_number(at(i)), F.lit(0.0))) for i in (2, 3))
    kind = _by_word(F.col("op"))
    out = kind == "PAYOUT"
    amount = F.when(out, F.when(second != 0, second).otherwise(first)).otherwise(F.when(first != 0, first).otherwise(second))
    name = lambda i: F.coalesce(at(i), F.lit(""))
    ref = F.coalesce(F.get("text", F.col("time.i") - 1), F.lit(""))
    moved = _move("panel", origin=F.lit("SHIFTED"), account=F.when(out, name(1)).otherwise(name(0)), party=F.when(out, name(0)).otherwise(name(1)), ts=F.col("time.ts"), type=kind, amount=amount, ref=ref, detail=F.col("op"))
    return own.withColumn("value", amount).filter("value <> 0").select(*moved, F.col("source_id").alias("source"), F.col("row_no").cast("long").alias("load_seq"))
