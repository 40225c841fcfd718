"""Lines put together from loose words of wide captures, around their amounts.

Wide lists write name, clock, state and amount in columns at different heights, so a reader that goes by lines mixes them.
Words are (image, word_no, text, x0, y0, x1, y1, confidence). The image is cut into zones half way between
one amount and the next; a zone's start and the words are sorted together by height, so each word takes the last start
above it and no range join is needed. Within a zone, words of about equal height make a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .text import LETTER, MINUS, UPPER_LETTER, without_state

#: What a word that is an amount looks like, with and without the currency sign; a sign alone; a clock.
_MONEY_WORD = rf"^[+{MINUS}]?\$[\d.,]+$"
_SIGNED_WORD = rf"^[+{MINUS}]\d{{1,3}}(?:\.\d{{3}})*(?:,\d{{1,2}})?$"
_SIGN_WORD = rf"^[+{MINUS}]$"
_CLOCK_WORD = r"^([01]?\d|2[0-3]):[0-5]\d$"
#: A sign stands at the height of its amount if their middles are less than this apart.
_LEVEL = 20
#: Heights of an amount that its zone reaches above the first and below the last; of a word that a line's words may be apart; of a word from which on it is a picture.
_REACH, _LINE, _TALL, _GAP = 3, 0.5, 1.6, 1.5


def _levels(heights: Column, apart: Column) -> Column:
    """For ascending heights, each one's line: the height of the first word that is less than ``apart`` above it."""
    return F.aggregate(heights, F.array().cast("array<double>"), lambda acc, y: F.concat(acc, F.array(F.when(y - F.element_at(F.concat(F.array(y), acc), -1) < apart, F.element_at(F.concat(F.array(y), acc), -1)).otherwise(y))))


def _amounts(words: DataFrame) -> DataFrame:
    """Words with ``money``: the amount's text if the word is one."""
    order = Window.partitionBy("image").orderBy("word_no")
    text, last = F.col("text"), F.lag("text").over(order)
    signed = last.rlike(_SIGN_WORD) & text.rlike(_MONEY_WORD) & (F.abs(F.lag("cy").over(order) - F.col("cy")) < _LEVEL)
    money = (
        F.when(F.coalesce(signed, F.lit(False)), F.concat(last, text)).when(text.rlike(_MONEY_WORD) & text.rlike(r"\d"), text)
        .when(text.rlike(_SIGNED_WORD), F.concat(F.substring(text, 1, 1), F.lit("$"), F.substring(text, 2, 100)))
    )
    return words.withColumn("money", money)


def lines_from_words(words: DataFrame) -> DataFrame:
    """image, line_no, text, confidence: for each amount a line "name amount" and one "caption clock", after the headings above the first.

    Images with fewer than two amounts give none; words without a place or a text are passed over. A name is the lowest line
    of letters above its amount, without the avatar's initials; what stands at the amount's own height is neither name nor caption. Repeated
    words are words of their own. An empty table gives none.
    """
    own = words.select("image", "word_no", F.trim("text").alias("text"), *(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")), F.coalesce(F.col("confidence").cast("double"), F.lit(90.0)).alias("confidence"))
    own = own.filter("text <> '' and x0 is not null and y0 is not null and x1 is not null and y1 is not null").withColumns({"cy": (F.col("y0") + F.col("y1")) / 2, "h": F.col("y1") - F.col("y0")})
    own = _amounts(own)
    has = F.col("money").isNotNull()
    hs = F.array_sort(F.collect_list("h"))
    own = materialize(own, "words")
    whole = own.groupBy("image").agg(
        F.count_if(has).alias("n"), F.min(F.when(has, F.col("x0"))).alias("left"), F.get(hs, F.floor(F.size(hs) / 2).cast("int")).alias("usual"),
        F.min(F.when(has, F.struct("cy", "word_no", "h"))).alias("first"),
    ).filter("n >= 2").select("image", "left", F.when(F.col("usual") == 0, 20.0).otherwise(F.col("usual")).alias("usual"), (F.col("first.cy") - _REACH * F.col("first.h")).alias("start"), (_REACH * F.col("first.h")).alias("reach"))
    by_height = Window.partitionBy("image").orderBy("cy", "word_no")
    before, after = F.lag("cy").over(by_height), F.lead("cy").over(by_height)
    whole = materialize(whole, "images")
    own = own.join(whole, "image")
    zones = own.filter(has).select(
        "image", F.row_number().over(by_height).alias("zone"), F.coalesce((before + F.col("cy")) / 2, F.col("start")).alias("low"), F.coalesce((after + F.col("cy")) / 2, F.col("cy") + F.col("reach")).alias("high"),
        F.struct("money", F.col("cy").alias("y"), F.col("confidence").alias("sure")).alias("amount"),
    )
    marks = zones.select("image", F.col("low").alias("cy"), F.lit(-1).cast("long").alias("word_no"), F.struct("zone", "high", "amount").alias("z"))
    body = own.filter(~has).select("image", "cy", F.col("word_no").cast("long").alias("word_no"), F.lit(None).cast(marks.schema["z"].dataType).alias("z"), F.struct("text", "x0", "x1", "y0", "y1", "h", "confidence").alias("w"))
    both = marks.withColumn("w", F.lit(None).cast(body.schema["w"].dataType)).unionByName(body)
    last = F.last("z", ignorenulls=True).over(Window.partitionBy("image").orderBy("cy", "word_no").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("z", last).filter("w is not null").join(whole, "image")
    # words above the first zone are headings, those past a zone's end or right of the amounts are nothing
    inside = F.col("z").isNull() | ((F.col("cy") < F.col("z.high")) & (F.col("w.x1") <= F.col("left")))
    placed = placed.filter(inside).withColumns({"zone": F.coalesce("z.zone", F.lit(0)), "clock": F.col("z").isNotNull() & F.col("w.text").rlike(_CLOCK_WORD)})
    zone = Window.partitionBy("image", "zone")
    placed = placed.withColumn("first_clock", F.min(F.when(F.col("clock"), F.struct("word_no", "w.text"))).over(zone))
    placed = materialize(placed, "placed")
    lone = placed.filter("zone > 0").groupBy("image", "zone").agg(F.first("first_clock.text").alias("clock"))
    placed = placed.filter(~F.coalesce(F.col("word_no") == F.col("first_clock.word_no"), F.lit(False)))
    said = F.when(F.col("zone") > 0, without_state(F.col("w.text"))).otherwise(F.col("w.text"))
    fine = placed.withColumn("said", said).filter((F.col("said") != "") & (F.col("w.h") <= _TALL * F.col("usual")))
    packed = fine.groupBy("image", "zone", "usual").agg(F.array_sort(F.collect_list(F.struct("cy", "word_no", "said", F.col("w.x0").alias("x0"), F.col("w.x1").alias("x1"), F.col("w.y0").alias("y0"), F.col("w.y1").alias("y1"), F.col("w.confidence").alias("sure")))).alias("ws"))
    level = _levels(F.col("ws.cy"), _LINE * F.col("usual"))
    spread = packed.withColumn("level", level).select("image", "zone", "usual", F.explode(F.arrays_zip("ws", "level")).alias("x"))
    rows = spread.groupBy("image", "zone", "usual", F.col("x.level").alias("level")).agg(
        F.array_sort(F.collect_list(F.struct("x.ws.x0", "x.ws.cy", "x.ws.word_no", "x.ws.said", "x.ws.x1"))).alias("ws"), F.min("x.ws.y0").alias("y0"), F.max("x.ws.y1").alias("y1"), F.min("x.ws.sure").alias("sure")
    )
    rows = rows.select("image", "zone", "usual", "level", "ws", F.array_join("ws.said", " ").alias("text"), ((F.col("y0") + F.col("y1")) / 2).alias("middle"), "sure")
    rows = materialize(rows, "lines")
    heads = rows.filter("zone = 0").select("image", F.lit(0).alias("zone"), F.lit(0).alias("part"), "level", "text", F.lit(90.0).alias("confidence"))
    # the zones' rows, above and below the amount
    at = zones.select("image", "zone", "amount").join(whole.select("image", "usual"), "image")
    sided = rows.filter("zone > 0").drop("usual").join(at, ["image", "zone"])
    above = (F.col("middle") < F.col("amount.y") - _LINE * F.col("usual")) & F.col("text").rlike(f"[{LETTER}]{{3,}}")
    under = F.col("middle") > F.col("amount.y") + _LINE * F.col("usual")
    name = sided.groupBy("image", "zone").agg(
        F.max(F.when(above, F.struct("level", "ws", "sure"))).alias("top"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(under, F.struct("level", "text")))), lambda r: r["text"]), " ").alias("caption"),
    )
    full = at.join(name, ["image", "zone"], "left").join(lone, ["image", "zone"], "left")
    ws = F.col("top.ws")
    avatar = (F.size(ws) > 2) & F.get(ws, F.lit(0))["said"].rlike(f"^[{UPPER_LETTER}]{{1,3}}$") & (F.get(ws, F.lit(1))["x0"] - F.get(ws, F.lit(0))["x1"] > _GAP * F.col("usual"))
    shown = F.when(avatar, F.slice(ws, F.lit(2), F.size(ws))).otherwise(ws)
    title = without_state(F.array_join(F.transform(shown, lambda w: w["said"]), " "))
    upper = full.select("image", "zone", F.lit(1).alias("part"), F.lit(0.0).alias("level"), F.concat_ws(" ", title, "amount.money").alias("text"), F.least(F.coalesce("top.sure", F.col("amount.sure")), "amount.sure").alias("confidence"))
    lower = full.select("image", "zone", F.lit(2).alias("part"), F.lit(0.0).alias("level"), F.trim(F.concat_ws(" ", without_state(F.coalesce("caption", F.lit(""))), "clock")).alias("text"), F.lit(90.0).alias("confidence"))
    every = heads.unionByName(upper).unionByName(lower)
    number = F.row_number().over(Window.partitionBy("image").orderBy("zone", "part", "level"))
    return every.select("image", number.alias("line_no"), F.trim("text").alias("text"), "confidence")
