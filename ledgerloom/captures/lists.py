"""Lists of movements in a capture, told by what stands above and below each amount.

Lines are (image, line_no, text, confidence, x0, words, today, report_day); words are (text, confidence, x0, y0, x1, y1) in reading
order, and may be missing. Every amount makes a row. Wallets write the rest in five ways, and which one it is shows in
the lines around the amount:

A  name and amount; below it caption and day.           B  caption and amount; below it "de" or "a" and the name.
C  a day above; caption and amount; below it the name.  D  two lines of text with the amount between them, in a line of its own.
E  name and clock above; caption, state and amount below.

All of it is windows over the lines of an image, so any number of images is read at once; nothing is parsed by a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .dates import carry_days, day_in_text, is_heading, repair_days

WORDS = "array<struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>>"
ROW = ("image", "line_no", "day", "clock", "name", "type", "amount", "cut", "caption", "doubtful")

#: Amounts of a wallet that writes them the English way, with ARS behind; unreadable ones; and that wallet's caption.
_ARS = rf"(?:^|\s)([+{T.MINUS}F]?)\s*[/|]?\s*([\dOoU][\dOoU.,-]*?)\s*-?ARS\b"
_ARS_ODD = rf"[+{T.MINUS}]?\s*\d[^A-Za-z]*\bARS\s*$"
_ARS_CAPTION = "(?i)transferencia cvu"
_ARS_BROKEN = r"(?i)transferencia cvu\s+(\S.*)$"
#: The account number's caption that stands where a name would, and buttons at a phone's lower edge.
_NO_NAME = r"(?i)^c\s*v[a-z]{0,2}\s*/\s*c\s*b\s*u$"
_BUTTONS = rf"(\s+(I{{1,3}}|l{{1,3}}|\||[O0o]|[^{T.LETTER}0-9\s]+))+\s*$"


def without_icons(lines: DataFrame) -> DataFrame:
    """Lines without the signs and short words far left of a ``$`` that an icon was read as: further than three heights of the line."""
    w, n = F.col("words"), F.size("words")
    height = F.array_max(F.transform(w, lambda x: x["y1"] - x["y0"]))
    placed = (n > 0) & F.forall(w, lambda x: x["x0"].isNotNull())

    def icon(x: Column, k: Column) -> Column:
        t, following = F.trim(x["text"]), F.get(w, k + 1)
        loose = t.rlike(rf"^[+{T.MINUS}—=_~]+$") | ((k == 0) & t.rlike(r"^[^\d$]{1,2}$"))
        return loose & following["text"].startswith("$") & (following["x0"] - x["x1"] > 3 * height)

    left = F.filter(w, lambda x, k: ~F.coalesce(icon(x, k), F.lit(False)))
    own = lines.withColumn("__left", F.when(placed, left)).withColumn("__out", F.coalesce(F.size("__left") < F.size("words"), F.lit(False)))
    sure = F.array_min(F.transform("__left", lambda x: x["confidence"]))
    return own.withColumns({
        "text": F.when(F.col("__out"), F.array_join(F.transform("__left", lambda x: F.trim(x["text"])), " ")).otherwise(F.col("text")),
        "confidence": F.when(F.col("__out"), F.coalesce(sure, "confidence")).otherwise(F.col("confidence")),
        "words": F.when(F.col("__out"), F.col("__left")).otherwise(F.col("words")),
    }).drop("__left", "__out")


def english_amounts(lines: DataFrame) -> DataFrame:
    """Images whose amounts are written the English way, as lines "name amount" with local amounts; others as they are.

    Names may take several lines. Failed transfers go. An amount that can't be read stays as 0 (``unreadable``), so that its row isn't lost.
    """
    text = F.col("text")
    is_amount = text.rlike(_ARS) | text.rlike(_ARS_BROKEN) | text.rlike(_ARS_ODD)
    image, order = Window.partitionBy("image"), Window.partitionBy("image").orderBy("line_no")
    own = lines.withColumn("unreadable", F.lit(False)).withColumn("__ars", is_amount).withColumn("__many", F.count_if("__ars").over(image) >= 2)
    # a failed transfer's word may stand in the line below the amount
    own = own.withColumns({"__heading": text.rlike("(?i)^(a[vy]er|hoy)$"), "__below": F.coalesce(F.lead("text").over(order), F.lit("")), "__above_ars": F.coalesce(F.lag("__ars").over(order), F.lit(False))})
    used = F.col("__above_ars") & text.rlike("(?i)fallid") & ~F.col("__heading")
    own = own.withColumns({"__used": used, "__breaks": F.col("__ars") | F.col("__heading") | used})
    own = own.withColumn("__seg", F.coalesce(F.sum(F.col("__breaks").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    caption = text.rlike(r"(?i)\bcvu$") & (F.size(F.split(text, " ")) <= 3)
    part = F.when(~F.col("__breaks") & ~caption, text)
    names = F.array_join(F.collect_list(part).over(Window.partitionBy("image", "__seg").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), " ")
    own = own.withColumn("__names", names)
    plain = text.rlike(_ARS)
    spot = F.regexp_extract(text, _ARS_CAPTION, 0)
    mark = F.when(plain, F.regexp_extract(text, _ARS, 0)).when(spot != "", spot).otherwise(F.regexp_extract(text, _ARS_ODD, 0))
    at = F.instr(text, mark) - 1
    tail = F.substring(text, at + 1, F.length(text))
    left = F.filter(F.split(F.regexp_replace(F.substring(text, F.lit(1), at), _ARS_CAPTION, " "), " "), lambda t: t != "")
    # the icon's arrow: words of one or two characters before the first longer one
    first = F.array_position(F.transform(left, lambda t: F.length(t) > 2), True).cast("int")
    left = F.when(first > 0, F.slice(left, F.greatest(first, F.lit(1)), F.size(left))).otherwise(F.array().cast("array<string>"))
    given = F.regexp_extract(text, _ARS, 1)
    unsigned = plain & (given == "")
    sign = F.when(~plain, F.when(tail.rlike(f"^[{T.MINUS}]"), "-").otherwise("+")).when(unsigned, F.when(text.rlike(r"^[T↑]\s"), "-").otherwise("+")).when(given.isin("+", "F"), "+").otherwise("-")
    digits = F.translate(F.regexp_replace(F.regexp_extract(text, _ARS, 2), "[OoU]", "0"), "-", ".")
    shape = r"^(\d{1,3}(?:,\d{3})*|\d+)(?:\.(\d{1,2}))?$"
    whole = F.when(plain & digits.rlike(shape), F.replace(F.regexp_extract(digits, shape, 1), F.lit(","), F.lit("")).try_cast("long"))
    cents = F.rpad(F.regexp_extract(digits, shape, 2), 2, "0")
    local = F.when(whole > 0, F.concat(sign, F.lit("$"), F.translate(F.format_number(whole, 0), ",", "."), F.lit(","), cents))
    who = F.array_join(F.filter(F.split(F.concat_ws(" ", "__names", F.array_join(left, " ")), " "), lambda t: t.rlike(f"[{T.LETTER}0-9]")), " ")
    sure = F.when(local.isNull(), 0).when(unsigned, 40).otherwise(F.least(F.coalesce("confidence", F.lit(90)), F.lit(90)))
    failed = text.rlike("(?i)fallid") | (F.col("__below").rlike("(?i)fallid"))
    row = own.filter("__many and (__ars or __heading) and not __used").filter(~(F.col("__ars") & ~F.col("__heading") & failed))
    heading = F.when(F.col("__heading"), F.when(text.rlike("(?i)^h"), "Hoy").otherwise("Ayer"))
    row = row.withColumns({"__text": F.coalesce(heading, F.trim(F.concat_ws(" ", who, F.coalesce(local, F.concat(sign, F.lit("$0,00")))))), "__sure": F.when(F.col("__heading"), 95).otherwise(sure).cast("double"), "__none": F.col("__ars") & local.isNull()})
    row = row.withColumns({"text": F.col("__text"), "confidence": F.col("__sure"), "unreadable": F.col("__none"), "words": F.lit(None).cast(WORDS), "x0": F.lit(None).cast("double")})
    keep = [*lines.columns, "unreadable"]
    return own.filter("not __many").select(*keep).unionByName(row.select(*keep))


def _no_text(text: Column) -> Column:
    """Without three letters in a row."""
    return ~text.rlike(f"[{T.LETTER}]{{3,}}")


def _no_day(text: Column) -> Column:
    return F.regexp_replace(text, T.SLASHED_DAY, " ")


def _around(lines: DataFrame) -> DataFrame:
    """Columns of each line on its own, of its image, and of its neighbours."""
    order, image = Window.partitionBy("image").orderBy("line_no"), Window.partitionBy("image")
    own = lines.withColumn("am", T.find_amount(F.col("text"))).withColumns({"heading": is_heading(F.col("text")), "said": day_in_text(F.col("text"), F.col("today"))})
    own = own.withColumns({
        "has": F.col("am").isNotNull(),
        "alone": F.col("am").isNotNull() & _no_text(F.substring(F.col("text"), F.lit(1), F.col("am.at"))),
        "detail_x": F.when(F.col("am").isNull() & ~F.col("heading") & (F.col("text").rlike(T.SLASHED_DAY) | F.col("text").rlike(T.CLOCK)), F.col("x0")),
    })
    xs = F.array_sort(F.collect_list("detail_x").over(image))
    own = own.withColumns({
        "column_x": F.get(xs, F.floor(F.size(xs) / 2).cast("int")),
        "between": (F.count_if("has").over(image) >= 2) & (F.count_if("alone").over(image) * 2 >= F.count_if("has").over(image)),
        # a day above ends what an amount can look back to
        "ends": F.col("has") | F.col("said").isNotNull(),
        "bare": F.regexp_replace(F.regexp_replace("text", rf"^[^{T.LETTER}]+", ""), r"[\s—–-]+$", ""),
    })
    own = own.withColumn("seg", F.coalesce(F.sum(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    side = F.when(~F.col("has") & ~F.col("heading"), F.col("bare"))
    own = own.withColumns({
        "side_above": F.coalesce(F.lag(side).over(order), F.lit("")), "side_below": F.coalesce(F.lead(side).over(order), F.lit("")),
        "sure_above": F.coalesce(F.lag("confidence").over(order), F.lit(100.0)),
        "d1": F.lead(F.when(~F.col("has") & ~F.col("heading"), F.col("text"))).over(order), "d2": F.lead(F.when(~F.col("has") & ~F.col("heading"), F.col("text")), 2).over(order),
        "under": F.lead(F.when(~F.col("has"), F.col("text"))).over(order),
    })
    # what looks like a name above: two words of three letters, and most words of it
    shown = T.clean_name(T.without_state(F.regexp_replace("text", T.CLOCK, " ")))
    own = own.withColumn("shown", F.when(~F.col("has"), shown))
    words = F.split("shown", " ")
    long = F.size(F.filter(words, lambda t: t.rlike(f"[{T.LETTER}]{{3,}}")))
    fine = (long >= 2) & (long * 2 >= F.size(words)) & (F.coalesce("confidence", F.lit(100.0)) >= 50) & ~T.is_usual_caption(F.col("shown")) & ~F.col("shown").rlike(T.COLLECT_WORDS) & ~F.col("shown").rlike(T.PAYOUT_WORDS)
    cut = T.is_cut(T.without_state(F.regexp_replace("text", T.CLOCK, " ")))
    above = Window.partitionBy("image", "seg").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    clock = T.clock_in(F.col("text"))
    return own.withColumns({
        "name_above": F.first(F.when(fine, F.struct(F.col("shown").alias("name"), cut.alias("cut"))), ignorenulls=True).over(above),
        "clock_above": F.first(F.when(clock != "", clock), ignorenulls=True).over(above),
    })


def _rows(own: DataFrame) -> DataFrame:
    """The lines with what each amount's row says: its form, name, caption, clock and own day."""
    am, text, blank = F.col("am"), F.col("text"), F.lit("")
    # the name: words right of the icons' column, or what stands left of the amount
    money = lambda t: t.rlike(T.MONEY) | t.rlike(rf"^[+{T.MINUS}]?\$") | t.rlike(rf"^[+{T.MINUS}]?[$8S§]?[\d.]+,\d{{1,2}}$") | t.rlike(rf"^([+{T.MINUS}]|\d[\d.,]*)$")
    by_words = F.array_join(F.transform(F.filter("words", lambda w: (w["x0"] >= F.col("column_x") - 10) & ~money(w["text"])), lambda w: w["text"]), " ")
    raw = F.when((F.size("words") > 0) & F.col("column_x").isNotNull(), by_words).otherwise(F.substring(text, F.lit(1), am["at"]))
    for pattern in (T.MONEY, rf"[+{T.MINUS}]?\$[\d.,]*$", T.MONEY_BARE):
        raw = F.regexp_replace(raw, pattern, "")
    own = own.withColumn("name_text", F.when(F.col("has"), T.without_state(raw))).withColumns({"whole": T.clean_name(F.col("name_text")), "cut": T.is_cut(F.col("name_text"))})
    both = r"(?i)^(prex a prex (?:de|a))\s+(.+)$"
    own = own.withColumns({"own_caption": F.regexp_extract("whole", both, 1), "name": F.when(F.col("whole").rlike(both), F.regexp_extract("whole", both, 2)).otherwise(F.col("whole"))})
    own = own.withColumns({
        "counts": F.coalesce(F.col("has") & am["amount"].isNotNull() & ((am["amount"] != 0) | F.col("unreadable")) & ~F.col("whole").rlike(r"(?i)^rendimientos?\b"), F.lit(False)),
        "torn": F.coalesce(F.col("confidence") < 50, F.lit(False)), "weak": F.coalesce(F.col("confidence") < 60, F.lit(False)),
    })
    # D: text above and below the amount
    up = F.when(_no_text(F.col("side_above")) | (F.col("sure_above") < 50), "").otherwise(F.col("side_above"))
    own = own.withColumns({"d_up": up, "d_both": T.squeezed(F.concat_ws(" ", up, F.col("side_below")))})
    of = r"(?i)^(.*?\b(?:de|desde|a|para))\s+(.+)$"
    lead, who = F.regexp_extract("d_both", of, 1), F.regexp_extract("d_both", of, 2)
    parted = F.col("d_both").rlike(of) & (lead.rlike(T.COLLECT_WORDS) | lead.rlike(T.PAYOUT_WORDS))
    own = own.withColumns({"d_caption": F.when(parted, lead).otherwise(F.col("d_up")), "d_name": F.when(parted, who).otherwise(F.col("side_below"))})
    nobody = F.col("d_name").rlike(_NO_NAME) | F.col("d_both").rlike(r"(?i)^(.*\b(?:transferencia|prex a prex)\s+(?:de|a))\s*(\.{2,}|…)?$")
    own = own.withColumn("nobody", nobody)
    own = own.withColumn("form_d", F.col("counts") & F.col("between") & (_no_text(F.col("name")) | F.col("torn")) & ((F.col("d_name") != "") | F.col("nobody")))
    account = F.regexp_replace(F.regexp_replace("d_both", r"\s*(\.{2,}|…)$", ""), r"(?i)c\s*v[a-z]{0,2}\s*/\s*c\s*b\s*u$", "CVU/CBU")
    own = own.withColumns({"d_caption": F.when(F.col("nobody"), account).otherwise(F.col("d_caption")), "d_cut": F.when(F.col("nobody"), F.col("d_both").rlike(r"(\.{2,}|…)$")).otherwise(T.is_cut(F.col("d_name"))), "d_name": F.when(F.col("nobody"), "").otherwise(T.clean_name(F.col("d_name")))})
    # E: a name above; not if a counterpart stands below
    usual = T.is_usual_caption(F.col("name"))
    below = F.trim(F.regexp_replace(_no_day(F.coalesce("under", blank)), T.CLOCK, " "))
    own = own.withColumn("usual", usual).withColumn("form_e", F.col("counts") & ~F.col("form_d") & F.col("usual") & T.counterpart(below, F.lit(True)).isNull() & F.col("name_above").isNotNull())
    detail = F.when(F.col("between") | F.col("form_e") | F.col("d1").isNull(), "").otherwise(F.trim(F.concat_ws(" ", "d1", "d2")))
    own = own.withColumn("detail", detail)
    no_day = _no_day(F.col("detail"))
    own = own.withColumns({
        "rest": F.trim(F.regexp_replace(no_day, T.CLOCK, " ")), "left_caption": F.regexp_replace(F.regexp_replace(no_day, T.CLOCK, " "), _BUTTONS, ""),
        "clock": F.when(F.col("form_d"), "").when(F.col("form_e"), F.coalesce("clock_above", blank)).otherwise(F.when(T.clock_in(no_day) != "", T.clock_in(no_day)).otherwise(T.clock_in(_no_day(F.col("name_text"))))),
        "own_day": F.when(~F.col("has"), F.col("said")).when(F.col("counts") & ~F.col("form_d"), F.coalesce(day_in_text(F.col("detail"), F.col("today")), day_in_text(F.substring(text, F.lit(1), am["at"]), F.col("today")))),
    })
    own = own.withColumn("other", T.counterpart(F.col("rest"), F.col("usual")))
    other = F.col("other").isNotNull() | (F.col("usual") & (F.col("rest") != "") & ~F.col("rest").rlike(T.COLLECT_WORDS) & ~F.col("rest").rlike(T.PAYOUT_WORDS))
    own = own.withColumns({"form_b": ~F.col("form_e") & other, "from": F.coalesce("other", "rest")})
    pick = lambda d, e, b, a: F.when(F.col("form_d"), d).when(F.col("form_e"), e).when(F.col("form_b"), b).otherwise(a)
    said = F.col("own_caption")
    own = own.withColumns({
        "row_name": pick(F.col("d_name"), F.col("name_above.name"), T.clean_name(F.col("from")), F.col("name")),
        "row_cut": pick(F.col("d_cut"), F.col("name_above.cut"), T.is_cut(F.col("from")), F.col("cut")),
        "row_caption": pick(F.col("d_caption"), F.when(said != "", said).otherwise(F.col("name")), F.when(said != "", said).otherwise(F.col("name")), F.when(said != "", said).otherwise(F.col("left_caption"))),
        "type_text": pick(F.col("d_caption"), F.when(said != "", said).otherwise(F.col("name")), F.when(said != "", said).otherwise(F.col("name")), F.when(said != "", said).otherwise(F.col("detail"))),
    })
    kind = F.when(F.col("form_d"), T.type_of(am, F.col("type_text"), "COLLECT")).otherwise(T.type_of(am, F.col("type_text")))
    own = own.withColumn("kind", F.when(F.col("counts"), kind))
    nameless = F.when(F.col("form_d"), (F.col("row_name") == "") & ~F.col("nobody")).otherwise((F.col("row_name") == "") | T.is_usual_caption(F.col("row_name")))
    doubt = F.col("kind.doubtful") | nameless | F.col("weak") | (F.col("form_d") & F.col("torn"))
    return own.select(
        "image", "line_no", F.col("counts").alias("is_row"), "own_day", "today", "report_day", "clock", F.col("row_name").alias("name"), F.col("kind.type").alias("type"), F.col("am.amount").alias("amount"),
        F.coalesce("row_cut", F.lit(False)).alias("cut"), T.caption_shown(F.col("row_caption")).alias("caption"), doubt.alias("doubtful"),
    )


def read_lists(lines: DataFrame) -> DataFrame:
    """image, line_no, day, clock, name, type, amount, cut, caption, doubtful: the rows that the images' lists show.

    ``line_no`` is the amount's line. A row without a day takes the one above it, or report_day; days out of reach are
    repaired where misread digits explain them. What was guessed is doubtful. Null texts are empty lines, which go; null words and confidences
    are unknown ones. Images without an amount give no rows, as does an empty table. Other columns are passed over.
    """
    have = set(lines.columns)
    kind = {"confidence": "double", "x0": "double", "words": WORDS, "today": "date", "report_day": "date"}
    own = lines.select("image", "line_no", "text", *((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in kind.items()))
    own = english_amounts(T.clean_lines(without_icons(own)))
    days = carry_days(_rows(_around(own))).withColumn("doubtful", F.col("doubtful") | F.col("day").isNull())
    return repair_days(days, ("image",), "line_no").select(*ROW)
