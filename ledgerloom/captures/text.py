"""Lines of a capture as the reader gave them: amounts, clocks, names and captions in them (columns of one line's text).

A line's text is a string column; every function is an expression, and ``clean_lines`` is the only one that looks at a line's neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import parse_number
from .dates import unmarked

#: Letters as the reader may give them, and the characters that stand for a minus.
LETTER, UPPER_LETTER, LOWER_LETTER = "A-Za-zÁÉÍÓÚÑáéíóúñ", "A-ZÁÉÍÓÚÑ", "a-záéíóúñ"
MINUS = r"\-−–"
#: An amount with its sign; without one, at the end of a line; and what an amount's word looks like.
MONEY = rf"([+{MINUS}]?)\s*\$\s*(\d{{1,4}}(?:\.\d{{3}})+(?:,\d{{1,2}})?|\d+(?:,\d{{1,2}})?)"
MONEY_BARE = rf"([+{MINUS}]?)\s*([8S§])?(\d{{1,3}}(?:\.\d{{3}})*,\d{{2}}|\d{{1,3}}(?:\.\d{{3}})+ \d{{2}})[\s—–-]*$"
CLOCK = r"(?i)\b([01]?\d|2[0-3])[:.]([0-5]\d)(?:[:.]([0-5]\d))?\s*(?:hs?\b)?"
SLASHED_DAY = r"\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b"
#: Words of money that came in, and of money that went out.
COLLECT_WORDS = r"(?i)recibid|recibiste|te enviaron|te transfiri|te pag[oó]|cobr|ingres|acredit|deposit|reintegr|devoluci|\bcarga\b|transferencia de\b|prex a prex de\b"
PAYOUT_WORDS = r"(?i)enviad|enviaste|pagast|pago|retir|debit|extracci|transferiste|transferencia a |prex a prex a "
#: Captions that say nothing, and states and origins of money that stand beside a row.
USUAL_CAPTIONS = ("Transferencia enviada", "Transferencia recibida", "Te enviaron dinero", "Enviaste dinero")
STATES = "dinero disponible|aprobad[oa]|rechazad[oa]|pendiente|cancelad[oa]|en proceso"


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


# --- lines -------------------------------------------------------------------


def clean_lines(lines: DataFrame, by: tuple[str, ...] = ("image",), order: str = "line_no") -> DataFrame:
    """Lines with what readers often get wrong put right: strokes within amounts, commas for thousands, 4 for A, 5 for $, misread "De".

    A line whose amount was touched loses confidence (55 at most), so that its row is looked at. Empty lines go.
    """
    text = squeezed(F.col("text"))
    strokes = F.regexp_replace(text, r"(\d[.,])[/|'`´]+(\d{3}\b)", "$1$2")
    # strokes anywhere in an amount before ARS
    many = rf"[+{MINUS}][\d/|'.,]*\d[\d/|'.,]*(?=\s*ARS\b)"
    whole = F.regexp_extract(strokes, many, 0)
    strokes = F.when(whole != "", F.replace(strokes, whole, F.regexp_replace(whole, "[/|']", ""))).otherwise(strokes)
    own = lines.withColumns({"__raw": text, "text": strokes})
    own = own.withColumn("__touched", F.col("text") != F.col("__raw"))
    # a comma before three digits parts thousands
    own = own.withColumn("text", F.regexp_replace("text", r"(\$\s*\d{1,3}),(\d{3})(?![\d.,])", "$1.$2"))
    above = F.lag("text").over(Window.partitionBy(*by).orderBy(order))
    misread = above.rlike("(?i)enviad|transferiste") & F.col("text").rlike(rf"^[4Á]\s+[{UPPER_LETTER}][{LETTER}]+\s") & F.col("text").rlike(r"\d{1,2}/\d{1,2}")
    own = own.withColumn("text", F.when(F.coalesce(misread, F.lit(False)), F.regexp_replace("text", r"^[4Á]\s+", "A ")).otherwise(F.col("text")))
    # 5 or S for the currency sign, parted from the amount by a blank
    sign = rf"([+{MINUS}])\s*[5S§]\s+(\d{{1,3}}(?:[.,]\d{{3}})+(?:,\d{{2}})?)(?!\d)"
    amount = F.regexp_extract("text", sign, 2)
    turned = F.replace(F.regexp_replace("text", sign, "$1\\$ $2"), amount, F.regexp_replace(amount, r",(\d{3})", ".$1"))
    own = own.withColumns({"__sign": F.col("text").rlike(sign), "text": F.when(F.col("text").rlike(sign), turned).otherwise(F.col("text"))})
    of = rf"^(?:\S{{1,2}}\s+)?(?:Oe|Dz|Ds|Des|Os|Oz|D[eo]s?|0e)\s+(?=[{UPPER_LETTER}][{LETTER}]+\s+[{UPPER_LETTER}])"
    own = own.withColumn("text", F.regexp_replace("text", of, "De "))
    less = F.least(F.coalesce("confidence", F.lit(90)), F.lit(55))
    own = own.withColumn("confidence", F.when(F.col("__touched") | F.col("__sign"), less).otherwise(F.col("confidence")))
    return own.filter("text <> ''").drop("__raw", "__touched", "__sign")


# --- amounts -----------------------------------------------------------------


def find_amount(text: Column) -> Column:
    """struct<sign, amount, at, doubtful, arrow>: the first amount in a line, or null.

    ``at`` is where it begins (from 0). Four digits before the first dot are a doubled one (taken out, doubtful); cents may
    be small digits glued behind; a clock behind ``$`` is no amount; without ``$`` the amount at the line's end counts, and is doubtful.
    ``arrow``: the sign belongs to an arrow before it.
    """
    whole, sign, body = (F.regexp_extract(text, MONEY, i) for i in (0, 1, 2))
    has = text.rlike(MONEY)
    at = F.instr(text, whole) - 1
    rest = F.substring(text, at + F.length(whole) + 1, F.length(text))
    four = body.rlike(r"^\d{4}\.")
    fixed = F.when(body.rlike(r"^(\d)\1"), F.regexp_replace(body, r"^\d", "")).when(body.rlike(r"^\d(\d)\1"), F.regexp_replace(body, r"^(\d)\d", "$1")).when(body.rlike(r"^\d\d(\d)\1"), F.regexp_replace(body, r"^(\d\d)\d", "$1")).otherwise(F.substring(body, 2, 99))
    clock = rest.rlike(r"^:\d{2}")
    plain = ~body.rlike(r",\d")
    cents = F.when(plain & rest.rlike(r"^\s?\d{2}\s*$"), F.regexp_extract(rest, r"(\d{2})", 1).cast("double") / 100)
    value = parse_number(body)
    odd = plain & rest.rlike(r"^[%°ºª'\"*]")
    result = lambda sign, amount, at, doubt: F.struct(sign.alias("sign"), amount.alias("amount"), at.cast("int").alias("at"), doubt.alias("doubtful"))
    with_sign = (
        F.when(four, result(sign, parse_number(fixed), at, F.lit(True)))
        .when(clock, F.lit(None))
        .when(cents.isNotNull(), result(sign, F.floor((value + cents) * 100 + 0.5) / 100, at, F.lit(True)))
        .otherwise(result(sign, value, at, odd))
    )
    b_whole, b_sign, b_mark, b_body = (F.regexp_extract(text, MONEY_BARE, i) for i in (0, 1, 2, 3))
    # an 8 before a leading zero is a digit, not a misread sign
    digits = F.when((b_mark == "8") & b_body.startswith("0"), F.concat(F.lit("8"), b_body)).otherwise(b_body)
    bare = F.when(text.rlike(MONEY_BARE), result(b_sign, parse_number(F.regexp_replace(digits, r" (\d{2})$", ",$1")), F.length(text) - F.length(b_whole), F.lit(True)))
    got = F.when(has, with_sign).otherwise(bare)
    arrow = (got["sign"] != "") & (got["at"] > 0) & F.substring(text, got["at"], 1).rlike("[<=←]")
    return F.when(got.isNotNull(), F.struct(got["sign"].alias("sign"), got["amount"].alias("amount"), got["at"].alias("at"), got["doubtful"].alias("doubtful"), F.coalesce(arrow, F.lit(False)).alias("arrow")))


def type_of(amount: Column, caption: Column, default: str = "PAYOUT") -> Column:
    """struct<type, doubtful>: the amount's sign decides, else the caption; doubtful if they disagree or neither tells."""
    sign = F.when(amount["arrow"], F.lit(None)).when(amount["sign"] == "+", "COLLECT").when(amount["sign"].rlike(f"[{MINUS}]"), "PAYOUT")
    word = F.when(caption.rlike(COLLECT_WORDS), "COLLECT").when(caption.rlike(PAYOUT_WORDS), "PAYOUT")
    doubt = (sign.isNull() & word.isNull()) | F.coalesce(sign != word, F.lit(False)) | F.coalesce(amount["doubtful"], F.lit(False))
    return F.struct(F.coalesce(sign, word, F.lit(default)).alias("type"), doubt.alias("doubtful"))


def clock_in(text: Column) -> Column:
    """HH:mm or HH:mm:ss if the text shows a clock, else empty."""
    h, m, s = (F.regexp_extract(text, CLOCK, i) for i in (1, 2, 3))
    return F.when(text.rlike(CLOCK), F.concat(F.lpad(h, 2, "0"), F.lit(":"), m, F.when(s != "", F.concat(F.lit(":"), s)).otherwise(""))).otherwise("")


# --- captions ----------------------------------------------------------------


def without_state(text: Column) -> Column:
    """A text without states ("Aprobado") and origins of money, and the icon letter before them."""
    return squeezed(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i)(?:^|\s)\S?\s*({STATES})\b", " "))


def is_usual_caption(text: Column) -> Column:
    """Whether a text is one of the usual captions, with two misread letters at most and three stray ones before it at most."""
    letters = F.regexp_replace(unmarked(text), "[^a-z]+", "")
    known = [c.lower().replace(" ", "") for c in USUAL_CAPTIONS]
    out = F.lit(False)
    for c in known:
        more = F.length(letters) - len(c)
        out = out | (letters == c) | (more.between(0, 3) & (F.levenshtein(F.right(letters, F.lit(len(c))), F.lit(c)) <= 2))
    return out


def caption_shown(text: Column) -> Column:
    """The caption if it says something: usual ones, today, yesterday and such without two letters in a row are empty."""
    t = squeezed(text)
    return F.when(~t.rlike(rf"[{LETTER}]{{2,}}") | t.rlike("(?i)^(hoy|ayer)$") | is_usual_caption(t), "").otherwise(t)


# --- names -------------------------------------------------------------------


def is_cut(text: Column) -> Column:
    """Whether a name ends in dots: the wallet cut it."""
    return _tidied(text).rlike(r"(\.{2,}|…)\s*[—–-]?\s*$")


def _tidied(text: Column) -> Column:
    s = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[|_]+", " "), r"\s+", " "))
    return F.regexp_replace(s, r"\s+\S*\d\S*/\d{2,4}$", "")  # the rest of a misread day


def clean_name(text: Column) -> Column:
    """A name without what icons, avatars and buttons beside it were read as, and with glued words parted."""
    s = F.regexp_replace(_tidied(text), r"(\.{2,}|…)\s*[—–-]?\s*$", "")
    s = F.trim(F.regexp_replace(s, r"[\s—–-]+$", ""))
    # single small letters and signs at the right; a capital initial stays
    s = F.regexp_replace(s, rf"(?<=\S)(?:\s+(?:[a-zñ]|[^{LETTER}\s]+))+$", "")
    # one or two small letters before a capital, with more behind: the avatar
    s = F.regexp_replace(s, rf"^[a-zñ]{{1,2}} (?=[{UPPER_LETTER}]\S* \S)", "")
    # a sign that only single letters follow
    s = F.regexp_replace(s, rf"(?<=\S) [^{LETTER}0-9\s]+(?: \S)*$", "")
    # single characters, and words without two letters in a row, at the left
    s = F.regexp_replace(s, rf"^(?:(?:\S|(?!\S*[{LETTER}]{{2}})\S+) )+(?=\S)", "")
    # the avatar's initials: they begin what the following words begin with, or double its first letter
    words = F.split(s, " ")
    first = F.lower(words[0])
    initials = F.lower(F.array_join(F.transform(F.slice(words, 2, 99), lambda w: F.substring(w, 1, 1)), ""))
    doubled = (F.length(first) == 2) & (F.substring(first, 1, 1) == F.substring(first, 2, 1)) & (F.substring(first, 1, 1) == F.substring(initials, 1, 1))
    avatar = (F.size(words) > 2) & (F.length(first) <= 3) & first.rlike(rf"^[{LOWER_LETTER}]+$") & (initials.startswith(first) | doubled)
    s = F.when(avatar, F.array_join(F.slice(words, 2, 99), " ")).otherwise(s)
    s = F.regexp_replace(s, rf"^[^{LETTER}]+", "")
    s = F.regexp_replace(s, rf"([{LOWER_LETTER}]{{2}})([{UPPER_LETTER}][{LOWER_LETTER}])", "$1 $2")
    return F.trim(F.regexp_replace(s, r":\s", ", "))


def counterpart(text: Column, certain: Column) -> Column:
    """Who a line names with "a", "de" or "para"; null if it does not begin so.

    ``certain``: the line above is a usual caption, so a preposition glued to the name, or a small letter, counts too.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^[^{LETTER}]+", "")
    glued = rf"^(de|a)(?:\s+|[lI|](?=[{UPPER_LETTER}])|(?=[{LETTER}]))(.+)$"
    who = F.regexp_extract(t, glued, 2)
    sure = F.when(certain & t.rlike(glued), F.concat(F.upper(F.substring(who, 1, 1)), F.substring(who, 2, 1000)))
    loose = r"^(?i:(de|a|para))(\s?)(.*)$"
    word, gap, rest = (F.regexp_extract(t, loose, i) for i in (1, 2, 3))
    fine = t.rlike(loose) & rest.rlike(rf"^[{UPPER_LETTER}]") & ((gap != "") | word.rlike("^[a-z]"))
    return F.coalesce(sure, F.when(fine, rest))
