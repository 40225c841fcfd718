"""Receipts: one movement an image, read twice; and whose account a batch of receipts belongs to.

Lines are (image, reading, line_no, text, today); the first reading goes before the second wherever both tell something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import name_key
from ..functions.numbers import parse_number
from .dates import infer_day, month_of, unmarked
from .text import LETTER, MINUS, UPPER_LETTER, squeezed

#: What makes a text a receipt, and the words around its parts.
_RECEIPT, _PARTS = "(?i)comprobante", "(?i)origen y destino|de operaci"
_PARTIES, _OPERATION = "(?i)origen y destino", "(?i)operaci"
_NO_NAME = r"(?i)mercado ?pago|cvu|cbu|cuit|cuil|alias|banco|brubank|uala|naranja|personal pay|^\W*$"
_DAY = r"(\d{1,2})\s*/\s*([a-z0-9]{2,12})\s*/\s*(\d{4})(?:\s*a\s*las\s*(\d{1,2})[:.](\d{2}))?"
_AMOUNT = rf"^[+{MINUS}]?\s*\$\s*(\d{{1,3}}(?:\.\d{{3}})*(?:,\d{{1,2}})?|\d+(?:,\d{{1,2}})?)\s*$"
#: Lines from the operation's on in which its number may stand.
_NEAR = 3


def receipts_among(lines: DataFrame) -> DataFrame:
    """The images that are receipts, by the words of all their lines."""
    seen = lines.groupBy("image").agg(F.max(F.col("text").rlike(_RECEIPT)).alias("named"), F.max(F.col("text").rlike(_PARTS)).alias("parted"))
    return seen.filter("named and parted").select("image")


def party_name(text: Column) -> Column:
    """A party's line without digits and the capitals that an icon was read as (as long as two words are left)."""
    s = squeezed(F.regexp_replace(text, rf"[^{LETTER}'., ]+", " "))
    return F.regexp_replace(s, rf"^(?:[{UPPER_LETTER}]{{1,3}} )+(?=\S+ \S)", "")


def read_receipts(lines: DataFrame) -> DataFrame:
    """image, day, clock, origin, target, amount, caption, ref, doubtful: one row per image that shows an amount or both parties.

    The amount is a line of its own; the parties are the first two names below their heading, above the operation's line. A row is
    doubtful if day, amount, parties or reference are missing. Null texts are empty lines; images that are no receipts give nothing sensible, see ``receipts_among``.
    """
    own = lines.select("image", "reading", "line_no", squeezed(F.col("text")).alias("text"), "today").filter("text <> ''")
    order = Window.partitionBy("image", "reading").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    t, plain = F.col("text"), unmarked(F.col("text"))
    month = F.regexp_extract(plain, _DAY, 2)
    month = F.when(month.rlike(r"^\d+$"), month.try_cast("int")).otherwise(month_of(month))
    part = lambda i: F.nullif(F.regexp_extract(plain, _DAY, i), F.lit("")).cast("int")
    clock = F.when(F.regexp_extract(plain, _DAY, 4) != "", F.concat(F.lpad(F.regexp_extract(plain, _DAY, 4), 2, "0"), F.lit(":"), F.regexp_extract(plain, _DAY, 5))).otherwise("")
    own = own.withColumns({
        "when": F.when(plain.rlike(_DAY) & month.isNotNull(), F.struct(infer_day(part(1), month, part(3), F.col("today")).alias("day"), clock.alias("clock"))),
        "money": F.nullif(parse_number(F.nullif(F.regexp_extract(t, _AMOUNT, 1), F.lit(""))), F.lit(0.0)),
        "motive": F.when(t.rlike(r"(?i)motivo:?\s*(.+)$"), F.trim(F.regexp_extract(t, r"(?i)motivo:?\s*(.+)$", 1))),
        "below": F.coalesce(F.max(t.rlike(_PARTIES)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)),
        "from_op": F.count_if(t.rlike(_OPERATION)).over(upto),
    })
    first_op = F.min(F.when(t.rlike(_OPERATION), F.col("line_no"))).over(Window.partitionBy("image", "reading"))
    number = F.row_number().over(order)
    own = own.withColumns({"k": number, "has_op": first_op.isNotNull()})
    op_k = F.min(F.when(t.rlike(_OPERATION), F.col("k"))).over(Window.partitionBy("image", "reading"))
    heading_k = F.min(F.when(t.rlike(_PARTIES), F.col("k"))).over(Window.partitionBy("image", "reading"))
    own = own.withColumns({"op_k": op_k, "heading_k": heading_k})
    # the operation's line that ends the parties is the first one below their heading
    end = F.min(F.when(t.rlike(_OPERATION) & F.col("below"), F.col("k"))).over(Window.partitionBy("image", "reading"))
    name = party_name(t)
    named = F.col("below") & ((F.col("k") < F.col("end_k")) | F.col("end_k").isNull()) & ~t.rlike(_NO_NAME) & ~t.rlike(r"\d{4,}") & (F.size(F.split(name, " ")) >= 2)
    ref_here = F.when(F.col("has_op"), (F.col("k") >= F.col("op_k")) & (F.col("k") < F.col("op_k") + _NEAR)).otherwise(True)
    ref = F.when(ref_here, F.nullif(F.regexp_extract(t, r"\b(\d{9,16})\b", 1), F.lit("")))
    own = own.withColumn("end_k", end).withColumns({"party": F.when(named, name), "number": ref})
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("k", c)))[c]
    read = own.groupBy("image", "reading").agg(
        first("when").alias("when"), first("money").alias("amount"), first("motive").alias("motive"), first("number").alias("ref"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("party").isNotNull(), F.struct("k", "party")))), lambda p: p["party"]), 1, 2).alias("parties"),
    ).withColumn("parties", F.when(F.size("parties") == 2, F.col("parties")))
    best = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("reading", c)))[c].alias(c)
    one = read.groupBy("image").agg(*(best(c) for c in ("when", "amount", "motive", "ref", "parties"))).filter("amount is not null or parties is not null")
    doubt = F.col("when.day").isNull() | F.col("amount").isNull() | F.col("parties").isNull() | F.col("ref").isNull()
    return one.select(
        "image", "when.day", F.coalesce("when.clock", F.lit("")).alias("clock"), F.coalesce(F.get("parties", F.lit(0)), F.lit("")).alias("origin"), F.coalesce(F.get("parties", F.lit(1)), F.lit("")).alias("target"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"), F.when(F.lower("motive") != "varios", F.concat(F.lit("Motivo: "), "motive")).otherwise("").alias("caption"), F.coalesce("ref", F.lit("")).alias("ref"), doubt.alias("doubtful"),
    )


def owners(receipts: DataFrame) -> DataFrame:
    """(batch, owner): the name key of whose account a batch's receipts (batch, account, place, origin, target) are.

    The party that the account's name contains (the first seen), else the one named most often, twice at least (ties: the
    first seen). Batches where neither holds have no row.
    """
    full = receipts.filter("origin <> '' and target <> ''")
    named = full.select("batch", "account", F.posexplode(F.array("origin", "target")).alias("i", "party"), "place").withColumn("key", name_key(F.col("party")))
    seen = named.groupBy("batch", "key").agg(F.count("*").alias("n"), F.min(F.struct("place", "i")).alias("at"), F.max(name_key(F.col("account"))).alias("account_key"))
    held = (F.col("key") != "") & F.contains("account_key", F.col("key"))
    best = seen.groupBy("batch").agg(F.min(F.when(held, F.struct("at", "key")))["key"].alias("held"), F.min(F.struct((-F.col("n")).alias("less"), "at", "key")).alias("top"))
    owner = F.coalesce("held", F.when(F.col("top.less") <= -2, F.col("top.key")))
    return best.select("batch", owner.alias("owner")).filter("owner is not null")


def resolve_receipts(receipts: DataFrame) -> DataFrame:
    """Receipts (batch, account, place, origin, target, doubtful ...) with type and name, by whose account it is.

    Money to the owner is collected from the origin, money from the owner is paid to the target. Where no owner is known, or is no party, it
    counts as collected and is doubtful; so does one without parties, as it was read.
    """
    own = receipts.join(owners(receipts).withColumnRenamed("batch", "__b"), F.col("batch") == F.col("__b"), "left")
    paid = (name_key(F.col("origin")) == F.col("owner")) & (name_key(F.col("target")) != F.col("owner"))
    known = F.coalesce((name_key(F.col("target")) == F.col("owner")) | (name_key(F.col("origin")) == F.col("owner")), F.lit(False))
    both = (F.col("origin") != "") & (F.col("target") != "")
    paid = F.coalesce(paid, F.lit(False)) & both
    return own.withColumns({
        "type": F.when(paid, "PAYOUT").otherwise("COLLECT"), "name": F.when(paid, F.col("target")).otherwise(F.col("origin")), "doubtful": F.col("doubtful") | (both & ~known),
    }).drop("__b", "owner")
