"""From the readings of a batch of images to a source of movements: days, shifts and accounts from names, the better of two readings,
votes, overlaps, and the table that is kept.

Images are (batch, image, file, document, title, taken): ``file`` and ``taken`` (a wall-clock time) of the image or of the document that holds
it, ``document`` null for loose images, ``title`` what the document calls itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import natural_key
from ..functions.times import SHIFTS, minutes_of, shift_of_text
from .dates import day_of_title
from .text import is_usual_caption

#: The header of the table that captures are kept as.
HEADER = ("Fecha", "Titular", "Operación", "Monto", "Cuenta", "Imagen", "Leyenda", "Hora", "Turno", "Referencia", "Origen: captura de pantalla")


def contexts(images: DataFrame, shifts=SHIFTS, default_shift: str = "") -> DataFrame:
    """batch, image, document, image_no, today, report_day, shift, account: what names and times say of each image.

    The report's day is the title's, else the file's; it is then today too, and for a shift that crosses midnight the next day is, as its captures
    are taken when it ends. Without one today is the day the image was taken. ``image_no`` is the natural order of file names within the batch (and document).
    """
    taken = F.to_date("taken")
    whole = F.concat_ws(" ", F.coalesce("document", "file"), F.coalesce("title", F.lit("")))
    own = images.withColumns({"report_day": F.coalesce(day_of_title(F.col("title"), taken), day_of_title(F.coalesce("document", "file"), taken)), "named": shift_of_text(whole, shifts)})
    night = [s.name for s in shifts if (minutes_of(s.start) or 0) > (minutes_of(s.end) or 0)]
    late = F.col("named").isin(*night) if night else F.lit(False)
    today = F.when(F.col("report_day").isNull(), taken).otherwise(F.date_add("report_day", F.when(late, 1).otherwise(0)))
    number = F.row_number().over(Window.partitionBy("batch", "document").orderBy(natural_key(F.col("file")), "file", "image"))
    return own.select("batch", "image", "document", number.alias("image_no"), today.alias("today"), "report_day", F.when(F.col("named") != "", F.col("named")).otherwise(F.lit(default_shift)).alias("shift"), F.coalesce("title", F.lit("")).alias("account"))


def reading_scores(rows: DataFrame) -> DataFrame:
    """(image, points) of a reading's rows: two for a name that is no caption, one for a clock, one less for a doubt."""
    named = (F.coalesce("name", F.lit("")) != "") & ~is_usual_caption(F.col("name"))
    one = F.when(named, 2).otherwise(0) + F.when(F.coalesce("clock", F.lit("")) != "", 1).otherwise(0) - F.when(F.col("doubtful"), 1).otherwise(0)
    return rows.groupBy("image").agg(F.sum(one).alias("points"))


def better_reading(first: DataFrame, second: DataFrame) -> DataFrame:
    """For each image the rows of the reading that scores more; the first where they are equal."""
    other = reading_scores(second).withColumnRenamed("points", "p2").join(reading_scores(first).withColumnRenamed("points", "p1"), "image", "left").filter("p2 > coalesce(p1, 0)").select("image")
    return first.join(other, "image", "left_anti").unionByName(second.join(other, "image", "left_semi"))


def valid_rows(rows: DataFrame) -> DataFrame:
    """Rows that can be kept: a day, an amount above 0, a clock that is empty or one, and an account."""
    clock = F.coalesce("clock", F.lit(""))
    return rows.filter(F.col("day").isNotNull() & (F.col("amount") > 0) & ((clock == "") | clock.rlike(r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?$")) & (F.trim(F.coalesce("account", F.lit(""))) != ""))


def batch_totals(rows: DataFrame) -> DataFrame:
    """batch, n, n_collects, collects, n_payouts, payouts, n_doubtful."""
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("amount"))), F.lit(0.0))
    return rows.groupBy("batch").agg(
        F.count("*").alias("n"), F.count_if(F.col("type") == "COLLECT").alias("n_collects"), total("COLLECT").alias("collects"),
        F.count_if(F.col("type") == "PAYOUT").alias("n_payouts"), total("PAYOUT").alias("payouts"), F.count_if("doubtful").alias("n_doubtful"),
    )


def as_cells(rows: DataFrame, source_id: Column | str = "batch") -> DataFrame:
    """Rows as the cells of a source (source_id, sheet, row_no, cells, numbers) under HEADER, as ``import_sources`` reads them."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    clock = text("clock")
    cells = F.array(
        F.date_format("day", "dd/MM/yyyy"), F.concat(text("name"), F.when(F.col("cut"), "...").otherwise("")), F.when(F.col("type") == "COLLECT", "Cobro").otherwise("Pago"), F.format_string("%.2f", "amount"),
        text("account"), text("image"), text("caption"), clock, F.when(clock == "", text("shift")).otherwise(""), text("ref"), F.lit(""),
    )
    none = F.lit(None).cast("double")
    numbers = F.array(none, none, none, F.col("amount"), *[none] * 7)
    source = F.col(source_id) if isinstance(source_id, str) else source_id
    number = F.row_number().over(Window.partitionBy("__source").orderBy("chain", "place", "image", "line_no")).cast("int")
    body = rows.withColumn("__source", source.cast("string")).select(F.col("__source").alias("source_id"), F.lit("").alias("sheet"), number.alias("row_no"), cells.alias("cells"), numbers.alias("numbers"))
    heads = body.select("source_id").distinct().select("source_id", F.lit("").alias("sheet"), F.lit(0).alias("row_no"), F.array(*map(F.lit, HEADER)).alias("cells"), F.lit(None).cast("array<double>").alias("numbers"))
    return heads.unionByName(body)
