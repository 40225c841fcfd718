"""Orders that people expect: numbers within names by value, and letters as a language orders them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The collation of names: as Spanish orders them (small letters before capitals, accents after plain letters).
NAMES = "es"


def natural_key(text: Column, width: int = 20) -> Column:
    """A sort key of a text's runs: digits by value (page 2 before page 10), all else without case and marks.

    Runs of digits are padded after their leading zeros are taken off; of equal values the shorter writing goes first,
    which the text itself decides (put it behind the key). Null sorts as empty.
    """
    t = F.lower(F.translate(F.coalesce(text, F.lit("")), "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN"))
    runs = F.regexp_extract_all(t, F.lit(r"\d+|\D+"), F.lit(0))

    def run(r: Column) -> Column:
        bare = F.regexp_replace(r, "^0+(?=.)", "")
        # the number of digits goes first, so longer numbers than the padding still sort by value
        return F.when(r.rlike(r"^\d"), F.concat(F.lpad(F.length(bare).cast("string"), 4, "0"), F.lpad(bare, width, "0"), F.when(F.length(bare) > width, bare).otherwise(""))).otherwise(r)

    return F.array_join(F.transform(runs, run), "\u0001")


def by_name(text: Column) -> Column:
    """A text that sorts and compares as names do."""
    return F.collate(F.coalesce(text, F.lit("")), NAMES)
