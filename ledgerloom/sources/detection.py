"""All sources of a load at once: what each of them is, its movements, and what was left out.

The first rows of every source are looked at in groups (one small group for each source), which gives a table of
scores: source, format, header row, columns. Each format then projects the rows of all sources that it may fit, with the column numbers
that the table holds for each of them. The union is written once; counts, time coverage and the choice of the best format that
yields anything come from that table. No source is counted on its own, and one that fails fails alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import natural_key
from ..storage import materialize
from .importers import COLUMNS, FORMATS, TWO_ROW_COLUMNS, Mapping, Places, import_mapped, signature
from .panels import pasted_records, shifted_records

#: Rows of a source that are looked at; fewer for the shifted panel and for saved mappings.
HEAD, SHIFTED_HEAD, MAPPED_HEAD = 200, 100, 5
#: The formats' order where scores are equal.
ORDER = ("TWO_ROW_PANEL", "PASTED_PANEL", "FROM_TO_PANEL", "SHIFTED_PANEL", "ANCHORED_WALLET", "MARKET_WALLET", "HOLDERS", "CAPTURES", "BRANCHES", "FLAT_PANEL")
MAPPED = "MAPPED"
#: What a row of a headerless two-row export looks like in its date, kind and owner, and the words of a certain shifted panel.
_DATE, _KIND, _OWNER, _ASKED = r"\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}", r"(?i)(player|agent)", r"(?i)(player|agent)$", "(?i)solicitado por"
_KEY = ("source_id", "sheet")
_SCORES = "source_id string, sheet string, format string, score int, header_row int, columns map<string,int>, mapping string, error string"


@dataclass(frozen=True)
class Imports:
    """records: movement columns, source, load_seq; holders: ref, holder, load_seq; sources: one row for each source
    (source_id, sheet, ordinal, format, score, side, n, n_holders, skipped, first_ts, last_ts, error; format null: not recognised)."""

    records: DataFrame
    holders: DataFrame
    sources: DataFrame


def headerless_two_rows(rows: list[list[str]]) -> bool:
    """Whether the first row and the first five of 15 cells and more look like the two-row export's data."""
    looks = lambda r: len(r) >= 15 and bool(re.match(_DATE, (r[3] or "").strip()) and re.match(_KIND, (r[6] or "").strip()) and re.match(_OWNER, (r[7] or "").strip()))
    data = [r for r in rows if len(r) >= 15][:5]
    return bool(data) and looks(rows[0]) and all(map(looks, data))


def _sniff(saved: dict[str, Mapping]):
    def one(rows: list[list[str]]) -> Iterator[tuple]:
        for at, row in enumerate(rows[:MAPPED_HEAD]):
            if any(row) and (key := signature(row)) in saved:
                yield MAPPED, 1000, at, None, key, None
                return
        failed = None
        for f in FORMATS:
            try:
                found = f.find(rows)
            except Exception as e:  # noqa: BLE001  a format that can't read a source isn't its format
                found, failed = None, f"{f.key}: {e}"
            if found:
                yield f.key, f.points(found[1]), found[0], {k: v for k, v in found[1].items() if k}, None, None
        if headerless_two_rows(rows):
            yield "TWO_ROW_PANEL", 100, -1, dict(TWO_ROW_COLUMNS), None, None
        if failed:
            yield None, 0, -1, None, None, failed

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_no")
        source, sheet = pdf["source_id"].iloc[0], pdf["sheet"].iloc[0]
        rows = [[c or "" for c in r] for r in pdf["cells"]]
        return pd.DataFrame([(source, sheet, *x) for x in one(rows)], columns=[*_KEY, "format", "score", "header_row", "columns", "mapping", "error"])

    return run


def score_sources(cells: DataFrame, saved: dict[str, Mapping] | None = None) -> DataFrame:
    """source_id, sheet, format, score, header_row, columns, mapping, error: every format that each source may have.

    A saved mapping goes before all others. Panels without a header score by the records that their first rows give.
    """
    head = cells.filter(F.col("row_no") < HEAD)
    scores = head.select(*_KEY, "row_no", "cells").groupBy(*_KEY).applyInPandas(_sniff(saved or {}), _SCORES)
    found = lambda records: records.groupBy(*_KEY).agg(F.count("*").alias("n"))
    pasted = found(_by_source(pasted_records, head)).select(*_KEY, F.lit("PASTED_PANEL").alias("format"), F.when(F.col("n") >= 2, 90).otherwise(40).alias("score"))
    first = cells.filter(F.col("row_no") < SHIFTED_HEAD)
    asked = first.groupBy(*_KEY).agg(F.max(F.exists("cells", lambda c: F.coalesce(c.rlike(_ASKED), F.lit(False)))).alias("asked"))
    shifted = found(_by_source(shifted_records, first)).join(asked, list(_KEY)).select(*_KEY, F.lit("SHIFTED_PANEL").alias("format"), F.when(F.col("asked"), 95).otherwise(60).alias("score"))
    bare = pasted.unionByName(shifted).select(*_KEY, "format", "score", F.lit(-1).alias("header_row"), F.lit(None).cast("map<string,int>").alias("columns"), F.lit(None).cast("string").alias("mapping"), F.lit(None).cast("string").alias("error"))
    return scores.unionByName(bare)


def _by_source(read, cells: DataFrame) -> DataFrame:
    """Records of a headerless panel with the source and sheet they come from."""
    joined = cells.withColumn("source_id", F.to_json(F.array("source_id", "sheet"))).withColumn("sheet", F.lit(""))
    pair = F.from_json("source", "array<string>")
    return read(joined).withColumns({"source_id": F.get(pair, F.lit(0)), "sheet": F.get(pair, F.lit(1))}).drop("source")


def _move(columns: list[Column]) -> Column:
    return F.struct(*columns)


def import_sources(cells: DataFrame, saved: dict[str, Mapping] | None = None, only: str | None = None) -> Imports:
    """The movements of all sources of ``cells``, each by its best format that yields any (``only``: by that one).

    Formats go by falling score, ties in their fixed order. Sources are numbered in the natural order of their names. Null cells are
    empty; sources without rows don't appear; columns other than the cells' are passed over.
    """
    saved = saved or {}
    cells = materialize(cells.select(*_KEY, "row_no", "cells", "numbers"), "cells")
    scores = materialize(score_sources(cells, saved), "scores")
    fit = scores.filter(F.col("format").isNotNull()) if only is None else scores.filter(F.col("format") == only)
    shape = [*_KEY, F.col("row_no").cast("long").alias("row_no"), "format"]
    empty = {c: F.lit("") for c in COLUMNS} | {"ts": F.lit(None).cast("timestamp_ntz"), "amount": F.lit(None).cast("double"), "no_time": F.lit(False)}
    parts = []
    for f in FORMATS:
        of = fit.filter(F.col("format") == f.key).select(*_KEY, "format", "header_row", "columns")
        body = cells.join(of, list(_KEY)).filter(F.col("row_no") > F.col("header_row"))
        places = Places()
        ok, columns = f.project(places)
        if f.lookup:
            columns = [(columns[0] if c == "ref" else columns[1] if c == "party" else e).alias(c) for c, e in empty.items()]
        ok = F.coalesce(ok, F.lit(False))
        meant = F.coalesce(f.meant(places), F.lit(False)) if f.meant else F.lit(True)
        parts.append(body.select(*shape, ok.alias("ok"), (meant & ~ok).alias("skipped"), F.when(ok, _move(columns)).alias("move")))
    for key, read in (("PASTED_PANEL", pasted_records), ("SHIFTED_PANEL", shifted_records)):
        of = fit.filter(F.col("format") == key).select(*_KEY)
        rows = _by_source(read, cells.join(of, list(_KEY), "left_semi"))
        parts.append(rows.select(*_KEY, F.col("load_seq").alias("row_no"), F.lit(key).alias("format"), F.lit(True).alias("ok"), F.lit(False).alias("skipped"), _move([F.col(c) for c in COLUMNS]).alias("move")))
    for key, mapping in saved.items():
        of = fit.filter((F.col("format") == MAPPED) & (F.col("mapping") == key)).select(*_KEY, "header_row")
        body = cells.join(of, list(_KEY)).filter(F.col("row_no") > F.col("header_row"))
        rows = _by_source(lambda c, m=mapping: import_mapped(c, Mapping(**{**m.__dict__, "header_row": -1})), body)
        kept = rows.select(*_KEY, F.col("load_seq").cast("long").alias("row_no"), F.lit(MAPPED).alias("format"), F.lit(True).alias("ok"), F.lit(False).alias("skipped"), _move([F.col(c) for c in COLUMNS]).alias("move"))
        lost = body.select(*_KEY, F.col("row_no").cast("long").alias("row_no")).join(kept.select(*_KEY, "row_no"), [*_KEY, "row_no"], "left_anti")
        parts += [kept, lost.select(*_KEY, "row_no", F.lit(MAPPED).alias("format"), F.lit(False).alias("ok"), F.lit(True).alias("skipped"), F.lit(None).cast(kept.schema["move"].dataType).alias("move"))]
    rows = materialize(reduce(DataFrame.unionByName, parts), "imported")
    held = rows.groupBy(*_KEY, "format").agg(F.count_if("ok").alias("yield"), F.count_if("skipped").alias("skipped"), F.min("move.ts").alias("first_ts"), F.max("move.ts").alias("last_ts"))
    place = F.create_map(*(F.lit(x) for i, k in enumerate((MAPPED, *ORDER)) for x in (k, i)))
    # a mapping is the user's choice, so it stands though it yields nothing
    best = fit.join(held, [*_KEY, "format"], "left").filter((F.coalesce("yield", F.lit(0)) > 0) | (F.col("format") == MAPPED))
    first = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.desc("score"), place[F.col("format")]))
    best = best.withColumn("r", first).filter("r = 1").select(*_KEY, "format", "score", "mapping", F.coalesce("yield", F.lit(0)).alias("yield"), F.coalesce("skipped", F.lit(0)).alias("skipped"), "first_ts", "last_ts")
    lookups = [f.key for f in FORMATS if f.lookup]
    sides = F.create_map(*(F.lit(x) for k, v in ({f.key: f.side for f in FORMATS} | {"PASTED_PANEL": "panel", "SHIFTED_PANEL": "panel"}).items() for x in (k, v)))
    mapped = F.create_map(*(F.lit(x) for k, m in saved.items() for x in (k, m.side))) if saved else F.create_map(F.lit(""), F.lit(""))
    names = cells.select(*_KEY).distinct()
    # few rows, one for each source
    number = F.row_number().over(Window.orderBy(natural_key(F.col("source_id")), "source_id", "sheet")) - 1
    errors = scores.filter("error is not null").groupBy(*_KEY).agg(F.first("error").alias("error"))
    lookup = F.col("format").isin(*lookups)
    sources = names.withColumn("ordinal", number).join(best, list(_KEY), "left").join(errors, list(_KEY), "left").select(
        *_KEY, "ordinal", "format", "score", F.when(F.col("format") == MAPPED, mapped[F.col("mapping")]).otherwise(sides[F.col("format")]).alias("side"),
        F.when(lookup, 0).otherwise(F.coalesce("yield", F.lit(0))).alias("n"), F.when(lookup, F.col("yield")).otherwise(0).alias("n_holders"), F.coalesce("skipped", F.lit(0)).alias("skipped"), "first_ts", "last_ts", "error",
    )
    sources = materialize(sources, "sources")
    chosen = rows.filter("ok").join(sources.select(*_KEY, "format", "ordinal"), [*_KEY, "format"])
    seq = (F.shiftleft(F.col("ordinal").cast("long"), 40) + F.col("row_no")).alias("load_seq")
    name = F.when(F.coalesce("sheet", F.lit("")) != "", F.concat_ws(" / ", "source_id", "sheet")).otherwise(F.col("source_id"))
    return Imports(
        chosen.filter(~lookup).select("move.*", name.alias("source"), seq),
        chosen.filter(lookup).select(F.col("move.ref").alias("ref"), F.col("move.party").alias("holder"), seq),
        sources,
    )
