"""Known report formats, found by their headers and projected to movements.

Each format has a header (column names after ``norm``; ``?`` marks optional ones) and a
projection. Detection looks at a source's first rows on the driver; the rest is one
DataFrame projection. Cells that are no number or time leave the row out (it counts as skipped).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import cbu_of, clean_text, doc_of, norm
from ..functions.numbers import parse_number, round2
from ..functions.times import DAY_MS, from_excel_serial, from_ms, parse_datetime, parse_time_of_day, to_ms
from .cells import head

#: The words that name an operation of a panel, and words of money that comes in and goes out in unknown reports.
OPERATION = r"(?i)^(dep[oó]sito|retiro|bonus|bono|bonificaci[oó]n)$"
IN_WORDS, OUT_WORDS = "cobro|deposit|entra|ingres|credit|carga", "pago|retir|sal|egres|debit|descarga"
#: The columns of a two-row export that comes without its header.
TWO_ROW_COLUMNS = {"ref": 1, "date": 3, "amount": 4, "note": 5, "kind": 6, "owner": 7, "name": 12, "agent": 14}
COLUMNS = ("side", "origin", "account", "party", "ts", "type", "amount", "ref", "detail", "doc", "cbu", "no_time", "shift")


def plain(s: str | None) -> str:
    """``norm`` for the driver's header rows."""
    s = unicodedata.normalize("NFD", s or "").lower()
    return re.sub("[^a-z0-9]+", "", s)


def find_header(rows: list[list[str]], names: dict[str, str | list[str]], most: int = 20, anchor: str | None = None) -> tuple[int, dict[str, int]] | None:
    """Row number and column numbers of the first row that has all names.

    A name is looked for as it is, then as a beginning. With an ``anchor`` columns right of it come first,
    and only equal names count. Optional names (``?x``) that are missing get -1.
    """
    for r, row in enumerate(rows[:most]):
        cells = [plain(c) for c in row]
        start = cells.index(anchor) if anchor in cells else -1
        if anchor and start < 0:
            continue
        found = {anchor: start} if anchor else {}
        for name, spec in names.items():
            at = -1
            for want in [spec] if isinstance(spec, str) else spec:
                tests = [lambda i, c: i >= start and c == want, lambda i, c: c == want] if anchor else [lambda i, c: c == want, lambda i, c: c.startswith(want)]
                at = next((i for test in tests for i, c in enumerate(cells) if test(i, c)), -1)
                if at >= 0:
                    break
            if at < 0 and not name.startswith("?"):
                break
            found[name.removeprefix("?")] = at
        else:
            return r, found
    return None


class Places:
    """Column numbers that a row carries itself (``columns``), so that one projection serves sources whose columns differ."""

    def __getitem__(self, name: str) -> Column:
        return F.try_element_at(F.col("columns"), F.lit(name))


def _cell(at: int | Column | None) -> Column:
    if isinstance(at, Column):
        return F.get("cells", at)
    return F.lit(None).cast("string") if at is None or at < 0 else F.get("cells", at)


def _amount(at: int | Column | None) -> Column:
    """A number cell's value, else what the text says."""
    if at is None or (isinstance(at, int) and at < 0):
        return parse_number(_cell(at))
    return F.coalesce(F.get("numbers", at if isinstance(at, Column) else F.lit(at)), parse_number(_cell(at)))


def _time(c: Column) -> Column:
    """Text, or a workbook's serial number."""
    return F.coalesce(parse_datetime(c), from_excel_serial(c.try_cast("double")))


def _clock(c: Column) -> Column:
    part = c.try_cast("double")
    return F.coalesce(parse_time_of_day(c), F.when(part < 1, F.floor(part * DAY_MS + 0.5)))


def _day_start(ts: Column) -> Column:
    return to_ms(ts) - F.pmod(to_ms(ts), F.lit(DAY_MS))


def _move(side: str, **columns) -> list[Column]:
    full = {"side": F.lit(side), "account": F.lit(""), "party": F.lit(""), "ref": F.lit(""), "detail": F.lit(""), "doc": F.lit(""), "cbu": F.lit(""), "no_time": F.lit(False), "shift": F.lit("")} | columns
    full["amount"] = round2(F.abs(full["amount"]))
    return [full[c].alias(c) for c in COLUMNS]


@dataclass(frozen=True)
class Format:
    key: str
    side: str
    score: int
    names: dict
    project: Callable[[dict[str, int]], tuple[Column, list[Column]]]
    anchor: str | None = None
    exact: tuple[str, ...] = ()
    most_cells: int | None = None  # filled cells of the header at most
    lookup: bool = False
    #: a column whose presence makes the format certain (score 100)
    certain: str | None = None
    #: rows that count as skipped if they can't be read; None: all
    meant: Callable | None = None

    def points(self, columns: dict[str, int]) -> int:
        return 100 if self.certain and columns.get(self.certain, -1) >= 0 else self.score

    def find(self, rows: list[list[str]]):
        found = find_header(rows, self.names, anchor=self.anchor)
        if found and any(plain(rows[found[0]][found[1][c]]) != c for c in self.exact):
            return None
        if found and self.most_cells and sum(plain(c) != "" for c in rows[found[0]]) > self.most_cells:
            return None
        return found


def _by_word(op: Column) -> Column:
    return F.when(norm(op).startswith("retiro"), "PAYOUT").when(norm(op).startswith("bon"), "BONUS").otherwise("COLLECT")


def player(by: Column, source: Column, target: Column) -> Column:
    """Of the two ends of an operation the one that did not begin it."""
    other = lambda x: (x != "") & (norm(x) != norm(by))
    return F.when(other(target), target).when(other(source), source).otherwise(target)


def _two_row_panel(c):
    kind, amount, ts = norm(_cell(c["kind"])), _amount(c["amount"]), _time(_cell(c["date"]))
    word = F.when(F.contains(kind, F.lit("bonus")) | F.contains(kind, F.lit("bono")), "BONUS").when(F.contains(kind, F.lit("withdraw")), "PAYOUT").when(F.contains(kind, F.lit("deposit")), "COLLECT").when(amount >= 0, "COLLECT").otherwise("PAYOUT")
    ok = (norm(_cell(c["owner"])) == "player") & amount.isNotNull() & ts.isNotNull()
    return ok, _move("panel", origin=F.lit("TWO_ROW"), account=clean_text(_cell(c["agent"])), party=clean_text(_cell(c["name"])), ts=ts, type=word, amount=amount, ref=clean_text(_cell(c["ref"])), detail=clean_text(_cell(c["note"])))


def _from_to_panel(c):
    op, ts, amount = clean_text(_cell(c["op"])), _time(_cell(c["date"])), _amount(c["amount"])
    by, source, target = (clean_text(_cell(c[x])) for x in ("by", "de", "a"))
    party = player(by, source, target)
    ok = op.rlike(OPERATION) & ts.isNotNull() & (F.coalesce(amount, F.lit(0.0)) != 0)
    return ok, _move("panel", origin=F.lit("FROM_TO"), account=by, party=party, ts=ts, type=_by_word(op), amount=amount, ref=clean_text(_cell(c["id"])), detail=op)


def _flat_panel(c):
    day, clock, amount = _time(_cell(c["day"])), _clock(_cell(c["hour"])), _amount(c["amount"])
    op, agent = norm(_cell(c["op"])), clean_text(_cell(c["agent"]))
    kind = F.when(op.startswith("bon"), "BONUS").when((op == "pago") | op.startswith("retiro") | (amount < 0), "PAYOUT").otherwise("COLLECT")
    ts = from_ms(_day_start(day) + F.coalesce(clock, F.lit(0)))
    return day.isNotNull() & amount.isNotNull(), _move("panel", origin=F.when(agent.rlike("(?i) ZEUS$"), "ZEUS").otherwise("PANEL"), account=F.regexp_replace(agent, "(?i) ZEUS$", ""), party=clean_text(_cell(c["name"])), ts=ts, type=kind, amount=amount)


def _anchored_wallet(c):
    amount, ts, state = _amount(c["amount"]), _time(_cell(c["date"])), F.coalesce(norm(_cell(c["state"])), F.lit(""))
    back, inward = state.startswith("revert"), norm(_cell(c["way"])).startswith("entr")
    concept, channel = clean_text(_cell(c["concept"])), norm(_cell(c["channel"]))
    kind = F.when(back, "REVERSED").when(norm(concept) == "fee", "FEE").when(channel == "interno", "INTERNAL").when(inward, "COLLECT").otherwise("PAYOUT")
    either = lambda a, b: F.when(inward, _cell(c[a])).otherwise(_cell(c[b]))
    ok = amount.isNotNull() & ts.isNotNull() & ((state == "") | back | state.isin("hecha", "aprobada"))
    detail = F.trim(F.concat_ws(" ", concept, F.when(channel == "interno", "Interno")))
    return ok, _move("wallet", origin=F.lit("CASH"), account=clean_text(_cell(c["account"])), party=clean_text(either("sender", "receiver")), doc=doc_of(either("sender_doc", "receiver_doc")), cbu=cbu_of(either("sender_cbu", "receiver_cbu")), ts=ts, type=kind, amount=amount, ref=clean_text(_cell(c["idinterno"])), detail=detail)


def _market_wallet(c):
    amount, op = _amount(c["value"]), clean_text(_cell(c["op"]))
    ts = F.coalesce(_time(_cell(c["approved"])), _time(_cell(c["created"])))
    ok = (F.coalesce(amount, F.lit(0.0)) != 0) & ts.isNotNull() & ~op.rlike("(?i)rechaz|cancel|pendiente")
    return ok, _move("wallet", origin=F.lit("MARKET"), account=clean_text(_cell(c["account"])), party=clean_text(_cell(c["payer"])), doc=doc_of(_cell(c["payer_doc"])), ts=ts, type=F.when(amount > 0, "COLLECT").otherwise("PAYOUT"), amount=amount, ref=clean_text(_cell(c["iddeoperacionenmercadopago"])), detail=op)


def _holders(c):
    ref, holder = clean_text(_cell(c["id"])), clean_text(_cell(c["holder"]))
    return (ref != "") & (holder != ""), [ref.alias("ref"), holder.alias("holder")]


def _captures(c):
    day, amount, clock = _time(_cell(c["fecha"])), _amount(c["monto"]), _clock(_cell(c["hora"]))
    name = clean_text(_cell(c["titular"]))
    ts = from_ms(_day_start(day) + F.coalesce(clock, F.lit(DAY_MS // 2)))
    kind = F.when(norm(_cell(c["operacion"])).startswith("cobro"), "COLLECT").otherwise("PAYOUT")
    return day.isNotNull() & (F.coalesce(amount, F.lit(0.0)) != 0), _move("wallet", origin=F.lit("CAPTURE"), account=clean_text(_cell(c["cuenta"])), party=F.trim(F.regexp_replace(name, r"(\.\.\.|…)$", "")), ts=ts, no_time=clock.isNull(), type=kind, amount=amount, detail=clean_text(_cell(c["leyenda"])), shift=F.when(clock.isNull(), clean_text(_cell(c["turno"]))).otherwise(""), ref=clean_text(_cell(c["referencia"])))


def _branches(c):
    amount, ts, kind = _amount(c["amount"]), _time(_cell(c["date"])), F.coalesce(norm(_cell(c["kind"])), F.lit(""))
    account = F.array_join(F.filter(F.array(clean_text(_cell(c["branch"])), clean_text(_cell(c["till"]))), lambda x: x != ""), " · ")
    ok = (F.coalesce(amount, F.lit(0.0)) != 0) & ts.isNotNull() & kind.rlike("^(ingreso|egreso)")
    return ok, _move("wallet", origin=F.lit("BRANCH"), account=account, doc=doc_of(_cell(c["tax"])), cbu=cbu_of(_cell(c["target"])), ts=ts, type=F.when(kind.startswith("ingreso"), "COLLECT").otherwise("PAYOUT"), amount=amount, detail=clean_text(_cell(c["text"])))


#: The formats' header names.
FORMATS = (
    Format("TWO_ROW_PANEL", "panel", 100, {"kind": "transactiontype", "owner": "ownertype", "name": "ownername", "amount": "amount", "date": "date", "?agent": "username", "?ref": "transactionid", "?note": "notes"}, _two_row_panel, meant=lambda c: norm(_cell(c["owner"])) == "player"),
    Format("FROM_TO_PANEL", "panel", 97, {"date": "fecha", "op": "operacion", "by": "iniciador", "de": "de", "a": "a", "amount": "monto", "?id": "id"}, _from_to_panel, exact=("de", "a")),
    Format("ANCHORED_WALLET", "wallet", 100, {"amount": "monto", "way": "direccion", "date": "fecha", "?account": "cuenta", "?channel": "canal", "?state": "estado", "?concept": "concepto", "?sender": "nombreremitente", "?receiver": "nombredestinatario", "?sender_doc": "cuitremitente", "?receiver_doc": "cuitdestinatario", "?sender_cbu": "cburemitente", "?receiver_cbu": "cbudestinatario"}, _anchored_wallet, anchor="idinterno"),
    Format("MARKET_WALLET", "wallet", 100, {"op": "tipodeoperacion", "value": ["valordelacompra", "montonetodelaoperacion"], "?approved": "fechadeaprobacion", "?created": "fechadeorigen", "?account": "codigodelacuentadelvendedor", "?payer": "pagador", "?payer_doc": "numerodeidentificaciondelpagador"}, _market_wallet, anchor="iddeoperacionenmercadopago"),
    Format("HOLDERS", "wallet", 100, {"id": "numeroderetiro", "holder": "nombredeltitular"}, _holders, lookup=True),
    Format("CAPTURES", "wallet", 100, {"fecha": "fecha", "titular": "titular", "operacion": "operacion", "monto": "monto", "?cuenta": "cuenta", "?imagen": "imagen", "?leyenda": "leyenda", "?hora": "hora", "?turno": "turno", "?referencia": "referencia"}, _captures, anchor="origencapturadepantalla"),
    Format("BRANCHES", "wallet", 90, {"branch": "sucursal", "date": "fecha", "kind": "tipo", "amount": "importe", "?till": "caja", "?text": "descripcion", "?target": "destino", "?tax": "cuit"}, _branches, certain="target"),
    Format("FLAT_PANEL", "panel", 70, {"day": "dia", "hour": "hora", "op": "operacion", "agent": "agente", "name": "nombre", "amount": "monto"}, _flat_panel, most_cells=8),
)


@dataclass(frozen=True)
class Imported:
    format: str
    records: DataFrame
    lookup: DataFrame | None = None
    skipped: int = 0
    columns: dict = field(default_factory=dict)


def import_source(cells: DataFrame, only: str | None = None) -> Imported | None:
    """Detect one source's format and project its rows; None if no format yields a row.

    Formats are tried by falling score (or ``only`` the named one). Records have the movement columns
    and ``source``; a lookup format gives (ref, holder) instead.
    """
    rows = head(cells)
    for f in sorted((f for f in FORMATS if only in (None, f.key)), key=lambda f: -f.score):
        found = f.find(rows)
        if not found:
            continue
        at, columns = found
        ok, projected = f.project(columns)
        body = cells.filter(F.col("row_no") > at)
        kept = body.filter(F.coalesce(ok, F.lit(False)))
        n, total = kept.count(), body.count()
        if not n:
            continue
        out = kept.select(*projected, F.col("source_id").alias("source"), F.col("row_no").alias("load_seq"))
        return Imported(f.key, out.limit(0) if f.lookup else out, out if f.lookup else None, total - n, columns)
    return None


@dataclass(frozen=True)
class Mapping:
    """Columns of an unknown format, as the user chose them."""

    side: str
    date: int
    amount: int
    header_row: int = 0
    hour: int | None = None
    kind: int | None = None
    party: int | None = None
    account: int | None = None
    ref: int | None = None
    origin: str = ""
    collect_if: str = ""


def signature(row: list[str]) -> str:
    """A header row as the key of a saved mapping."""
    return "|".join(plain(c) for c in row)


def saved_mapping(cells: DataFrame, saved: dict[str, Mapping], most: int = 5) -> Mapping | None:
    """The mapping saved for one of the source's first rows; it goes before detection."""
    for at, row in enumerate(head(cells, most)):
        if any(row) and (m := saved.get(signature(row))):
            return replace(m, header_row=at)
    return None


def column_letter(i: int) -> str:
    """A column's name: A to Z, AA and so on."""
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def import_mapped(cells: DataFrame, m: Mapping) -> DataFrame:
    """Rows of a source by a user's mapping; rows without a time or with a zero amount are left out."""
    ts, clock, amount, word = _time(_cell(m.date)), _clock(_cell(m.hour)), _amount(m.amount), F.coalesce(norm(_cell(m.kind)), F.lit(""))
    sign = F.when(amount >= 0, "COLLECT").otherwise("PAYOUT")
    if m.collect_if:
        named = F.when(F.contains(word, F.lit(plain(m.collect_if))), "COLLECT").otherwise("PAYOUT")
    else:
        named = F.when(word.rlike(IN_WORDS), "COLLECT").when(word.rlike(OUT_WORDS), "PAYOUT").otherwise(sign)
    kind = F.when(word == "", sign).when(F.contains(word, F.lit("bon")), "BONUS").otherwise(named)
    when = F.when(clock.isNotNull(), from_ms(_day_start(ts) + clock)).otherwise(ts)
    kept = cells.filter((F.col("row_no") > m.header_row) & ts.isNotNull() & (F.coalesce(amount, F.lit(0.0)) != 0))
    moved = _move(m.side, origin=F.lit(m.origin or m.side.upper()), account=clean_text(_cell(m.account)), party=clean_text(_cell(m.party)), ts=when, type=kind, amount=amount, ref=clean_text(_cell(m.ref)))
    return kept.select(*moved, F.col("source_id").alias("source"), F.col("row_no").alias("load_seq"))


def fill_holders(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """Empty parties are filled from (ref, holder); of several holders of one reference the last loaded (``load_seq``, if there is one) counts."""
    last = F.struct("load_seq", "holder") if "load_seq" in lookup.columns else F.struct("holder")
    one = lookup.groupBy("ref").agg(F.max(last)["holder"].alias("__holder"))
    full = records.join(one, "ref", "left")
    return full.withColumn("party", F.when(F.coalesce("party", F.lit("")) == "", F.coalesce("__holder", F.lit(""))).otherwise(F.col("party"))).drop("__holder")
