"""Files to cells to movements."""

import io
import zipfile

from ledgerloom.sources.cells import pasted_cells, read_cells, split_rows, tables_of
from ledgerloom.sources.importers import Mapping, fill_holders, import_mapped, import_source


def test_split_rows():
    assert split_rows('﻿a;b;"c;1"\r\n1;2;"x ""y"""\n\n;;\n3') == [["a", "b", "c;1"], ["1", "2", 'x "y"'], ["3"]]
    assert split_rows('"1,2,""z"""\n"3,4,5"') == [["1", "2", "z"], ["3", "4", "5"]]
    assert split_rows("") == []
    assert tables_of("x.csv", "á,b\n".encode("cp1252")) == [("", [["á", "b"]])]


def workbook(rows):
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Preamble\nDIA,HORA,Operacion,agente,NOMBRE,MONTO\n02/03/2026,10:05,Carga,ag ZEUS,ana1,\"1.500,50\"\n02/03/2026,,Retiro,ag,leo,20\nx,,,,,1\n")
    (tmp_path / "b.xlsx").write_bytes(workbook([["ID Interno", "Cuenta", "Monto", "Direccion", "Fecha", "Estado", "Nombre Remitente", "CUIT Remitente"], ["7", "box", "100", "Entrante", "02/03/2026, 10:00:00", "Hecha", "ANA PAZ", "20-30414243-3"], ["8", "box", "5", "Saliente", "02/03/2026, 10:00:00", "Pendiente", "", ""]]))
    cells = read_cells(spark, str(tmp_path))
    by = {p: import_source(cells.filter(cells.source_id.endswith(p))) for p in ("a.csv", "b.xlsx")}
    a = sorted((r.party, r.type, r.amount, str(r.ts), r.origin, r.account) for r in by["a.csv"].records.collect())
    assert by["a.csv"].format == "FLAT_PANEL" and by["a.csv"].skipped == 1
    assert a == [("ana1", "COLLECT", 1500.5, "2026-03-02 10:05:00", "ZEUS", "ag"), ("leo", "PAYOUT", 20.0, "2026-03-02 00:00:00", "PANEL", "ag")]
    (b,) = by["b.xlsx"].records.collect()
    assert (b.party, b.doc, b.ref, b.type, b.amount) == ("ANA PAZ", "30414243", "7", "COLLECT", 100.0)


def test_mapping_and_lookup(spark):
    cells = pasted_cells(spark, "f\th\tm\timp\tc\n2026-03-02\t10:00\tCobro\t50\tana\n2026-03-02\t\tsalida\t7\tleo\n2026-03-02\t\t\t-3\t\n\t\t\t9\t")
    got = import_mapped(cells, Mapping("wallet", date=0, hour=1, kind=2, amount=3, party=4))
    assert [(r.type, r.amount, str(r.ts)) for r in got.orderBy("load_seq").collect()] == [("COLLECT", 50.0, "2026-03-02 10:00:00"), ("PAYOUT", 7.0, "2026-03-02 00:00:00"), ("PAYOUT", 3.0, "2026-03-02 00:00:00")]
    names = import_source(pasted_cells(spark, "Numero de retiro\tNombre del titular\n5\tRUTH PAZ"))
    assert names.format == "HOLDERS" and names.lookup.first().holder == "RUTH PAZ"
    lone = spark.createDataFrame([("5", ""), ("6", "x")], "ref string, party string")
    assert {r.ref: r.party for r in fill_holders(lone, names.lookup).collect()} == {"5": "RUTH PAZ", "6": "x"}
    assert import_source(pasted_cells(spark, "a\tb\n1\t2")) is None
