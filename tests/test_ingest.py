"""Sources, dispositions, identities and incremental import."""

import hashlib
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import components
from ledgerloom.operators import ingest as I
from ledgerloom.operators import statements as S
from ledgerloom.operators.components import connected_components
from ledgerloom.sources import positioned, workbook
from ledgerloom.streaming import incremental


def book(path, rows, macro=False):
    cell = lambda c, r, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = "".join(f'<row r="{r}">' + "".join(cell(c, r, v) for c, v in enumerate(vs) if v) + "</row>" for r, vs in rows)
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Lançamentos" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
        if macro:
            z.writestr("xl/vbaProject.bin", "x")


def test_workbooks(spark, tmp_path):
    book(tmp_path / "a.xlsx", [(1, ["Itaú"]), (3, ["data", "lançamento", "", "valor (R$)"]), (4, ["05/01/2026", "IOF", "", "-1,50"])])
    book(tmp_path / "b.xlsx", [(1, ["x"])], macro=True)
    (tmp_path / "c.xlsx").write_bytes(b"no zip")
    cells = workbook.read_workbooks(spark, str(tmp_path))
    found = {(r.file.rsplit("/", 1)[1], r.row_no): (r.cells, r.error) for r in cells.collect()}
    assert found["a.xlsx", 2] == ([], None) and found["a.xlsx", 4] == (["05/01/2026", "IOF", "", "-1,50"], None)
    assert found["b.xlsx", None] == (None, "MACRO_NOT_ALLOWED") and found["c.xlsx", None] == (None, "CORRUPTED_FILE")
    (layout,) = [r for r in I.layout_score(cells.where("error is null")).collect()]
    assert abs(layout.score - 0.9) < 1e-9 and layout.supported
    files = spark.read.format("binaryFile").load(str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[1]: (r.detected_type, r.error) for r in I.validated_files(files).collect()}
    assert kinds["a.xlsx"] == ("xlsx", None) and kinds["c.xlsx"] == ("unknown", "INVALID_MIME_TYPE")


def test_positioned_text(spark):
    items = [("f", 1, 60.0, 700.0, "05/01/2026"), ("f", 1, 80.0, 699.2, "PIX"), ("f", 1, 120.0, 700.4, "TRANSF"), ("f", 1, 410.0, 700.0, "-"), ("f", 1, 420.0, 700.0, "1,50"), ("f", 1, 60.0, 690.0, "06/01/2026"), ("f", 1, 510.0, 690.0, "9,00")]
    lines = positioned.statement_lines(spark.createDataFrame(items, "file string, page int, x double, y double, text string")).orderBy("line_no").collect()
    assert [(r.raw_date, r.raw_description, r.raw_amount, r.raw_balance) for r in lines] == [("05/01/2026", "PIX TRANSF", "-1,50", ""), ("06/01/2026", "", "", "9,00")]


def lines(spark, rows):
    return spark.createDataFrame([("f", i, "c", "a", d, t, v) for i, (d, t, v) in enumerate(rows, 1)], incremental.LINE_SCHEMA)


def test_dispositions(spark):
    rows = [("05/01/2026", "IOF", "-1,50"), ("05/01/2026", "SALDO ANTERIOR", "1,00"), ("31/02/2026", "x", "1,00"), ("", "no date", "1,00"), ("06/01/2026", "y", "abc"), ("", "Lançamentos futuros", ""), ("07/01/2026", "z", "1,00"), ("", "Posição consolidada", ""), ("08/01/2026", "w", "1,00")]
    assert [(r.row_no, r.disposition) for r in I.dispositions(lines(spark, rows)).orderBy("row_no").collect()] == [(1, "candidate"), (2, "ignored"), (3, "invalid"), (5, "invalid"), (7, "future")]
    paged = I.dispositions(lines(spark, rows), stops_at_summary=False).orderBy("row_no").collect()
    assert (paged[-1].row_no, paged[-1].disposition) == (9, "ignored")


def test_counterparties(spark):
    texts = {"DA COPEL 0000001778170": ("COPEL", "0000001778170", "direct-debit-v1"), "CREDIARIO ITAU 73955": ("ITAU", "73955", "crediario-itau-v1"), "PIX TRANSF ACME CLOUD 10/01": ("ACME CLOUD", None, "pix-transf-v1"), "PIX TRANSF 123 10/01": (None, None, "pix-transf-v1"), "compra": (None, None, None), "DEB AUTOR 12345 SOLAR": ("SOLAR", "12345", "authorized-debit-v1")}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in I.with_counterparty(frame, "t").collect():
        assert (r.counterparty_name, r.document_number, r.counterparty_rule) == texts[r.t]


def test_import_is_idempotent(spark, tmp_path):
    rows = [("05/01/2026", "IOF", "-1,50"), ("05/01/2026", "IOF", "-1,50"), ("06/01/2026", "SISPAG X", "2,00")]
    (tmp_path / "in").mkdir()
    lines(spark, rows).write.parquet(str(tmp_path / "in" / "1"))
    lines(spark, rows).withColumn("file", F.lit("g")).write.parquet(str(tmp_path / "in" / "2"))
    for turn in ("one", "two"):
        incremental.stream_statements(spark, str(tmp_path / "in" / "*"), str(tmp_path / "ledger"), str(tmp_path / f"check-{turn}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 3


@pytest.mark.parametrize("few", [components.FEW_EDGES, 0])
def test_components_of_a_long_path_and_a_star(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)  # with and without a look for hubs
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(5, 5), (201, 200), (200, 201)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert set(found[i] for i in range(41)) == {0} and set(found[i] for i in range(100, 140)) == {100} and found[200] == found[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_identities_by_hand(spark):
    rows = spark.createDataFrame([("f", 1, "company-1", "acct-é", "05/01/2026", "da  copel 17781a", "-1,50"), ("f", 2, "company-1", "acct-é", "05/01/2026", "DA COPEL 17781A", "-1,50")], incremental.LINE_SCHEMA)
    first, second = I.canonical(rows).orderBy("row_no").collect()
    base = (
        "17:externalIdVersion7:hash-v1" "4:bank4:itau" "9:companyId9:company-1" "13:bankAccountId6:acct-é" "4:date10:2026-01-05" "16:amountMinorUnits4:-150"
        "21:normalizedDescription15:DA COPEL 17781A" "17:documentComponent6:17781A"
    )
    assert first.base_key == second.base_key == base and (first.occurrence, second.occurrence) == (1, 2)
    for row, n in ((first, 1), (second, 2)):
        assert row.external_id == "hash-v1:" + hashlib.sha256(f"4:base{len(base)}:{base}15:occurrenceIndex1:{n}".encode()).hexdigest()
    none = F.lit(None).cast("string")
    made = spark.range(1).select(I.fingerprint(F.lit("pdf"), F.lit("f"), F.lit(7), F.lit(2), F.lit("05/01/2026"), F.lit("😀"), none).alias("x")).first().x
    plain = "6:source3:pdf12:sourceFileId1:f15:sourceRowNumber1:710:pageNumber1:27:rawDate10:05/01/202614:rawDescription2:😀9:rawAmount0:"
    assert made == hashlib.sha256(plain.encode()).hexdigest()


def test_codes_of_broken_rows(spark):
    rows = [("f", 1, "", " ", None, 0.0, " ", "income", "x"), ("f", 2, "c", "a", date(2026, 1, 1), -1.0, "t", "income", "hash-v1:x"), ("f", 3, "c", "a", date(2026, 1, 1), None, "t", None, "hash-v1:x"), ("f", 4, "c", "a", date(2026, 1, 1), 1.0, "t", None, "hash-v1:x")]
    frame = spark.createDataFrame(rows, "file string, row_no int, company_id string, bank_account_id string, date date, amount double, description string, type string, external_id string")
    found = {(r.row_no, r.code) for r in I.row_issues(frame).collect()}
    assert found == {(1, c) for c in ("MISSING_COMPANY_ID", "MISSING_BANK_ACCOUNT_ID", "INVALID_DATE", "ZERO_AMOUNT", "MISSING_DESCRIPTION", "INVALID_EXTERNAL_ID")} | {(2, "INVALID_TRANSACTION_TYPE"), (3, "INVALID_AMOUNT"), (4, "INVALID_TRANSACTION_TYPE")}


def test_workbook_to_ledger_rows(spark):
    head = ["Data", "Lançamento", "ag./origem", "Valor (R$)", "Saldo (R$)"]
    sheets = {
        "good": [("Lançamentos", [["Itaú Empresas"], ["Nome:", " ACME  LTDA"], ["Agência:", "0123"], ["Conta:", "45-6"], head, ["05/01/2026", "SALDO ANTERIOR", "", "", "10,00"], ["05/01/2026", "DA COPEL 17781", "", "-1,50", "x"], [],
                 ["06/01/2026", "IOF", "", "0,00", ""], ["07/01/2026", "SISPAG X", "futuro", "3,00", ""], ["08/01/2026", "SISPAG Y", "", "", ""], ["09/01/2026", "SISPAG Z", "", "2,00", "12,00"], ["Lançamentos futuros"], ["10/01/2026", "SISPAG W", "", "5,00", ""],
                 ["Posição consolidada"], ["11/01/2026", "SISPAG V", "", "6,00", ""]])],
        "other-sheet": [("Resumo", [["Itaú"]]), ("Dados", [["x"], head[:2] + head[3:], ["05/01/2026", "IOF", "-1,00", "4,00"]]), ("Posição consolidada", [["y"]])],
        "no-amount": [("Lançamentos", [["Itaú"], ["Data Valor", "Lançamento"], ["05/01/2026", "IOF"]])],
        "strange": [("A", [["hello"]])],
        "late": [("Dados", [[]] * 31 + [head, ["05/01/2026", "IOF", "", "-1,00"]])],
    }
    rows = [(f, i, name, n, c, None) for f, pages in sheets.items() for i, (name, lines) in enumerate(pages) for n, c in enumerate(lines, 1)] + [("bad", None, None, None, None, "CORRUPTED_FILE")]
    cells = spark.createDataFrame(rows, "file string, sheet_no int, sheet string, row_no int, cells array<string>, error string")
    errors = {r.file: r.error for r in S.file_errors(cells).collect()}
    assert errors == {"good": None, "other-sheet": None, "no-amount": "HEADER_NOT_FOUND", "strange": "BANK_NOT_DETECTED", "late": "BANK_NOT_DETECTED", "bad": "CORRUPTED_FILE"}
    lines = S.statement_lines(S.statement_rows(cells)).cache()
    good = {r.row_no: (r.disposition, r.reason) for r in lines.where("file = 'good'").collect()}
    assert good == {6: ("ignored", "IGNORED_BALANCE_ROW"), 7: ("candidate", None), 9: ("invalid", "ZERO_AMOUNT"), 10: ("future", "FUTURE_TRANSACTION_SKIPPED"), 11: ("invalid", "INVALID_AMOUNT"), 12: ("candidate", None), 14: ("future", "FUTURE_TRANSACTION_SKIPPED")}
    (other,) = lines.where("file = 'other-sheet'").collect()
    assert (other.raw_amount, other.raw_balance, other.raw_origin, other.disposition) == ("-1,00", "4,00", None, "candidate")
    told = {r.file: (r.holder_name, r.agency, r.account_number) for r in S.workbook_metadata(cells).collect()}
    assert told.pop("good") == ("ACME LTDA", "0123", "45-6") and set(told.values()) == {(None, None, None)}
    owned = lines.where("disposition = 'candidate'").withColumns({"company_id": F.lit("c"), "bank_account_id": F.lit("a")})
    known = I.first_of_each(I.canonical(owned))
    found = S.issues(lines, known)
    codes = sorted((r.file, r.row_no or 0, r.code) for r in found.collect())
    assert codes == [("good", 0, "FUTURE_TRANSACTION_SKIPPED"), ("good", 0, "STATEMENT_PERIOD_DERIVED"), ("good", 7, "INVALID_BALANCE"), ("good", 9, "ZERO_AMOUNT"), ("good", 11, "INVALID_AMOUNT"), ("other-sheet", 0, "STATEMENT_PERIOD_DERIVED")]
    report = I.import_report(lines, known)
    whole = {r.file: r for r in S.envelope(S.file_errors(cells), report, found, S.workbook_metadata(cells)).collect()}
    assert (whole["good"].total_rows, whole["good"].ignored_rows, whole["good"].invalid_rows, whole["good"].imported_rows, whole["good"].status) == (7, 3, 2, 2, "partial_success")
    assert [c.code for c in whole["good"].errors] == ["ZERO_AMOUNT", "INVALID_AMOUNT"] and whole["bad"].total_rows is None and whole["good"].holder_name == "ACME LTDA"


def test_metadata_of_pages(spark):
    rows = [("f", 1, "ACME LTDA  CPF: 1"), ("f", 2, "Agência: 0123-4 Conta: 99-1"), ("f", 3, "Período de visualização: de 01/01/2026 até 31/01/2026"), ("g", 1, "x")]
    found = {r.file: r for r in S.text_metadata(spark.createDataFrame(rows, "file string, line_no int, text string")).collect()}
    f = found["f"]
    assert (f.holder_name, f.agency, f.account_number, str(f.period_start), str(f.period_end)) == ("ACME LTDA", "0123-4", "99-1", "2026-01-01", "2026-01-31") and found["g"].agency is None
