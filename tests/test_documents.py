"""Archives, office files and refusals; locators and what a changed value marks."""

from __future__ import annotations

import io
import json
import zipfile

from ledgerlight.operators import locators
from ledgerlight.sources import documents as D

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def docx(body):
    return zipped(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def xlsx():
    rels = "".join(f'<Relationship Id="r{i}" Target="{t}"/>' for i, t in ((1, "worksheets/a.xml"), (2, "/xl/worksheets/b.xml")))
    return zipped(**{
        "xl/workbook.xml": f'<workbook {S} xmlns:r="{RELS}"><sheets><sheet name="B" r:id="r2"/><sheet name="A" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": f"<Relationships>{rels}</Relationships>",
        "xl/sharedStrings.xml": f"<sst {S}><si><t>Revenue</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>",
        "xl/worksheets/a.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>12.5</v></c></row><row/><row><c t="inlineStr"><is><t>in line</t></is></c></row></sheetData></worksheet>',
        "xl/worksheets/b.xml": f'<worksheet {S}><sheetData><row><c r="B2" t="s"><v>1</v></c></row></sheetData></worksheet>',
    })


def pages(spark, objects, **limits):
    df = spark.createDataFrame([(n, k, c) for n, k, c in objects], "sha256 string, kind string, content binary")
    return {(r.sha256, r.page_no): r.text or r.reason for r in D.pages(df, D.Limits(**limits)).collect()}


def test_pages(spark):
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('1')}{p('2')}</w:tc></w:tr></w:tbl>"
    got = pages(spark, [
        ("doc", "docx", docx(p("first") + table + p(" ") + p("last"))), ("book", "xlsx", xlsx()), ("txt", "txt", "naïve".encode()), ("latin", "txt", "naïve".encode("latin-1")), ("html", "html", b"<p>x &amp; y</p>"),
        ("empty", "docx", docx(p(" "))), ("dtd", "docx", zipped(**{"word/document.xml": "<!DOCTYPE x [<!ENTITY a 'b'>]><x/>"})), ("odd", "zip", zipped(readme="x")), ("cut", "docx", docx(p("x"))[:40]), ("pdf", "pdf", b"%PDF-1"),
        ("bin", "txt", b"a\0b"), ("broken", "docx", zipped(**{"word/document.xml": "<x>"})),
    ])
    assert got == {
        ("doc", 1): "first\nlast\na\t1\n2", ("book", 1): "\ttwo runs", ("book", 2): "Revenue\t\t12.5\nin line", ("txt", 1): "naïve", ("latin", 1): "naïve", ("html", 1): "x & y", ("empty", None): "no_text_layer",
        ("dtd", None): "extract_xml_refused", ("odd", None): "format_unsupported: unknown_zip_container", ("cut", None): "format_unsupported: zip_corrupt", ("pdf", None): "format_unsupported: pdf",
        ("bin", None): "format_unsupported: binary", ("broken", None): "extract_xml_refused",
    }


def test_bombs_are_refused_by_name(spark):
    bomb, many = zipped(**{"word/document.xml": "0" * 3_000_000}), zipped(**{f"m{i}": "" for i in range(30)})
    got = pages(spark, [("bomb", "docx", bomb), ("many", "zip", many), ("slow", "docx", docx(p("x"))), ("rows", "xlsx", xlsx())], bytes=1_000_000, members=20)
    assert got["bomb", None] == "extract_zip_bomb: uncompressed>1000000" and got["many", None] == "extract_zip_bomb: members>20"
    assert pages(spark, [("slow", "docx", docx(p("x")))], seconds=-1)["slow", None] == "extract_timeout"
    assert pages(spark, [("rows", "xlsx", xlsx())], rows=1)["rows", None] == "extract_too_many_rows"
    # a directory that declares less than a member holds
    small = bytearray(zipped(a="0" * 5000))
    at = small.rfind(b"PK\x01\x02")
    small[at + 24 : at + 28] = (10).to_bytes(4, "little")
    df = spark.createDataFrame([("lies", "zip", bytes(small)), ("good", "zip", zipped(**{"d/a.csv": "x;y", "b.csv": ""}))], "sha256 string, kind string, content binary")
    got = {(r.sha256, r.member): (r.content and bytes(r.content), r.reason) for r in D.members(df).collect()}
    assert got["good", "d/a.csv"] == (b"x;y", None) and got["good", "b.csv"] == (b"", None) and got["lies", "a"][0] is None and got["lies", "a"][1]


def test_locators(spark):
    doc = {"a/b": {"m~n": [{"val": 5}, {"val": "6.50"}]}, "0": {"1": "named"}, "facts": {"f/1": {"value": 9}}, "tables": [{"rows": [{"cells": [{"value": "7"}]}]}], "q's": 1}
    objects = spark.createDataFrame([("j", json.dumps(doc)), ("t", "<p>costs 1,250 in 2024, 1,300.5 later</p>"), ("bad", "{")], "sha256 string, content string")
    loc = lambda kind, sha, pointer=None, fact=None, snippet=None: (kind, sha, pointer, fact, 0, 0, 0, snippet)
    rows = [
        (1, "5", loc("api", "j", "/a~1b/m~0n/0/val")), (2, "6.5", loc("api", "j", "/a~1b/m~0n/1/val")), (3, "named", loc("api", "j", "/0/1")), (4, "9", loc("xbrl", "j", fact="f/1")), (5, "7", loc("table", "j")),
        (6, "1", loc("api", "j", "/q's")), (7, "x", loc("api", "j", "/none")), (8, "x", loc("api", "gone", "/a")), (9, "x", loc("api", "bad", "/a")), (10, "x", loc("api", "j", "a")), (11, "1300.5", loc("html", "t", snippet="2024, 1,300.5")),
        (12, "1", loc("html", "t", snippet="not there")), (13, "1", None), (14, "1", loc("fax", "j")),
    ]
    facts = spark.createDataFrame(rows, f"fact_id int, value string, locator {locators.LOCATOR}")
    got = {r.fact_id: (r.status, r.actual or r.reason) for r in locators.resolved(facts, objects).collect()}
    assert got == {
        1: ("same", "5"), 2: ("revised", "6.50"), 3: ("same", "named"), 4: ("same", "9"), 5: ("same", "7"), 6: ("same", "1"), 7: ("unresolved", "nothing_there"), 8: ("unresolved", "object_missing"), 9: ("unresolved", "not_json"),
        10: ("unresolved", "bad_pointer"), 11: ("same", "1300.5"), 12: ("unresolved", "snippet_not_found"), 13: ("unresolved", "no_locator"), 14: ("unresolved", "unknown_locator: fax"),
    }


def test_a_verified_fact_wins_and_marks_what_is_made_of_it(spark):
    kind = "fact_id int, issuer int, concept string, value double, origin string, filed string"
    facts = spark.createDataFrame([(1, 1, "cash", 5.0, "filed", "2024-01-01"), (2, 1, "cash", 6.0, "filed", "2024-02-01"), (3, 2, "cash", 1.0, "filed", "2024-01-01")], kind)
    manual = spark.createDataFrame([(4, 1, "cash", 7.0, "manual", "2023-01-01")], kind)
    assert {r.fact_id: r.superseded_by for r in locators.verified(facts, manual, ["issuer", "concept"]).collect()} == {1: 4, 2: 4, 3: None, 4: None}
    line = "issuer int, at string, concept string, kind string, source string, period_start string, period_end string"
    lines = spark.createDataFrame([(1, "d", "net_debt", "fact", "cash", "a", "a"), (1, "d", "ev", "fact", "cash", "a", "a"), (2, "d", "ev", "fact", "cash", "a", "a"), (1, "d", "pe", "fact", "net_income", "a", "b")], line)
    changed = spark.createDataFrame([(1, "cash", "a", "a")], "issuer int, source string, period_start string, period_end string")
    assert sorted(r.concept for r in locators.dependants(changed, lines).collect()) == ["ev", "net_debt"]
