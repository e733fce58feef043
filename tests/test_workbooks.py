"""Sheets read by ranges of their bytes."""

from __future__ import annotations

import zipfile

import pytest
from wareflow.sources import tables

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
MORE = 'xmlns:x14ac="http://schemas.microsoft.com/office/spreadsheetml/2009/9/ac"'


def book(path, rows, strings=(), prefix="", tail="<rowBreaks count='1'/><mergeCells/>"):
    p = f"{prefix}:" if prefix else ""
    ns = NS.replace("xmlns=", f"xmlns:{prefix}=") if prefix else NS
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><{p}worksheet {ns} {MORE}><{p}cols/><{p}sheetData>' + "".join(rows) + f"</{p}sheetData>{tail if not p else ''}</{p}worksheet>")


def read(spark, path, columns, **options):
    tables.register(spark)
    return spark.read.format("xlsx").schema(", ".join(f"{c} string" for c in columns)).options(path=str(path), **options).load()


@pytest.mark.parametrize("size", [200, 777, 5_000, 1 << 24])
def test_every_row_is_read_once_whatever_the_ranges(spark, tmp_path, size):
    rows = ['<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>']
    wanted = []
    for k in range(2, 400):
        if k % 13 == 0:
            rows.append(f'<row r="{k}" x14ac:dyDescent="0.25"/>')
            wanted.append((None, None, None))
        else:
            text = "x &lt;row&gt; " * (k % 7)
            rows.append(f'<row r="{k}" x14ac:dyDescent="0.25"><c r="A{k}"><v>{k}</v></c><c r="B{k}" t="s"><v>{k}</v></c><c r="C{k}" t="inlineStr"><is><t>{text}</t></is></c></row>')
            wanted.append((str(k), f"s{k}", "x <row> " * (k % 7)))
    book(tmp_path / "x.xlsx", rows, [f"<t>s{k}</t>" for k in range(400)])
    got = read(spark, tmp_path / "x.xlsx", "abc", bytesPerTask=str(size))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)
    assert got.rdd.getNumPartitions() > 10 or size >= 5_000


def test_rows_longer_than_ranges_and_blocks(spark, tmp_path):
    rows = [f'<row><c t="inlineStr"><is><t>{c * 1_500_000}</t></is></c></row>' for c in "hab"] + ["<row><c><v>1</v></c></row>"]
    book(tmp_path / "x.xlsx", rows)
    got = read(spark, tmp_path / "x.xlsx", "a", bytesPerTask="400000").collect()
    assert sorted((len(r.a), r.a[0]) for r in got) == [(1, "1"), (1_500_000, "a"), (1_500_000, "b")]


def test_prefixes_rich_texts_and_sheets_without_rows(spark, tmp_path):
    row = '<x:row><x:c r="B1" t="s"><x:v>1</x:v></x:c><x:c r="AA1"><x:v>7</x:v></x:c></x:row>'
    book(tmp_path / "p.xlsx", [row], ["<t>no</t>", "<r><t>a</t></r><r><t> b</t></r><rPh><t>sound</t></rPh>"], prefix="x")
    assert [tuple(r) for r in read(spark, tmp_path / "p.xlsx", ("a", "b", "c"), header="false").collect()] == [(None, "a b", None)]
    book(tmp_path / "e.xlsx", [])
    assert read(spark, tmp_path / "e.xlsx", "a").count() == 0
    book(tmp_path / "h.xlsx", ["<row><c><v>1</v></c></row>"])
    assert read(spark, tmp_path / "h.xlsx", "a").count() == 0 and read(spark, tmp_path / "h.xlsx", "a", header="false").count() == 1
