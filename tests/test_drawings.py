"""The spreadsheet file and the charts, read back as XML."""

import re
import xml.etree.ElementTree as ET
import zipfile
import zlib

import pytest

from junctura.sinks import drawings as D
from junctura.sinks import pdf as P
from junctura.sinks import workbook as W

M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
SVG = "{http://www.w3.org/2000/svg}"


def test_workbook_reads_back(spark, tmp_path):
    rows = [(f"m<{k}>&", k, k / 7, "green" if k < 2 else "", None if k else "x\x01y") for k in range(30)]
    table = spark.createDataFrame(rows, "module_id string, n int, fdr double, fill string, note string")
    W.write_workbook(str(tmp_path / "a.xlsx"), [("Results", table), ("Empty", table.limit(0))])
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        assert z.testzip() is None
        parts = {n: ET.fromstring(z.read(n)) for n in z.namelist()}
    assert [s.get("name") for s in parts["xl/workbook.xml"].iter(f"{M}sheet")] == ["Results", "Empty"]
    got = [[(c.get("s"), c.findtext(f"{M}v") or c.findtext(f"{M}is/{M}t")) for c in r] for r in parts["xl/worksheets/sheet1.xml"].iter(f"{M}row")]
    assert got[0] == [("1", c) for c in ("module_id", "n", "fdr", "note")] and len(got) == 31
    for (k, row) in enumerate(got[1:]):
        style = "2" if k < 2 else None
        assert row == [(style, f"m<{k}>&"), (style, str(k)), (style, repr(k / 7)), (style, None if k else "xy")]
    assert len(list(parts["xl/worksheets/sheet2.xml"].iter(f"{M}row"))) == 1
    assert len(list(parts["xl/styles.xml"].iter(f"{M}cellXfs"))[0]) == 4
    assert [W._column(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_charts_show_every_item():
    chart = ET.fromstring(D.scatter([(0.1, 2, True), (-0.5, 0, False), (float("nan"), 1, True)], "x", "y", [1.3]))
    assert len(chart.findall(f"{SVG}circle")) == 2
    gene = ET.fromstring(D.sashimi("a<b", 0, 100, [(0, 20), (60, 100)], {0: {5: 2.0, 6: 4.0, 50: 1.0}, 1: {}}, {0: [(20, 60, 7, 1.0)], 1: [(20, 60, 3, 0.5), (10, 60, 1, 0.2)]}))
    assert len(gene.findall(f"{SVG}rect")) == 2 and {"7", "3", "1", "a<b"} <= {t.text for t in gene.findall(f"{SVG}text")}
    heat = ET.fromstring(D.heat_map(["own", "x"], {("own", "x"): 0.25}))
    assert [t.text for t in heat.findall(f"{SVG}text")].count("0.25") == 2
    bars = ET.fromstring(D.intersections(["a", "b"], [(["a"], 5), (["a", "b"], 2)]))
    assert len(bars.findall(f"{SVG}rect")) == 2 and sum(c.get("fill") == "black" for c in bars.findall(f"{SVG}circle")) == 3
    assert ET.fromstring(D.scatter([], "x", "y")) is not None


def test_a_sheet_is_not_cut(spark, tmp_path, monkeypatch):
    """What one sheet cannot hold goes on in the next."""
    monkeypatch.setattr(W, "MOST_ROWS", 3)
    W.write_workbook(str(tmp_path / "b.xlsx"), [("A", spark.range(5).coalesce(1))])
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        assert sum(z.read(n).count(b"<v>") for n in z.namelist() if "sheets/" in n) == 5


def _pages(path):
    """Contents of the pages, after the table of places has been followed."""
    data = path.read_bytes()
    start = int(re.search(rb"startxref\n(\d+)\n%%EOF", data)[1])
    assert data.startswith(b"%PDF-1.4\n") and data[start:].startswith(b"xref\n0 ")
    places = [int(p) for p in re.findall(rb"(\d{10}) 00000 n", data[start:])]
    for n, p in enumerate(places, 1):
        assert data[p:].startswith(f"{n} 0 obj\n".encode())
    streams = [(int(m[1]), m.end()) for m in re.finditer(rb"/Length (\d+) /Filter /FlateDecode >>\nstream\n", data)]
    assert len(streams) == int(re.search(rb"/Count (\d+)", data)[1])
    return [zlib.decompress(data[at : at + n]).decode("cp1252") for n, at in streams]


def test_pdf_report_holds_all(spark, tmp_path):
    rows = [(f"m{k:02d}", f"gene({k})", "SE" if k % 3 else "A3SS", [0.4 - k / 50, 0.0], abs(0.4 - k / 50), 10.0 ** -(k % 5), "HIGH" if k % 2 else "FAIL", k % 2 == 0, True) for k in range(40)]
    kinds = "module_id string, gene_name string, event_type string, delta_psi array<double>, max_abs_delta_psi double, fdr double, confidence_tier string, null_converged boolean, full_converged boolean"
    table = spark.createDataFrame(rows, kinds)
    diff, diagnosed = table.drop("confidence_tier", "null_converged", "full_converged"), table.select("module_id", "confidence_tier", "null_converged", "full_converged")
    P.pdf_report(str(tmp_path / "a.pdf"), str(tmp_path / "figures"), diff, diagnosed, {"s1\\": "group 1"}, {"seed": None})
    title, volcano, types, quality, top = _pages(tmp_path / "a.pdf")
    assert "(s1\\\\: group 1)" in title and "(seed: None)" in title
    assert volcano.count(" 1 J ") == len({(round(r[4], 3), r[0] >= "m20", r[5]) for r in rows})
    assert "(A3SS)" in types and "(14)" in types and "(26)" in types
    assert quality.count("(20)") == 2 and "(50)" in quality and "(100)" in quality
    assert len(re.findall(r"\(m\d\d\)", top)) == 20 and r"(gene\(4\))" in top
    assert sorted(f.name for f in (tmp_path / "figures").iterdir()) == ["diagnostics.svg", "event_types.svg", "top_events.svg", "volcano_plot.svg"]
    for f in (tmp_path / "figures").iterdir():
        ET.fromstring(f.read_text())
    P.pdf_report(str(tmp_path / "b.pdf"), str(tmp_path / "none"), diff.limit(0), diagnosed.limit(0))
    assert len(_pages(tmp_path / "b.pdf")) == 5


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_venn_has_every_region(n):
    """Each exclusive intersection has a region of its own, in which its number stands."""
    names = [f"tool{k}" for k in range(n)]
    every = [[t for k, t in enumerate(names) if code >> k & 1] for code in range(1, 1 << n)]
    drawn = ET.fromstring(D.venn(names, [(who, 1000 + i) for i, who in enumerate(every)]))
    texts = [t.text for t in drawn.iter(f"{SVG}text")]
    assert len(list(drawn.iter(f"{SVG}polygon"))) == n
    for i, who in enumerate(every):
        assert str(1000 + i) in texts, who
    for t in names:
        assert f"{t} ({sum(1000 + i for i, who in enumerate(every) if t in who)})" in texts


def test_venn_of_too_many_sets():
    with pytest.raises(ValueError):
        D.venn(list("abcde"), [])


def test_comparison_charts():
    p = ET.fromstring(D.plane([(0.5, -0.2), (float("nan"), 1.0), (-0.1, 0.3)], "a", "b", "r = 1"))
    assert len(list(p.iter(f"{SVG}circle"))) == 2
    assert "no shared events" in D.plane([], "a", "b")
    b = ET.fromstring(D.bars(["x", "y"], {"TPR": [0.5, 2.0], "FDR": [float("nan"), 0.1]}, "x"))
    assert [r.get("height") for r in b.iter(f"{SVG}rect")] == ["90.0", "0.0", "180.0", "18.0"]
    t = ET.fromstring(D.accuracy_plane([("own", 0.04, 0.7), ("other", 0.2, 0.5), ("none", float("nan"), 0.1)], "own"))
    assert [c.get("r") for c in t.iter(f"{SVG}circle")] == ["6", "3"]
