"""The report of five pages as a PDF file, drawn with the format's own operators."""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from . import drawings as D
from .drawings import COLOURS
from .report import convergence, html_bars, tier_table, title_rows, top_events, type_shares, volcano_chart, volcano_places

WIDTH, HEIGHT = 792, 612
BLACK, GREY, PALE, WHITE = "#000000", "#999999", "#f2f2f2", "#ffffff"
TOP_COLUMNS = ("module_id", "gene_name", "event_type", "max_abs_delta_psi", "fdr", "confidence_tier")


def _rgb(colour: str) -> str:
    return " ".join(f"{int(colour[k : k + 2], 16) / 255:.3f}" for k in (1, 3, 5))


def _shown(value) -> str:
    return "NA" if value is None else f"{value:.4g}" if isinstance(value, float) else str(value)


class Page:
    """Drawing operators of one page; places are in points from the lower left."""

    def __init__(self):
        self.operators: list[str] = []

    def text(self, x: float, y: float, text, size: float = 10, bold: bool = False, colour: str = BLACK) -> None:
        safe = str(text).replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")
        safe = "".join(c for c in safe if c >= " ")
        self.operators.append(f"BT /F{2 if bold else 1} {size:g} Tf {_rgb(colour)} rg {x:.1f} {y:.1f} Td ({safe}) Tj ET")

    def box(self, x: float, y: float, width: float, height: float, colour: str) -> None:
        self.operators.append(f"{_rgb(colour)} rg {x:.1f} {y:.1f} {width:.1f} {height:.1f} re f")

    def line(self, x1: float, y1: float, x2: float, y2: float, colour: str = BLACK, width: float = 1, dash: str = "[]") -> None:
        self.operators.append(f"{_rgb(colour)} RG {width:g} w 0 J {dash} 0 d {x1:.1f} {y1:.1f} m {x2:.1f} {y2:.1f} l S")

    def dot(self, x: float, y: float, radius: float, colour: str) -> None:
        self.operators.append(f"{_rgb(colour)} RG {2 * radius:g} w 1 J [] 0 d {x:.2f} {y:.2f} m {x:.2f} {y:.2f} l S")

    def title(self, text: str) -> None:
        self.text(60, HEIGHT - 60, text, 18, True)

    def points(self, points: Sequence[tuple[float, float, bool]], x_name: str, y_name: str, level: float) -> None:
        left, right, low, high = 90, WIDTH - 60, 90, HEIGHT - 90
        x_top = max([abs(x) for x, _, _ in points], default=1) or 1
        y_top = max([y for _, y, _ in points] + [level])
        at = lambda x, y: (left + (x / x_top + 1) / 2 * (right - left), low + y / y_top * (high - low))
        self.line(left, low, right, low)
        self.line(left, low, left, high)
        self.line(left, at(0, level)[1], right, at(0, level)[1], GREY, 0.7, "[4]")
        for x in (-x_top, 0, x_top):
            self.text(at(x, 0)[0] - 10, low - 16, f"{x:.3g}")
        for y in (0, y_top):
            self.text(left - 36, at(0, y)[1] - 3, f"{y:.3g}")
        self.text((left + right) / 2 - 50, low - 36, x_name)
        self.text(20, high + 12, y_name)
        for x, y, marked in points:
            self.dot(*at(x, y), 2, COLOURS[1] if marked else GREY)

    def bars(self, bars: Sequence[tuple[str, float]], x: float, width: float, heading: str, low: float = 90, high: float = HEIGHT - 120) -> None:
        """Bars that lie one under the other, thinner the more there are, so that all are shown."""
        self.text(x, high + 12, heading, 12, True)
        step = min(30.0, (high - low) / max(1, len(bars)))
        top = max([v for _, v in bars], default=0) or 1
        for k, (name, value) in enumerate(bars):
            y = high - step * (k + 1)
            self.text(x, y + step * 0.3, name, min(10.0, step * 0.8))
            self.box(x + 110, y + step * 0.15, (width - 160) * value / top, step * 0.7, COLOURS[0])
            self.text(x + 114 + (width - 160) * value / top, y + step * 0.3, f"{value:g}", min(10.0, step * 0.8))

    def table(self, columns: Sequence[str], rows: Sequence[Sequence[str]], places: Sequence[float], y: float = HEIGHT - 100) -> None:
        self.box(40, y - 5, WIDTH - 80, 18, "#8b0000")
        for x, c in zip(places, columns):
            self.text(x, y, c, 9, True, WHITE)
        for k, row in enumerate(rows, 1):
            if k % 2:
                self.box(40, y - 18 * k - 5, WIDTH - 80, 18, PALE)
            for x, end, text in zip(places, [*places[1:], WIDTH - 40], row):
                self.text(x, y - 18 * k, text, min(9.0, 1.8 * (end - x) / max(1, len(text))))


def write_pdf(path: str, pages: Sequence[Page]) -> None:
    """A file of pages with the two fonts that every reader has; other characters than theirs become "?"."""
    first = 5
    kids = " ".join(f"{first + 2 * k} 0 R" for k in range(len(pages)))
    font = "<< /Type /Font /Subtype /Type1 /BaseFont /{} /Encoding /WinAnsiEncoding >>"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), font.format("Helvetica").encode(), font.format("Helvetica-Bold").encode()]
    for k, page in enumerate(pages):
        content = zlib.compress("\n".join(page.operators).encode("cp1252", "replace"))
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents {first + 2 * k + 1} 0 R >>".encode())
        objects.append(f"<< /Length {len(content)} /Filter /FlateDecode >>\nstream\n".encode() + content + b"\nendstream")
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    table = f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n" + "".join(f"{p:010d} 00000 n \n" for p in places)
    out += f"{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()
    with open(path, "wb") as f:
        f.write(out)


def pdf_report(path: str, figures: str, diff: DataFrame, diagnosed: DataFrame, samples: Mapping | None = None, parameters: Mapping | None = None, threshold: float = 0.05) -> None:
    """Title, volcano, event types, diagnostics and top events; the charts also as SVG files in `figures`.

    An empty result gives the same pages without points, bars or rows.  What is collected is a
    row a type or tier, the 20 best modules, and the volcano's places on a grid.
    """
    title = Page()
    title.text(60, HEIGHT - 140, "Junction usage report", 28, True)
    y, section = HEIGHT - 200, None
    for r in title_rows(diff.sparkSession, dict(samples or {}), dict(parameters or {})).collect():
        if r.section != section:
            section, y = r.section, y - 26
            title.text(60, y, section, 14, True)
        y -= 15
        title.text(80, y, f"{r.key}: {r.value}")
    scatter = Page()
    scatter.title("Volcano plot")
    scatter.points(volcano_places(diff, threshold=threshold), "difference in usage", "-log10 FDR", -math.log10(threshold))
    shares = type_shares(diff).orderBy("event_type").collect()
    types = Page()
    types.title("Event types")
    types.bars([(str(r.event_type), r.n) for r in shares], 60, 330, "modules")
    types.bars([(str(r.event_type), r.n_significant) for r in shares], 420, 330, f"FDR < {threshold:g}")
    tiers, rates = tier_table(diagnosed), convergence(diagnosed)
    rate = rates.first()
    quality = Page()
    quality.title("Diagnostics")
    quality.bars([(r.confidence_tier, r.n) for r in tiers.collect()], 60, 330, "confidence tiers")
    quality.bars([(name, round(rate[f"{name}_percent"], 1)) for name in ("null", "full", "both")], 420, 330, "fits that converged, percent")
    best = [[_shown(r[c]) for c in TOP_COLUMNS] for r in top_events(diff, diagnosed, 20, threshold).collect()]
    top = Page()
    top.title("Top 20 significant events")
    top.table(TOP_COLUMNS, best, (46, 270, 380, 470, 590, 670))
    write_pdf(path, [title, scatter, types, quality, top])
    os.makedirs(figures, exist_ok=True)
    drawings = {"volcano_plot": volcano_chart(diff, threshold=threshold), "event_types": html_bars(type_shares(diff), "event_type", "n"), "diagnostics": html_bars(tiers, "confidence_tier", "n"), "top_events": D.table(TOP_COLUMNS, best)}
    for name, drawing in drawings.items():
        with open(f"{figures}/{name}.svg", "w") as f:
            f.write(drawing)
