"""Charts as SVG text: volcano, depth and arcs of a gene, heat maps, sets, and comparisons of tools."""

from __future__ import annotations

import html
import math
from collections.abc import Mapping, Sequence

import numpy as np

COLOURS = ("#4682b4", "#b22222", "#2e8b57", "#daa520")
GREY = "#999999"


def _svg(width: float, height: float, body: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height:.0f}" font-family="sans-serif" font-size="11">{body}</svg>'


def _text(x: float, y: float, text: str, anchor: str = "middle", more: str = "") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}"{more}>{html.escape(text)}</text>'


def scatter(points: Sequence[tuple[float, float, bool]], x_name: str, y_name: str, lines: Sequence[float] = (), width: int = 480, height: int = 360) -> str:
    """Points (x, y, marked) with axes; `lines` are levels of y."""
    points = [(x, y, m) for x, y, m in points if math.isfinite(x) and math.isfinite(y)]
    x_top = max([abs(x) for x, _, _ in points], default=1) or 1
    y_top = max([y for _, y, _ in points] + list(lines), default=1) or 1
    at = lambda x, y: (50 + (x / x_top + 1) / 2 * (width - 70), height - 40 - y / y_top * (height - 60))
    body = [f'<path d="M50 20V{height - 40}H{width - 20}" fill="none" stroke="black"/>', _text(width / 2, height - 8, x_name), _text(14, height / 2, y_name, more=f' transform="rotate(-90 14 {height / 2:.0f})"')]
    body += [_text(at(x, 0)[0], height - 26, f"{x:.3g}") for x in (-x_top, 0, x_top)] + [_text(46, at(0, y)[1] + 4, f"{y:.3g}", "end") for y in (0, y_top)]
    body += [f'<path d="M50 {at(0, y)[1]:.1f}H{width - 20}" stroke="{GREY}" stroke-dasharray="4"/>' for y in lines]
    body += [f'<circle cx="{at(x, y)[0]:.1f}" cy="{at(x, y)[1]:.1f}" r="2.5" fill="{COLOURS[1] if m else GREY}"/>' for x, y, m in points]
    return _svg(width, height, "".join(body))


def sashimi(title: str, start: int, end: int, exons: Sequence[tuple[int, int]], depth: Mapping[int, Mapping[int, float]], arcs: Mapping[int, Sequence[tuple[int, int, int, float]]], width: int = 760) -> str:
    """A track for each label: depth by position, and arcs (start, end, count, height from 0 to 1) over it; exons below."""
    at = lambda p: 40 + (p - start) / max(1, end - start) * (width - 60)
    body, y = [_text(width / 2, 16, title)], 30
    top = max([d for track in depth.values() for d in track.values()], default=0) or 1
    for k, label in enumerate(sorted(set(depth) | set(arcs))):
        base, colour = y + 130, COLOURS[k % len(COLOURS)]
        steps, last = [f"M{at(start):.1f} {base}"], None
        for p in sorted(depth.get(label, {})):
            if last is not None and p > last + 1:
                steps.append(f"V{base}H{at(p):.1f}")
            steps.append(f"V{base - 60 * depth[label][p] / top:.1f}H{at(p + 1):.1f}" if last is not None else f"H{at(p):.1f}V{base - 60 * depth[label][p] / top:.1f}H{at(p + 1):.1f}")
            last = p
        body.append(f'<path d="{"".join(steps)}V{base}Z" fill="{colour}" fill-opacity="0.5"/>')
        for a, b, n, h in arcs.get(label, ()):
            peak, mid = base - 70 - 50 * h, (at(a) + at(b)) / 2
            body.append(f'<path d="M{at(a):.1f} {base}Q{mid:.1f} {2 * peak - base:.1f} {at(b):.1f} {base}" fill="none" stroke="{colour}" stroke-width="{1 + 2 * h:.1f}"/>')
            body.append(_text(mid, peak - 2, str(n)))
        body.append(_text(6, base - 30, f"group {label}", "start"))
        y = base + 10
    body.append(f'<path d="M{at(start):.1f} {y + 12}H{at(end):.1f}" stroke="black"/>')
    body += [f'<rect x="{at(a):.1f}" y="{y + 5}" width="{max(1.0, at(b) - at(a)):.1f}" height="14"/>' for a, b in exons]
    return _svg(width, y + 44, "".join([*body, _text(at(start), y + 36, f"{start:,}", "start"), _text(at(end), y + 36, f"{end:,}", "end")]))


def heat_map(names: Sequence[str], values: Mapping[tuple[str, str], float]) -> str:
    """A square of values from 0 to 1."""
    size, left = 56, 110
    body = []
    for i, a in enumerate(names):
        body += [_text(left - 6, 30 + size * (i + 0.5), a, "end"), _text(left + size * (i + 0.5), 22, a)]
        for j, b in enumerate(names):
            v = values.get((a, b), values.get((b, a), 1.0 if a == b else 0.0))
            body.append(f'<rect x="{left + size * j}" y="{30 + size * i}" width="{size}" height="{size}" fill="{COLOURS[0]}" fill-opacity="{v:.3f}" stroke="white"/>' + _text(left + size * (j + 0.5), 34 + size * (i + 0.5), f"{v:.2f}"))
    return _svg(left + size * len(names) + 10, 40 + size * len(names), "".join(body))


def intersections(names: Sequence[str], counts: Sequence[tuple[Sequence[str], int]]) -> str:
    """Bars of the sizes of exclusive intersections over dots that tell whose they are."""
    top, step = max([n for _, n in counts], default=0) or 1, 28
    body = [_text(100, 170 + 18 * i, name, "end") for i, name in enumerate(names)]
    for k, (who, n) in enumerate(counts):
        x = 120 + step * k
        body.append(f'<rect x="{x - 8}" y="{140 - 120 * n / top:.1f}" width="16" height="{120 * n / top:.1f}" fill="{COLOURS[0]}"/>' + _text(x, 136 - 120 * n / top, str(n)))
        body += [f'<circle cx="{x}" cy="{166 + 18 * i}" r="5" fill="{"black" if name in who else "#dddddd"}"/>' for i, name in enumerate(names)]
    return _svg(130 + step * len(counts), 170 + 18 * len(names), "".join(body))


def _inside(k: int, n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points lie in set k of n: circles around a centre, or four ellipses that cross, on a plane from -1 to 1."""
    if n <= 3:
        turn = 2 * math.pi * k / n + (math.pi / 2 if n == 3 else math.pi)
        far = 0.0 if n == 1 else 0.3
        return (x - far * math.cos(turn)) ** 2 + (y + far * math.sin(turn)) ** 2 < 0.5**2
    tilt, dx, dy = (math.pi / 4 if k < 2 else -math.pi / 4), (-0.3, -0.06, 0.06, 0.3)[k], (0.1, -0.12, -0.12, 0.1)[k]
    u, v = (x - dx) * math.cos(tilt) + (y - dy) * math.sin(tilt), (y - dy) * math.cos(tilt) - (x - dx) * math.sin(tilt)
    return (u / 0.68) ** 2 + (v / 0.36) ** 2 < 1


def venn(names: Sequence[str], counts: Sequence[tuple[Sequence[str], int]], size: int = 460) -> str:
    """Up to four sets and the sizes of their exclusive intersections, each written in the middle of its region."""
    if not 1 <= len(names) <= 4:
        raise ValueError("a diagram shows one to four sets; draw intersections() of more")
    n = len(names)
    grid = np.linspace(-1, 1, 201)
    x, y = (v.ravel() for v in np.meshgrid(grid, grid))
    inside = [_inside(k, n, x, y) for k in range(n)]
    at = lambda u, v: (size / 2 + u * size / 2, size / 2 + 24 + v * size / 2)
    body = []
    for k, mask in enumerate(inside):
        shape = mask.reshape(201, 201)
        rows = np.flatnonzero(shape.any(1))
        left, right = [(grid[shape[r].argmax()], grid[r]) for r in rows], [(grid[200 - shape[r, ::-1].argmax()], grid[r]) for r in rows[::-1]]
        edge = " ".join(f"{px:.1f},{py:.1f}" for px, py in (at(u, v) for u, v in left + right))
        body.append(f'<polygon points="{edge}" fill="{COLOURS[k]}" fill-opacity="0.3" stroke="{COLOURS[k]}"/>')
        total = sum(c for who, c in counts if names[k] in who)
        body.append(_text(size * (k + 0.5) / n, 16, f"{names[k]} ({total})", more=f' fill="{COLOURS[k]}" font-weight="bold"'))
    told = {frozenset(who): c for who, c in counts}
    for code in range(1, 1 << n):
        region = np.all([mask if code >> k & 1 else ~mask for k, mask in enumerate(inside)], axis=0)
        if region.any():
            # the point farthest from the region's border, roughly: nearest to the middle of its points
            px, py = x[region], y[region]
            near = int(((px - px.mean()) ** 2 + (py - py.mean()) ** 2).argmin())
            body.append(_text(*at(px[near], py[near]), str(told.get(frozenset(names[k] for k in range(n) if code >> k & 1), 0))))
    return _svg(size, size + 30, "".join(body))


def plane(points: Sequence[tuple[float, float]], x_name: str, y_name: str, note: str = "", size: int = 360) -> str:
    """Points around zero in both directions, with a note in the corner."""
    points = [(x, y) for x, y in points if math.isfinite(x) and math.isfinite(y)]
    top = max([max(abs(x), abs(y)) for x, y in points], default=1) or 1
    at = lambda v: 50 + (v / top + 1) / 2 * (size - 70)
    body = [f'<rect x="50" y="20" width="{size - 70}" height="{size - 70}" fill="none" stroke="black"/>', f'<path d="M{at(0):.1f} 20V{size - 50}M50 {size - 30 - at(0):.1f}H{size - 20}" stroke="{GREY}" stroke-dasharray="4"/>']
    body += [_text(at(v), size - 34, f"{v:.3g}") for v in (-top, 0, top)] + [_text(46, size - 26 - at(v), f"{v:.3g}", "end") for v in (-top, 0, top)]
    body += [_text(size / 2, size - 10, x_name), _text(14, size / 2, y_name, more=f' transform="rotate(-90 14 {size / 2:.0f})"'), _text(58, 36, note, "start")]
    body += [f'<circle cx="{at(x):.1f}" cy="{size - 30 - at(y):.1f}" r="2.5" fill="{COLOURS[0]}" fill-opacity="0.6"/>' for x, y in points] or [_text(size / 2, size / 2, "no shared events")]
    return _svg(size, size, "".join(body))


def bars(names: Sequence[str], series: Mapping[str, Sequence[float]], marked: str | None = None) -> str:
    """Groups of bars from 0 to 1 with their values; one group may be marked."""
    width, left, base = 16 * len(series) + 18, 40, 200
    body = [f'<path d="M{left} 20V{base}H{left + width * len(names)}" fill="none" stroke="black"/>', _text(left - 4, 24, "1", "end"), _text(left - 4, base, "0", "end")]
    for i, name in enumerate(names):
        x = left + width * i + 9
        for k, values in enumerate(series.values()):
            v = min(max(values[i], 0.0), 1.0) if math.isfinite(values[i]) else 0.0
            colour = COLOURS[1] if name == marked else COLOURS[k % len(COLOURS)]
            body.append(f'<rect x="{x + 16 * k}" y="{base - 180 * v:.1f}" width="14" height="{180 * v:.1f}" fill="{colour}"/>' + _text(x + 16 * k + 7, base - 180 * v - 3, f"{values[i]:.2f}", more=' font-size="7"'))
        body.append(_text(x + 8 * len(series), base + 12, name, "end", f' transform="rotate(-45 {x + 8 * len(series):.0f} {base + 12})"'))
    body += [_text(left + 10 + 90 * k, 12, name, "start", f' fill="{COLOURS[k % len(COLOURS)]}"') for k, name in enumerate(series)]
    return _svg(left + width * len(names) + 20, base + 110, "".join(body))


def accuracy_plane(tools: Sequence[tuple[str, float, float]], marked: str, size: int = 420) -> str:
    """Tools (name, false-discovery rate, true-positive rate) with their names and a line at 0.05."""
    right = max([f for _, f, _ in tools if math.isfinite(f)] + [0.05]) * 1.15
    at = lambda f, t: (50 + f / right * (size - 130), size - 40 - t * (size - 60))
    body = [f'<path d="M50 20V{size - 40}H{size - 60}" fill="none" stroke="black"/>', f'<path d="M{at(0.05, 0)[0]:.1f} 20V{size - 40}" stroke="{COLOURS[1]}" stroke-dasharray="4"/>', _text(size / 2, size - 10, "false-discovery rate"), _text(14, size / 2, "true-positive rate", more=f' transform="rotate(-90 14 {size / 2:.0f})"')]
    for name, f, t in tools:
        if math.isfinite(f) and math.isfinite(t):
            x, y = at(f, t)
            body.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{6 if name == marked else 3}" fill="{COLOURS[1] if name == marked else GREY}"/>' + _text(x + 6, y - 4, name, "start", ' font-size="8"'))
    return _svg(size, size, "".join(body))


def table(columns: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    """Rows of text under a line, columns as wide as their longest entry."""
    widths = [12 + 7 * max(map(len, column)) for column in zip(columns, *rows)]
    lefts = [10 + sum(widths[:k]) for k in range(len(widths))]
    body = [f'<path d="M10 24H{10 + sum(widths)}" stroke="black"/>']
    body += [_text(x, 18 * n + 18, cell, "start") for n, row in enumerate([columns, *rows]) for x, cell in zip(lefts, row)]
    return _svg(20 + sum(widths), 18 * len(rows) + 30, "".join(body))
