"""A figure of one neighbourhood as SVG, drawn from the plot-ready layers."""

from __future__ import annotations

from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def svg(buildings: list, images: list, radius_m: float, half_side: float, title: str = "", size: int = 900) -> str:
    """North is up. ``buildings``: footprint, colour; ``images``: e, n, dx, dy, colour; both in metres from the centre."""
    scale = size / (2 * half_side)
    x, y = lambda e: f"{(e + half_side) * scale:.1f}", lambda n: f"{(half_side - n) * scale:.1f}"
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}" viewBox="0 0 {size} {size}">', f'<rect width="{size}" height="{size}" fill="white"/>']
    for b in buildings:
        ring = " ".join(f"{x(p['e'])},{y(p['n'])}" for p in b["footprint"])
        out.append(f'<polygon points="{ring}" fill="{b["colour"]}" stroke="#333333" stroke-width="0.5"/>')
    for i in images:
        if i["dx"] is not None:
            out.append(f'<line x1="{x(i["e"])}" y1="{y(i["n"])}" x2="{x(i["e"] + i["dx"])}" y2="{y(i["n"] + i["dy"])}" stroke="{i["colour"]}"/>')
        out.append(f'<circle cx="{x(i["e"])}" cy="{y(i["n"])}" r="3" fill="{i["colour"]}"/>')
    out.append(f'<circle cx="{x(0)}" cy="{y(0)}" r="{radius_m * scale:.1f}" fill="none" stroke="#cc3333" stroke-dasharray="6 4"/>')
    out.append(f'<path d="M{x(0)} {y(0)}m-6 0h12m-6-6v12" stroke="#cc3333"/>')
    out.append(f'<text x="10" y="20" font-family="sans-serif" font-size="14">{escape(title)}</text></svg>')
    return "\n".join(out) + "\n"


def draw(path: str, queries: DataFrame, extent: DataFrame, building_layer: DataFrame | None = None, image_layer: DataFrame | None = None, qid: int = 0, title: str = "") -> None:
    """Write the figure of one query; only that query's rows, as many as a figure can show, come to the driver."""
    own = F.col("qid") == qid
    around = queries.where(own).join(extent, "qid").select("radius_m", "half_side").first()
    rows = [df.where(own).collect() if df is not None else [] for df in (building_layer, image_layer)]
    Path(path).write_text(svg(*rows, around["radius_m"], around["half_side"], title or f"{len(rows[0])} buildings, {len(rows[1])} images"))
