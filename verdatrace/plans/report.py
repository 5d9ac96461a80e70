"""One HTML page about an analysis, with SVG charts; driver-side, over small aggregates."""

from __future__ import annotations

from html import escape
from typing import Any


def table(rows: list[dict[str, Any]]) -> str:
    """An HTML table; numbers are aligned to the right."""
    if not rows:
        return "<p>none</p>"
    show = lambda v: "-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    head = "".join(f"<th>{escape(str(k))}</th>" for k in rows[0])
    body = "".join("<tr>" + "".join(f"<td{' class=n' if isinstance(v, int | float) else ''}>{escape(show(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def bars(items: list[tuple[str, float]], unit: str = "", width: int = 640) -> str:
    """Horizontal bars, each with its label and value."""
    if not items:
        return ""
    top = max(v for _, v in items) or 1
    rows = [f'<text x="0" y="{k * 26 + 17}">{escape(n)}</text><rect x="180" y="{k * 26 + 5}" width="{(width - 260) * v / top:.1f}" height="16" rx="4" fill="#2c7a51"/><text x="{190 + (width - 260) * v / top:.1f}" y="{k * 26 + 17}">{v:.3g}{escape(unit)}</text>' for k, (n, v) in enumerate(items)]
    return f'<svg viewBox="0 0 {width} {len(items) * 26 + 6}" role="img">{"".join(rows)}</svg>'


def dumbbells(items: list[tuple[str, float | None, float | None]], unit: str = " days", width: int = 640) -> str:
    """Two values a row joined by a line; a missing value has no dot."""
    if not items:
        return ""
    top = max([v for _, a, b in items for v in (a, b) if v is not None] or [1]) or 1
    at = lambda v: 180 + (width - 260) * v / top
    out = []
    for k, (name, a, b) in enumerate(items):
        y = k * 26 + 13
        out.append(f'<text x="0" y="{y + 4}">{escape(name)}</text>')
        if a is not None and b is not None:
            out.append(f'<line x1="{at(a):.1f}" x2="{at(b):.1f}" y1="{y}" y2="{y}" stroke="#999"/>')
        out += [f'<circle cx="{at(v):.1f}" cy="{y}" r="5" fill="{c}"><title>{v:g}{escape(unit)}</title></circle>' for v, c in ((a, "#2c7a51"), (b, "#31579b")) if v is not None]
    return f'<svg viewBox="0 0 {width} {len(items) * 26 + 6}" role="img">{"".join(out)}</svg>'


def spread_labels(places: list[float], gap: float) -> list[float]:
    """Places moved apart so that neighbours keep a gap, in their order."""
    order, out = sorted(range(len(places)), key=lambda k: places[k]), list(places)
    for a, b in zip(order, order[1:], strict=False):
        out[b] = max(out[b], out[a] + gap)
    return out


def page(title: str, summary: dict[str, Any], latency: list[dict[str, Any]] | None = None) -> str:
    """The whole page from :meth:`Result.summary`."""
    parts = [f"<h1>{escape(title)}</h1>", "<h2>Tiers</h2>", bars([(r["tier"], float(r["area_ha"])) for r in summary["tiers"]], " ha"), table(summary["tiers"]), "<h2>Classes</h2>", table(summary["classes"])]
    for name, rows in summary.get("accuracy", {}).items():
        parts += [f"<h2>{escape(name)}</h2>", table(rows)]
    if latency:
        parts += ["<h2>Latency</h2>", dumbbells([(str(r["patch_id"]), r["s2_latency_days"], r["s1_latency_days"]) for r in latency])]
    parts += ["<h2>Limits</h2>", table([summary["thresholds"]]), "<h2>Rejections</h2>", *(table(r) for r in summary["rejections"].values()), "<h2>Seconds</h2>", table([summary["seconds"]]) if summary["seconds"] else ""]
    style = "body{font:15px system-ui;margin:2em auto;max-width:52em}table{border-collapse:collapse}td,th{padding:.2em .7em;border-bottom:1px solid #ddd;text-align:left}td.n{text-align:right}svg{max-width:100%}svg text{font-size:13px}"
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{escape(title)}</title><style>{style}</style><body>{"".join(parts)}</body></html>'
