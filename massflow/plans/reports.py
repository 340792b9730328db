"""HTML pages and small pictures of finished studies; nothing is fitted here."""

from __future__ import annotations

import html
import json
import struct
import zlib
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

import numpy as np

from massflow.sources.files import bars_svg, json_safe

STYLE = "<style>body{font:16px sans-serif;max-width:1100px;margin:2em auto}td,th{padding:6px;border-bottom:1px solid #ccd;text-align:right}pre{white-space:pre-wrap}</style>"


def table(rows: Sequence[Mapping[str, Any]]) -> str:
    if not rows:
        return "<p>no rows</p>"
    names = list(dict.fromkeys(k for r in rows for k in r))
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    cells = ("<tr>" + "".join(f"<td>{html.escape(show(r.get(n)))}</td>" for n in names) + "</tr>" for r in rows)
    return f"<table><tr>{''.join(f'<th>{html.escape(n)}</th>' for n in names)}</tr>{''.join(cells)}</table>"


def page(title: str, note: str, sections: Mapping[str, str], whole: Any, path: str | Path) -> Path:
    """Sections of HTML and the whole result as folded JSON."""
    body = "".join(f"<h2>{html.escape(k)}</h2>{v}" for k, v in sections.items())
    dump = html.escape(json.dumps(json_safe(whole), indent=1, sort_keys=True))
    Path(path).write_text(f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{html.escape(title)}</title>{STYLE}<h1>{html.escape(title)}</h1><p>{html.escape(note)}</p>{body}<details><summary>All numbers</summary><pre>{dump}</pre></details></html>')
    return Path(path)


def png_bars(values: Mapping[str, float | None], path: str | Path, height: int = 160, bar: int = 40) -> None:
    """A grey-scale PNG of bars from 0 to the largest value, one a name, in order."""
    x = np.array([0.0 if v is None else max(0.0, v) for v in values.values()])
    top = max(x.max(initial=0), 1e-300)
    grid = np.full((height, max(1, len(x)) * bar), 255, np.uint8)
    for i, v in enumerate(x):
        grid[height - round(v / top * (height - 4)) :, i * bar + 6 : (i + 1) * bar - 6] = 90
    raw = np.hstack([np.zeros((height, 1), np.uint8), grid]).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", grid.shape[1], height, 8, 0, 0, 0, 0)
    Path(path).write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def study(title: str, models: Mapping[str, Mapping[str, Any]], path: str | Path) -> Path:
    """Occupancy and agreement of a joint study's models."""
    rows = [{"model": n, "windows": m["n"], "occupied": m["occupied"], "ari_vs_scaled_joint": m["ari"], "both_single_state": m["both_single_state"], "counts": str(m["counts"])} for n, m in models.items()]
    bars = bars_svg({n: float(m["ari"]) for n, m in models.items()})
    return page(title, "Clusters are forced; agreement is not accuracy, and one state on both sides agrees trivially.", {"Models on common windows": table(rows), "Agreement with the scaled joint model": bars}, models, path)


def run(folder: str | Path) -> Path:
    """The page of a finished univariate run, from its sealed files alone."""
    folder = Path(folder)
    metrics = json.loads((folder / "metrics.json").read_text())
    rows = [
        {"year": f["year"], "k": f["k"], "model": n, "windows": m["strict"]["n"], "mean_dwell": m["strict"]["temporal"]["mean_dwell"], "ood_rate": m["strict"]["ood_rate"], "ari_vs_w2": f["ari_against_w2"].get(n), "within_w2": m["strict"]["within"]}
        for f in metrics["folds"] for n, m in f["models"].items()
    ]
    sections = {"Folds": table(rows), "Refits": table([{"year": f["year"]} | {k: v for k, v in (f.get("refit") or {}).items() if k != "mapping"} for f in metrics["folds"]])}
    for name, groups in metrics["stability"]["models"].items():
        sections[f"Stability of {name}"] = table([{"group": g, "repeats": v["repeats"], "ari_mean": v["ari_mean"], "ari_range": str(v["ari_range"])} for g, v in groups.items()])
    sections["Overlap"] = table([{k: v for k, v in r.items() if k != "null_draws"} for r in metrics["overlap"]["rows"]])
    return page("Study of one asset", "Descriptive: no forecast, no claim of value.", sections, metrics, folder.parent / f"{folder.name}-report.html")
