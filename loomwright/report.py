"""Reports of summaries and maps as Markdown and SVG, made on the driver from small tables."""

from __future__ import annotations

import json
import math
from html import escape

from pyspark.sql import DataFrame

#: Points that a map shows at most; the map is sampled before.
MOST_POINTS = 2000
PALETTE = "#4c78a8 #f58518 #54a24b #e45756 #72b7b2 #eeca3b #b279a2 #ff9da6 #9d755d #bab0ac #2f4b7c #a05195".split()


def markdown_table(rows: DataFrame, most: int = MOST_POINTS) -> str:
    names = rows.columns
    body = [[("" if v is None else str(v)).replace("|", "\\|") for v in r] for r in rows.limit(most).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [names, ["---"] * len(names), *body])


def svg_bars(values: list[tuple[str, float]], width: int = 480) -> str:
    top = max((v for _, v in values), default=0) or 1
    bars = [f'<text x="0" y="{24 * i + 16}">{escape(n)}</text><rect x="160" y="{24 * i + 4}" width="{(width - 220) * v / top:.1f}" height="16" fill="{PALETTE[0]}"/><text x="{165 + (width - 220) * v / top:.1f}" y="{24 * i + 16}">{v:.3f}</text>' for i, (n, v) in enumerate(values)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{24 * len(values) + 8}" font-family="sans-serif" font-size="12">{"".join(bars)}</svg>'


def svg_map(points: DataFrame, size: int = 640) -> str:
    """Points (x, y in 0..1, cluster, retrievals): larger where retrieved more, hollow where never."""
    rows = points.limit(MOST_POINTS).collect()
    peak = max((r["retrievals"] for r in rows), default=0)
    out = []
    for r in rows:
        radius = 3 + 4.5 * math.log1p(r["retrievals"]) / math.log1p(peak) if peak else 3
        colour = PALETTE[r["cluster"] % len(PALETTE)]
        fill = colour if r["retrievals"] else "none"
        out.append(f'<circle cx="{20 + r["x"] * (size - 40):.1f}" cy="{size - 20 - r["y"] * (size - 40):.1f}" r="{radius:.1f}" fill="{fill}" stroke="{colour}"/>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">{"".join(out)}</svg>'


def svg_rank_histogram(histogram: DataFrame, most: int = 10) -> str:
    """Bars of how often the first relevant hit stood at each rank; the last bar is of queries where none was found."""
    n = {r["rank"]: r["n"] for r in histogram.collect()}  # at most most + 1 rows
    return svg_bars([("not found" if k > most else f"rank {k}", float(n.get(k, 0))) for k in range(1, most + 2)])


def json_report(evaluation, metrics: tuple[str, ...] = ()) -> str:
    """An evaluation as JSON: per label the means, the milliseconds a query and the excluded queries."""
    out: dict[str, dict] = {}
    for r in evaluation.summary.orderBy("label", "metric").limit(MOST_POINTS).collect():
        if not metrics or r["metric"] in metrics:
            out.setdefault(r["label"], {"milliseconds_per_query": round(evaluation.milliseconds[r["label"]], 3), "excluded": evaluation.excluded[r["label"]], "mean": {}})["mean"][r["metric"]] = r["mean"]
    return json.dumps(out, indent=2, sort_keys=True)


def markdown_report(evaluation, metrics: tuple[str, ...]) -> str:
    """A table of means, a row per metric and a column per label, with times and excluded queries below."""
    labels = list(evaluation.milliseconds)
    mean = {(r["metric"], r["label"]): r["mean"] for r in evaluation.summary.limit(MOST_POINTS).collect()}
    rows = [["metric", *labels], ["---"] * (len(labels) + 1), *[[m, *[f"{mean[m, x]:.3f}" if (m, x) in mean else "" for x in labels]] for m in metrics]]
    rows += [["ms per query", *[f"{evaluation.milliseconds[x]:.1f}" for x in labels]], ["excluded", *[str(evaluation.excluded[x]) for x in labels]]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
