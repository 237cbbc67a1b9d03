"""Reports of bounded size, rendered on the driver."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The report lists so many rows; that is what it is.
ROWS = 50


def _cell(v) -> str:
    return "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)


def markdown(summary: DataFrame, details: DataFrame, order: str = "record_index") -> str:
    """The one summary row, and the first rows of the details in order."""
    row = summary.first()
    lines = ["# Summary", "", *(f"- {k}: {_cell(v)}" for k, v in (row.asDict() if row else {}).items()), "", "| " + " | ".join(details.columns) + " |", "|" + "---|" * len(details.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(_cell, r)) + " |" for r in details.orderBy(order).limit(ROWS).collect())]) + "\n"


def html_page(title: str, table: DataFrame, order: str, limit: int = 300) -> str:
    rows = table.orderBy(order).limit(limit).collect()
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(_cell(v))}</{tag}>" for v in values) + "</tr>"
    return f"<!DOCTYPE html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{cells('th', table.columns)}{''.join(cells('td', r) for r in rows)}</table>"


def terminal(metrics: DataFrame, order: str = "place", width: int = 20) -> str:
    """Aligned text with a bar for the resolved rate."""
    bar = F.rpad(F.repeat(F.lit("#"), F.round(F.coalesce("resolved_rate", F.lit(0.0)) * width).cast("int")), width, ".")
    rows = metrics.orderBy(order).select(F.format_string("%-24s %s %6s", "model_label", bar, F.coalesce(F.format_string("%.1f%%", 100 * F.col("resolved_rate")), F.lit("-"))).alias("x")).collect()
    return "\n".join(r.x for r in rows) or "No evaluation rows found."
