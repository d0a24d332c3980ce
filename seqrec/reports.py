"""Markdown reports of small results (splits, metrics, codecs, counters, latencies)."""

from __future__ import annotations

from datetime import timedelta
from pathlib import Path

from pyspark.sql import DataFrame


def _cell(v: object) -> str:
    if v is None:
        return "unlimited"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, timedelta):
        return f"{v.total_seconds():.6f}"
    return f"{v:,}" if isinstance(v, int) else str(v)


def table(rows: DataFrame, order: tuple[str, ...] = (), most: int = 1000) -> str:
    """``rows``, which must be few, as a Markdown table."""
    got = (rows.orderBy(*order) if order else rows).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError("a report has a bounded number of rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(_cell, r)) + " |" for r in got])


def write(path: str | Path, title: str, settings: dict[str, object], sections: dict[str, DataFrame]) -> Path:
    """A report with a settings list and a table for each section."""
    parts = [f"# {title}", "\n".join(f"- {k}: {_cell(v)}" for k, v in settings.items())]
    parts += [f"## {name}\n\n{table(df)}" for name, df in sections.items()]
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n\n".join(p for p in parts if p) + "\n", encoding="utf-8")
    return path
