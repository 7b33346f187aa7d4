"""Reports: sorted Markdown from result tables, without a clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def markdown(title: str, sections: Sequence[tuple[str, DataFrame]], stamp: str | None = None, limit: int | None = None) -> str:
    """A report with a table for each section, in the order of its DataFrame.

    Rows stream from the driver's iterator one partition at a time.  With a limit a section says
    how many rows it shows of all; without one it shows all.
    """
    out = [f"# {title}", ""] + ([stamp, ""] if stamp else [])
    for name, df in sections:
        shown = df if limit is None else df.limit(limit)
        rows = ["| " + " | ".join(_cell(v) for v in r) + " |" for r in shown.toLocalIterator()]
        total = len(rows) if limit is None else df.count()
        out += [f"## {name} ({total}" + (f", first {len(rows)}" if total > len(rows) else "") + ")", ""]
        if rows:
            out += ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *rows, ""]
    return "\n".join(out).rstrip() + "\n"


def _cell(value) -> str:
    text = "" if value is None else ", ".join(map(str, value)) if isinstance(value, list) else str(value)
    return text.replace("|", "\\|").replace("\n", " ")
