"""Small documents that the driver writes: queues, discovery results, report packs, heatmaps and progress. Replaced at once."""

from __future__ import annotations

import html
import json
import os
import tempfile

from pyspark.sql import DataFrame


def replace(path: str, text: str) -> None:
    """Writes a file so that readers see the old or the new text, never a part."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def records(rows: DataFrame, most: int) -> list[dict]:
    """A report's rows as plain values; more than `most` are an error, not a cut."""
    got = [json.loads(r) for r in rows.toJSON().take(most + 1)]
    if len(got) > most:
        raise ValueError(f"a document holds {most} rows at most")
    return got


def save_json(path: str, document: dict | list) -> None:
    replace(path, json.dumps(document, indent=2, sort_keys=True, default=str) + "\n")


def save_queue(path: str, candidates: DataFrame, most: int = 10_000) -> None:
    """A candidate queue that approves nothing by itself."""
    save_json(path, {"version": 1, "queue_type": "candidate_only", "auto_approval_enabled": False, "candidates": records(candidates, most)})


def save_discovery(path: str, venue: str, markets: DataFrame, rejected: DataFrame, most: int = 10_000) -> None:
    """Discovered markets of a venue with counts by reject reason."""
    found = records(markets, most)
    save_json(path, {"venue": venue, "stats": {"accepted": len(found), "rejected_by_reason": {r["reason"]: r["n"] for r in records(rejected, 100)}}, "markets": found})


def _cell(value: object) -> str:
    return "" if value is None else f"{value:.4g}" if isinstance(value, float) else str(value)


def markdown(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A report pack: a heading and one table a section."""
    out = [f"# {title}"]
    for name, rows in tables.items():
        columns, got = rows.columns, records(rows, most)
        out += ["", f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
        out += ["| " + " | ".join(_cell(r.get(c)).replace("|", "\\|") for c in columns) + " |" for r in got] or ["(no rows)"]
    return "\n".join(out) + "\n"


def heat_text(cells: DataFrame, row: str, column: str, value: str) -> str:
    """A heatmap as aligned text; cells without a value are dots."""
    names, heads, at = _grid(cells, row, column, value)
    width = max([len(str(x)) for x in names + heads] + [6])
    lines = [" " * width + " " + " ".join(str(h).rjust(width) for h in heads)]
    lines += [str(n).ljust(width) + " " + " ".join((_cell(at[n, h]) if (n, h) in at else ".").rjust(width) for h in heads) for n in names]
    return "\n".join(lines)


def heat_html(title: str, cells: DataFrame, row: str, column: str, value: str) -> str:
    """A heatmap as a table whose cells are darker the larger they are."""
    names, heads, at = _grid(cells, row, column, value)
    low, high = min(at.values(), default=0.0), max(at.values(), default=1.0)

    def cell(n: object, h: object) -> str:
        if (n, h) not in at:
            return "<td></td>"
        share = (at[n, h] - low) / (high - low) if high > low else 0.5
        return f'<td style="background:rgba(200,80,40,{share:.2f})">{html.escape(_cell(at[n, h]))}</td>'

    head = "".join(f"<th>{html.escape(str(h))}</th>" for h in heads)
    body = "".join(f"<tr><th>{html.escape(str(n))}</th>{''.join(cell(n, h) for h in heads)}</tr>" for n in names)
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr><th></th>{head}</tr>{body}</table>\n"


def _grid(cells: DataFrame, row: str, column: str, value: str, most: int = 20_000) -> tuple[list, list, dict]:
    got = [r for r in records(cells.select(row, column, value), most) if r.get(value) is not None]
    return sorted({r[row] for r in got}), sorted({r[column] for r in got}), {(r[row], r[column]): float(r[value]) for r in got}
