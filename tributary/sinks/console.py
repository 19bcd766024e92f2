"""Console sinks. Rows come to the driver one partition at a time."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame, Row


def render_json(row: Row) -> str:
    return json.dumps(row.asDict(True), default=str, ensure_ascii=False)


def render_pretty(row: Row) -> str:
    return json.dumps(row.asDict(True), default=str, ensure_ascii=False, indent=2)


def render_table(rows: list[Row], columns: list[str], max_width: int = 40) -> str:
    """A fixed-width table; cells wider than max_width end in an ellipsis."""

    def cell(value: object) -> str:
        text = "" if value is None else str(value)
        return text if len(text) <= max_width else text[: max_width - 1] + "…"

    body = [[cell(r[c]) for c in columns] for r in rows]
    widths = [max(len(c), *(len(b[i]) for b in body)) if body else len(c) for i, c in enumerate(columns)]
    line = lambda cells: " | ".join(x.ljust(w) for x, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([line(columns), "-+-".join("-" * w for w in widths), *map(line, body)])


class ConsoleSink:
    """format: json, json_pretty, debug, table, snapshot_table, or a function of a row. Safe to repeat.

    A snapshot table shows each row as a table of its own, between header and footer: `snapshot` names the column that holds its rows (an array of structs).
    """

    redelivery = "safe"

    def __init__(self, format: str | Callable[[Row], str] = "json", max_width: int = 40, stderr: bool = False, out: TextIO | None = None, header: str | None = None, footer: str | None = None, limit: int = 1000, snapshot: str | None = None):
        if format == "snapshot_table" and not snapshot:
            raise ValueError("a snapshot table needs the column of its rows")
        self.snapshot = snapshot
        self.format, self.max_width, self.header, self.footer, self.limit = format, max_width, header, footer, limit
        self.out = out or (sys.stderr if stderr else sys.stdout)

    def write(self, df: DataFrame, order: str | None = None) -> int:
        df = df.orderBy(order) if order else df
        if self.format == "snapshot_table":
            return self._snapshots(df)
        render = {"json": render_json, "json_pretty": render_pretty, "debug": repr}.get(self.format, self.format)
        n = 0
        if self.header:
            print(self.header, file=self.out)
        if self.format == "table":  # a table is for reading: its rows are buffered, so they have a limit
            rows = df.limit(self.limit).collect()
            print(render_table(rows, df.columns, self.max_width), file=self.out)
            n = len(rows)
        else:
            for row in df.toLocalIterator():
                print(render(row), file=self.out)
                n += 1
        if self.footer:
            print(self.footer, file=self.out)
        return n

    def _snapshots(self, df: DataFrame) -> int:
        n, names = 0, df.schema[self.snapshot].dataType.elementType.names
        for row in df.toLocalIterator():
            for text in (self.header, render_table(list(row[self.snapshot] or []), names, self.max_width), self.footer):
                if text:
                    print(text, file=self.out)
            n += 1
        return n
