"""Text of results, under a token budget. Rows come to the driver only after a limit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..sources.index import Store

BUDGET, RESERVED, ROWS = 20_000, 500, 200


def tokens(text: str) -> int:
    return math.ceil(len(text) / 4)


def table(df: DataFrame, columns: list[str] | None = None, rows: int = ROWS) -> str:
    """One line a row, values separated by two blanks; nulls are left out."""
    shown = df.select(*columns) if columns else df
    got = shown.limit(rows + 1).collect()
    lines = ["  ".join(_value(v) for v in r if v is not None) for r in got[:rows]]
    return "\n".join([*lines, *(["… more rows"] if len(got) > rows else [])]) or "(none)"


def _value(value) -> str:
    if isinstance(value, float):
        return f"{value:.6g}"
    return ", ".join(map(_value, value)) if isinstance(value, (list, tuple)) and not hasattr(value, "asDict") else str(value)


def dossier(sections: dict[str, DataFrame], budget: int = BUDGET) -> str:
    """Sections in order as long as they fit; the first always stays, and those left out are named.
    What follows a section that doesn't fit is never computed."""
    out, used, missing = [], 0, []
    for title, df in sections.items():
        if missing or (out and used >= budget - RESERVED):
            missing.append(title)
            continue
        text = f"== {title} ==\n{table(df)}"
        if out and used + tokens(text) > budget - RESERVED:
            missing.append(title)
            continue
        out.append(text)
        used += tokens(text)
    return "\n\n".join(out) + (f"\n\n(left out: {', '.join(missing)})" if missing else "")


class Digest:
    """A text that is made once for each published version of a store and kept beside it, so that
    other sessions find it; it goes with the version."""

    def __init__(self, store: Store, name: str = "digest"):
        self.store, self.name = store, name

    def text(self, make) -> str:
        version = (self.store.info() or {}).get("version")
        if version is None:
            return make(None)
        folder = f"{self.store.folder}/{version}/{self.name}"
        if self.store.exists(f"{folder}/_SUCCESS"):
            return self.store.spark.read.parquet(folder).first()["text"]
        text = make(self.store.current())
        self.store.spark.createDataFrame([(text,)], "text string").coalesce(1).write.mode("overwrite").parquet(folder)
        return text
