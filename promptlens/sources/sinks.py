"""Writers. Tables go out through Spark; small reports are single files written whole, then renamed."""

from __future__ import annotations

import csv
import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame

#: The most rows of a single-file report; larger tables go out through Spark.
REPORT_ROWS = 1_000_000
#: The most rows of a LaTeX table.
LATEX_ROWS = 1_000


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, nulls empty, quotes doubled, as many files as partitions."""
    df.write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", '""').option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, check: bool = False) -> None:
    """Parquet by Spark's commit protocol; with check, read back and compared as multisets."""
    df.write.mode("overwrite").parquet(path)
    if check:
        back = df.sparkSession.read.parquet(path)
        if back.exceptAll(df).limit(1).count() or df.exceptAll(back).limit(1).count():
            raise RuntimeError(f"what was written to {path} differs")


def write_by_group(df: DataFrame, path: str, column: str) -> None:
    """One folder of CSV files for each value of a column."""
    df.write.mode("overwrite").partitionBy(column).option("header", "true").option("escape", '"').csv(path)


def _whole(path: str, write: Callable) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=folder, prefix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            write(f)
        os.replace(tmp, path)
    except BaseException:
        os.unlink(tmp)
        raise


def write_report(df: DataFrame, path: str, bom: bool = True, na: str = "") -> int:
    """One CSV file that spreadsheets read as UTF-8; more than REPORT_ROWS rows are an error. Returns the rows."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError("too many rows for one file: use write_csv")

    def write(f):
        f.write("﻿" if bom else "")
        out = csv.writer(f, lineterminator="\n")
        out.writerow(df.columns)
        out.writerows([na if v is None else str(v).upper() if isinstance(v, bool) else v for v in r] for r in rows)

    _whole(path, write)
    return len(rows)


def write_json(value: object, path: str) -> None:
    """Indented JSON, all of it or nothing."""
    _whole(path, lambda f: f.write(json.dumps(value, ensure_ascii=False, indent=2) + "\n"))


def latex_table(df: DataFrame, label: str, value: str, caption: str) -> str:
    """A small table of counts with thin spaces between thousands and a total; more than LATEX_ROWS rows are an error."""
    rows = df.select(label, value).limit(LATEX_ROWS + 1).collect()
    if len(rows) > LATEX_ROWS:
        raise ValueError("too many rows for a LaTeX table: use write_report")
    shown = lambda n: f"{n:,}".replace(",", r"\,")
    safe = lambda s: "".join("\\" + c if c in "&%$#_{}" else c for c in str(s))
    body = "\n".join(f"{safe(r[0])} & {shown(r[1])} \\\\" for r in rows)
    total = shown(sum(r[1] for r in rows))
    return "\n".join(["\\begin{table}[ht]", "\\centering", f"\\caption{{{safe(caption)}}}", "\\begin{tabular}{lr}", "\\hline", f"{safe(label)} & {safe(value)} \\\\", "\\hline", body, "\\hline", f"Totale & {total} \\\\", "\\hline", "\\end{tabular}", "\\end{table}"])
