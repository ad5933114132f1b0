"""Writing report results (S04) and chart frames.

A report is a DataFrame; it is written by the executors, one folder per
report. CSV output keeps a header and writes missing values as ``NA``; row
names are not data and are never written. Only ``single_file=True`` brings a
result (not the work behind it) into one task, for small aggregated reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, fmt: str = "csv", na: str = "NA",
                 single_file: bool = False, mode: str = "overwrite") -> None:
    out = df.repartition(1) if single_file else df
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("nullValue", na).option("emptyValue", "").csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_chart_frame(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The data behind a chart, as parquet (the drawing itself is not built)."""
    write_report(df, path, fmt="parquet", mode=mode)


def write_reports(reports: dict[str, DataFrame], root: str, fmt: str = "csv", **kw) -> list[str]:
    """Write several reports, one folder each under ``root``; returns the paths."""
    paths = []
    for name, df in reports.items():
        p = f"{root.rstrip('/')}/{name}"
        write_report(df, p, fmt=fmt, **kw)
        paths.append(p)
    return paths
