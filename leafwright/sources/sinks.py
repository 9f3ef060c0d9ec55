"""Saved results: tables for many packages, and the files of one package."""

from __future__ import annotations

import csv
import io
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from ..operators import report
from ..schema import PRIVATE, TRUTH_COLUMNS


def write_tables(frames: dict[str, DataFrame], path: str, kind: str = "parquet") -> list[str]:
    """Each frame under ``path``, partitioned by package; all pass the gate for personal data before the first is written."""
    for name, df in frames.items():
        if held := sorted(set(PRIVATE) & set(df.columns)):
            raise ValueError(f"{name} holds private columns: {held}")
    report.check_no_pii(*frames.values())
    for name, df in frames.items():
        df.write.mode("overwrite").partitionBy("package_id").format(kind).save(f"{path.rstrip('/')}/{name}")
    return list(frames)


def csv_text(df: DataFrame, columns: tuple[str, ...]) -> str:
    """The columns of a small frame (one package's rows) as CSV."""
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(columns)
    writer.writerows(tuple(r) for r in df.select(*columns).toLocalIterator())
    return out.getvalue()


def write_files(files: dict[str, str], out_dir: str) -> list[str]:
    """Text files, none of which is written if one holds personal data."""
    for text in files.values():
        report.check_text(text)
    folder = Path(out_dir)
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8", newline="")
    return list(files)


def json_text(value: Any) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def truth_text(truth: DataFrame) -> str:
    """Ground truth of one package as CSV, by page."""
    return csv_text(truth.orderBy("page_number"), TRUTH_COLUMNS)
