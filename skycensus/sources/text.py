"""Fixed-width text: slices by position, trimmed and cast; what can't be cast is null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_width(lines: DataFrame, spec: list[tuple[str, int, int, str]], line: str = "value") -> DataFrame:
    """Columns (name, first place from 1, width, type) of each line; the other columns stay."""
    rest = [c for c in lines.columns if c != line]
    cut = lambda at, n: F.trim(F.substring(line, at, n))
    return lines.select(*rest, *[cut(at, n).try_cast(kind).alias(name) for name, at, n, kind in spec])
