"""What the query modules share: the register, rounding, and the fixture views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycensus.plans import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}
OBS, ORB, SCORED = f"obs AS ({fx.OBS_DUCK})", f"orb AS ({fx.ORB})", f"scored AS ({fx.SCORED})"
ORBX, FINAL = f"orb AS ({fx.ORBX})", f"final AS ({fx.FINAL})"


def query(sql: str | None, name: str | None = None):
    """Register a query with its SQL; None where SQL can't express it, and tests hold it against plain loops."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero made zero, integers long."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def r6(**cols: str) -> str:
    """SQL select items, rounded to six places."""
    return ", ".join(f"round({x}, 6) + 0.0 AS {name}" for name, x in cols.items())
