"""Output types of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain(rows: DataFrame) -> DataFrame:
    """Decimals as doubles, days as ISO text, integers as longs, so that engines can be compared."""
    out = []
    for name, kind in rows.dtypes:
        column = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            column = column.cast("double")
        elif kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("long")
        elif kind.startswith(("array", "struct", "map")):
            column = F.to_json(column)
        out.append(column.alias(name))
    return rows.select(*out)
