"""Result shape shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tidy(df: DataFrame) -> DataFrame:
    """Integers as long, doubles at 9 places."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
            out.append(F.col(name).cast("long").alias(name))
        elif kind in ("double", "float"):
            out.append(F.round(F.col(name).cast("double"), 9).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
