"""Tables that come as several sheets of the same columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sheets(sheets: dict[str, DataFrame], required: list[str] | None = None) -> DataFrame:
    """All sheets as one table with the column ``sheet``. Columns must be the same in the same order, and the
    ``required`` ones there, else it raises before any job; rows with only nulls are dropped."""
    if not sheets:
        raise ValueError("no sheets")
    names = list(sheets)
    columns = sheets[names[0]].columns
    for name in names[1:]:
        if sheets[name].columns != columns:
            raise ValueError(f"columns of sheet {name} differ: {sheets[name].columns}")
    if missing := [c for c in required or [] if c not in columns]:
        raise ValueError(f"columns are missing: {missing}")
    return reduce(DataFrame.unionByName, (df.dropna(how="all").withColumn("sheet", F.lit(name)) for name, df in sheets.items()))


def sheet_counts(united: DataFrame) -> DataFrame:
    """(sheet, n): rows of each sheet and, with a null sheet, of all."""
    return united.rollup("sheet").agg(F.count(F.lit(1)).alias("n"))


def rename_missing(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with columns renamed where the wanted name is not there yet."""
    for old, new in names.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def existing_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()
