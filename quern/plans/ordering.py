"""Running numbers and sums over a whole table, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.lineage import cut


def running_sum(df: DataFrame, order: list[str], value: Column, out: str, by: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """``df`` with the column ``out``: the sum of ``value`` over the rows up to this one (without it, unless
    ``inclusive``) in the order of the columns ``order``, within each ``by`` if given.

    The rows are range-partitioned by ``by`` and ``order`` and written to the shared checkpoint folder; each part is
    summed for itself, and the sums of the parts before (one row a part and ``by``) are joined to it. So the whole
    order, or one ``by`` with a third of all rows, is spread over all parts. Rows that tie in ``order`` are summed in
    an order of their own in each run; give a unique last column. Null orders first."""
    by = by or []
    parts = cut(df.repartitionByRange(*by, *order).withColumn("_value", value.cast("bigint")).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", *by).orderBy(*order)
    frame = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = parts.groupBy("_part", *by).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(1)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    renamed = offsets.select(*(F.col(c).alias(f"_o{c}") for c in ["_part", *by]), "_before")
    on = F.lit(True)
    for c in ["_part", *by]:
        on = on & F.col(c).eqNullSafe(F.col(f"_o{c}"))
    own = F.coalesce(F.sum("_value").over(frame), F.lit(0))
    own = own if inclusive else own - F.coalesce(F.col("_value"), F.lit(0))
    summed = parts.withColumn("_own", own).join(renamed, on)
    return summed.withColumn(out, F.col("_own") + F.col("_before")).select(*df.columns, out)


def row_numbers(df: DataFrame, order: list[str], out: str = "row_no", by: list[str] | None = None) -> DataFrame:
    """``df`` with the number of each row from 1 in the order of ``order``, within each ``by`` if given."""
    return running_sum(df, order, F.lit(1), out, by)
