"""Places of rows in an order, without bringing a table or a large group into one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressroom.plans.scratch import keep

# How Spark composes a monotonic id: the partition above these bits, the row of the partition below.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "place") -> DataFrame:
    """``df`` as a stored table, with ``name``: the place of each row in its group, from 1; one group without ``group``.

    ``order`` must order the rows of a group completely. Rows are dealt by ranges of group and order, so a
    group of any size is spread over tasks; each stored part then begins at the sum of those before it. Only the
    first row number and the count of each part and group are put in order.
    """
    group = group or []
    sorted_rows = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    stored = keep(sorted_rows.withColumn("_row", F.monotonically_increasing_id())).withColumn(
        "_part", F.shiftright("_row", ROW_BITS)
    )
    starts = stored.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = starts.select(
        *group, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )
    return (
        stored.join(shifts, [*group, "_part"])
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_row", "_part", "_shift")
    )
