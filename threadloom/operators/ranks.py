"""Places in a whole table's order without passing it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import materialize


def placed(table: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds the 1-based place ``name`` in ``order``, which must tell all rows apart.

    Rows are sorted in range partitions and written once; a row's place is its place inside its partition plus the
    sizes of the partitions before. Only those sizes, one row a partition, pass through one task.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = table.repartitionByRange(*order).sortWithinPartitions(*order)
    held, _ = materialize(ordered.select("*", F.spark_partition_id().alias("_part"), inside.alias("_inside")), "placed")
    sizes = held.groupBy("_part").agg(F.count("*").alias("_size"))
    upto = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("_part", F.coalesce(upto, F.lit(0)).alias("_before"))
    return held.join(F.broadcast(before), "_part").select(*table.columns, (F.col("_before") + F.col("_inside") + 1).alias(name))


def running_max(table: DataFrame, group: str, value: str, name: str, *order: Column) -> DataFrame:
    """Adds the largest ``value`` of a group's rows up to each row in ``order``, which must tell a group's rows apart.

    Rows are sorted in range partitions; a row takes the larger of what its own partition and those before hold of its group.
    """
    held, _ = materialize(table.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()), "running")
    inside = held.withColumn("_inside", F.max(value).over(Window.partitionBy("_part", group).orderBy(*order)))
    upto = F.max("_most").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = held.groupBy("_part", group).agg(F.max(value).alias("_most")).select("_part", group, upto.alias("_before"))
    return inside.join(parts, ["_part", group]).select(*table.columns, F.greatest("_inside", "_before").alias(name))
