"""Distributed ranking, id assignment and prefix sums.

None of these uses a window without ``partitionBy`` over the data (that would
pull every row into one task), and none collects data to the driver.

* ``global_rank``: range-partition + sort, number rows inside each partition,
  add per-partition offsets.  The offsets table has one row per partition,
  so it is the only thing that is broadcast.  The numbered rows are written
  out first: the numbering depends on partition
  layout; writing it to the shared checkpoint folder pins it (and cuts the
  lineage) so a lost executor cannot renumber rows between the two uses.
* ``prefix_aggs`` / ``prefix_sum``: running sums and minima per key in
  RequestID order, dealt by key and fixed block of the order column, so a key
  holding a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridegrid.session import materialize

ROW_BITS = 33  # monotonically_increasing_id keeps the record number in the low 33 bits
PREFIX_BLOCK = 1 << 16


def global_rank(df: DataFrame, order_cols: list[str | Column], out: str = "Rank") -> DataFrame:
    """Add a 1-based, gapless rank following ``order_cols`` (which must be a total order)."""
    # No partition count: AQE coalesces the range partitions to the data size; coalescing
    # merges neighbouring ranges, so partition ids still follow the sort order.
    staged = materialize(
        df.repartitionByRange(*order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__mono", F.monotonically_increasing_id()),
        "rank",
    )
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))  # one row per partition
        .select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    )
    local = F.col("__mono") - F.shiftleft(F.col("__pid").cast("long"), ROW_BITS)
    return (
        staged.join(F.broadcast(offsets), "__pid")
        .withColumn(out, F.col("__off") + local + F.lit(1))
        .drop("__pid", "__mono", "__off")
    )


def running_count(df: DataFrame, order_cols: list[str | Column], flag: Column, out: str) -> DataFrame:
    """Add how many rows with ``flag`` come up to and with each row in ``order_cols`` order (a total order).

    As ``global_rank``: counted inside each range partition, plus the counts of the
    partitions before it, which are one broadcast row per partition.
    """
    staged = materialize(
        df.withColumn("__flag", flag.cast("long")).repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
        .withColumn("__pid", F.spark_partition_id()).withColumn("__mono", F.monotonically_increasing_id()), "running")
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged.groupBy("__pid").agg(F.sum("__flag").alias("__n")).select(
        "__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    within = Window.partitionBy("__pid").orderBy("__mono").rowsBetween(Window.unboundedPreceding, 0)
    return (staged.withColumn("__in", F.sum("__flag").over(within)).join(F.broadcast(offsets), "__pid")
            .withColumn(out, F.col("__off") + F.col("__in")).drop("__flag", "__pid", "__mono", "__off", "__in"))


def assign_ids(df: DataFrame, order_cols: list[str | Column], existing_max: Column, out: str) -> DataFrame:
    """New surrogate ids continuing after ``existing_max`` (a scalar Column), in ``order_cols`` order."""
    ranked = global_rank(df, order_cols, "__rank")
    return ranked.withColumn(out, (F.coalesce(existing_max, F.lit(0)) + F.col("__rank")).cast("int")).drop("__rank")


def prefix_aggs(df: DataFrame, keys: list[str], order_col: str, aggs: dict[str, tuple[str, Column]],
                inclusive: bool = False, block: int = PREFIX_BLOCK) -> DataFrame:
    """Running ``sum`` / ``min`` / ``max`` columns per ``keys`` in ``order_col`` order (exclusive by default).

    ``aggs`` maps an output column to ("sum", "min" or "max", value).  ``order_col``
    is a unique integer (RequestID).  Rows are dealt by (keys, block of ``block``
    consecutive order values): the window inside a block holds at most
    ``block`` rows and the window over block totals one row per block of a
    key.  The explicit repartition keeps it so when the input is already dealt
    by the keys alone (after a join on them).  NULL values do not count; a sum of nothing is 0.
    """
    fns = {"sum": F.sum, "min": F.min, "max": F.max}
    end = 0 if inclusive else -1
    blk = F.floor(F.col(order_col) / F.lit(block)).cast("long")
    names = list(aggs)
    values = [aggs[n][1].alias(f"__v{i}") for i, n in enumerate(names)]
    in_block = Window.partitionBy(*keys, "__blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", blk.alias("__blk"), *values).repartition(*keys, "__blk").select(
        *df.columns, "__blk", *[fns[aggs[n][0]](f"__v{i}").over(in_block).alias(f"__l{i}") for i, n in enumerate(names)])
    totals = df.select(*keys, blk.alias("__blk"), *values).groupBy(*keys, "__blk").agg(
        *[fns[aggs[n][0]](f"__v{i}").alias(f"__t{i}") for i, n in enumerate(names)])
    offsets = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__blk").alias("__b"),
                            *[fns[aggs[n][0]](f"__t{i}").over(before).alias(f"__o{i}") for i, n in enumerate(names)])
    cond = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__blk") == F.col("__b")]

    def whole(i: int, kind: str) -> Column:
        if kind == "sum":
            return F.coalesce(F.col(f"__o{i}"), F.lit(0)) + F.coalesce(F.col(f"__l{i}"), F.lit(0))
        # least and greatest leave NULLs out
        return (F.least if kind == "min" else F.greatest)(f"__o{i}", f"__l{i}")

    return local.join(offsets, cond, "left").select(
        *df.columns, *[whole(i, aggs[n][0]).alias(n) for i, n in enumerate(names)])


def prefix_sum(df: DataFrame, keys: list[str], order_col: str, value: Column | str, out: str,
               inclusive: bool = False, block: int = PREFIX_BLOCK) -> DataFrame:
    """Running sum of ``value`` per ``keys`` in ``order_col`` order (exclusive by default)."""
    v = F.col(value) if isinstance(value, str) else value
    return prefix_aggs(df, keys, order_col, {out: ("sum", v)}, inclusive, block)
