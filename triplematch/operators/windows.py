"""Running ids, next rows and forward fill over a global order (W1, W5, W6, W7), without single-partition windows.

Positions always come from keys in the data (file name and block start, the order column, a splitter range), never
from the physical partition a row happens to sit in, so they are the same however a plan is evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplematch.session import write_table

BLOCK = 1 << 20


def join_groups(left: DataFrame, right: DataFrame, groups: list[str], keys: list[str] | None = None,
                how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, joined on ``groups``, where null equals null, and on ``keys``."""
    if not groups:
        return left.join(right, list(keys or []), how)
    named = right.select(*[F.col(c).alias(f"_g_{c}") for c in groups], *[c for c in right.columns if c not in groups])
    for c in keys or []:
        named = named.withColumnRenamed(c, f"_k_{c}")
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in groups] + [F.col(c) == F.col(f"_k_{c}") for c in keys or []]
    return left.join(named, on, how).drop(*[f"_g_{c}" for c in groups], *[f"_k_{c}" for c in keys or []])


def _offsets(counts: DataFrame, order: list[str], n: str) -> DataFrame:
    """Exclusive running sum over a table of one row per block, range or file split (small)."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_off", F.coalesce(F.sum(n).over(w), F.lit(0)))


def read_numbered(spark: SparkSession, path: str | list[str], col: str = "line_no") -> DataFrame:
    """W1 for text: ``value`` and its dense 0-based line number in (file name, position) order.

    A file split is read by one task from start to end, so a line's position in its split is a running id less the
    smallest running id of the split. The lines of the splits before it, in order of file name and start byte, are
    added from a table of one row per split. That table is broadcast: the driver holds the same rows when it plans
    the scan. The lines themselves are not shuffled.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                       F.col("_metadata.file_block_start").alias("_start"))
    lines = raw.withColumn("_id", F.monotonically_increasing_id())
    splits = lines.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    splits = _offsets(splits, ["_file", "_start"], "_n").drop("_n")
    return lines.join(F.broadcast(splits), ["_file", "_start"]).select(
        "value", (F.col("_off") + F.col("_id") - F.col("_first")).cast("long").alias(col))


def number_by(df: DataFrame, order: str, col: str, block: int = BLOCK) -> DataFrame:
    """W1 over an integer order column: a dense 0-based number in ``order``.

    Blocks of ``block`` consecutive order values are numbered in parallel; the rows of the blocks before come from
    a table of one row per block. Rows whose ``order`` is null take no part.
    """
    d = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)).cast("long"))
    offs = _offsets(d.groupBy("_blk").agg(F.count(F.lit(1)).alias("_n")), ["_blk"], "_n").drop("_n")
    pos = F.row_number().over(Window.partitionBy("_blk").orderBy(order))
    return (d.withColumn("_pos", pos).join(offs, "_blk")
             .withColumn(col, (F.col("_off") + F.col("_pos") - 1).cast("long")).drop("_blk", "_pos", "_off"))


def sorted_runs(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` in ranges of ``order``, with ``_run`` (number of the range, ascending with the order) and ``_at``
    (ascending in the range by steps of one).

    The input is evaluated once: it is written first, since Spark reads a range sort's input twice, to sample its keys
    and to deal it out. The ranges are written and read again, which freezes both columns. A range is one task's share whatever a key's weight: the place of a row in the input is the last sort key,
    so equal keys spread over ranges. Consumers combine ranges by tables of one row per range (and group).
    """
    keys = [*order, F.col("_tie")]
    once = write_table(df.withColumn("_tie", F.monotonically_increasing_id()), "unsorted")
    runs = once.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return write_table(runs.drop("_tie").withColumn("_run", F.spark_partition_id())
                       .withColumn("_at", F.monotonically_increasing_id()), "runs")


def running_sums(df: DataFrame, key: str, sums: dict[str, str], partition: list[str] | None = None) -> DataFrame:
    """Sums of columns (``new name -> column``) over the rows of greater or equal ``key``, per partition.

    Balanced ranges of (partition, key) are summed up in parallel; the sums of a partition's ranges before come from a
    table of one row per range, so no task sees more than a range of the rows. ``key`` is unique within a partition.
    """
    part = list(partition or [])
    d = sorted_runs(df, *[F.col(c) for c in part], F.col(key).desc())
    per = d.groupBy(*part, "_run").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    above = Window.partitionBy(*part).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*part, "_run", *[F.coalesce(F.sum(f"_s_{n}").over(above), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*part, "_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    d = join_groups(d.select("*", *[F.sum(c).over(inside).alias(f"_i_{n}") for n, c in sums.items()]), per, part, ["_run"])
    return d.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def previous_row(df: DataFrame, value: Column, order: list[Column], out: str, partition: list[str] | None = None) -> DataFrame:
    """``df`` plus ``out``: ``value`` of the row before, in ``order`` within its partition (null for the first).

    Within a balanced range by ``lag``; a range's first row takes the last one of the partition's range before, from a
    table of one row per range.
    """
    part = list(partition or [])
    d = sorted_runs(df, *[F.col(c) for c in part], *order).withColumn("_v", value)
    last = d.groupBy(*part, "_run").agg(F.max_by("_v", "_at").alias("_last"))
    carry = last.select(*part, "_run", F.lag("_last").over(Window.partitionBy(*part).orderBy("_run")).alias("_carry"))
    here = Window.partitionBy(*part, "_run").orderBy("_at")
    d = d.withColumn("_prev", F.lag("_v").over(here)).withColumn("_first", F.row_number().over(here) == 1)
    d = join_groups(d, carry, part, ["_run"])
    return d.select(*df.columns, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")).alias(out))


def number_sorted(df: DataFrame, order: str | list[str], col: str) -> DataFrame:
    """W1 over any sortable columns (e.g. words): a dense 0-based number in their order, nulls first, ties in any order.

    Balanced ranges (:func:`sorted_runs`) are offset by the rows of the ranges before them, from a broadcast table of
    one row per range. No window sees a row of the data.
    """
    d = sorted_runs(df, *[F.col(c) for c in ([order] if isinstance(order, str) else order)])
    per = d.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    offs = _offsets(per, ["_run"], "_n").drop("_n")
    return d.join(F.broadcast(offs), "_run").select(*df.columns, (F.col("_off") + F.col("_at") - F.col("_first")).cast("long").alias(col))


def forward_fill(df: DataFrame, order: str, value: str, out: str, block: int = BLOCK,
                 partition: list[str] | None = None) -> DataFrame:
    """Carry the last non-NULL ``value`` (in ``order``) forward onto every row, as ``out``.

    Two levels instead of one global window: rows are cut into blocks of ``block`` consecutive
    order values; each block fills itself in parallel, and the value that enters each block comes
    from a running max over the per-block last values -- a table of (#rows / block) rows, joined on
    the key by which the blocks are partitioned already.
    """
    part = list(partition or [])
    b = F.floor(F.col(order) / F.lit(block)).cast("long")
    d = df.withColumn("_blk", b)
    w_in = Window.partitionBy(*part, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_local", F.last(F.col(value), ignorenulls=True).over(w_in))
    # one row per block: its last non-NULL value (NULL when it has none)
    per_blk = d.groupBy(*part, "_blk").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias("_v"))
    # the value entering each block: last non-NULL over the earlier blocks (#blocks rows per key)
    w_blk = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    entering = per_blk.select(*part, "_blk", F.last("_v", ignorenulls=True).over(w_blk).alias("_carry"))
    res = d.join(entering, [*part, "_blk"], "left").withColumn(out, F.coalesce(F.col("_local"), F.col("_carry")))
    return res.drop("_blk", "_local", "_carry")


def next_order(df: DataFrame, key: str, order: str, out: str, block: int = 4096) -> DataFrame:
    """The ``order`` value of the next row of the same ``key`` (NULL for the last row), gaps allowed.

    Within blocks of ``block`` order values by ``lead``; the last row of a block takes the first value of the next
    block that has rows, from a table of one row per (key, block). A key that holds a third of all rows is many
    blocks, so no task gets it whole.
    """
    d = df.select(key, order).withColumn("_blk", F.floor(F.col(order) / F.lit(block)).cast("long"))
    inner = F.lead(order).over(Window.partitionBy(key, "_blk").orderBy(order))
    first = d.groupBy(key, "_blk").agg(F.min(order).alias("_first"))
    after = first.select(key, "_blk", F.lead("_first").over(Window.partitionBy(key).orderBy("_blk")).alias("_after"))
    return d.withColumn("_next", inner).join(after, [key, "_blk"]).select(
        key, order, F.coalesce("_next", "_after").alias(out))
