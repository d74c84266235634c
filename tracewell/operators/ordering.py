"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.expr import BIGINT_MAX, int_div

MICROS = 1_000_000


def number_rows(df: DataFrame, group: Sequence[str], ts: str, tie: str, name: str, slice_seconds: int = 60) -> DataFrame:
    """``row_number`` per group in ``(ts, tie)`` order, rows without a time last, without gathering a group in one task.

    A plain window would sort a whole group, however large, in a single task.
    Here each group is cut into time slices: rows are numbered inside a slice,
    and a slice starts after the rows counted in the earlier ones. Only the
    counts, at most one per slice of the group's time span, meet in one place.
    """
    # NULL groups count as groups. Their keys are plain columns, so that the rows
    # are shuffled once, for the window and the join alike.
    names = [f"_group{i}" for i in range(len(group))]
    keyed = df.withColumns({
        **{n: F.coalesce(F.col(c).cast("string"), F.lit("")) for n, c in zip(names, group)},
        "_nulls": F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in group]),
        # rows without a time are a slice of their own, after all others
        "_slice": F.coalesce(time_slice(F.col(ts), slice_seconds * MICROS), F.lit(BIGINT_MAX)),
    })
    owner = [*names, "_nulls"]
    keys = [*owner, "_slice"]
    before = F.sum("_n").over(Window.partitionBy(*owner).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(ts, tie))
    return keyed.withColumn("_inside", inside).join(offsets, keys) \
        .select(*df.columns, (F.col("_inside") + F.col("_before")).alias(name))


def time_slice(ts: Column, width_micros: int) -> Column:
    """Number of the fixed-width time slice that holds ``ts``."""
    micros = F.unix_micros(ts)
    return int_div(micros - F.pmod(micros, F.lit(width_micros)), width_micros)
