"""Greedy packing folds: a context budget that degrades and skips, and bins that never split an item."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Token budgets of a review's context and of one call's diff.
CONTEXT_TOKENS, CALL_TOKENS = 25_000, 6_000


def ordered_fold(rows: DataFrame, group: list[str], order: list, numbers: list[Column], start, step: Callable, name: str, kind: str) -> DataFrame:
    """rows with a column that a fold over each group in order gives: step(state, *numbers) -> (state, value).

    Groups are sorted within partitions and folded as their rows pass, so a group needn't fit in memory; a fold is
    sequential, so one group is one task's work. Null numbers count as 0.
    """
    given = [f"__x{i}" for i in range(len(numbers))]
    wide = rows.withColumns({g: F.coalesce(n.cast("long"), F.lit(0)) for g, n in zip(given, numbers, strict=True)})
    spread = (wide.repartition(*group) if group else wide.repartition(1)).sortWithinPartitions(*group, *order)
    own, keys, values = len(rows.columns), [rows.columns.index(c) for c in group], range(len(rows.columns), len(wide.columns))
    fields = [*rows.schema.fields, StructField(name, StringType() if kind == "string" else IntegerType())]

    def run(batches):
        key, state = None, start
        for b in batches:
            made = []
            names = zip(*(b.column(i).to_pylist() for i in keys), strict=True) if keys else [()] * b.num_rows
            for k, v in zip(names, zip(*(b.column(i).to_pylist() for i in values), strict=True), strict=True):
                if k != key:
                    key, state = k, start
                state, value = step(state, *v)
                made.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns[:own], pa.array(made, pa.string() if kind == "string" else pa.int32())], names=[f.name for f in fields])

    return spread.mapInArrow(run, StructType(fields))


def pack(blocks: DataFrame, group: list[str], order: list[str], size: str, short: str, must: str, budget: int) -> DataFrame:
    """blocks with kept ('whole', 'short' or 'dropped'), by a greedy fold in order over each group.

    A row that must be kept or still fits stays whole and uses its size, even past the budget; else its short form is
    tried; else it is dropped. Later, smaller rows may still fit. Rows that must be kept come first, then by order.
    """

    def step(used, whole, brief, needed):
        if needed or used + whole <= budget:
            return used + whole, "whole"
        return (used + brief, "short") if used + brief <= budget else (used, "dropped")

    return ordered_fold(blocks, group, [F.desc(must), *order], [F.col(size), F.col(short), F.col(must)], 0, step, "kept", "string")


def bins(items: DataFrame, group: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """items with bin, from 0: a new bin opens when a bin that isn't empty would exceed most; large items stand alone."""

    def step(state, x):
        used, at = state
        used, at = (x, at + 1) if used > 0 and used + x > most else (used + x, at)
        return (used, at), at

    return ordered_fold(items, group, order, [F.col(size)], (0, 0), step, "bin", "int")


def added_up(cost: Column) -> Column:
    """Sum of costs; null as soon as one is null, or without rows."""
    return F.when(F.bool_and(cost.isNotNull()), F.sum(cost))
