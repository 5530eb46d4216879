"""Rows numbered in a total order across partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import working_name, written

#: monotonically_increasing_id keeps the partition above these bits, and the row in it below.
_ROW_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a column name: 0, 1, 2 ... in the order given, written to the shared folder.

    One shuffle by ranges of the order, so that a task has about as many rows as any other where the order's columns
    differ. The driver gets a row count for each partition, never a row. Rows that the order leaves equal get any of
    their numbers.
    """
    at, part, base = (working_name(df, x) for x in ("at", "part", "base"))
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    out = written(laid, "numbered").withColumn(part, F.shiftright(at, _ROW_BITS))
    bases, total = [], 0
    for p, n in sorted(tuple(r) for r in out.groupBy(part).count().collect()):
        bases.append((p, total))
        total += n
    sides = df.sparkSession.createDataFrame(bases, f"{part} long, {base} long")
    place = F.col(base) + F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return out.join(F.broadcast(sides), part).select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name))
