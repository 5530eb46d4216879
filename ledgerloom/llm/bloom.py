"""Two-pass Bloom filtering with built-in functions: which hashes may occur more than once.

Pass one counts, for every hash, two cells of a table of `bits` cells each and keeps the cells met at least
twice: only 8-byte cell numbers shuffle, combined before the shuffle. Kept cells become 4 KiB bitmaps, of
at most 2 * bits / 8 bytes in all. Pass two tests rows against the bitmaps. A hash that occurs twice always
passes; one that occurs once passes with a probability of about (rows / bits) ** 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import working_name

#: Bits of one bitmap of bitmap_construct_agg.
BITMAP_BITS = 32768


def table_bits(rows: int, per_row: int = 8) -> int:
    """Cells of each table: a power of two, at least per_row for each row."""
    return max(BITMAP_BITS, 1 << max(0, rows * per_row - 1).bit_length())


def cells(key: Column, bits: int) -> list[Column]:
    """The two cells of a key, numbered so that the tables do not overlap."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) + F.lit(i * bits) for i in (0, 1)]


def met_cells(keys: DataFrame, key: Column, bits: int, least: int) -> DataFrame:
    """Cells that at least `least` rows of keys fall in: one long column, cell."""
    each = keys.select(F.explode(F.array(*cells(key, bits))).alias("cell"))
    return each.groupBy("cell").count().where(F.col("count") >= least).select("cell")


def flagged(df: DataFrame, keys: DataFrame, key: Column, rows: int, flag: str, max_bytes: int = 64 << 20, least: int = 2) -> DataFrame:
    """df with a boolean column flag: whether the row's key may occur at least `least` times among keys.

    key must resolve in df and in keys. The bitmaps are broadcast while their bound, 2 * bits / 8 bytes, is at
    most max_bytes. Beyond it the kept cells stay a distributed table, which meets the rows' cell numbers by a
    shuffled join, so that nothing that grows without bound is broadcast.
    """
    bits = table_bits(rows)
    hot = met_cells(keys, key, bits, least)
    out, tests = df, []
    own = working_name(df, "own")
    of = lambda stem, i: working_name(df, f"{stem}{i}")
    if bits // 4 <= max_bytes:
        maps = hot.groupBy((F.col("cell") / F.lit(BITMAP_BITS)).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("cell", F.lit(BITMAP_BITS))).alias("bits"))
        for i, cell in enumerate(cells(key, bits)):
            at, bucket, bitmap = of("cell", i), of("bucket", i), of("bits", i)
            side = maps.select(F.col("bucket").alias(bucket), F.col("bits").alias(bitmap))
            out = out.withColumn(at, cell).join(F.broadcast(side), F.floor(F.col(at) / F.lit(BITMAP_BITS)) == F.col(bucket), "left")
            byte = F.expr(f"substring({bitmap}, cast(pmod({at}, {BITMAP_BITS}) div 8 + 1 as int), 1)")
            tests.append(F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False)))
    else:
        for i, cell in enumerate(cells(key, bits)):
            at, met = of("cell", i), of("hot", i)
            out = out.withColumn(at, cell).join(hot.select(F.col("cell").alias(met)), F.col(at) == F.col(met), "left")
            tests.append(F.col(met).isNotNull())
    return out.withColumn(own, tests[0] & tests[1]).select(*[F.col(f"`{c}`") for c in df.columns], F.col(own).alias(flag))


def with_ids(df: DataFrame, ids: DataFrame, id_col: str, count: int) -> DataFrame:
    """Rows of df whose id is in ids (one column, id_col, distinct): only rows that pass the filter shuffle."""
    seen = working_name(df, "seen")
    return flagged(df, ids, F.col(id_col), count, seen, least=1).where(F.col(seen)).drop(seen).join(ids, id_col, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, id_col: str, count: int) -> DataFrame:
    """Rows of df whose id is not in ids: rows that fail the filter pass straight through."""
    name = working_name(df, "seen")
    seen = flagged(df, ids, F.col(id_col), count, name, least=1)
    return seen.where(~F.col(name)).drop(name).unionByName(seen.where(F.col(name)).drop(name).join(ids, id_col, "left_anti").select(*df.columns))
