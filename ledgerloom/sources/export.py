"""Typed JSON rows, CSV, a default limit, and a row cap that raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DecimalType, StructField, TimestampType


#: Rows of a result where nothing else is asked for. Fixed value.
DEFAULT_ROWS = 10_000
#: Rows that one task counts by itself; a power of two.
STRETCH = 1 << 17


def shown(f: StructField) -> Column:
    """Bytes as `0x` hex, decimals as text, timestamps as RFC 3339 in UTC, all else as it is."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, BinaryType):
        return F.concat(F.lit("0x"), F.lower(F.hex(c)))
    if isinstance(f.dataType, DecimalType):
        return c.cast("string")
    if isinstance(f.dataType, TimestampType):
        return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return c


def export_json(df: DataFrame) -> DataFrame:
    """One JSON object per row in a column `json`; nulls are written."""
    return df.select(F.to_json(F.struct(*[shown(f).alias(f.name) for f in df.schema.fields]), {"ignoreNullFields": "false"}).alias("json"))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quoted where needed; null is NULL."""
    df.select(*[shown(f).alias(f.name) for f in df.schema.fields]).write.option("header", "true").option("nullValue", "NULL").option("escape", '"').csv(path)


def limited(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The first rows of a result that asks for no number itself: DEFAULT_ROWS, or fewer if so asked for, never more."""
    return df.limit(DEFAULT_ROWS if rows is None else min(rows, DEFAULT_ROWS))


def row_cap(df: DataFrame, cap: int = DEFAULT_ROWS) -> DataFrame:
    """df, as long as it has no more than `cap` rows; reading one with more is an error that says so. The test is part of
    the plan, so the source is read once, and of no partition more than cap + 1 rows.

    Up to a cap of STRETCH, rows pass through one task in their order, and none is held. Above, they stay dealt: the rows of
    each stretch are counted by themselves, and the sizes, on the first row of each, are added up in one place. Rows are in
    no order then."""
    refused = F.raise_error(F.lit(f"the result has more than {cap} rows")).cast("boolean")
    fits = lambda n: F.when(n > cap, refused).otherwise(F.lit(True))
    if cap <= STRETCH:
        return df.limit(cap + 1).coalesce(1).withColumn("__n", F.monotonically_increasing_id()).where(fits(F.col("__n") + 1)).drop("__n")
    in_task = F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))
    stretch, first = F.shiftright("__n", STRETCH.bit_length() - 1), in_task % STRETCH == 0
    counted = df.withColumn("__n", F.monotonically_increasing_id()).where(fits(in_task + 1)).withColumns({"__s": stretch, "__first": first})
    sized = counted.withColumn("__size", F.count("*").over(Window.partitionBy("__s")))
    sizes = Window.partitionBy(F.when(F.col("__first"), F.lit(-1)).otherwise(F.col("__s")))
    total = sized.withColumn("__total", F.sum(F.when(F.col("__first"), F.col("__size"))).over(sizes))
    return total.where(fits(F.col("__total"))).select(*[F.col(f"`{c}`") for c in df.columns])
