"""Join helpers: broadcast only behind a proven size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Above these limits a configuration-derived side is shuffled instead.
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 256 << 20


def bounded_broadcast(df: DataFrame, row_bound: int, row_bytes: int = 256,
                      max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` when its size is provably small.

    ``row_bound`` is an upper bound the caller derives from configuration
    (roles x boards x cells x cap, ...) and never from the data itself;
    ``row_bytes`` bounds the width of one row. Beyond either limit the join
    falls back to the strategy AQE chooses from run-time sizes.
    """
    small = row_bound <= max_rows and row_bound * row_bytes <= max_bytes
    return F.broadcast(df) if small else df


def first_per_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """Rows that come first in ``order_cols`` within each ``keys`` group.

    The order columns must identify a row within its group. Written as a
    partial aggregation (map-side combine) plus a semi join on the winners, so
    a hot key is reduced before the shuffle instead of being sorted in one task.
    """
    winner = F.min(F.struct(*order_cols)).alias("_w")
    winners = df.groupBy(*keys).agg(winner).select(*keys, *[F.col(f"_w.{c}").alias(c) for c in order_cols])
    return df.join(winners, on=keys + order_cols, how="left_semi")


def rows_of_min(df: DataFrame, keys: list[str], value_col: str) -> DataFrame:
    """All rows whose ``value_col`` equals the group minimum (rank() = 1),
    via partial aggregation and a semi join."""
    mins = df.groupBy(*keys).agg(F.min(value_col).alias(value_col))
    return df.join(mins, on=keys + [value_col], how="left_semi")


def _sql_literal(v, dtype) -> str:
    if v is None:
        return f"CAST(NULL AS {dtype.simpleString()})"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return f"CAST({v!r} AS {dtype.simpleString()})"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline_table(spark: SparkSession, schema: T.StructType, rows: list[tuple]) -> DataFrame:
    """A small configuration table as a SQL VALUES relation: planned as a
    JVM-local relation, with no Python round trip at execution time."""
    names = ", ".join(f.name for f in schema.fields)
    if not rows:
        return spark.createDataFrame([], schema)
    values = ", ".join("(" + ", ".join(_sql_literal(v, f.dataType) for v, f in zip(r, schema.fields)) + ")"
                       for r in rows)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
