"""What several operators share: cutting lineage, joins by checked size, and working columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.scratch import discard, materialize, new_path, shared_dir

__all__ = ["BROADCAST_ROWS", "NO_ID", "ascii_lower", "discard", "materialize", "new_path", "partitions_for", "row_keys", "same_row", "shared_dir", "small", "table"]

#: Largest side, in rows, that an operator broadcasts; a side of more rows is joined by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if ``rows``, its counted size, is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """So many partitions that each has about ``per_partition`` rows, and at least the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


#: Stands for a null doc_id in __id.
NO_ID = -(1 << 63)


def row_keys(*cols: str) -> list[Column]:
    """Columns __id and __row that tell rows apart by doc_id, null included, and by a hash of ``cols``: rows that agree
    in them are the same to an operator that reads nothing else, so a verdict joins back to just those."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"), F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols], *[F.col(c).isNull() for c in cols]).alias("__row")]


same_row = ["__id", "__row"]
