"""What has been converted already: skipping inputs whose manifest entry still holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, key: str, columns: list[str], settings: str = "") -> DataFrame:
    """(key, fingerprint): a hash over the given columns and settings; nulls count as empty."""
    return df.select(F.col(key), F.sha2(F.concat_ws("\u0001", F.lit(settings), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"), 256).alias("fingerprint"))


def classify(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added, changed, deleted or same, by fingerprint."""
    b, a = before.select(key, F.col("fingerprint").alias("b")), after.select(key, F.col("fingerprint").alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return b.join(a, key, "full").select(key, change.alias("change"))


def pending(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The keys that have to be converted again."""
    return after.join(before, [key, "fingerprint"], "left_anti").select(key)
