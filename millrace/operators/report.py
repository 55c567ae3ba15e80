"""Compression reports: sizes of encoded payloads by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compression_report(df: DataFrame, payload: Column, encoded: Column, *by: str, sets: str = "groupBy") -> DataFrame:
    """``(by..., n_rows, raw_bytes, encoded_bytes, ratio)``; ``sets`` may be ``groupBy``, ``rollup`` or ``cube``.

    Payloads shrink to two lengths before the shuffle; sums are combined on the map side, so a hot group is no burden.
    """
    sized = df.select(*by, F.octet_length(payload).cast("long").alias("raw"), F.octet_length(encoded).cast("long").alias("enc"))
    out = getattr(sized, sets)(*by).agg(F.count("*").alias("n_rows"), F.sum("raw").alias("raw_bytes"), F.sum("enc").alias("encoded_bytes"))
    return out.withColumn("ratio", F.col("encoded_bytes") / F.col("raw_bytes"))
